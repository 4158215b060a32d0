"""Decontamination: documents that share n-grams with reference texts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.grams import word_run_hashes
from inkwell.sources import store

K_WORDS = 13
MIN_SHARED = 2
#: A reference of at most so many distinct n-grams (64-bit hashes, some 20 MB) is broadcast.
BROADCAST_GRAMS = 2_000_000


def grams(text: Column, k: int = K_WORDS) -> Column:
    """Hashes of the lower-cased word k-grams; a shorter text is one gram, a text without words none."""
    return word_run_hashes(text, k)


def reference(texts: DataFrame, text_col: str = "text", k: int = K_WORDS) -> DataFrame:
    """The distinct gram hashes of the reference texts."""
    texts = store.text_batches(store.spread(texts.select(text_col)))
    return texts.select(F.explode(grams(F.col(text_col), k)).alias("gram")).distinct()


def overlap(docs: DataFrame, ref: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K_WORDS, ref_rows: int | None = None) -> DataFrame:
    """``id_col`` and ``n_shared``, the number of distinct grams shared, of documents with any.

    Only matching grams are shuffled when the reference is broadcast, which its counted size
    decides; a larger one joins by gram, which adaptive execution splits where a gram is hot.
    """
    if ref_rows is None:
        ref = store.materialise(ref)  # counted and read, but made once
        ref_rows = ref.count()
    ref = F.broadcast(ref) if ref_rows <= BROADCAST_GRAMS else ref
    docs = store.text_batches(store.spread(docs.select(id_col, text_col)))
    exploded = docs.select(id_col, F.explode(grams(F.col(text_col), k)).alias("gram"))
    return exploded.join(ref, "gram", "left_semi").groupBy(id_col).agg(F.count("*").alias("n_shared"))


def split_contaminated(docs: DataFrame, ref: DataFrame, id_col: str = "doc_id", text_col: str = "text", language: Column | None = None, k: int = K_WORDS, min_shared: int = MIN_SHARED) -> tuple[DataFrame, DataFrame]:
    """(clean, dropped): documents with ``min_shared`` grams or more in the reference are dropped;
    those outside ``language`` (a condition) pass."""
    scope = docs if language is None else docs.where(language)
    hits = overlap(scope, ref, id_col, text_col, k).where(F.col("n_shared") >= min_shared)
    clean = docs.join(hits, id_col, "left_anti")
    dropped = docs.join(hits, id_col).withColumn("drop_reason", F.lit("contaminated"))
    return clean, dropped


class GramIndex:
    """The grams of several reference corpora, kept under ``path`` and joined where they lie.

    Each corpus is a partition of a table that is bucketed and sorted by gram, so a join shuffles the
    documents' grams to the buckets and leaves the reference in place. Adding a corpus reads that
    corpus alone and replaces what it had before; a new session attaches the files as they are.
    """

    def __init__(self, spark: SparkSession, path: str, k: int = K_WORDS, buckets: int = 64):
        self.spark, self.path, self.k = spark, path.rstrip("/"), k
        self.name = f"gram_index_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (gram BIGINT, corpus STRING) USING parquet PARTITIONED BY (corpus) "
            f"CLUSTERED BY (gram) SORTED BY (gram) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            spark.sql(f"MSCK REPAIR TABLE {self.name}")  # the corpora that other sessions have added
        self.buckets = buckets

    def corpora(self) -> list[str]:
        return sorted(r[0].partition("=")[2] for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())

    def add(self, corpus: str, texts: DataFrame, text_col: str = "text") -> None:
        """The distinct grams of ``texts`` as ``corpus``. One task a bucket writes one file; nulls give none."""
        found = reference(texts, text_col, self.k).repartition(self.buckets, "gram")
        found.createOrReplaceTempView(f"{self.name}_new")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (corpus = '{corpus}') SELECT gram FROM {self.name}_new")
        self.spark.catalog.dropTempView(f"{self.name}_new")

    def grams(self, corpora: list[str] | None = None) -> DataFrame:
        rows = self.spark.table(self.name)
        return (rows if corpora is None else rows.where(F.col("corpus").isin(corpora))).select("gram")

    def overlap(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", corpora: list[str] | None = None) -> DataFrame:
        """``id_col`` and ``n_shared``, the distinct grams that a document shares with the union of the corpora."""
        docs = store.text_batches(store.spread(docs.select(id_col, text_col)))
        exploded = docs.select(id_col, F.explode(grams(F.col(text_col), self.k)).alias("gram"))
        return exploded.join(self.grams(corpora), "gram", "left_semi").groupBy(id_col).agg(F.count("*").alias("n_shared"))
