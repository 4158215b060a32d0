"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to
the shared folder and gives what it reads again to the next. All but the last return the columns
of ``documents``; columns beyond them pass through. Each stage's docstring says what nulls,
empty texts, ties, repeated rows and empty tables give.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import langid, lines, mixing, packing, simhash
from inkwell.llm.common import materialise, release, word_count, written
from inkwell.llm.queries import vocabulary


def _carried(docs: DataFrame, *own: str) -> DataFrame:
    """``own`` columns, and all others in the struct ``row``, so that none can clash with what a stage makes."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*(rest or [F.lit(None).alias("none")])).alias("row"))


def _restored(out: DataFrame, names: list[str], *own: str) -> DataFrame:
    return out.select(*[F.col(c) if c in own else F.col("row").getField(c).alias(c) for c in names])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; ``lang`` stays as it was given.

    Null, empty and letterless texts go; rows with a null id or lang are judged like others but
    don't teach; repeated rows share their verdict; an empty table stays empty.
    """
    own = ("doc_id", "text", "lang")
    found = langid.language_id(_carried(docs, *own))
    return _restored(found.where(~F.col("langid.rejected")), docs.columns, *own)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; ``n_chars`` follows.

    A document has no URL, so its source stands for the host; null sources are one site. A text
    of boilerplate alone, a null and an empty one stay as they are, as does ``n_chars`` where no
    line goes; repeated rows are pages of their own.
    """
    own = [c for c in ("doc_id", "text", "source", "n_chars") if c in docs.columns]
    cut = lines.drop_boilerplate(_carried(docs, *own))
    if "n_chars" in own:
        changed = F.col("lines.n_dropped") > 0
        cut = cut.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return _restored(cut, docs.columns, *own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group, the one with the smallest id.

    Rows without an id come last in a group and stay where no other row holds their text; ids that
    repeat with texts of several groups keep one row in each; rows alike in id and text keep one,
    the first by their other columns. Null, empty and blank texts are one group.
    """
    return simhash.drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, each document as often as it is taken (0 to 3 times).

    Null sources are the last source; texts of no words are taken at their source's rate or its
    floor and weigh nothing; repeated rows and null ids are documents of their own.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # so that no column can clash with the mix
    keyed = docs.select(row.alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("same"))
    mixed = mixing.emit(mixing.mix(keyed, F.col("size"), identity=("same",)))
    return mixed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4096 tokens.

    Null and empty texts are their end token alone; repeated rows are pieces of their own.
    """
    return packing.pack(packing.pieces(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express compression, SimHash groups or the packing search; tests/llm/test_pipeline.py
#: holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = written()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, mark, keep=docs)  # what the stage and the ones before it left
    return docs
