"""Where queries register, and what they derive from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources import store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query function by its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its texts go to Python in bounded batches, whatever a query does with them."""
    return store.text_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: A derived score in [0, 1), the same in both engines.
SCORE = "(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0)"
TYPES = "CASE doc_id % 3 WHEN 0 THEN 'human_written' WHEN 1 THEN 'ai_generated' ELSE 'ai_edited' END"


def duck_mod(m: int, text: str) -> str:
    """SQL for the SHA-256 of ``text`` modulo ``m``."""
    return f"list_reduce(list_transform(range(8), lambda i: CAST('0x' || substr(sha256({text}), (i * 8 + 1)::INT, 8) AS BIGINT)), lambda a, b: (a * {(1 << 32) % m} + b) % {m})"


def score(salt: str = ""):
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def text_type():
    return F.element_at(F.array(F.lit("human_written"), F.lit("ai_generated"), F.lit("ai_edited")), (F.col("doc_id") % 3 + 1).cast("int"))


def docs_of(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def labelled(spark, sf_dir):
    """Labels with a score and the source as domain."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return labels.join(docs_of(spark, sf_dir).select("doc_id", "source", "lang"), "doc_id").withColumn("score", score())


LABELLED = f"SELECT doc_id, quality::INT AS label, source, lang, {SCORE} AS score FROM labels JOIN documents USING (doc_id)"
