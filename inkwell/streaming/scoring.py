"""Resumable scoring: each micro-batch's scores are appended once, keyed by row id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resumable_scores(spark: SparkSession, source: str, schema, score, out: str, checkpoint: str, id_col: str = "doc_id", files_per_batch: int = 1) -> DataFrame:
    """Score the Parquet files of ``source`` that no earlier run scored; returns all scores.

    ``source`` is a folder or, as a pattern, a file. ``score`` maps a frame to (``id_col``, ``score``). The stream stops when all files are read;
    a rerun goes on from its checkpoint. A batch that is replayed after a failure writes the same
    folder again, so no row is scored twice. Scores that are null or not finite fail the batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        scored = score(batch)
        bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
        scored = scored.withColumn("score", F.when(bad, F.raise_error(F.lit("score is not finite"))).otherwise(F.col("score")))
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")
