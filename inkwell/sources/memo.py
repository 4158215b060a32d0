"""A memo of a costly function of text, addressed by content and shared by runs."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources import store

_RUN = "run"
_BUCKET = "bucket"


class Memo:
    """Values of ``function`` (a Series of texts to a Series of values of type ``kind``) kept under ``path``.

    An entry's key is the SHA-256 of the function's ``name``, its ``options`` and the text; entries are
    dealt to ``buckets`` folders by their key. Each run writes a folder of its own, which counts once
    it is whole, so runs at the same time don't disturb each other, and one that dies leaves nothing.
    Of a key that several runs have computed the entry of the first run is read, always. Reading
    is bound to the buckets that hold a wanted key.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, function: Callable[[pd.Series], pd.Series], kind: str, options: dict | None = None, buckets: int = 64):
        self.spark, self.path, self.function, self.kind, self.buckets = spark, path.rstrip("/"), function, kind, buckets
        self.salt = f"{name}\0{json.dumps(options or {}, sort_keys=True)}"
        self.schema = f"key string, value {kind}, {_RUN} string, {_BUCKET} int"

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def runs(self) -> list[str]:
        """The runs that are whole, first to last."""
        fs = self._fs()
        if not fs.exists(self._at()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._at()) if s.isDirectory()]
        return sorted(n for n in names if n.startswith(f"{_RUN}=") and fs.exists(self._at(n, "_SUCCESS")))

    def key(self, text: Column) -> Column:
        return F.sha2(F.concat(F.lit(self.salt + "\0"), text), 256)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(self.buckets)).cast("int")

    def entries(self, among: list[int] | None = None) -> DataFrame:
        """``key``, ``value``, ``bucket``: one a key, of the buckets ``among`` or of all."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], self.schema).drop(_RUN)
        rows = self.spark.read.option("basePath", self.path).schema(self.schema).parquet(*[f"{self.path}/{r}" for r in runs])
        if among is not None:
            rows = rows.where(F.col(_BUCKET).isin(among))
        if len(runs) == 1:
            return rows.drop(_RUN)
        first = rows.groupBy("key", _BUCKET).agg(F.min_by(F.struct("value"), _RUN).alias("e"))
        return first.select("key", "e.value", _BUCKET)

    def _write(self, rows: DataFrame, run: str) -> None:
        rows.repartition(F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(f"{self.path}/{_RUN}={run}")

    def apply(self, rows: DataFrame, text_col: str, out_col: str) -> tuple[DataFrame, int]:
        """``rows`` with ``out_col``, and how many distinct texts the function was called on.

        Null texts have no value and no entry. The function sees each text that no run holds once,
        in the batches of Arrow; its values are written before they are used.
        """
        conf = self.spark.conf
        if conf.get("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true") == "false":
            raise ValueError("a memo tells whole runs by their success marks")
        keyed = store.text_batches(rows).withColumn("_key", self.key(F.col(text_col)))
        texts = keyed.where(F.col(text_col).isNotNull()).select(F.col("_key").alias("key"), F.col(text_col).alias("text"))
        wanted = texts.select("key").distinct().withColumn(_BUCKET, self.bucket(F.col("key")))  # keys alone are shuffled and written
        wanted = store.materialise(wanted)
        asked = [r[_BUCKET] for r in wanted.select(_BUCKET).distinct().collect()]  # at most as many as buckets
        missing = wanted
        if self.runs():
            missing = store.materialise(wanted.join(self.entries(asked).select("key"), "key", "left_anti"))
            texts = texts.join(store.small(missing.select("key")), "key", "left_semi")
        calls = missing.count()
        if calls:
            function = F.pandas_udf(self.function, self.kind)
            once = texts.dropDuplicates(["key"]).select("key", function("text").alias("value"), self.bucket(F.col("key")).alias(_BUCKET))
            self._write(once, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")
        known = self.entries(asked).join(wanted.select("key"), "key", "left_semi").select(F.col("key").alias("_key"), F.col("value").alias(out_col))
        return keyed.join(known, "_key", "left").drop("_key"), calls

    def compact(self) -> int:
        """All runs as one, an entry a key; returns the number of runs before.

        The one is written under the name of the first run's successor before the others go, so a
        reader finds every key at any time. No run may be writing.
        """
        runs = self.runs()
        if len(runs) > 1:
            self._write(self.entries(), f"{runs[0].removeprefix(_RUN + '=')}-all")
            for r in runs:
                self._fs().delete(self._at(r), True)
        return len(runs)
