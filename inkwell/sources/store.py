"""Frames written to the shared folder and read again."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``: a temporary one where that is unset and all runs
    in one process; a cluster without a shared folder is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: executors need a folder that all of them and the driver share")
        root = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A frame of at most so many rows may be broadcast; one of ids, and a flag at most, of so many (some 70 bytes each).
BROADCAST_ROWS, BROADCAST_IDS = 200_000, 600_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def narrowed(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` by a semi or anti join with written ``ids``; if these are too many to broadcast, the join is
    written, so that ``rows`` may be read again without another shuffle."""
    kept = rows.join(small(ids, BROADCAST_IDS), key, how)
    return kept if ids.count() <= BROADCAST_IDS else materialise(kept)


def text_batches(df: DataFrame, rows: int = 1000, size: int = 4 << 20) -> DataFrame:
    """``df``, after bounding the batches in which this session hands rows to Python, so that texts and
    arrays of any length take some MB of a worker."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        own = re.fullmatch(r"(-?\d+)b?", conf.get(key))
        if not own or not 0 < int(own[1]) <= most:
            conf.set(key, str(most))
    return df


def spread(df: DataFrame, most: int = 1 << 30) -> DataFrame:
    """``df``, dealt to all cores where it is read from fewer files than there are cores and is small (at
    most ``most`` bytes by Spark's statistics): a file of one row group is one task's otherwise.
    Larger inputs come in enough parts and are left as they are, as are frames that read no files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= most and 0 < len(df.inputFiles()) < cores else df


def ordered_digest(rows: DataFrame, key: str, name: str, value: str | None = None) -> DataFrame:
    """``n`` and the SHA-256 of the keys, or of ``value`` in the order of the keys, joined by newlines.

    Keys are ranged over all tasks, which sort a range each and join its values to blocks, a batch
    each. The digest is one chain, so one task takes the blocks in order: it sorts some bytes a value and
    holds nothing else.
    """
    ordered = rows.select(key, F.col(value or key).alias("_value")).orderBy(key).select("_value")

    def joined(batches):
        part = TaskContext.get().partitionId()  # ranges are numbered in order
        for i, b in enumerate(batches):
            if b.num_rows:
                block = "\n".join(b.column(0).to_pylist()).encode()
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, i, b.num_rows, block)], names=["part", "i", "n", "block"])

    def run(batches):
        digest, n = hashlib.sha256(), 0
        for b in batches:
            for m, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if m:
                    digest.update(b"\n" + block if n else block)
                    n += m
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], names=["n", name])

    blocks = text_batches(ordered).mapInArrow(joined, "part long, i long, n long, block binary")
    none = rows.sparkSession.range(1).selectExpr("-1L AS part", "0L AS i", "0L AS n", "binary('') AS block")  # no rows have a digest too
    return blocks.unionByName(none).repartition(1).sortWithinPartitions("part", "i").select("n", "block").mapInArrow(run, f"n long, {name} string")
