"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most this many rows may be broadcast; beyond it, plain joins are used.
BROADCAST_ROWS = 200_000
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and all runs in one process (tests, a laptop), a temporary folder of this
    machine is used and set; a cluster without a shared folder is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: executors need a folder that all of them and the driver share")
        path = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: What a batch of texts on its way to Python and back holds at most.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the batches in which this session hands rows to Python: texts of any
    length then take some MB of a worker and of the executor's memory outside its heap."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        own = re.fullmatch(r"(-?\d+)b?", conf.get(key))  # the session's value or Spark's default
        if not own or not 0 < int(own[1]) <= most:
            conf.set(key, str(most))
    return df


def materialise(df: DataFrame, label: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again; with ``group_rows``, in row groups of so many rows,
    which writers and readers hold whole: for rows of some MB.

    This cuts the lineage (a lost executor loses nothing), stops recomputation where a frame
    is used twice, and leaves a scan with no partitioning, so that later joins shuffle both
    sides and adaptive execution can split their hot keys.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkwell-{label}-{uuid.uuid4().hex}"
    df.write.options(**{"parquet.block.row.count.limit": group_rows} if group_rows else {}).parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def written() -> int:
    """How many folders of ``materialise`` there are; a mark for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete what ``materialise`` wrote in this process after the mark ``since``, but for the
    folder that ``keep`` reads; returns the number of folders.

    Results that still read those folders must have been written before.
    """
    own = getattr(keep, "written_to", None)
    gone = [p for p in _written[since:] if p != own]
    _written[since:] = [p for p in _written[since:] if p == own]
    return sum(_delete(spark, p) for p in gone)


def discard(df: DataFrame) -> None:
    """Delete the folder of a materialised frame that nothing reads any more."""
    path = getattr(df, "written_to", None)
    if path in _written:
        _written.remove(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows (counted), else as it is.

    Call it on a materialised frame: the count then reads only Parquet footers.
    """
    return F.broadcast(df) if df.count() <= limit else df


def unit_hash(seed: int, *cols: Column) -> Column:
    """A double in [0, 1) from the columns' 64-bit hash; the same for the same values."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null.

    Each word, with the white space before it, becomes one character, so no array of the words
    of a long text is built.
    """
    marks = F.rtrim(F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x"), F.lit(" \t\n\x0b\x0c\r"))
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")
