"""Packing by power-of-two decomposition: every sequence is a piece of one document.

A document of n ids is cut into pieces whose lengths are powers of two, the longest first, as the
binary digits of n say. Pieces of one length form a bucket; each is a sequence of its own, so none
crosses documents and none needs padding. Batches are drawn from one bucket at a time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import tokens
from inkwell.llm.common import materialise, small, text_batches

LONGEST = 2048
_encoders: dict = {}


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """``n`` as the fewest powers of two of at most ``longest``, in descending order."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def decompose(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Tokenize every whole text, append ``end_id`` and cut into pieces of binary lengths.

    Columns ``doc_id``, ``start`` (the document's ids before the piece), ``length``, ``ids_crc32`` (of
    its little-endian unsigned 32-bit ids), ``doc_tokens`` and, if asked for, ``ids``. Null and empty
    texts are the end id alone. Repeated rows and null ids are documents of their own; other
    columns are not read; an empty table gives no piece. ``longest`` must be a power of two. A
    narrow map.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError(f"longest is {longest}, not a power of two")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names, kinds = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"], [pa.int64()] * 5
    if with_ids:
        names, kinds = [*names, "ids"], [*kinds, pa.list_(pa.int64())]

    def run(batches):
        if path not in _encoders:  # Python workers serve many tasks
            _encoders[path] = tokens.make_id_encoder(path)
        encode, end = _encoders[path], end_id.to_bytes(4, "little")
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data, start = encode(text) + end, 0
                for length in binary_lengths(n := len(data) // 4, longest):
                    part = data[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(part), n) + ((np.frombuffer(part, "<u4").astype(np.int64),) if with_ids else ()))
                    start += length
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=names)

    return text_batches(src).mapInArrow(run, ", ".join(f"{n} {'array<long>' if n == 'ids' else 'long'}" for n in names))


def _numbered(pieces: DataFrame) -> DataFrame:
    """Adds ``task``, the partition, and ``turn``, a piece's number from 0 among those of its length there."""
    at = pieces.columns.index("length")
    schema = pieces.withColumn("task", F.lit(0)).withColumn("turn", F.lit(0).cast("long")).schema

    def run(batches):
        task, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            lengths, which, n = np.unique(b.column(at).to_numpy(), return_inverse=True, return_counts=True)
            turn = np.empty(len(which), np.int64)
            turn[np.argsort(which, kind="stable")] = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            turn += np.array([seen.get(x, 0) for x in lengths.tolist()], np.int64)[which]
            for x, k in zip(lengths.tolist(), n.tolist()):
                seen[x] = seen.get(x, 0) + k
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(which), task, np.int32)), pa.array(turn)], names=schema.names)

    return pieces.mapInArrow(run, schema)


def bucketed(pieces: DataFrame) -> DataFrame:
    """Number the pieces of each length: adds ``bucket`` (the length is 2^bucket), ``rank`` (gapless
    from 0 in the bucket), ``sequence_id`` and ``offset`` (always 0).

    Every task numbers its own pieces, and only the counts of tasks and lengths are summed up,
    a dozen rows a task; pieces are neither sorted nor shuffled, and a length that most
    documents share is no one task's. The numbered pieces are written before they are counted:
    ranks stay as they are whichever executor is lost.
    """
    own = pieces.columns
    pieces = materialise(_numbered(pieces), "binary-pieces")
    before = Window.partitionBy("_l").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy(F.col("task").alias("_t"), F.col("length").alias("_l")).agg(F.count("*").alias("_n"))
    base = materialise(counts.select("_t", "_l", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "binary-base")
    placed = pieces.join(small(base), (F.col("task") == F.col("_t")) & (F.col("length") == F.col("_l")))
    bucket, rank = F.round(F.log2(F.col("length").cast("double"))).cast("int"), F.col("_base") + F.col("turn")
    return placed.select(*own, (rank * 64 + bucket).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), bucket.alias("bucket"), rank.alias("rank"))


def batched(placed: DataFrame, batch_tokens: int) -> DataFrame:
    """Adds ``batch``: within a bucket, batches of ``batch_tokens`` ids (one sequence at least), so
    all sequences of a batch have one length. A narrow map over ``bucketed``."""
    per = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("length"))).cast("long")
    return placed.withColumn("batch", F.floor(F.col("rank") / per).cast("long"))
