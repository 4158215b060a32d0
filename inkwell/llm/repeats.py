"""Passages that documents share, by a sparse suffix array over minimiser positions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import discard, materialise, small, text_batches

MIN_WORDS = 50
PREFIX = 25  # words of a suffix that select minimisers and are compared first
_BLOCK = 1 << 20  # bytes hashed at once
_RUN = 200_000  # rows of one key that are held at once
_KEYS = ("key", "key2")
# odd, so invertible modulo 2**64
_BASE, _WORD_BASE, _OTHER_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b):
        a = np.full(size, b, dtype=np.uint64)
        a[0] = 1
        return np.cumprod(a, dtype=np.uint64)

    return run(base), run(pow(base, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _spans(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes, modulo 2**64 and mixed, of the stretches lo:hi of ``values``."""
    size = 1 << max(12, int(len(values)).bit_length())
    power, inverse = _powers(base, size)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return _mix((total[hi] - total[lo]) * inverse[lo])


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every run of bytes but ASCII white space, in blocks of bounded size."""
    out, at = [], 0
    while at < len(data):
        end = at + _BLOCK
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        b = np.frombuffer(data, dtype=np.uint8, count=min(end, len(data)) - at, offset=at)
        solid = np.zeros(len(b) + 2, dtype=np.int8)
        solid[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
        step = np.diff(solid)
        lo, hi = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(lo):
            out.append(_spans(_byte_values()[b], lo, hi, _BASE) ^ (hi - lo).astype(np.uint64))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    lo = np.arange(len(words) - size + 1)
    return _spans(words, lo, lo + size, _WORD_BASE)


def minimisers(words: np.ndarray, min_words: int = MIN_WORDS, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray]:
    """The position of the retained suffix of each window of ``min_words`` words (the leftmost
    smallest hash of its first words) and the hashes of all those first words."""
    if len(words) < min_words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    heads = _grams(words, prefix)
    windows = np.lib.stride_tricks.sliding_window_view(heads, min_words - prefix + 1)
    return np.arange(len(windows)) + windows.argmin(axis=1), heads


def _suffixes(docs: DataFrame, min_words: int, prefix: int) -> DataFrame:
    """``key`` (hash of the first words), ``doc_id``, ``pos`` of the retained suffixes."""

    def run(batches):
        for b in batches:
            keys, ids, places = [], [], []
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                at, heads = minimisers(word_hashes(data), min_words, prefix)
                at = np.unique(at)
                keys.append(heads[at])
                ids.append(np.full(len(at), doc))
                places.append(at)
            cols = [np.concatenate(x) if x else np.zeros(0) for x in (keys, ids, places)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0].astype(np.uint64).view(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.int32))], names=["key", "doc_id", "pos"]
            )

    return text_batches(docs.select("doc_id", "text")).mapInArrow(run, "key long, doc_id long, pos int")


def _windows(docs: DataFrame, min_words: int, prefix: int) -> DataFrame:
    """The candidates (``text`` and the ``keys`` of suffixes that have an equal neighbour) extended
    left and right: every window of ``min_words`` words around them, as ``key`` and ``key2`` (two
    hashes of 64 bits with bases of their own: equal windows are equal texts, at any size of
    corpus), ``doc_id``, ``pos``."""

    def run(batches):
        for b in batches:
            keys, more, ids, places = [], [], [], []
            for doc, data, near in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2)):
                words = word_hashes(data)
                at, heads = minimisers(words, min_words, prefix)
                if not len(at):
                    continue
                near = near.values.to_numpy().view(np.uint64)
                start = np.flatnonzero(np.isin(heads[at], near))
                keys.append(_spans(words, start, start + min_words, _WORD_BASE))
                more.append(_spans(_mix(words + np.uint64(_OTHER_BASE)), start, start + min_words, _OTHER_BASE))
                ids.append(np.full(len(start), doc))
                places.append(start)
            cols = [np.concatenate(x) if x else np.zeros(0) for x in (keys, more, ids, places)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(np.uint64).view(np.int64)) for c in cols[:2]] + [pa.array(cols[2].astype(np.int64)), pa.array(cols[3].astype(np.int32))], names=["key", "key2", "doc_id", "pos"]
            )

    return text_batches(docs.select("doc_id", "text", "keys")).mapInArrow(run, "key long, key2 long, doc_id long, pos int")


def _compare(n_keys: int, run_rows: int):
    """Sorted rows (keys, document, place): those with a neighbour of equal keys in another document,
    and whole runs at the edges of the partition, whose neighbours may stand in the next one.

    A run's first row is its class: ``low`` and ``low_pos``. ``docs`` is the number of its
    documents, told by the first row of each part of a run (null in the others)."""

    def run(batches):
        held, cut_run, before = None, True, None  # whether the run that begins has rows elsewhere; its last document so far

        def emit(cols, edge_head, edge_tail, before):
            *keys, doc, pos = cols
            new = np.any([np.diff(k) != 0 for k in keys], axis=0)
            lo, hi = np.r_[0, np.flatnonzero(new) + 1], np.r_[np.flatnonzero(new) + 1, len(doc)]
            other = np.r_[True, new | (np.diff(doc) != 0)]  # a document's first row in the run
            if before is not None and doc[0] == before:
                other[0] = False
            docs = np.add.reduceat(other.astype(np.int64), lo)
            edge = np.zeros(len(lo), dtype=bool)
            edge[0] |= edge_head
            edge[-1] |= edge_tail
            size = hi - lo
            pick = np.repeat(edge | (doc[lo] != doc[hi - 1]), size)
            head = np.zeros(len(doc), dtype=bool)
            head[lo] = True
            wide = lambda v: np.repeat(v, size)[pick]
            return pa.RecordBatch.from_arrays(
                [pa.array(c[pick]) for c in cols]
                + [pa.array(wide(doc[lo])), pa.array(wide(pos[lo])), pa.array(wide(docs), mask=~head[pick]), pa.array(wide(docs)), pa.array(wide(edge))],
                names=[*_KEYS[:n_keys], "doc_id", "pos", "low", "low_pos", "docs", "n_docs", "edge"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            part = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys + 2)]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part)]
            last = np.flatnonzero(np.any([k != k[-1] for k in part[:n_keys]], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield emit([x[:cut] for x in part], cut_run, False, before)
                cut_run, before = False, None
            held = [x[cut:] for x in part]
            if len(held[0]) > run_rows:  # a long run goes out in parts, settled like runs at the cuts
                yield emit(held, True, True, before)
                held, cut_run, before = None, True, held[-2][-1]
        if held is not None and len(held[0]):
            yield emit(held, cut_run, True, before)

    return run


def _shared(rows: DataFrame, label: str, n_keys: int = 1, run_rows: int = _RUN) -> DataFrame:
    """Sort ``rows`` by keys over all tasks and compare neighbours: the keys, ``doc_id``, ``pos``,
    ``first`` and ``first_pos`` (the class: the smallest document with the keys and its first place),
    ``n_docs`` of keys in two documents or more.

    Ranges are cut by keys and document, so keys that a third of the rows share spread over tasks.
    Only runs at the cuts need settling: their extremes are summed by keys, two a task at most,
    and joined again, broadcast if they are few.
    """
    keys = list(_KEYS[:n_keys])
    ordered = rows.repartitionByRange(*keys, "doc_id").sortWithinPartitions(*keys, "doc_id", "pos")
    schema = ", ".join(f"{k} long" for k in keys) + ", doc_id long, pos int, low long, low_pos int, docs long, n_docs long, edge boolean"
    out = materialise(ordered.mapInArrow(_compare(n_keys, run_rows), schema), label)
    ends = out.where("edge").groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(F.struct("low", "low_pos")).alias("_low"), F.sum("docs").alias("_docs"))
    ends = small(materialise(ends, f"{label}-edges"))
    same = F.col("edge")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    joined = out.join(ends, same, "left")
    own = lambda inside, settled: F.when(F.col("edge"), F.col(settled)).otherwise(F.col(inside))
    found = joined.select(*keys, "doc_id", "pos", own("low", "_low.low").alias("first"), own("low_pos", "_low.low_pos").alias("first_pos"), own("n_docs", "_docs").alias("n_docs"))
    return found.where("n_docs > 1")


def _digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``same`` (64 bits), 128-bit ``digest`` and ``n_words`` of every text."""

    def run(batches):
        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([xxhash.xxh3_128_digest(t) for t in texts], type=pa.binary()), pa.array([len(t.split()) for t in texts], type=pa.int32())],
                names=["doc_id", "same", "digest", "n_words"],
            )

    return text_batches(docs.select("doc_id", "same", "text")).mapInArrow(run, "doc_id long, same long, digest binary, n_words int")


def _merge(min_words: int):
    """Stretches (``doc_id``, ``first``, ``pos``, ``len``, ``first_pos``, ``n_docs``) sorted by document, class
    and place, joined where windows follow on windows."""

    def run(batches):
        held = None

        def close(cols):
            doc, first, pos, length, first_pos, n_docs = cols
            last = pos + length - min_words  # the last window
            # the furthest window so far of the document and class: those are lifted apart first
            lift = np.cumsum(np.r_[0, (np.diff(doc) != 0) | (np.diff(first) != 0)]).astype(np.int64) << 32
            reach = np.maximum.accumulate(last + lift)
            new = np.r_[True, pos[1:] + lift[1:] > reach[:-1] + 1]
            lo = np.flatnonzero(new)
            stop = np.r_[lo[1:], len(doc)] - 1
            return pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (doc[lo], pos[lo], reach[stop] - lift[lo] - pos[lo] + min_words, first[lo], first_pos[lo], np.maximum.reduceat(n_docs, lo))],
                names=["doc_id", "start_word", "n_words", "first_doc_id", "first_start", "n_docs"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            part = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part)]
            other = np.flatnonzero((part[0] != part[0][-1]) | (part[1] != part[1][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield close([x[:cut] for x in part])
            held = [x[cut:] for x in part]
        if held is not None and len(held[0]):
            yield close(held)

    return run


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, prefix: int = PREFIX) -> DataFrame:
    """Passages of ``min_words`` words or more that documents share: ``doc_id``, ``start_word`` (from
    0), ``n_words``, ``first_doc_id`` and ``first_start`` (the smallest document with the passage and
    where it begins there), ``n_docs`` (the most documents that hold a window of it).

    Words are runs of anything but ASCII white space. Of every window of ``min_words`` words the
    suffix at its minimiser is retained, chosen by content, so equal windows retain equal
    suffixes. Retained suffixes are sorted by a hash of their first ``prefix`` words and compared
    with their neighbours; those with an equal one in another document are extended left and
    right to the windows around them, which are sorted by 128 bits of hash and compared in turn.
    Windows of a document that follow on each other and have the same first document are one
    stretch. Nothing is missed: equal windows meet at both steps, and each stretch links its
    document to its class, the first one, which has a row of its own (itself as ``first_doc_id``).

    Null texts, texts of fewer words and rows without an id give nothing; rows of one id are one
    document; documents with equal whole texts get one stretch of the whole, and only the first
    of them is indexed. An empty table gives an empty result; other columns are not read.
    """
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("same")).where("doc_id is not null and text is not null")
    seen = materialise(_digests(src).where(F.col("n_words") >= min_words), "digests")
    texts = seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count_distinct("doc_id").alias("n_docs")).where("n_docs > 1")
    texts = materialise(texts.select(F.col("digest").alias("_digest"), "first", "n_docs"), "copies")
    copies = materialise(seen.join(texts, F.col("digest") == F.col("_digest")).select("doc_id", "same", F.col("n_words").alias("len"), "first", "n_docs"), "copied")
    spare = small(materialise(copies.where("doc_id <> first").select(F.col("doc_id").alias("_id"), F.col("same").alias("_same")).distinct(), "spare"))
    kept = src.join(spare, (F.col("doc_id") == F.col("_id")) & (F.col("same") == F.col("_same")), "left_anti")
    suffixes = materialise(_suffixes(kept, min_words, prefix), "suffixes")
    near = _shared(suffixes, "suffix-pairs").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("key").alias("keys"))
    discard(suffixes)
    candidates = kept.join(near, F.col("doc_id") == F.col("_id")).drop("_id")
    windows = materialise(_windows(candidates, min_words, prefix), "windows")
    hits = _shared(windows, "window-pairs", 2).select("doc_id", "first", "pos", F.lit(min_words).alias("len"), "first_pos", "n_docs")
    discard(windows)
    whole = copies.select("doc_id", "first", F.lit(0).alias("pos"), "len", F.lit(0).alias("first_pos"), "n_docs")
    stretches = hits.unionByName(whole).repartition("doc_id").sortWithinPartitions("doc_id", "first", "pos")
    return stretches.mapInArrow(_merge(min_words), "doc_id long, start_word long, n_words long, first_doc_id long, first_start long, n_docs long")
