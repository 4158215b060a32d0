"""Ranked lexical search: document-sharded postings with integer impacts, searched term at a time.

The index is a table of shards. A shard holds some thousand documents by rising id and, for each of
its terms in order, the documents that hold it and their impacts (CSR: one array of documents, one
of impacts, and the number of postings of each term). A search adds up a term's impacts in a dense
array over the shard's documents, takes the shard's best, and merges the bests of all shards.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import materialise, small, text_batches

#: Characters that terms are made of: ASCII letters and digits, and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: In UTF-8: other bytes become spaces, A-Z lower case.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: A shard ends at so many documents or postings; one document is never cut.
SHARD_DOCS, SHARD_POSTINGS = 8192, 1_000_000
#: Queries come to the driver in blocks of about so many distinct terms a query at most together.
BLOCK_TERMS = 500_000
_SHARDS = "doc_ids array<long>, terms array<string>, counts array<int>, docs array<int>, impacts array<int>"


@dataclass
class Index:
    """``shards`` as written, ``n_docs`` with at least one term, ``n_terms`` of all documents."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _shard(ids: list, sizes: list[int], vocabulary: dict, term: list[np.ndarray], times: list[np.ndarray], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """One shard as a row. ``ids`` in the order of documents, null last."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    place = np.empty(len(ids), np.int32)
    place[order] = np.arange(len(ids), dtype=np.int32)
    names = sorted(vocabulary)
    to = np.empty(len(names), np.int32)
    to[[vocabulary[n] for n in names]] = np.arange(len(names), dtype=np.int32)
    per = [len(t) for t in term]
    doc, col, tf = np.repeat(place, per), to[np.concatenate(term)], np.concatenate(times).astype(np.int64)
    m = np.repeat(75 + np.array([25 * n * n_docs // n_terms for n in sizes], np.int64), per)
    at = np.lexsort((doc, col))
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * m)  # under a million
    row = {
        "doc_ids": [[ids[i] for i in order]],
        "terms": [[n.decode() for n in names]],
        "counts": [np.bincount(col, minlength=len(names)).astype(np.int32)],
        "docs": [doc[at]],
        "impacts": [impact[at].astype(np.int32)],
    }
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(v, type=pa.list_(k)) for v, k in zip(row.values(), kinds)], names=list(row))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> Index:
    """Index every row of ``docs`` over its whole text.

    Two numbers of the whole table go before: the documents with a term and their terms, counted by
    Spark. Null and empty texts, and those without a term, are in no shard. Repeated rows, repeated
    and null ids are documents of their own. Other columns are not read. A task builds its shards
    one after another, so it holds one shard, whatever its rows; each is a row group, so that what reads
    them holds one too.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = F.regexp_count("text", F.lit(TERM)).cast("long")
    total = src.select(n.alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 0

    def run(batches):
        def begin():
            return [], [], defaultdict(count().__next__), [], []

        ids, sizes, vocabulary, term, times = begin()
        held = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = terms(text) if text else []
                if not found:
                    continue
                own = Counter(found)
                ids.append(doc)
                sizes.append(len(found))
                term.append(np.fromiter(map(vocabulary.__getitem__, own), np.int32, len(own)))
                times.append(np.fromiter(own.values(), np.int32, len(own)))
                held += len(own)
                if len(ids) >= shard_docs or held >= shard_postings:
                    yield _shard(ids, sizes, vocabulary, term, times, n_docs, n_terms)
                    ids, sizes, vocabulary, term, times = begin()
                    held = 0
        if ids:
            yield _shard(ids, sizes, vocabulary, term, times, n_docs, n_terms)

    encoded = text_batches(src).select("doc_id", F.col("text").cast("binary").alias("text"))
    return Index(materialise(encoded.mapInArrow(run, _SHARDS), "lexical-index", group_rows=1), n_docs, n_terms)


def document_frequencies(found: Index, wanted: list[str]) -> dict[str, int]:
    """In how many documents each of the ``wanted`` terms occurs: shards' counts, summed by Spark."""
    ask = small(found.shards.sparkSession.createDataFrame([(t,) for t in wanted], "term string"))
    each = found.shards.select(F.inline(F.arrays_zip("terms", "counts"))).toDF("term", "n")
    return {r["term"]: r["n"] for r in each.join(ask, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores above 0; of equal ones at the edge, the first places."""
    some = np.flatnonzero(scores > 0)
    if len(some) <= k:
        return some
    own = scores[some]
    edge = own[np.argpartition(own, len(own) - k)[len(own) - k]]
    above = some[own > edge]
    return np.concatenate([above, some[own == edge][: k - len(above)]])


def _search_shard(doc_ids, names, counts, docs, impacts, queries, weights, k):
    """The shard's best of each query: (query, document ids, scores)."""
    at = {t: i for i, t in enumerate(names) if t in weights}
    ends = np.cumsum(counts)
    scores = np.zeros(len(doc_ids), np.int64)
    for q, own in queries:
        hit = False
        for t, times in own.items():
            if (i := at.get(t)) is not None and weights[t]:
                span = slice(ends[i] - counts[i], ends[i])
                scores[docs[span]] += impacts[span] * np.int64(weights[t] * times)  # a term has a document once
                hit = True
        if hit:
            top = best(scores, k)
            yield q, doc_ids.take(pa.array(top)), scores[top]
            scores[:] = 0


def _search_block(found: Index, block: list[tuple[int, dict]], k: int) -> DataFrame:
    spark = found.shards.sparkSession
    df = document_frequencies(found, sorted({t for _, own in block for t in own}))
    # bounded by the block: its queries' terms
    shared = spark.sparkContext.broadcast((block, {t: weight(found.n_docs, n) for t, n in df.items()}))

    def run(batches):
        queries, weights = shared.value
        for b in batches:
            for row in range(b.num_rows):
                ids, names, counts, docs, impacts = (b.column(i)[row].values for i in range(5))
                own = list(_search_shard(ids, names.to_pylist(), counts.to_numpy(), docs.to_numpy(), impacts.to_numpy(), queries, weights, k))
                if own:
                    which = pa.array(np.repeat([q for q, *_ in own], [len(s) for *_, s in own]))
                    yield pa.RecordBatch.from_arrays([which, pa.concat_arrays([i for _, i, _ in own]), pa.array(np.concatenate([s for *_, s in own]))], names=["query", "doc_id", "score"])

    return found.shards.mapInArrow(run, "query long, doc_id long, score long")


def search(found: Index, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Each query's ``k`` documents of the highest score above 0 (all, if fewer): ``id_col``, ``rank`` (from
    1; equal scores by rising doc_id, null last), ``doc_id``, ``score``.

    A query is a distinct row of id and text; one id with several texts has its ranks for each. Null
    and termless queries have no row. Queries are taken in blocks by their hash, as many as keep a
    block's terms to ``block_terms`` on the average; each block is one pass over the index in which every
    shard gives its ``k`` best of each query, so what is merged grows with shards, not documents.
    """
    own = queries.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.regexp_count("text", F.lit(TERM)) > 0).distinct()
    own = materialise(own.withColumn("query", F.xxhash64("id", "text")), "lexical-queries")
    size = own.agg(F.sum(F.regexp_count("text", F.lit(TERM)))).first()[0] or 0
    blocks, parts = max(1, -(-size // block_terms)), []
    for i in range(blocks):
        rows = own.where(F.pmod("query", F.lit(blocks)) == i).select("query", F.col("text").cast("binary").alias("text")).collect()
        block = [(r["query"], {t.decode(): n for t, n in Counter(terms(bytes(r["text"]))).items()}) for r in rows]
        if found.n_docs and block:
            parts.append(_search_block(found, block, k))
    if not parts:
        return own.select(F.col("id").alias(id_col), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(small(own.select("query", "id")), "query").select(F.col("id").alias(id_col), "rank", "doc_id", "score")
