"""Power-of-two packing: against plain encoding, piece by piece."""

import struct
import zlib
from collections import defaultdict

import pytest

from inkwell.llm import decomposition, tokens
from inkwell.llm.queries import QUERIES, vocabulary

PATH = vocabulary("word_bpe_49k.json")


def test_binary_lengths():
    assert decomposition.binary_lengths(1) == [1]
    assert decomposition.binary_lengths(2048) == [2048]
    assert decomposition.binary_lengths(5000) == [2048, 2048, 512, 256, 128, 8]
    for n in range(1, 5000):
        parts = decomposition.binary_lengths(n, 256)
        assert sum(parts) == n and parts == sorted(parts, reverse=True) and all(p <= 256 and p & (p - 1) == 0 for p in parts)
        assert len(parts) == n // 256 + (n % 256).bit_count()


def _whole(rows, texts):
    """Every piece is a sequence of its own of a binary length, and the pieces of a document give its ids."""
    t, seen, ranks = tokens.load(PATH), set(), defaultdict(list)
    for (doc, text), n in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        own = [r for r in rows if r["doc_id"] == doc and r["doc_tokens"] == len(ids)]
        want = []
        start = 0
        for length in decomposition.binary_lengths(len(ids)):
            want.append((start, length, zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))))
            start += length
        got = [(r["start"], r["length"], r["ids_crc32"]) for r in own]
        assert all(got.count(w) >= n for w in want)
    for r in rows:
        assert r["offset"] == 0 and r["length"] == 1 << r["bucket"] and r["sequence_id"] not in seen
        seen.add(r["sequence_id"])
        ranks[r["bucket"]].append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values())


def test_query_whole_table(spark, sf_dir):
    rows = QUERIES["op11_power_of_two_packing"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    texts = defaultdict(int)
    for d in docs:
        texts[d["doc_id"], d["text"]] += 1
    _whole(rows, texts)
    t = tokens.load(PATH)
    assert sum(r["length"] for r in rows) == sum(len(t.encode(d["text"] or "", add_special_tokens=False).ids) + 1 for d in docs)


def test_odd_rows(odd, odd_rows, empty):
    rows = decomposition.bucketed(decomposition.decompose(odd.repartition(3), PATH)).collect()
    texts = defaultdict(int)
    for r in odd_rows:
        texts[r[0], r[1]] += 1
    _whole(rows, texts)
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] == 1] == [(0, 1, 1)]
    assert decomposition.bucketed(decomposition.decompose(empty, PATH)).count() == 0
    with pytest.raises(ValueError):
        decomposition.decompose(odd, PATH, longest=1000)


def test_numbers_do_not_depend_on_partitions(odd):
    pieces = decomposition.decompose(odd.repartition(6), PATH, longest=256, with_ids=True)
    rows = decomposition.batched(decomposition.bucketed(pieces.coalesce(2)), 512).collect()  # two maps' worth in a task
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(len(r["ids"]) == r["length"] for r in rows)
    held = defaultdict(list)
    for r in rows:
        held[r["bucket"], r["batch"]].append(r["length"])
    assert all(sum(x) <= max(512, x[0]) for x in held.values())
    full = [k for k, x in held.items() if sum(x) == max(512, x[0])]
    assert len(held) - len(full) <= 9  # at most one unfilled batch a length
