"""Ranked lexical search against plain Python, over one and many shards and blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from inkwell.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def _plain(docs, queries, k=20):
    found = [(i, _terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(x for _, t in found for x in set(t))
    out = []
    for item, text in {(i, t) for i, t in queries}:
        scored = []
        for doc, t in found:
            tf, s = Counter(t), 0
            m = 75 + 25 * len(t) * n_docs // n_terms if n_terms else 0
            for q in _terms(text):
                if tf[q]:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[q] + 1))) * (1_000_000_000 * tf[q] // (1000 * tf[q] + 12 * m))
            if s:
                scored.append((-s, doc is None, doc))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize(("shard_docs", "postings", "block", "k"), [(8192, 10**6, 500_000, 20), (3, 10**6, 4, 5), (10, 40, 30, 1), (1, 1, 1, 500)])
def test_against_plain_python(spark, shard_docs, postings, block, k):
    r = random.Random(k)
    words = ["Alpha", "alpha", "BETA", "gam_ma", "x1", "É", "é", "日本", "straße", "ZOË", "zoË", "一", "q"]
    docs = [(i if i % 9 else None, " -".join(r.choices(words, k=r.randint(1, 30)))) for i in range(60)]
    docs += docs[:9] + [(200, None), (201, ""), (202, " \t--__"), (203, "alpha " * 3000), (50, "alpha"), (51, "alpha")]
    queries = [(1, "alpha Alpha beta"), (2, "é É 日本"), (2, "x1"), (3, None), (4, "--"), (5, "nowhere"), (None, "q zoË"), (1, "alpha Alpha beta"), (6, " ".join(words * 3))]
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, query string, score int").repartition(4)
    q = spark.createDataFrame([(*x, 0) for x in queries], "item_id long, text string, doc_id int")
    found = lexical.index(d, shard_docs=shard_docs, shard_postings=postings)
    assert _got(lexical.search(found, q, k=k, block_terms=block)) == _plain(docs, queries, k)


def test_odd_rows_and_empty(spark, odd, odd_rows, empty):
    queries = [(1, "one two emoji"), (2, odd_rows[6][1])]
    q = spark.createDataFrame(queries, "item_id long, text string")
    assert _got(lexical.search(lexical.index(odd), q)) == _plain([r[:2] for r in odd_rows], queries)
    assert lexical.search(lexical.index(empty), q).count() == 0
    assert lexical.search(lexical.index(odd), q.where("false")).count() == 0


def test_whole_tables(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = _got(lexical.search(lexical.index(docs, shard_docs=50), items))
    assert got == _plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_ties_at_the_edge_go_to_the_first_places():
    r = np.random.default_rng(1)
    for _ in range(300):
        scores = r.integers(0, 4, r.integers(1, 40))
        k = int(r.integers(1, 12))
        want = sorted(np.flatnonzero(scores > 0).tolist(), key=lambda i: (-scores[i], i))[:k]
        assert sorted(lexical.best(scores, k).tolist()) == sorted(want)
