import itertools
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkwell.llm import graph, mixing, simhash
from inkwell.llm.common import word_count


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, links):
    parent = {i: i for i in pairs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in pairs}


def test_fingerprints_and_components(spark, odd, odd_rows):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    want = defaultdict(list)
    for r in odd_rows:
        want[r[0]].append(f"{brute_fingerprint(r[1]):016x}")
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append(r.fingerprint)
    assert {k: sorted(v) for k, v in want.items()} == {k: sorted(v) for k, v in found.items()}
    by_id = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by_id[4] == by_id[5] == 4 and by_id[1] == by_id[2] == by_id[3] == 1 and by_id[11] == by_id[12] == 11


@pytest.mark.parametrize("held", [simhash.HELD, 12])
def test_links_lose_no_component(spark, held):
    """Buckets of more than 12 fingerprints are dealt out again where only 12 are held."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set()
    for b in base:
        x = int(b)
        for _ in range(12):
            for bit in rng.choice(64, size=rng.integers(0, 5), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = brute_components(range(len(fps)), links)
    got = {r.node: r.component for r in graph.connected_components(simhash.near_links(df, held)).collect()}
    parts, wanted = {}, {}
    for i, x in enumerate(signed):
        parts.setdefault(got.get(x, x), set()).add(i)
        wanted.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, wanted.values())) and len(wanted) < len(fps)


def test_hot_bucket_without_links(spark):
    """Thousands of fingerprints with 32 bits alike but for a few links, found without comparing all pairs."""
    rng = np.random.default_rng(5)
    code = sorted({int(x) for x in rng.integers(0, 1 << 32, 6000)})
    fps = [x | 0xABCD1234 << 32 for x in code] + [code[0] ^ 7 | 0xABCD1234 << 32]
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(set(fps))]
    edges = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 500).distinct().collect()
    got = {frozenset((r.u, r.v)) for r in edges}
    a = np.array(signed, dtype=np.int64).view(np.uint64)
    want = set()
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 3):
            want.add(frozenset((signed[i], signed[i + 1 + j])))
    assert got and got <= want
    left = {frozenset(p) for p in want} - got  # implied by the forests: both ends have links
    ends = {x for p in got for x in p}
    assert all(p <= ends for p in left)


def test_dense_bucket_gives_a_forest(spark):
    fps = [i ^ (1 << j) for i in (0,) for j in range(8)] + [0]
    df = spark.createDataFrame([(x,) for x in sorted(set(fps))], "fp long")
    rows = simhash.near_links(df).collect()
    assert len(rows) <= 24 * 8
    parts = graph.connected_components(simhash.near_links(df)).collect()
    assert {r.component for r in parts} == {0} and len(parts) == 8


def test_components_of_chain_hub_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 160))
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graph, "STAR_BROADCAST_EDGES", 0)
    edges = [(i, i + 1) for i in range(0, 9)] + [(50, i) for i in range(51, 60)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 10)} | {i: 50 for i in range(51, 60)}


def water_fill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, capped = {}, set()
    total = sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in free)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / share for s in names}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return target
        capped.update(over)


def test_mixing_targets(spark, odd, odd_rows):
    mixed = mixing.mix(odd, word_count(F.col("text")))
    rows = mixed.select("doc_id", "source", "text", "mix.*").collect()
    assert len(rows) == len(odd_rows)
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    want = water_fill(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert r.size == len((r.text or "").encode().split()) and 0 <= r.copies <= 3
    again = mixing.mix(odd, word_count(F.col("text"))).select("doc_id", "mix").collect()
    assert sorted(map(repr, again)) == sorted(repr(x) for x in mixed.select("doc_id", "mix").collect())
    out = mixing.emit(mixed)
    assert out.count() == sum(r.copies for r in rows) and "mix" not in out.columns


def taken_of(mixed):
    taken = F.sum(F.col("mix.size") * F.col("mix.copies")).alias("taken")
    return mixed.groupBy("source").agg(taken, F.max("mix.size").alias("largest"), F.first("mix.target").alias("target")).collect()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_mixing_comes_to_its_targets(spark, sf):
    """Each source within its largest document, and within half of 1 % where small ones make up for it."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    by = taken_of(mixing.mix(docs, word_count(F.col("text"))))
    assert all(abs(r.taken - r.target) < r.largest for r in by)
    if sf == "sf0.1":
        assert sum(abs(r.taken - r.target) <= 0.005 * r.target for r in by) >= 15


def test_mixing_rows_alike(spark):
    """Null ids, repeated rows and a source of one size: as many are taken as the target needs."""
    rows = [(None, "a", 100, "x")] * 200 + [(i, "b", i * 7919 % 50 + 1, "x") for i in range(1000)]
    rows += [(None, "c", 300, "x")] * 50 + [(None, None, 7, "x")] * 999 + [(5, "d", 0, "x")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, draw string").repartition(7)
    mixed = mixing.mix(docs, F.col("size"))
    by = {r.source: r for r in taken_of(mixed)}
    assert mixed.count() == len(rows) and mixed.columns == [*docs.columns, "mix"]
    assert all(abs(r.taken - r.target) <= max(r.largest, 0.0) for r in by.values())
    assert abs(by[None].taken - by[None].target) <= 7 and by["d"].taken == 0
    again = mixing.mix(docs, F.col("size"))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, mixed.collect()))


def test_mixing_chance_is_the_fraction(spark):
    """Over many seeds a document gets its copy more as often as the fraction says, big ones too."""
    sizes = [400, 300, 50, 50] + [5] * 60
    docs = spark.createDataFrame([(i, "a", n) for i, n in enumerate(sizes)] + [(999, "b", 700)], "doc_id long, source string, size long")
    draws = [mixing.mix(docs, F.col("size"), seed=s).select("doc_id", "mix.copies", "mix.rate").collect() for s in range(6)]
    rate = {r.doc_id: r.rate for r in draws[0]}
    mean = {i: sum(r.copies for d in draws for r in d if r.doc_id == i) / len(draws) for i in rate}
    assert all(int(rate[i]) <= mean[i] <= int(rate[i]) + 1 for i in rate)
    assert abs(sum(mean[i] - rate[i] for i in range(4, 64)) / 60) < 0.15


def test_mixing_share_is_met(spark):
    rows = [(i, f"s{i % 5}", (i * 7919) % 50 + 1) for i in range(5000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), F.col("size"))
    by = mixed.groupBy("source").agg(F.sum(F.col("mix.size") * F.col("mix.copies")).alias("taken"), F.first("mix.target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 50 for r in by)
    assert abs(sum(r.target for r in by) - sum(r[2] for r in rows)) < 1e-3


def test_empty_tables(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert mixing.mix(empty, word_count(F.col("text"))).count() == 0


def test_one_row_of_each_group_stays(spark, odd, odd_rows, empty, prose):
    """Repeated ids with texts of other groups, rows alike, rows without an id, clashing columns."""
    a, b = prose(41, 80), prose(42, 80)
    rows = [(2, b, "x"), (4, a, "y"), (4, b, "z"), (None, a, "w"), (7, None, "n"), (8, "", "e"), (9, prose(43, 60), "t"), (9, prose(43, 60), "t"), (9, prose(43, 60), "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[1], rows[4], rows[6]], key=repr)
    only = spark.createDataFrame([(None, a, "x"), (None, a, "x"), (None, b, "y")], docs.schema)
    assert sorted(r.text for r in simhash.drop_near_duplicates(only).collect()) == sorted([a, b])
    kept = simhash.drop_near_duplicates(odd).collect()
    groups = {brute_fingerprint(r[1]) for r in odd_rows}
    assert {brute_fingerprint(r.text) for r in kept} <= groups and len(kept) <= len(groups)
    assert simhash.drop_near_duplicates(empty).count() == 0
