import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import ann, packing, repeats, tokens
from inkwell.llm.queries import vocabulary


def check_plan(plan, counts, capacity):
    used = Counter()
    for times, filling in plan:
        assert times > 0 and sum(x * k for x, k in filling) <= capacity
        for x, k in filling:
            used[x] += times * k
    assert used == Counter({x: n for x, n in counts.items() if n})
    return sum(t for t, _ in plan)


def fewest(items, capacity):
    """The optimal number of bins by trying them all."""
    items = sorted(items, reverse=True)
    for n in range(1, len(items) + 1):
        def place(i, rooms):
            if i == len(items):
                return True
            tried = set()
            for b, r in enumerate(rooms):
                if r >= items[i] and r not in tried:
                    tried.add(r)
                    if place(i + 1, rooms[:b] + (r - items[i],) + rooms[b + 1 :]):
                        return True
            return False

        if place(0, (capacity,) * n):
            return n
    return 0


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(4)
    better = 0
    for _ in range(150):
        capacity = rng.choice([10, 20, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        counts = Counter(items)
        plan = packing.bin_completion(counts, capacity, evaluations=5000)
        n = check_plan(plan, counts, capacity)
        best = fewest(items, capacity)
        assert packing.lower_bound(counts, capacity) <= best == n
        better += n < sum(t for t, _ in packing.best_fit(counts, capacity))
    hard = Counter({6: 2, 5: 2, 4: 2, 3: 2, 7: 1, 2: 1, 9: 1})
    check_plan(packing.bin_completion(hard, 10), hard, 10)


def test_best_fit_of_a_large_histogram():
    rng = random.Random(1)
    counts = {x: rng.randint(1, 10**6) for x in rng.sample(range(1, 4097), 2500)}
    plan = packing.bin_completion(counts, evaluations=20)
    assert check_plan(plan, counts, 4096) <= packing.lower_bound(counts) * 1.01 + 3
    assert len(packing.best_fit(counts)) <= 3 * 4096


def maximal(lengths, left, room):
    """The wastes and fillings of a bin to which nothing left can be added, by trying them all."""
    for ks in itertools.product(*[range(n + 1) for n in left]):
        rest = room - sum(x * k for x, k in zip(lengths, ks))
        if rest >= 0 and not any(x <= rest and k < n for x, k, n in zip(lengths, ks, left)):
            yield rest, tuple((x, k) for x, k in zip(lengths, ks) if k)


def test_fillings_are_the_least_waste_of_all():
    rng = random.Random(12)
    for _ in range(200):
        capacity = rng.randint(8, 40)
        counts = {x: rng.randint(1, 4) for x in rng.sample(range(1, capacity + 1), rng.randint(1, min(6, capacity)))}
        largest = max(counts)
        lengths = sorted(counts, reverse=True)
        want = sorted(maximal(lengths, [counts[x] - (x == largest) for x in lengths], capacity - largest))
        waste = lambda f: capacity - largest - sum(x * k for x, k in f)
        for limit in (1, 3, 10**6):
            got = packing.undominated_fillings(largest, counts, capacity, limit)
            assert [waste(f) for f in got] == [w for w, _ in want[:limit]] and len(set(got)) == len(got)
            assert {(waste(f), f) for f in got} <= set(want)


def test_bin_completion_is_optimal_as_it_is_called():
    rng = random.Random(4)
    better = 0
    for _ in range(150):
        capacity = rng.choice([20, 30, 60])
        counts = Counter(rng.randint(capacity // 6, capacity // 2) for _ in range(rng.randint(6, 11)))
        n = check_plan(packing.bin_completion(counts, capacity), counts, capacity)
        assert n == fewest(counts.elements(), capacity)
        better += n < sum(t for t, _ in packing.best_fit(counts, capacity))
    assert better
    for seed in range(2):  # best fit takes 3 or 4 bins more than the lower bound
        rng = random.Random(seed)
        counts = Counter(rng.randint(700, 1500) for _ in range(300))
        assert check_plan(packing.bin_completion(counts), counts, 4096) == packing.lower_bound(counts)


def test_bins_of_best_fit_and_lower_bound():
    rng = random.Random(8)
    for _ in range(100):
        capacity = rng.choice([20, 100, 4096])
        counts = {x: rng.choice([1, 2, 5, 1000]) for x in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 60)))}
        bins = sum(t for t, _ in packing.best_fit(counts, capacity))
        assert packing.lower_bound(counts, capacity) <= packing.best_fit_bins(counts, capacity, 10**9) == bins


def test_packing_round_trip(odd, odd_rows):
    path = vocabulary("word_bpe_49k.json")
    library = tokens.load(path)
    rows = packing.pack(packing.pieces(odd, path, with_ids=True)).collect()
    want = Counter()
    for r in odd_rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), 4096):
            part = ids[i : i + 4096]
            crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            want[r[0], i // 4096, i, len(part), crc] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert all(len(r.ids) == r.length for r in rows)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(bins) == packing.lower_bound(Counter(r.length for r in rows))


def test_packing_many_equal_lengths(spark):
    df = spark.range(30_000).selectExpr("id doc_id", "0 piece", "0L start", "cast(if(id % 3 = 0, 7, 1 + id % 50) as long) length", "id ids_crc32")
    rows = packing.pack(df).select("sequence_id", "offset", "length").collect()
    assert len(rows) == 30_000 and len({(r[0], r[1]) for r in rows}) == 30_000
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) == -(-total // 4096)


def test_packing_empty(empty):
    assert packing.pack(packing.pieces(empty, vocabulary("word_bpe_49k.json"))).count() == 0


def brute_nearest(rows, k, every=20):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = np.array(v, dtype=np.float64)
    out = {}
    for q, v in good.items():
        if q % every == 0:
            scores = []
            for i, w in good.items():
                if i != q:
                    s = 0.0
                    for a, b in zip(v, w):
                        s += a * b
                    scores.append((-s, i))
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def vectors():
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)]  # ties
    rows += [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [None] + [1.0] * 7), (480, [float("inf")] * 8), (None, [1.0] * 8)]
    return rows + rows[:3]


def test_search_is_exact_at_factor_one(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    for shard_rows, block in ((4096, 16384), (64, 5)):
        got = defaultdict(list)
        for r in ann.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0, shard_rows=shard_rows, query_block=block).collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        want = brute_nearest(dict(reversed(rows)).items(), 20)
        assert set(got) == set(want)
        for q, found in got.items():
            found.sort()
            assert [x[0] for x in found] == list(range(1, 21))
            assert [(i, s) for _, i, s in found] == want[q]


def test_search_recall_of_the_query(spark):
    from inkwell.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r[1] for r in table], dtype=np.float64)
    ids = np.array([r[0] for r in table])
    got = defaultdict(set)
    for r in QUERIES["op4_vp_tree_search"](spark, sf).collect():
        got[r.query_id].add(r.vec_id)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        hits, total = hits + len(best & got[ids[i]]), total + 20
    assert hits >= 0.95 * total


def clustered(n=4000, dim=16, centres=25):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] + rng.normal(scale=0.15, size=(n, dim))).astype(np.float32)
    x[3000:3300] = x[3000]  # a hot vector
    return x.astype(np.float64)


@pytest.mark.parametrize("made", ["clustered", "table"])
def test_search_recall_over_many_shards(spark, made):
    """Rows whose id is divisible by 100 against all rows, over some 30 shards at the query's factor."""
    if made == "table":
        rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
        ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    else:
        x = clustered()
        ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = defaultdict(dict)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, shard_rows=len(x) // 30).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        found = got[int(ids[i])]
        assert len(found) == 20 and all(abs(score - x[np.flatnonzero(ids == v)[0]] @ x[i]) < 1e-9 for v, score in found.values())
        hits, total = hits + len(best & {v for v, _ in found.values()}), total + 20
    assert hits >= 0.9 * total


def test_shards_are_skipped_whole():
    """Every vector has a shard; at factor 1 the shards of the nearest are always visited; of vectors of
    one length in clusters, half of the others are not (lifting unequal lengths takes that away)."""
    x = clustered()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = ann.ShardTree(x[::4], float((x * x).sum(axis=1).max()), 32)
    shard = tree.deal(x)
    assert 20 < tree.shards <= 32 and len(set(shard.tolist())) > 20  # equal vectors are not cut apart
    q = x[::100]
    s = q @ x.T
    kth = np.sort(s, axis=1)[:, -20]
    visits = tree.visits(q, kth, 1.0)
    for i, own in enumerate(visits):
        assert set(shard[s[i] >= kth[i]].tolist()) <= set(own)
    assert sum(map(len, visits)) < 0.6 * 32 * len(q)


def test_search_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0])], "vec_id long, embedding array<float>")
    rows = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in rows] == [(0, 1, 1, 4.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_rows_that_share_an_id(spark):
    """Each (id, vector) is a row: a query of its own, and a candidate of all others, its id's too."""
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.normal(size=4).round(1).tolist()) for i in rng.integers(0, 30, 200)]
    rows += [(20, v) for _, v in rows[:60]] + rows[:9]  # a hot id; repeated rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    keys = {(r.vec_id, tuple(r.embedding)): r.key for r in df.select("vec_id", "embedding", F.xxhash64("embedding").alias("key")).collect()}
    for shard_rows in (4096, 40):
        got = defaultdict(list)
        for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=7, factor=1.0, shard_rows=shard_rows, query_block=50).collect():
            got[r.query_id, r.query_key].append((r["rank"], r.vec_id, r.score))
        assert len(got) == sum(i % 20 == 0 for i, _ in keys)
        for (i, v), key in keys.items():
            if i % 20:
                continue
            scored = sorted((-(((w[0] * v[0] + w[1] * v[1]) + w[2] * v[2]) + w[3] * v[3]), j) for j, w in keys if (j, w) != (i, v))[:7]
            assert sorted(got[i, key]) == [(n, j, -s) for n, (s, j) in enumerate(scored, 1)]


def brute_passages(rows, least):
    """Windows of all documents but whole copies of a smaller one; runs of one class are one row."""
    texts = defaultdict(set)
    for i, t in rows:
        if i is not None and len((t or "").encode().split()) >= least:
            texts[t].add(i)
    out, where = set(), defaultdict(set)
    for t, ids in texts.items():
        words, first = tuple(t.encode().split()), min(ids)
        if len(ids) > 1:
            out |= {(i, 0, len(words), first, 0, len(ids)) for i in ids}
        for s in range(len(words) - least + 1):
            where[words[s : s + least]].add((first, s))
    for t, ids in texts.items():
        words, doc, runs = tuple(t.encode().split()), min(ids), defaultdict(list)
        for s in range(len(words) - least + 1):
            hit = where[words[s : s + least]]
            if len({d for d, _ in hit}) > 1:
                first = min(hit)
                if len(ids) > 1 and first[0] == doc:
                    continue  # within the stretch of the whole
                run = runs[first[0]]
                if run and run[-1][1] == s - 1:
                    run[-1][1] = s
                    run[-1][3] = max(run[-1][3], len({d for d, _ in hit}))
                else:
                    run.append([s, s, first[1], len({d for d, _ in hit})])
        out |= {(doc, a, z - a + least, f, at, n) for f, run in runs.items() for a, z, at, n in run}
    return out


def test_shared_passages_equal_brute_force(spark, odd, odd_rows, prose):
    rng = random.Random(8)
    parts = [prose(1000 + i, rng.choice([20, 49, 50, 51, 60, 120])) for i in range(25)]
    rows = [(r[0], r[1]) for r in odd_rows]
    for i in range(120):
        body = " ".join(rng.choice(parts) if rng.random() < 0.6 else prose(5000 + 10 * i + j, rng.randint(1, 80)) for j in range(4))
        rows.append((1000 + i, body))
    rows += [(3000, "a " * 90), (3001, "b a " + "a " * 70), (3002, "x y " * 60), (3003, prose(77, 40) + " x y" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in repeats.shared_passages(df).collect()]
    want = brute_passages(rows, repeats.MIN_WORDS)
    whole = {(r[0], r[3]) for r in want if r[1] == 0 and r[0] != r[3]}
    assert len(found) == len(set(found))
    # the count of a stretch of a whole copied text may come from a window that more documents have
    key = lambda r: r[:4] + r[4:] * ((r[0], r[3]) not in whole and r[0] != r[3])
    assert {key(r) for r in found} == {key(r) for r in want}
    assert all(r[3] <= r[0] and r[5] > 1 for r in found) and len({r[3] for r in found}) > 20


def test_a_stretch_links_each_partner(spark, prose):
    """Touching passages that different documents share are stretches of their own."""
    a, b = prose(31, 70), prose(32, 80)
    rows = [(1, a + " " + prose(33, 30)), (2, prose(34, 20) + " " + b), (3, a + " " + b), (4, prose(35, 9) + " " + b)]
    got = {tuple(r) for r in repeats.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0, 70, 1, 0, 2), (3, 0, 70, 1, 0, 2), (2, 20, 80, 2, 20, 3), (3, 70, 80, 2, 20, 3), (4, 9, 80, 2, 20, 3)}


@pytest.mark.parametrize("n_keys, run_rows", [(1, 200_000), (1, 100), (2, 100)])
def test_runs_over_partition_edges(spark, n_keys, run_rows):
    rows = [(k, k % 2, d, p) for k in (5, 6, 7) for d in range(300) for p in range(2)] + [(8, 0, 1, 0), (8, 0, 1, 4), (9, 0, 2, 0), (9, 1, 3, 0)]
    df = spark.createDataFrame(rows, "key long, key2 long, doc_id long, pos int")
    got = repeats._shared(df if n_keys == 2 else df.drop("key2"), "test", n_keys, run_rows).collect()
    some = [r for r in rows if r[0] < 8 or (r[0] == 9 and n_keys == 1)]
    assert sorted((r.key, r.doc_id, r.pos) for r in got) == sorted((r[0], r[2], r[3]) for r in some)
    assert {(r.key, r.first, r.first_pos, r.n_docs) for r in got} == {(k, 0, 0, 300) for k in (5, 6, 7)} | ({(9, 2, 0, 2)} if n_keys == 1 else set())


def test_no_passages(empty):
    assert repeats.shared_passages(empty).count() == 0
