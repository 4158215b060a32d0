"""Near pairs against all pairs, and what the step writes."""

import itertools
import random

import pytest

from inkwell.operators import dedup
from inkwell.plans import catalog
from inkwell.sources import store


@pytest.mark.parametrize("threshold, frequent", [(0.8, 3), (0.8, 10**6), (0.6, 3)])
def test_near_pairs_are_all_pairs(spark, monkeypatch, threshold, frequent):
    """Sets of 1 to 3,000 grams, many at the threshold's edge or of another size, with grams that most begin with."""
    monkeypatch.setattr(dedup, "FREQUENT", frequent)
    monkeypatch.setattr(dedup, "PART_GRAMS", 5_000)
    rng = random.Random(4)
    draw = lambda n: {rng.randrange(-(2**63), 2**63) for _ in range(n)}
    common, rows = draw(30), []
    for n in (1, 2, 4, 5, 9, 10, 31, 32, 33, 40, 127, 128, 160, 600, 3000):
        for _ in range(3):
            base = draw(n) | set(rng.sample(sorted(common), min(n // 3, 30)))
            for _ in range(5):
                gone, more = rng.choice([(0, 0.25), (0.2, 0), (0.1, 0.1), (0.111, 0.111), (0.12, 0.12), (0, 0.26), (0.02, 0.01)])
                some = set(rng.sample(sorted(base), len(base) - int(gone * len(base)))) | draw(int(more * len(base)))
                rows.append((len(rows), rng.choice([1, 1, 1, -7]), sorted(some)))
    sets = store.materialise(spark.createDataFrame(rows, "id long, grp long, grams array<bigint>"))
    found = {(r.a, r.b): r.jaccard for r in dedup.near_pairs(sets, threshold).collect()}
    wanted = {}
    for i, (a, g, x) in enumerate(rows):
        for b, h, y in rows[i + 1 :]:
            shared = len(set(x) & set(y))
            if g == h and shared / (len(x) + len(y) - shared) >= threshold:
                wanted[a, b] = shared / (len(x) + len(y) - shared)
    assert found == pytest.approx(wanted) and len(wanted) > 100


def test_near_dedup_writes_no_grams(spark, monkeypatch, tmp_path):
    """Less than the texts; the hashes of their grams are eight times as much."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=2000)), "fr") for i in range(200)]
    rows += [(i + 200, t[:1950] + "x" * 5, "fr") for i, t, _ in rows[:50]] + [(300, rows[0][1], "fr")]
    monkeypatch.setattr(store, "folder", lambda _, n=itertools.count(): f"file://{tmp_path}/{next(n)}")
    gone = dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, language string"), "doc_id", ["language"], store.materialise)
    assert sorted(r.id for r in gone.collect()) == [*range(200, 250), 300]
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 2000 * len(rows) / 4


def test_a_build_writes_texts_once(spark, sf_dir, monkeypatch, tmp_path):
    """Behind the gates; three texts a row and their grams were written before."""
    monkeypatch.setattr(store, "folder", lambda _, n=itertools.count(): f"file://{tmp_path}/{next(n)}")
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert catalog.QUERIES["corpus_build"](spark, sf_dir).count() == n
    written = [p for p in tmp_path.iterdir() if list(p.glob("*.parquet"))]
    texts = [p for p in written if "text" in spark.read.parquet(str(p)).columns and max(len(r.text or "") for r in spark.read.parquet(str(p)).select("text").collect()) > 64]
    assert len(texts) == 1 and not [p for p in written if "grams" in spark.read.parquet(str(p)).columns]


@pytest.mark.parametrize("few", [0, 3, dedup.FEW_SETS])
def test_many_near_copies_are_linear_work(spark, monkeypatch, few):
    """Of 120 near copies of a text, each meets those that stay; all 7,140 pairs of them were verified before."""
    monkeypatch.setattr(dedup, "FEW_SETS", few)
    rng = random.Random(6)
    draw = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    edited = lambda words, share: [w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in words]
    base, chain = draw(400), draw(300)
    texts = [base, *(edited(base, rng.choice([0.002, 0.01, 0.03])) for _ in range(120))]
    for _ in range(40):  # each is near the one before it, the last isn't near the first
        chain = edited(chain, 0.01)
        texts.append(chain)
    rows = [(i, " ".join(t), "en") for i, t in enumerate(texts)]
    wanted, kept = set(), []
    for i, t in enumerate(texts):
        g = {tuple(t[j : j + 5]) for j in range(len(t) - 4)}
        if any(len(g & k) / len(g | k) >= 0.8 for k in kept):
            wanted.add(i)
        else:
            kept.append(g)
    seen, real = [], dedup.verified_texts
    monkeypatch.setattr(dedup, "verified_texts", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    gone = dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, language string"), "doc_id", ["language"], store.materialise)
    assert {r.id for r in gone.collect()} == wanted and len(kept) > 5
    if few < 160:
        assert sum(seen) < 3000


def test_grams_of_texts_stay_in_python(spark, monkeypatch):
    """They came to the JVM and went back to Python for each step before."""
    monkeypatch.setattr(dedup.grams, "shingle_hashes", lambda *_: pytest.fail("grams cross over"))
    rng = random.Random(7)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(40)]
    rows = [(i, t, "en") for i, t in enumerate([*base, *(t + " more" for t in base[:9]), *base[:3], "", "x", "x", None])]
    pairs, copies = dedup.near_text_pairs(spark.createDataFrame(rows, "doc_id long, text string, language string"), "doc_id", ["language"], "language")
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(i, 40 + i) for i in range(9)]
    assert sorted((r.id, r.rep) for r in copies.collect()) == [(49, 0), (50, 1), (51, 2), (54, 53)]


@pytest.mark.parametrize("n, most, written", [(40, 50, False), (60, 50, True)])
def test_rows_are_narrowed_by_broadcast_ids(spark, monkeypatch, n, most, written):
    """Ids had the bound of wider rows before, beyond which texts are shuffled and written."""
    monkeypatch.setattr(store, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(store, "BROADCAST_IDS", most)
    seen, real = [], store.materialise
    monkeypatch.setattr(store, "materialise", lambda df: seen.append(df) or real(df))
    rows = spark.range(100).selectExpr("id", "string(id) AS text")
    found = store.narrowed(rows, real(spark.range(n)), "id", "left_semi")
    assert found.count() == n and bool(seen) == written


def test_rounds_read_the_texts_that_are_left(spark, monkeypatch):
    """Each round read all texts before, to narrow them to those with a candidate."""
    monkeypatch.setattr(dedup, "FEW_SETS", 0)
    rng = random.Random(8)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(200)] for _ in range(30)]
    rows = [(i, " ".join(t), "en") for i, t in enumerate([*base, *([*t, "more"] for t in base[:9]), *([*t, "most"] for t in base[:9])])]
    seen, real = [], dedup.unshingled

    def spied(*args):
        out = real(*args)
        seen.append("InMemoryRelation" in out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(dedup, "unshingled", spied)
    cached = lambda: spark._jsc.sc().getPersistentRDDs().size()
    before = cached()
    gone = dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, language string"), "doc_id", ["language"], store.materialise)
    assert sorted(r.id for r in gone.collect()) == list(range(30, 48)) and cached() == before
    assert seen[:3] == [False] * 3 and all(seen[3:]) and len(seen) > 4
