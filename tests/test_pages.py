"""Keyset pages and bisected starts against plain walks."""

import math
import random

import pytest

from inkwell.sources import pages


def _posts(n, seed=1):
    r = random.Random(seed)
    return [(r.randint(0, n // 6), i, f"p{i}") for i in range(n)]


@pytest.mark.parametrize(("size", "again"), [(1, 0), (7, 0), (7, 3), (5, 5), (500, 0)])
def test_every_post_once_whatever_the_page_size(spark, tmp_path, size, again):
    posts, uri = _posts(60), f"file://{tmp_path}"
    df = spark.createDataFrame(posts, "created long, id long, body string")
    pages.land(df, f"{uri}/pages", size, again=again)
    got = pages.read_backward(spark, f"{uri}/pages", 8, f"{uri}/out", f"{uri}/ck")
    assert sorted(tuple(r) for r in got.select("created", "id", "body").collect()) == sorted(p for p in posts if p[0] < 8)


def test_runs_go_on_and_stop_without_progress(spark, tmp_path):
    uri = f"file://{tmp_path}"

    def page(n, rows):
        spark.createDataFrame(rows, "created long, id long").coalesce(1).write.parquet(f"{uri}/pages/page={n}")

    def read():
        got = pages.read_backward(spark, f"{uri}/pages", 100, f"{uri}/out", f"{uri}/ck")
        return sorted(tuple(r) for r in got.select("created", "id").collect())

    page(0, [(120, 9), (90, 5), (90, 4)])
    page(1, [(90, 4), (90, 3), (None, 7), (80, None)])
    assert read() == [(90, 3), (90, 4), (90, 5)]
    page(2, [(90, 3), (80, 2)])
    assert read() == [(80, 2), (90, 3), (90, 4), (90, 5)]
    page(3, [(90, 5), (80, 2)])  # nothing older: the walk ends here, whatever comes behind it
    page(4, [(70, 1)])
    assert read() == [(80, 2), (90, 3), (90, 4), (90, 5)]


def test_bisected_is_the_first_page_that_reaches_the_target():
    r = random.Random(2)
    for _ in range(400):
        stamps = sorted(r.randint(0, 30) for _ in range(r.randint(0, 25)))
        stamps = [None if r.random() < 0.3 else s for s in stamps]
        target, asked = r.randint(-1, 32), []
        got = pages.bisected(len(stamps), lambda i: asked.append(i) or stamps[i], target)
        want = next((i for i, s in enumerate(stamps) if s is not None and s >= target), len(stamps))
        assert got == want or (got < want and all(s is None for s in stamps[got:want]))
        if None not in stamps:
            assert len(asked) <= 1 + math.log2(len(stamps) + 1)


def test_range_equals_a_full_scan(spark, tmp_path):
    posts, uri = _posts(300, 4), f"file://{tmp_path}/pages"
    df = spark.createDataFrame(posts, "created long, id long, body string")
    pages.land(df, uri, 9, newest_first=False)
    n = -(-len(posts) // 9)
    for since, until in ((10, 20), (0, 1), (49, 60), (20, 20), (-5, 100)):
        rows, asked = pages.in_range(spark, uri, n, since, until)
        assert sorted(tuple(r) for r in rows.select("created", "id", "body").collect()) == sorted(p for p in posts if since <= p[0] < until)
        assert asked <= 2 * math.ceil(math.log2(n) + 1)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "page" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_task_reads_many_pages(spark, tmp_path):
    """70 pages are two tasks, where each was a task of its own."""
    posts, uri = [(i, i, f"p{i}") for i in range(70)], f"file://{tmp_path}"
    pages.land(spark.createDataFrame(posts, "created long, id long, body string"), f"{uri}/pages", 1)
    reader = pages._Backward({"path": f"{uri}/pages", "time": "created", "id": "id", "before": "100"}, ["created", "id", "body"])
    assert reader.latestOffset() == {"page": 70}
    parts = reader.partitions({"page": 0}, {"page": 70})
    assert len(parts) == 2
    assert sorted(r["id"] for p in parts for b in reader.read(p) for r in b.to_pylist()) == list(range(70))


def test_rising_pages_share_folders(spark, tmp_path, monkeypatch):
    """34 pages lie in 7 folders, where each had its own; pages from any folder, its first and its last are found."""
    monkeypatch.setattr(pages, "BLOCK_POSTS", 45)
    posts, uri = _posts(300, 9), f"file://{tmp_path}/pages"
    pages.land(spark.createDataFrame(posts, "created long, id long, body string"), uri, 9, newest_first=False)
    assert len([p for p in (tmp_path / "pages").iterdir() if p.is_dir()]) == 7
    ordered = sorted(p[:2] for p in posts)
    between = pages._between(spark, uri)
    for first, last in ((0, 0), (4, 5), (5, 5), (9, 20), (33, 33), (0, 33)):
        assert sorted(tuple(r) for r in between(first, last).select("created", "id").collect()) == ordered[9 * first : 9 * (last + 1)]
    for since, until in ((10, 20), (0, 1), (49, 60), (-5, 100)):
        rows, _ = pages.in_range(spark, uri, 34, since, until)
        assert sorted(tuple(r) for r in rows.select("created", "id", "body").collect()) == sorted(p for p in posts if since <= p[0] < until)
