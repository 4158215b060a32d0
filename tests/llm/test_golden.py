"""Golden records against plain Python, over few and many ranges and batches."""

import datetime as dt
import math
import random
import re

import pytest

from inkwell.llm import golden

SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, cluster string, pos int, age string, trust double"


def _records(seed: int, n: int):
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        when = None if r.random() < 0.15 else start + dt.timedelta(days=r.randint(0, 14), microseconds=r.choice([0, 0, 1, 5]))
        text = lambda *x: r.choice([None, "", " \t\r", *x])
        master = 7 if i % 3 == 0 else None if r.random() < 0.2 else r.randint(0, n // 4)
        rows.append((
            i if r.random() > 0.02 else None, master, r.choice(["store", "crm", "partner", "web", "else", None]), when, text("Ann", "Bée", " Joe", "Zoë Long", "Longer Nam"), text("a@x", "b@x", "c@x"),
            text("Ard", "Bel"), r.choice([None, 1, 2]), text("retail", "public", "online"), r.choice([None, 0.0, -1.005, 2.675, 99.99, math.nan, math.inf]), "clash", 1, "clash", 0.5,
        ))
    return rows + rows[: n // 10]  # repeated rows


def _plain(rows):
    solid = lambda x: x if x is not None and re.search(r"[^\x20\x09-\x0D]", x) else None
    trust = {s: i for i, s in enumerate(golden.TRUST)}
    by: dict = {}
    for client, master, source, when, name, email, city, nation, segment, balance, *_ in rows:
        cents = None if balance is None or not math.isfinite(balance) else math.floor(100 * balance + 0.5)
        by.setdefault(client if master is None else master, []).append((client, trust.get(source, 4), when, solid(name), solid(email), solid(city), nation, solid(segment), cents))
    out = []
    for cluster, rs in by.items():
        late = max((x[2] for x in rs if x[2]), default=None)
        recent = lambda x: (x[2] is None, -(x[2] - dt.datetime(2000, 1, 1)) // dt.timedelta(microseconds=1) if x[2] else 0, x[1], x[0] is None, x[0] or 0)
        rs = sorted(rs, key=recent)
        stale = lambda x: x[2] is None or late - x[2] > dt.timedelta(days=10)
        trusted = lambda x: (stale(x), x[1], rs.index(x))
        first = lambda i, key: min((x for x in rs if x[i] is not None), key=key, default=(None,) * 9)
        name, email = first(3, lambda x: (-len(x[3]), trusted(x))), first(4, trusted)
        segment = first(7, rs.index)
        balance = first(8, lambda x: (x[7] is None or x[7] != segment[7], rs.index(x)))
        address = min(rs, key=lambda x: ((x[5] is None) + (x[6] is None), rs.index(x)))
        out.append((cluster, len(rs), sum(map(stale, rs)), name[3], email[4], segment[7], address[5], address[6], balance[8],
                    name[0], email[0], segment[0], balance[0], address[0] if address[5] is not None or address[6] is not None else None))
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def odd_conf(spark):
    keys = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.enabled")}
    yield spark.conf
    for k, v in keys.items():
        spark.conf.set(k, v)


def _fixed(rows):
    """Rows whose RECENT keys are equal but whose values differ may come in any order: such keys are made unique."""
    seen, out = {}, []
    for r in rows:
        key = (r[0] if r[1] is None else r[1], r[3], r[2], r[0])
        if seen.setdefault(key, r) == r:
            out.append(r)
    return out


@pytest.mark.parametrize(("n", "ranges", "batch"), [(60, 1, 10_000), (60, 25, 3), (400, 7, 5), (400, 40, 1), (400, 3, 64)])
def test_against_plain_python(spark, odd_conf, n, ranges, batch):
    odd_conf.set("spark.sql.shuffle.partitions", ranges)
    odd_conf.set("spark.sql.adaptive.enabled", "false")
    odd_conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rows = _fixed(_records(n + ranges, n))
    df = golden.golden_records(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert _got(df) == _plain(rows)


def test_spanning_clusters_are_few_whatever_the_rows(spark, odd_conf):
    odd_conf.set("spark.sql.shuffle.partitions", 6)
    odd_conf.set("spark.sql.adaptive.enabled", "false")
    rows = _fixed(_records(3, 3000))
    across = golden.spanning(golden.ordered(spark.createDataFrame(rows, SCHEMA)))
    assert 1 <= len(across) <= 6 and 7 in across


def test_stale_to_the_microsecond_and_empty(spark):
    base = dt.datetime(2024, 3, 20)
    tail = ("clash", 1, "clash", 0.5)
    rows = [(1, None, "web", base, None, None, None, None, None, None, *tail)]
    rows += [(i, 1, "store", base - dt.timedelta(days=10, microseconds=us), None, f"{i}@x", None, None, None, None, *tail) for i, us in ((2, 0), (3, 1))]
    (r,) = golden.golden_records(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (r.n_records, r.n_stale, r.email, r.address_from, r.city) == (3, 1, "2@x", None, None)
    assert golden.golden_records(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_run_ends_where_the_order_breaks():
    import pyarrow as pa

    one = lambda *pos: pa.RecordBatch.from_arrays([pa.array(pos, pa.int64())], ["pos"])
    cut = [(b.column(0).to_pylist(), new) for b, new in golden._runs([one(4, 5), one(6, 9, 10), one(0, 1)])]
    assert cut == [([4, 5], True), ([6], False), ([9, 10], True), ([0, 1], True)]
