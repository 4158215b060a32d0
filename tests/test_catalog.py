"""Every query against its SQL, value by value."""

import math

import duckdb
import pytest

from inkwell.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(rows):
    flat = [tuple(round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r) for r in rows]
    return sorted(flat, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = norm(map(tuple, df.select(*cols).collect()))
    assert got
    if name in ORACLES:
        rel = con.execute(f"select {', '.join(cols)} from ({ORACLES[name]})")
        want = norm(rel.fetchall())
        assert len(got) == len(want)
        bad = [(a, b) for a, b in zip(got, want) if any((x != y) and not (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-5)) for x, y in zip(a, b))]
        assert not bad, bad[:3]
