"""Queries over texts that are empty, blank, null or not plain, each against its SQL."""

import duckdb
import pytest

from inkwell.operators import normalize
from inkwell.plans.catalog import ORACLES, QUERIES

#: Four of each, so that every variant and label meets them.
TEXTS = [t for t in ("own words", "", " \n\t", None, 'a "quoted" \\ text', "ends\r\nof lines\r") for _ in range(4)]
NAMES = [
    "normalize_polished",
    "normalize_prompted",
    "normalize_files",
    "normalize_variants",
    "release_normalize",
    "snapshot_digest",
    "memoised_values",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("blank")
    con = duckdb.connect()
    con.execute("create table d (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into d values (?, ?, ?, ?, ?)", [(i, t, None if i == 5 else "en", None if i == 6 else "s", len(t or "")) for i, t in enumerate(TEXTS)])
    con.execute(f"copy d to '{at}/documents.parquet' (format parquet)")
    con.execute(f"copy (select 1::bigint as item_id, 'an item' as text union all select 2, '') to '{at}/benchmark.parquet' (format parquet)")
    return str(at)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    want = con.execute(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("text", ["", None])
def test_a_blank_text_can_be_refused(spark, text):
    rows = spark.createDataFrame([(1, "x", None, "d"), (2, text, None, "d")], "id int, generation string, p string, domain string")
    human = normalize.polished("b", rows.selectExpr("id", "generation", "domain", "p AS polish_type", "p AS polishing_degree", "0 AS polishing_percent", "p AS polisher").where("false"), rows)
    assert human.count() == 2 and normalize.refuse_blank(human.where("source_id = '1'")).count() == 1
    with pytest.raises(Exception, match="empty text in b"):
        normalize.refuse_blank(human).collect()
