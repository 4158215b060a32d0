"""Partial results, torn lines and counts of a write."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkwell.sources import parts

ROWS = [(i, f"s {i % 5}/é", i % 3) for i in range(40)] + [(100, None, 1), (102, "none", 1), (101, "", 2)]


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, source string, v int").repartition(3)


def test_a_run_that_dies_goes_on_and_every_part_is_there_once(spark, rows, tmp_path):
    p = parts.Parts(spark, f"file://{tmp_path}/out", "source")
    made = []

    def compute(r):
        made.append(r.select("source").distinct().count())
        return r.withColumn("v", F.when((F.col("source") == "s 2/é") & F.lit(len(made) < 4), F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("v") * 10))

    assert p.run(rows, compute, at_once=2, most=2) == 2
    with pytest.raises(Exception, match="lost"):
        p.run(rows, compute, at_once=2)
    whole = p.done()
    assert len(whole) == 4
    part = p.read().count()
    assert p.run(rows, compute, at_once=2) == 4 and p.run(rows, compute) == 0
    got = Counter((r.id, r.source, r.v) for r in p.read().collect())
    assert got == Counter((i, s, v * 10) for i, s, v in ROWS) and 0 < part < len(ROWS)


def test_torn_last_lines_are_dropped_and_made_again(spark, rows, tmp_path):
    at = tmp_path / "log"
    at.mkdir()
    (at / "a.json").write_text('{"id": 0, "v": 7}\n{"id": 1, "v": 8}\n{"id": 2, "v"')
    (at / "b.json").write_text('{"id": 3, "v": 9}\n\n')
    calls = []

    def compute(r):
        calls.append(r.count())
        return r.select("id", (F.col("v") + 1).alias("v"))

    assert parts.resume_lines(rows, "id", compute, f"file://{at}", "id long, v int") == 40
    got = {r.id: r.v for r in parts.whole_lines(spark, f"file://{at}", "id long, v int").collect()}
    assert got == {i: {0: 7, 1: 8, 3: 9}.get(i, v + 1) for i, _, v in ROWS}
    assert parts.resume_lines(rows, "id", compute, f"file://{at}", "id long, v int") == 0 and calls == [40]
    (at / "c.json").write_text("{\n[\n")
    with pytest.raises(ValueError, match="2 lines"):
        parts.whole_lines(spark, f"file://{at}", "id long, v int")


def test_counts_come_with_the_write(spark, rows, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def tick(v):
        seen.add(1)
        return v

    once = rows.withColumn("v", tick(F.col("v")).cast("int"))
    got = parts.counted_write(once, f"file://{tmp_path}/out", {"source": ["s 0/é", "", "absent"], "v": [0, 1, 2]})
    want = Counter((s, v) if s in ("s 0/é", "") else (None, None) for _, s, v in ROWS)
    assert {g[:-1]: g[-1] for g in got} == dict(want)
    assert seen.value == len(ROWS) and spark.read.parquet(f"{tmp_path}/out").count() == len(ROWS)
