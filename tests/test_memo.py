"""The content-addressed memo: calls counted, runs at the same time, runs that died."""

from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkwell.sources import memo


def _memo(spark, path, **more):
    seen = spark.sparkContext.accumulator(0)

    def upper(text: pd.Series) -> pd.Series:
        seen.add(len(text))
        return text.str.upper()

    return memo.Memo(spark, path, "upper", upper, "string", **more), seen


def _rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)


def test_each_text_is_computed_once(spark, tmp_path):
    m, seen = _memo(spark, f"{tmp_path}/memo", buckets=8)
    texts = ["a", "b", "a", None, "", "é" * 1000, "b"]
    for calls, n in ((4, 4), (0, 4)):
        df, called = m.apply(_rows(spark, texts), "text", "up")
        assert called == calls and seen.value == n
        assert {r["id"]: r["up"] for r in df.collect()} == {i: t if t is None else t.upper() for i, t in enumerate(texts)}
    _, called = m.apply(_rows(spark, ["a", "new"]), "text", "up")
    assert called == 1 and seen.value == 5 and len(m.runs()) == 2
    assert m.compact() == 2 and len(m.runs()) == 1
    df, called = m.apply(_rows(spark, [*texts, "new"]), "text", "up")
    assert called == 0 and df.count() == 8 and m.entries().count() == 5


def test_other_options_are_other_entries(spark, tmp_path):
    for i, options in enumerate(({"k": 1}, {"k": 2}, {"k": 1})):
        m, _ = _memo(spark, f"{tmp_path}/memo", options=options)
        assert m.apply(_rows(spark, ["a"]), "text", "up")[1] == (i < 2)


def test_a_run_that_died_is_not_read(spark, tmp_path):
    m, _ = _memo(spark, f"{tmp_path}/memo")
    m.apply(_rows(spark, ["a"]), "text", "up")
    (run,) = m.runs()
    (tmp_path / "memo" / run / "_SUCCESS").unlink()
    assert m.runs() == [] and m.apply(_rows(spark, ["a"]), "text", "up")[1] == 1

    def fails(text):
        raise RuntimeError("lost")

    bad = memo.Memo(spark, f"{tmp_path}/memo", "upper", fails, "string")
    with pytest.raises(Exception, match="lost"):
        bad.apply(_rows(spark, ["b"]), "text", "up")
    assert m.apply(_rows(spark, ["a", "b"]), "text", "up")[1] == 1


def test_runs_at_the_same_time_keep_one_entry_a_key(spark, tmp_path):
    m, _ = _memo(spark, f"{tmp_path}/memo", buckets=4)
    texts = [f"t{i % 40}" for i in range(60)]
    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(lambda _: m.apply(_rows(spark, texts), "text", "up")[0].count(), range(3)))
    assert done == [60] * 3
    keys = m.entries().select("key")
    assert keys.count() == keys.distinct().count() == 40
    assert m.compact() >= 1 and m.entries().count() == 40


def test_only_wanted_buckets_are_read(spark, tmp_path):
    m, _ = _memo(spark, f"{tmp_path}/memo", buckets=16)
    m.apply(_rows(spark, [f"t{i}" for i in range(200)]), "text", "up")
    bucket = spark.range(1).select(m.bucket(m.key(F.lit("t7")))).first()[0]
    rows = m.entries([bucket])
    assert 0 < rows.count() < 60 and {f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()} >= {str(bucket)}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
