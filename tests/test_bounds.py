"""What a query hands to Python at a time, and what its steps write and shuffle."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkwell.plans import catalog
from inkwell.sources import memo, store


@pytest.mark.parametrize("name", ["normalize_variants", "passage_chunks", "html_extract", "gate_first_failure"])
def test_texts_come_to_python_in_bounded_batches(spark, sf_dir, name):
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    catalog.QUERIES[name](spark, sf_dir)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20


def test_a_digest_sorts_in_many_tasks(spark):
    """One task takes the blocks of all ranges; before, it sorted the ranges themselves."""
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.col("id").cast("string").alias("v")).repartition(7)
    wanted = [str(i) for i in sorted(range(5000), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())]
    found = store.ordered_digest(rows, "k", "d", "v")
    assert found.first().asDict() == {"n": 5000, "d": hashlib.sha256("\n".join(wanted).encode()).hexdigest()}
    assert store.ordered_digest(rows.where("k = 'none'"), "k", "d").first().asDict() == {"n": 0, "d": hashlib.sha256(b"").hexdigest()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_a_memo_writes_no_texts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "folder", lambda _, n=iter(range(99)): f"file://{tmp_path}/{next(n)}")
    kept = memo.Memo(spark, f"file://{tmp_path}/memo", "length", lambda t: t.str.len(), "long")
    rows = spark.createDataFrame(pd.DataFrame({"i": range(60), "t": [f"{i % 20} " * 50 for i in range(60)]}))
    for n, calls in ((40, 20), (60, 0)):
        out, called = kept.apply(rows.where(F.col("i") < n), "t", "x")
        assert called == calls and all(r.x == len(r.t) for r in out.collect())
    more = rows.select((F.col("i") + 100).alias("i"), F.concat("t", F.when(F.col("i") < 5, "y").otherwise("")).alias("t"))
    assert kept.apply(more, "t", "x")[1] == 5
    assert not [p for p in tmp_path.iterdir() if p.name != "memo" and "text" in spark.read.parquet(str(p)).columns]
