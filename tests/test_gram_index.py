"""The kept index of reference grams: grown by corpus, attached again, joined in place."""

import re

import pytest
from pyspark.sql import functions as F

from inkwell.operators import decontam


def _grams(text, k=4):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


REF = {"a": ["one two three four five six", None, "", "Short one"], "b": ["THREE four, five six seven eight", "é ü ß ñ ö"], "c": ["nothing in common here at all"]}
DOCS = [(1, "zero one two three four five six seven eight nine"), (2, "short ONE"), (3, None), (4, "é ü ß ñ"), (5, "other words than those of any"), (1, "three four five six")]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, gram string")


def _want(corpora):
    ref = set().union(*(_grams(t) for c in corpora for t in REF[c]))
    out: dict = {}
    for i, t in DOCS:
        out[i] = out.get(i, 0) + len(_grams(t) & ref)
    return {i: n for i, n in out.items() if n}


def test_grows_by_corpus_and_equals_a_rebuild(spark, docs, tmp_path):
    index = decontam.GramIndex(spark, f"file://{tmp_path}/index", k=4, buckets=4)
    for i, c in enumerate("abc"):
        index.add(c, spark.createDataFrame([(t,) for t in REF[c]], "text string"))
        assert {r.doc_id: r.n_shared for r in index.overlap(docs).collect()} == _want("abc"[: i + 1])
    files = {p.name for p in (tmp_path / "index" / "corpus=a").iterdir()}
    index.add("b", spark.createDataFrame([(t,) for t in REF["b"]], "text string"))  # again: replaced, not doubled
    assert {p.name for p in (tmp_path / "index" / "corpus=a").iterdir()} == files
    assert index.corpora() == ["a", "b", "c"] and index.grams().count() == sum(len(set().union(*map(_grams, REF[c]))) for c in "abc")
    assert {r.doc_id: r.n_shared for r in index.overlap(docs, corpora=["a", "c"]).collect()} == _want("ac")


def test_another_session_attaches_it(spark, docs, tmp_path):
    first = decontam.GramIndex(spark, f"file://{tmp_path}/index", k=4, buckets=4)
    first.add("a", spark.createDataFrame([(t,) for t in REF["a"]], "text string"))
    spark.sql(f"DROP TABLE {first.name}")
    again = decontam.GramIndex(spark, f"file://{tmp_path}/index", k=4, buckets=4)
    assert again.corpora() == ["a"] and {r.doc_id: r.n_shared for r in again.overlap(docs).collect()} == _want("a")


def test_the_reference_is_not_shuffled(spark, docs, tmp_path):
    index = decontam.GramIndex(spark, f"file://{tmp_path}/index", k=4, buckets=4)
    index.add("a", spark.createDataFrame([(t,) for t in REF["a"]], "text string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = index.overlap(docs.coalesce(1))._jdf.queryExecution().sparkPlan().toString()
        whole = index.overlap(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in whole and "Join" in plan
    scan = whole[whole.index("FileScan parquet") - 200 :]
    assert "Exchange hashpartitioning(gram" not in scan and whole.count("Exchange hashpartitioning(gram") == 1


def test_grams_are_those_of_word_runs(spark):
    texts = [t for ts in REF.values() for t in ts] + [t for _, t in DOCS]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", decontam.grams(F.col("t"), 4).alias("g")).collect()
    assert {r.i: None if r.g is None else len(set(r.g)) for r in got} == {i: None if t is None else len(_grams(t)) for i, t in enumerate(texts)}
