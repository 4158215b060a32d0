"""Joins that refuse, literals, file normalizing, request plans against plain Python, sinks."""

import hashlib

import pytest
from pyspark.sql import functions as F

from inkwell.functions import cleaning, decode
from inkwell.operators import filters, joins, metrics, normalize, ranking, requests, sampling
from inkwell.sources import sinks


def test_one_to_one_refuses(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    for bad in ([(1,)], [(1,), (2,), (2,)], [(1,), (2,), (3,)], [(1,), (None,)]):
        with pytest.raises(ValueError):
            joins.one_to_one(a, spark.createDataFrame(bad, "k int"), ["k"])
    assert joins.one_to_one(a, spark.createDataFrame([(2,), (1,), (3,)], "k int"), ["k"], exact=False).count() == 2
    scores = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "k int, score double")
    with pytest.raises(ValueError):
        joins.with_predictions(a, {"x": scores}, "k")


def test_aligned_checks_hashes(spark):
    a = spark.createDataFrame([(1, "h", 0.1)], "k int, sha string, score double")
    assert joins.aligned(a, a, "k", "sha").first().asDict() == {"k": 1, "sha": "h", "a": 0.1, "b": 0.1}
    with pytest.raises(ValueError):
        joins.aligned(a, a.withColumn("sha", F.lit("other")), "k", "sha")


def test_literal_texts(spark):
    rows = [("['a', ' ', 'b']",), ("{'x': 'c'}",), ("[{'x': 'd', 'y': 'e'}, 'f']",), ("plain text",), ("42",), ("  ",), (None,), ("'quoted'",)]
    got = spark.createDataFrame(rows, "v string").select(normalize.literal_texts("v").alias("t")).collect()
    assert [r.t for r in got] == [["a", "b"], ["c"], ["d", "e", "f"], ["plain text"], ["42"], [], [], ["quoted"]]


def test_files_by_domain(spark, tmp_path):
    d = tmp_path / "daily news"
    d.mkdir()
    (d / "Set_daily_news_human.csv").write_text('id,label,text,original_id\n7,1,"two\nlines, ""quoted""",\n')
    (d / "Set_daily_news_m1.csv").write_text("id,label,text,original_id\n8,0,made,7\n9,0,made too,\n")
    got = normalize.files_by_domain(spark, str(tmp_path), "files", "Set").orderBy("source_id", "variant").collect()
    assert [(r.source_id, r.variant, r.text, r.label_binary, r.generator) for r in got] == [
        ("daily news:7", "generated:m1", "made", 1, "m1"),
        ("daily news:7", "human", 'two\nlines, "quoted"', 0, None),
        ("daily news:9", "generated:m1", "made too", 1, "m1"),
    ]
    (d / "Set_daily_news_m2.csv").write_text("id,label,text,original_id\n8,1,x,\n")
    with pytest.raises(Exception, match="file name and label differ"):
        normalize.files_by_domain(spark, str(tmp_path), "files", "Set").collect()


def test_named_csv_in_several_files(spark, tmp_path):
    """A name of many bytes was one file and one task; a small one still is."""
    rows = [("a news/Set_a_news_m1.csv", i, 0, f'made, "{i}"\n' + "x" * 1000, i // 2) for i in range(200)]
    rows += [("a news/Set_a_news_human.csv", i, 1, f"own {i}", None) for i in range(5)]
    df = spark.createDataFrame(rows, "path string, id long, label int, text string, original_id long")
    sinks.write_named_csv(df, f"file://{tmp_path}", "path", size=20_000)
    assert (tmp_path / "a news/Set_a_news_human.csv").is_file()
    files = list((tmp_path / "a news/Set_a_news_m1.csv").glob("part-*.csv"))
    assert len(files) == 11 and max(f.stat().st_size for f in files) < 45_000
    got = normalize.files_by_domain(spark, f"file://{tmp_path}", "files", "Set")
    assert sorted((r.source_id, r.variant, r.text) for r in got.collect()) == sorted(
        (f"a news:{i if label else o}", "human" if label else "generated:m1", text) for _, i, label, text, o in rows
    )


def _index(n, *parts):
    return int(hashlib.sha256("\0".join(parts).encode()).hexdigest(), 16) % n


def test_plan_against_plain_python(spark):
    edits = [(f"e{i}", "train" if i < 4 else "test") for i in range(7)]
    pools = requests.Pools(
        styles={"en": [("plain", 2), ("persona", 1)]},
        generators={("en", "mirror"): [("org/a:x", 1), ("b", 3)], ("en", "edit"): [("b", 1), ("c", 1)]},
        reasoning={"org/a:x": [("high", 1), ("low", 2)], "b": [("high", 1)], "c": [("off", 1), ("high", 1)]},
        edits={"en": edits},
        mirrors={"en": {"general": ["about {topic}", "on {topic} in {length_hint}"], "news": ["news: {topic}"]}},
        ineligible=("skip",),
    )
    rows = [("en", "skip" if i % 4 == 0 else "src", str(i), "One two three. Four.", "news" if i % 3 == 0 else "odd") for i in range(12)]
    df = spark.createDataFrame(rows, "language string, source string, source_id string, text string, text_register string")
    got = {(r.source_id, r.slot): r for r in requests.plan(df, pools).collect()}
    assert len(got) == 12 * 2 + 9
    for _, src, sid, _, register in rows:
        first = edits[_index(7, src, sid, "edit0")]
        own = [e for e in edits if e[1] == first[1]]
        left = [e for e in own if e != first]
        second = left[_index(len(left), src, sid, "edit1")]
        assert [got[sid, 0].prompt_id, got[sid, 1].prompt_id] == [first[0], second[0]]
        for slot in (0, 1):
            g = ["b", "c"][_index(2, src, sid, f"gen-edit{slot}")]
            assert got[sid, slot].generator == g and got[sid, slot].prompt == "One two three. Four."
            assert got[sid, slot].reasoning == {"b": "none", "c": "off"}[g]
            assert got[sid, slot].markdown_mode == requests.MARKDOWN_MODES[_index(2, src, sid, g, f"md-edit{slot}")]
        if src != "skip":
            r, g = got[sid, -1], ["org/a:x", "b", "b", "b"][_index(4, src, sid, "gen-mirror")]
            assert r.generator == g
            known = "news" if register == "news" else "general"
            n = len(pools.mirrors["en"][known])
            at = _index(n, src, sid, g, "mirror")
            assert r.prompt_id == f"{known}/v{at + 1}"
            assert r.prompt == pools.mirrors["en"][known][at].format(topic="One two three.", length_hint="50 words")
        else:
            assert (sid, -1) not in got


def test_result_and_paraphrase_rows(spark):
    cols = "kind string, language string, source string, source_id string, text string, generator string, style string, prompt_id string, markdown_mode string, reasoning string, output string"
    rows = [("mirror", "en", "s", "1", "old", "a/b:c", "plain", "news/v1", "default", "low", "<t></think>Sure!\nBody"), ("edit", "en", "s", "1", "old", "g", "plain", "e2", "default", None, "New")]
    a, b = requests.result_rows(spark.createDataFrame(rows, cols)).collect()
    assert (a.text_id, a.text, a.cosine_score, a.bucket, a.meta.reasoning_request) == ("en/s/1/ai_generated/a_b_c/plain", "Body", 1.0, 3, "low")
    assert (b.text_id, b.text, b.text_type, b.bucket) == ("en/s/1/ai_edited/g/plain/e2", "New", "ai_edited", None)
    rows = [("1", "en", "abcd", "efgh"), ("2", "en", "abcd", "abcd"), ("3", "en", "abcd", "x"), ("4", "zh-tw", "我們這國", "们这国说"), ("5", "en", "abcd", " "), ("6", "en", "abcd", "a</think>efghi")]
    p = requests.paraphrased(spark.createDataFrame(rows, "text_id string, language string, text string, out string"), "out", F.lit("m")).orderBy("text_id").collect()
    assert [(r.text_id, r.text) for r in p] == [("1/para", "efgh"), ("6/para", "efghi")]


def test_costs(spark):
    rows = [(str(i), "en" if i % 2 else "ja", "x" * (10 + i)) for i in range(20)]
    models = {"a": (0.5, 1.0, True), "b": (2.0, 3.0, False)}
    got = requests.estimate_cost(spark.createDataFrame(rows, "text_id string, language string, text string"), models, {"en": 30, "ja": 9}).first()
    tin = tout = cost = 0
    for key, lang, text in rows:
        m = models[["a", "b"][_index(2, key, "para")]]
        body = len(text) / (4.0 if lang == "en" else 1.5)
        head = body + {"en": 30, "ja": 9}[lang] / 3.0
        tin, tout, cost = tin + int(head), tout + int(body), cost + (head * m[0] + body * m[1]) * (0.5 if m[2] else 1.0)
    assert (got.rows, got.tokens_in, got.tokens_out) == (20, tin, tout) and abs(got.cost - cost) < 1e-9
    e = spark.createDataFrame([("ai_edited", "aaaa", "bb"), ("ai_edited", "aaaa", "cc"), ("human_written", "zz", "z")], "text_type string, text string, source_text string")
    assert requests.embedding_cost(e, 2.0).first().asDict() == {"texts": 3, "cost": 4.0}


def test_running_over_many_ranges(spark):
    vals = [(i % 3 or None, (i * 37 % 101) / 7) for i in range(300)]
    df = spark.createDataFrame(vals, "g int, x double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.x): (r.n, r.n_before, r.n_total) for r in ranking.counted(df, ["g"], "x").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for (g, x), found in got.items():
        own = [b for a, b in vals if a == g]
        assert found == (own.count(x), sum(b < x for b in own), len(own))
    assert metrics.auroc(df.where("x < 0").withColumn("label", F.lit(1)).withColumnRenamed("x", "score"), ["g"]).count() == 0


def test_markdown_and_decoding(spark):
    t = "# Head\n> quote\n- **bold** [link](u) &amp; `code` ![i](p)\n|a|b|\n---\nend ,x"
    assert spark.createDataFrame([(t,)], "t string").select(cleaning.plain_markdown(F.col("t")).alias("p")).first().p == "Head bold link & b| end,x"  # bars go in pairs, so a third one stays
    calib = {"head_type": "seqcls", "score_min": 0.0, "score_max": 1.0, "flip": False, "binary_threshold": 0.5, "h_thresh": 0.3, "ai_thresh": 0.7, "label_names": ["human", "AI", "edited"], "bucket_descriptions": ["a", "b"]}
    r = spark.createDataFrame([([0.0, 9.0],), ([9.0, 0.0],), ([0.0, 0.0],)], "x array<double>").select(decode.decoded(F.col("x"), calib).alias("d"), decode.decoded(F.col("x"), calib, True).label.alias("b")).collect()
    assert [(x.d.label, x.b) for x in r] == [("AI", "AI"), ("human", "human"), ("edited", "human")]
    assert r[2].d.ai_involvement == 0.5 and r[2].d.bucket_probs == {"a": 0.5, "b": 0.5}


def test_filters_refuse_and_fill(spark):
    rows = spark.createDataFrame([("1", "ai_edited", "a{b", 2)], "text_id string, text_type string, text string, bucket int")
    with pytest.raises(ValueError):
        filters.require_humans(rows)
    assert filters.prepared(rows, "<{text}>").first().prompt == "<a{b>"
    assert spark.createDataFrame([("[deleted]",), (" ",), (None,), ("kept",)], "t string").where(filters.is_tombstone(F.col("t"))).count() == 3


def test_balanced_models(spark):
    rows = [(s, f"m{m}") for s in range(6) for m in range(3)]
    got = sampling.balanced_models(spark.createDataFrame(rows, "s int, m string"), "s", "m", 6)
    assert sorted(got) == list(range(6)) and sorted(got.values()) == ["m0", "m0", "m1", "m1", "m2", "m2"]


def test_sinks(spark, tmp_path):
    rows = [("r2", 'say "hi"\nthere', "train", ("x",)), ("r1", "a,b", "val", ("y",))]
    df = spark.createDataFrame(rows, "row_id string, text string, split string, meta struct<k:string>")
    assert sinks.write_splits(df, str(tmp_path / "s"), ["row_id", "text", "meta"]) == {"train": 1, "val": 1}
    back = {r.row_id: r for r in sinks.read_rows(spark, str(tmp_path / "s"), "row_id string, text string, meta string, split string").collect()}
    assert back["r2"].text == 'say "hi"\nthere' and back["r2"].meta == '{"k":"x"}' and back["r1"].split == "val"
    m = sinks.write_snapshot(df, str(tmp_path / "n"), "src", "rev", {"note": 1})
    assert m["rows"] == 2 and m["rows_sha256"] == hashlib.sha256(b"r1\nr2").hexdigest()
    with pytest.raises(ValueError):
        sinks.write_snapshot(df, str(tmp_path / "n"), "src", "rev", {"rows": 1})
    log = str(tmp_path / "log")
    one = sinks.append_scores(df.where("row_id = 'r1'"), lambda d: d.withColumn("score", F.lit(1.0)), log, {"model": "a"})
    assert one.count() == 1
    two = sinks.append_scores(df, lambda d: d.withColumn("score", F.lit(2.0)), log, {"model": "a"})
    assert {r.row_id: r.score for r in two.collect()} == {"r1": 1.0, "r2": 2.0}
    with pytest.raises(ValueError):
        sinks.append_scores(df, lambda d: d, log, {"model": "b"})


def test_requests_skip_failures_and_stop_at_refusals(spark):
    plan = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "fine")], "ord int, prompt string")

    def call(p):
        if p == "bad":
            raise RuntimeError(p)
        return p.upper()

    assert [(r.ord, r.output) for r in sinks.run_requests(plan, call).orderBy("ord").collect()] == [(1, "OK"), (3, "FINE")]

    def refused(p):
        raise PermissionError(p)

    with pytest.raises(Exception, match="PermissionError"):
        sinks.run_requests(plan, refused).collect()


def test_graded_scores_by_head(spark):
    df = spark.createDataFrame([("seqcls", [0.0, 0.0, 50.0]), ("corn", [50.0, 50.0, -50.0])], "head string, x array<double>")
    got = [r.s for r in df.select(decode.graded_score(F.col("x"), F.col("head")).alias("s")).collect()]
    assert abs(got[0] - 1.0) < 1e-9 and abs(got[1] - 2 / 3) < 1e-9
    with pytest.raises(Exception, match="unknown head"):
        df.withColumn("head", F.lit("other")).select(decode.graded_score(F.col("x"), F.col("head"))).collect()


def test_reports_manifests_and_top_ups(spark):
    rows = [("train", "en", "human_written", "news", None, None), ("train", "en", "ai_edited", None, "m", 0.5), ("val", "ja", "ai_generated", None, "m", 0.25)]
    shipped = spark.createDataFrame(rows, "split string, language string, text_type string, text_register string, model string, cost double")
    dropped = spark.createDataFrame([("empty",), ("empty",), ("refusal",)], "drop_reason string")
    hits = spark.createDataFrame([(2,), (9,), (4,)], "n_shared long")
    r = {k: sorted(tuple(x) for x in v.collect()) for k, v in sinks.build_report(shipped, dropped, hits).items()}
    assert r["splits"] == [("train", 2), ("val", 1)] and r["classes"] == [("en", 1, 0, 1), ("ja", 0, 1, 0)]
    assert r["registers"] == [("en", "news", 1)] and r["drops"] == [("empty", 2), ("refusal", 1)]
    assert r["overlap"] == [(3, 9, 4)] and r["cost"] == [("m", 2, 0.75)]
    p = spark.createDataFrame([("en", "p1", "do"), ("en", "p1", "do")], "language string, prompt_id string, text string")
    assert [tuple(x) for x in sinks.prompt_manifest(p, p, p).orderBy("kind").collect()] == [(k, "en", "p1", "do") for k in ("edit", "mirror", "system")]
    pool = spark.createDataFrame([(i,) for i in range(6)], "k int")
    assert sorted(x.k for x in sinks.top_up(pool, pool.where("k < 2"), ["k"], 3, ["k"]).collect()) == [2, 3, 4]


def test_empty_frames(spark):
    none = spark.createDataFrame([], "g string, label int, score double")
    for f in (metrics.auroc, metrics.detection):
        assert f(none, ["g"]).count() == 0
    assert metrics.tpr_variants(none, ["g"], 0.05).count() == 0
    assert metrics.conformal_threshold(none, ["g"], 0.05).count() == 0
    assert ranking.with_average_rank(none, ["g"], "score", "r").columns == ["g", "label", "score", "r"]


def test_null_group_keeps_its_ranks(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0), (None, 2.0), ("a", None), ("a", 3.0)], "g string, x double")
    got = sorted(((r.g or "", r.x or 0.0, r.k) for r in ranking.with_average_rank(df, ["g"], "x", "k").collect()), key=repr)
    assert got == [("", 1.0, 1.5), ("", 1.0, 1.5), ("", 2.0, 3.0), ("a", 0.0, None), ("a", 3.0, 1.0)]
