"""Cases that the tables don't hold: chains, scripts, wrappers, metric laws."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkwell.functions import cleaning, decode
from inkwell.operators import dedup, gates, metrics, sampling
from inkwell.plans import catalog
from inkwell.sources import passages, store
from inkwell.textfn import word_count


def test_greedy_dedup_keeps_the_end_of_a_chain(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (4, 6), (5, 6)], "a long, b long")
    assert sorted(r.id for r in dedup.greedy_keep(pairs, store.materialise).collect()) == [2, 5, 6]


@pytest.mark.parametrize("n, local", [(501, dedup.LOCAL_PAIRS), (24, 2)])
def test_greedy_dedup_of_a_long_chain(spark, n, local):
    """In one task, and by rounds until two pairs are left."""
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, n)], "a long, b long").coalesce(1)
    assert sorted(r.id for r in dedup.greedy_keep(pairs, store.materialise, local).collect()) == list(range(2, n + 1, 2))


@pytest.mark.parametrize("local", [dedup.LOCAL_PAIRS, 3])
def test_near_dedup_is_greedy(spark, local):
    """Against a plain greedy pass: chains of revisions, case, punctuation, short and other texts."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    rows = [(0, "Word0 Word1 a b c d", "en"), (1, "word0, word1, a b c d", "en"), (2, "one two", "en"), (3, " one two\n", "en"), (4, "one  two", "en"), (5, "", "en"), (6, " ", "en"), (7, None, "en"), (8, None, "fr")]
    text = [rng.choice(words) for _ in range(60)]
    for i in range(9, 60):  # a word changes at a time, and sometimes the text begins anew
        text = [rng.choice(words) for _ in range(60)] if i % 17 == 0 else [w if rng.random() > 0.02 else rng.choice(words) for w in text]
        rows.append((i, " ".join(text), ("en", "fr")[i % 2]))
    rows += [(100, "abcdefghijkl", "fr"), (101, "abcdefghijkl", "fr"), (102, "abcdefghi", "fr"), (103, "abcdefghi ", "fr"), (104, "abcdefghi", "de"), (105, "abcdefghi", None), (106, "abcdefghi", None)]
    kept, dropped = [], set()
    for i, t, lang in rows:
        if t is None:
            continue
        units, n = (t.split(), 5) if lang == "en" else (list(t.strip()), 10)
        grams = {tuple(units[j : j + n]) for j in range(len(units) - n + 1)} or t.strip()
        same = lambda g: g == grams if isinstance(grams, str) or isinstance(g, str) else len(g & grams) / len(g | grams) >= 0.8
        if any(same(g) for k, g in kept if k == lang):
            dropped.add(i)
        else:
            kept.append((lang, grams))
    df = spark.createDataFrame(rows, "doc_id long, text string, language string")
    sets = store.materialise(dedup.distinct_sets(store.materialise(dedup.shingled(df, "doc_id", ["language"], "language"))))
    pairs = dedup.near_pairs(sets.where("id = rep").select("id", "grp", "grams"))
    gone = {r.id for r in dedup.greedy_keep(pairs, store.materialise, local).collect()} | {r.id for r in sets.where("id <> rep").collect()}
    assert gone == dropped and len(dropped) > 20
    if local > 3:
        assert {r.id for r in dedup.near_dedup(df, "doc_id", ["language"], store.materialise).collect()} == dropped


def test_posts_keep_what_is_no_mark(spark):
    texts = ["about ~ 5 apples", "  # Head\n  > quote", "      - six spaces", "~~gone~~ `x` ***b*** a_b", "see [it](http://x.y/z) or https://q.r/s t"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(cleaning.clean_post(F.col("t")).alias("x")).collect()]
    assert got == ["about ~ 5 apples", "Head\nquote", "- six spaces", "gone x b ab", "see [it]( or t"]  # an address goes first, with the bracket after it


def first_gate(text, kind, lang, src, finish):
    """The first gate a row fails, in plain Python."""
    ai, en = kind != "human_written", lang == "en"
    size = lambda t: len(re.findall(r"\w+", t)) if en else len(re.findall("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f]", t))
    units = lambda t: t.split() if en else list(t)
    n = gates.COPY_WORDS if en else gates.COPY_CHARS
    grams = lambda t: {tuple(units(t)[i : i + n]) for i in range(len(units(t)) - n + 1)}
    if ai and not text.strip():
        return "empty"
    if ai and finish == "length":
        return "truncated"
    if ai and any(p in text[:200].lower() for p in gates.REFUSALS):
        return "refusal"
    if ai and lang == "zh-tw" and size(text) and sum(c in gates.SIMPLIFIED for c in text) / size(text) > gates.SIMPLIFIED_SHARE:
        return "wrong_script_simplified"
    if kind == "ai_generated" and src:
        if size(src) and not gates.LENGTH_BAND[0] <= size(text) / size(src) <= gates.LENGTH_BAND[1]:
            return "length_mismatch"
        if grams(text) & grams(src):
            return "regurgitation"
    if kind == "ai_edited" and src and text.strip() == src.strip():
        return "noop_edit"
    return None


def test_gates_of_every_language(spark, tmp_path):
    rng = random.Random(3)
    han = lambda n: "".join(rng.choice("東京都議會今天決定水火木金土日月山川") for _ in range(n))
    copied, latin = han(40), "un deux trois quatre cinq six sept huit neuf dix onze douze treize"
    texts = [(0, han(50), "zh-tw"), (1, han(200), "zh-tw"), (2, "们这国说时" + han(20), "zh-tw"), (3, copied + han(9), "ja"), (4, han(5) + copied, "ja"),
             (6, latin, "fr"), (7, latin, "fr"), (8, latin, "fr"), (9, latin, None), (10, latin + " x", None), (11, latin, "de"), (12, han(60), None), (13, han(8), None),
             (14, "I cannot help", "de"), (15, latin, "en"), (16, latin, "en")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.drop_reason for r in catalog.QUERIES["gate_first_failure"](spark, str(tmp_path)).collect()}
    by_id = {i: t for i, t, _ in texts}
    kinds = ["human_written", "ai_generated", "ai_edited"]
    as_read = lambda i, t: "I cannot help. " + t if i % 13 == 1 else "们这国东京都" + t if i % 17 == 1 else t
    want = {i: first_gate(as_read(i, t), kinds[i % 3], "zh-tw" if i % 17 == 1 else lang, by_id.get(i - 1), "length" if i % 11 == 0 else "stop") for i, t, lang in texts}
    assert got == want
    assert {"length_mismatch", "wrong_script_simplified", "regurgitation", "noop_edit", "refusal", "truncated", None} <= set(want.values())


def test_gates_in_order(spark):
    rows = [
        (1, " ", "ai_generated", "en", "x", "stop", "empty"),
        (2, "cut", "ai_edited", "en", "y", "length", "truncated"),
        (3, "I'm unable to do so", "ai_generated", "en", "I'm unable to do so", "stop", "refusal"),
        (4, "们这国说时会个", "ai_edited", "zh-tw", "x", "stop", "wrong_script_simplified"),
        (5, "one", "ai_generated", "en", "one two three four five", "stop", "length_mismatch"),
        (6, " same ", "ai_edited", "en", "same", "stop", "noop_edit"),
        (7, "As an AI I help", "human_written", "en", None, "stop", None),
    ]
    df = spark.createDataFrame(rows, "id int, text string, text_type string, language string, source_text string, finish_reason string, want string")
    got = df.withColumn("drop_reason", gates.drop_reason()).collect()
    assert [r.drop_reason for r in got] == [r.want for r in got]


def test_cleaning_literals(spark):
    rows = [("Ｈｅｌｌｏ",), ("Sure!\nBody here",), ("a</think> b </think>c",), ("раѕѕ",), ("hi 😀",), ("a　​b",)]
    df = cleaning.clean_text(spark.createDataFrame(rows, "t string"), "t", "c")
    assert [r.c for r in df.collect()] == ["hello", "body here", "b", "pass", "hi :grinning_face:", "a b"]
    w = spark.createDataFrame([("Sure!\nBody",), ("My top picks:\nA",), ("Here is the text:\nB",)], "t string").select(cleaning.strip_wrapper(F.col("t")).alias("w")).collect()
    assert [r.w.clean for r in w] == ["Body", "My top picks:\nA", "B"]


def test_metric_laws(spark):
    rows = [(0, i / 10) for i in range(5)] + [(1, 0.5 + i / 10) for i in range(5)]
    df = spark.createDataFrame(rows, "label int, score double")
    assert metrics.auroc(df, []).first().auroc == 1.0
    assert metrics.best_threshold(df).first().f1 == 1.0
    flat = spark.createDataFrame([(i % 2, 0.5) for i in range(10)], "label int, score double")
    assert metrics.auroc(flat, []).first().auroc == 0.5
    few = spark.createDataFrame([(0, 0.1), (0, 0.2), (0, 0.3)], "label int, score double")
    assert metrics.conformal_threshold(few, [], 0.01).first().threshold == float("inf")


def test_proportional_quotas(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(10)], "row_id int, s string")
    got = sampling.proportional(df, ["s"], "row_id", 5).collect()
    assert sorted(r.row_id for r in got) == [0, 1, 2, 3, 7] or sorted(r.row_id for r in got) == [0, 1, 2, 7, 8]


def test_corn_and_chunks(spark):
    df = spark.createDataFrame([([10.0, 10.0, -10.0], "a b c\n\nd e\nf g h i\nj")], "x array<double>, t string")
    r = df.select(decode.corn_cumulative(F.col("x")).alias("c"), passages.chunks(F.col("t"), word_count, 4, 5).alias("p")).select("p", decode.corn_rank(F.col("c")).alias("rank"), decode.corn_buckets(F.col("c")).alias("b")).first()
    assert r.rank == 2 and abs(sum(r.b) - 1) < 1e-9 and r.p == ["a b c\nd e", "f g h i", "j"]
