"""Landed files and sources as canonical rows, and the calibration record."""

import json

import pytest
from pyspark.sql import functions as F

from inkwell.operators import metrics
from inkwell.sources import readers, sinks

WORDS = " ".join(f"word{i}" for i in range(80))
KANJI = "漢" * 160


def test_jsonl_splits_at_line_feeds_only(spark, tmp_path):
    odd = "a b\u0085c"
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps({"text": t}, ensure_ascii=False) for t in (odd, "d")) + "\n", encoding="utf-8")
    got = readers.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", "text string").collect()
    assert sorted(r["text"] for r in got) == [odd, "d"]
    assert readers.read_jsonl(spark, f"file://{tmp_path}/none.jsonl", "text string").isEmpty()


def test_split_has_its_meta_back(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a "quoted"\nline', ("t", 5)), ("2", None, None)], "text_id string, text string, meta struct<topic:string,length:int>")
    sinks.write_rows(rows, f"file://{tmp_path}/s")
    got = readers.read_split(spark, f"file://{tmp_path}/s", "text_id string, text string, meta string", "topic string, length int").orderBy("text_id").collect()
    assert got[0]["text"] == 'a "quoted"\nline' and got[0]["meta"]["length"] == 5
    assert got[1]["text"] is None and got[1]["meta"] is None


def test_bytes_literals_are_decoded(spark):
    rows = spark.createDataFrame([(1, str("日本".encode())), (2, "b'broken"), (3, "(" * 9000), (4, None), (5, "")], "i int, t string")
    got = [r["x"] for r in rows.select("i", readers.decoded(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == ["日本", "b'broken", "(" * 9000, "", ""]


def test_wiki_without_segments(spark):
    rows = spark.createDataFrame([(1, "_START_ARTICLE__NEWLINE_"), (2, "_START_ARTICLE_ A _START_SECTION_ B _NEWLINE_c"), (3, " plain ")], "i int, t string")
    got = rows.select("i", readers.wiki_article(F.col("t")).alias("a")).orderBy("i").collect()
    assert [tuple(r["a"]) for r in got] == [("", ""), ("A", "B \nc"), ("", "plain")]


def test_every_source_takes_its_columns_and_empty_tables(spark):
    shapes = {
        "editlens": "text string, source string, source_id string, text_type string",
        "wiki40b-ja": "text string, wikidata_id string, version_id string",
        "wiki40b-zh-tw": "text string, wikidata_id string, version_id string",
        "amazon-reviews-ja": "text string, id string, label int",
        "open2ch": "id string, board string, dialogue struct<speaker:array<int>,content:array<string>>",
        "wikinews-ja": "body string, pageid long, revid long, title string, timestamp string",
        "ptt": "body string, board string, post_id string, title string",
        "twgov": "body string, s string, title string, unit string, pub_date string",
        "fineweb": "text string, id string, dump string, url string, date string",
        "arxiv-abstracts": "text string, id string, created string",
        "wikinews-en": "text array<string>, pageid long, title string, date string, lang string",
        "gutenberg": "TEXT string, METADATA string",
        "amazon-reviews-en": "text string, parent_asin string, user_id string, rating double, category string",
        "stackexchange": "INSTRUCTION string, RESPONSE string, SOURCE string",
        "reddit-l2": "body string, subreddit string, id string, title string, country string",
    }
    assert set(shapes) == set(readers.SOURCES)
    for name, schema in shapes.items():
        empty = readers.human_rows(spark.createDataFrame([], schema), readers.SOURCES[name], 5)
        assert empty.columns == ["text", "language", "source", "source_id", "text_register", "meta"]
        assert empty.isEmpty()


def test_rows_of_sources(spark):
    one = lambda name, rows, schema: readers.human_rows(spark.createDataFrame(rows, schema), readers.SOURCES[name]).orderBy("source_id").collect()
    board = one("ptt", [(KANJI, "Food", "M.1500000000.A.1", "t"), (KANJI, "Food", "M.1700000000.A.1", "t"), ("短", "Food", "M.1500000000.A.2", "t")], "body string, board string, post_id string, title string")
    assert [(r["source_id"], r["text_register"]) for r in board] == [("Food/M.1500000000.A.1", "reviews")]
    turns = one("open2ch", [("7", "b", ([1, 2, 3], [KANJI, "", "終"]))], "id string, board string, dialogue struct<speaker:array<int>,content:array<string>>")
    assert turns[0]["text"] == KANJI + "\n終"
    book = "\n\n".join(["front"] * 3 + [WORDS, "rest"])
    books = one("gutenberg", [(book, '{"text_id": 12, "title": "T"}'), (book, "{broken"), (book, '{"language": "fr"}'), (None, None)], "TEXT string, METADATA string")
    assert {r["source_id"] for r in books} == {"12", books[0]["source_id"] if books[0]["source_id"] != "12" else books[1]["source_id"]} and len(books) == 2
    assert all(r["text"].startswith("word0") for r in books)
    press = one("twgov", [("發稿單位：x\n" + KANJI + "\n聯絡人：y", "1", "t", "u", "2020-01-01"), (KANJI, "2", "t", "u", "2022-01-01")], "body string, s string, title string, unit string, pub_date string")
    assert [r["text"] for r in press] == [KANJI + "\n聯絡人：y"]


def test_limits_share_out_groups(spark):
    rows = [(WORDS + str(i), str(i), "big" if i < 30 else "small", "", "") for i in range(33)]
    raw = spark.createDataFrame(rows, "text string, id string, dump string, url string, date string")
    got = readers.human_rows(raw, readers.SOURCES["fineweb"], 10).groupBy("meta.dump").count().collect()
    assert {r["dump"]: r["count"] for r in got} == {"big": 5, "small": 3}


def test_machine_and_held_out_rows(spark):
    rows = [("1", WORDS, "human_written", "h", 0.0), ("2", WORDS, "ai_generated", "m", 0.2), ("3", WORDS, "ai_edited", "m", 0.3), ("4", "short", "ai_edited", "m", 0.3), ("5", None, "ai_edited", "m", 0.3)]
    raw = spark.createDataFrame(rows, "source_id string, text string, text_type string, model string, cosine_score double")
    machine = {r["source_id"]: r["cosine_score"] for r in readers.machine_rows(raw, "e").collect()}
    assert machine == {"2": 1.0, "3": 0.3}
    held = {r["source_id"]: (r["model"], r["split"]) for r in readers.held_out_rows(raw, "e", "far").collect()}
    assert held == {"1": (None, "far"), "2": ("m", "far"), "3": ("m", "far")}


def test_the_first_row_counts_before_blank_texts_go(spark):
    rows = [("1", "a", "human", "news", " "), ("2", "a", "human", "news", "text"), ("3", "", "human", None, "x"), ("4", "b", "human", "code", "y"), ("5", "c", "m", "news", "z"), ("6", "d", None, "news", "z")]
    raw = spark.createDataFrame(rows, "id string, source_id string, model string, domain string, generation string")
    assert [tuple(r) for r in readers.reference_humans(raw, "id").collect()] == [("3", "x")]


def test_calibration_checks_itself(spark):
    rows = [("en" if i % 2 else "ja", i % 3, {0: 0.1, 1: 0.9, 2: 0.5}[i % 3] + i / 1e5) for i in range(300)]
    d = spark.createDataFrame(rows, "group string, label int, score double")
    good = metrics.calibration(d, d, least=0.8).first()
    assert not good["flip"] and good["macro_f1"] > 0.99 and good["binding"] in ("en", "ja")
    assert 0 < good["h_thresh"] < good["ai_thresh"] <= 1
    wrong = d.withColumn("label", (F.col("label") + 1) % 3)
    with pytest.raises(Exception, match="misses its check"):
        metrics.calibration(d, wrong, least=0.8).collect()


def test_rows_of_the_other_sources(spark):
    def one(name, row, schema):
        (r,) = readers.human_rows(spark.createDataFrame([row], schema), readers.SOURCES[name]).collect()
        return r

    r = one("editlens", (WORDS, "news", "9", "human_written"), "text string, source string, source_id string, text_type string")
    assert (r["text_register"], r["source_id"], r["meta"]["sub_source"]) == ("journalistic", "9", "news")
    r = one("wiki40b-ja", (f"_START_ARTICLE_ 題 _START_PARAGRAPH_ {KANJI}", "b'Q1'", "5"), "text string, wikidata_id string, version_id string")
    assert (r["text"], r["source_id"], r["meta"]["topic"]) == (KANJI, "Q1@5", "題")
    r = one("amazon-reviews-ja", (KANJI + "a", "3", 4), "text string, id string, label int")
    assert (r["meta"]["rating"], r["meta"]["cjk"], r["meta"]["length"]) == (4, 160, 161)
    r = one("wikinews-ja", ("【2008年2月3日】" + KANJI, 1, 2, "t", "2009-05-06T00:00:00Z"), "body string, pageid long, revid long, title string, timestamp string")
    assert (r["text"], r["source_id"], r["meta"]["pub_date"]) == (KANJI, "1@2", "2008-02-03")
    r = one("arxiv-abstracts", (f" {WORDS}\n", "x/1", "2001-02-03T04:05"), "text string, id string, created string")
    assert (r["text"], r["meta"]["created"]) == (WORDS, "2001-02-03")
    r = one("wikinews-en", ([WORDS, "", "end"], 7, "t", "2010-01-01", "en"), "text array<string>, pageid long, title string, date string, lang string")
    assert (r["text"], r["source_id"]) == (WORDS + "\nend", "7")
    r = one("amazon-reviews-en", (WORDS, "p", "u", 5.0, "Books"), "text string, parent_asin string, user_id string, rating double, category string")
    assert (r["source_id"], r["meta"]["category"]) == ("p/u", "Books")
    r = one("stackexchange", ("q" * 300, WORDS, "site"), "INSTRUCTION string, RESPONSE string, SOURCE string")
    assert len(r["source_id"]) == 16 and len(r["meta"]["question"]) == 200
    r = one("reddit-l2", (WORDS, "ask", "i", "t", "Spain"), "body string, subreddit string, id string, title string, country string")
    assert (r["source_id"], r["text_register"]) == ("ask/i", "casual")
