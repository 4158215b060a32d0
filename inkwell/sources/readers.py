"""Landed files and tables as canonical rows: one shape for all sources, a declaration each."""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkwell.operators import gates, sampling
from inkwell.sources import passages
from inkwell.sources.sinks import read_rows
from inkwell.textfn import CJK, let, strip

# Registers of sub-sources and boards, labels of press release headers, other languages' domains.
REGISTERS = {
    "reddit_writing_prompts": "creative", "news": "journalistic", "fineweb_edu": "formal", "amazon_reviews": "reviews", "google_reviews": "reviews",
}
BOARDS = {"Gossiping": "casual", "Food": "reviews", "MobileComm": "reviews", "marvel": "creative", "eWriter": "creative"}
HEADER_LABELS = [
    "發稿單位", "發稿日期", "發布單位", "發布日期", "聯絡人", "新聞聯絡", "業務聯絡",
    "聯絡電話", "聯絡資訊", "主辦單位", "承辦單位", "資料來源", "發言人",
]
OTHER_DOMAINS = ["czech_news", "german_news", "code"]
ROC_OFFSET = 1911
DATELINE = r"【\s*(20\d{2})年(\d{1,2})月(\d{1,2})日\s*】"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records by line feed alone, so other line separators may stand inside strings; a path that
    is not there gives an empty frame."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("lineSep", "\n").json(path)


def read_split(spark: SparkSession, path: str, schema: str, meta: str) -> DataFrame:
    """A split's CSV with its ``meta`` column (JSON) as a struct of the schema ``meta``."""
    return read_rows(spark, path, schema).withColumn("meta", F.from_json("meta", meta))


@F.pandas_udf(StringType())
def _literal(text: pd.Series) -> pd.Series:
    def one(t):
        try:
            return None if t is None else ast.literal_eval(t).decode("utf-8", "replace")
        except (ValueError, SyntaxError, AttributeError, MemoryError, RecursionError):
            return t

    return text.map(one)


def decoded(text: Column) -> Column:
    """Text that was written as the literal of its bytes; other text as it is, null as empty."""
    text = F.coalesce(text, F.lit(""))
    literal = F.substring(text, 1, 2).isin("b'", 'b"')
    return F.when(literal, _literal(F.when(literal, text))).otherwise(text)  # a Python function sees all rows


def wiki_article(text: Column) -> Column:
    """struct(title, body) of text with structure tokens; text without them is all body."""
    plain = F.replace(text, F.lit("_NEWLINE_"), F.lit("\n"))
    parts = F.split(plain, "_START_ARTICLE_|_START_SECTION_|_START_PARAGRAPH_")
    parts = F.filter(F.transform(parts, strip), lambda x: x != "")

    def body(s: Column) -> Column:
        first = F.coalesce(F.get(s, F.lit(0)), F.lit(""))
        rest = F.when(F.size(s) > 1, F.array_join(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(1))), "\n")).otherwise(first)
        return F.struct(first.alias("title"), rest.alias("body"))

    return F.when(F.contains(plain, F.lit("_START_")), let(parts, body)).otherwise(F.struct(F.lit("").alias("title"), strip(plain).alias("body")))


def without_licence(text: Column) -> Column:
    """The book between the licence's start and end marks, where there are such."""
    head = F.regexp_replace(text, r"(?is)\A.*?\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG.*?\*\*\*", "")
    return strip(F.regexp_replace(head, r"(?is)\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG.*\z", ""))


def first_passage(text: Column, words: int = 300, skip: int = 3, most: int = 4000) -> Column:
    """Paragraphs after the first ``skip`` until ``words`` are reached, at most ``most`` characters."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda x: x != "")
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        grown = F.struct(F.concat(acc["out"], F.array(p)).alias("out"), (acc["n"] + F.regexp_count(p, F.lit(r"(?U)\S+"))).alias("n"))
        return F.when(acc["n"] < words, grown).otherwise(acc)

    taken = let(paragraphs, lambda x: F.aggregate(F.slice(x, skip + 1, F.greatest(F.size(x), F.lit(1))), zero, step, lambda acc: F.array_join(acc["out"], "\n\n")))
    return F.substring(taken, 1, most)


def publication_date(body: Column) -> Column:
    """The date of the first dateline, null without one."""
    y, m, d = (F.regexp_extract(body, DATELINE, i) for i in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def without_dateline(body: Column) -> Column:
    return strip(F.regexp_replace(body, DATELINE, ""))


def posted_year(post_id: Column) -> Column:
    """The UTC year of the Unix time in a post's id, null without one."""
    seconds = F.nullif(F.regexp_extract(post_id, r"M\.(\d+)\.A\.", 1), F.lit("")).cast("long")
    return F.year(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()))


def roc_date(text: Column) -> Column:
    """The first year-month-day of the Minguo calendar as an ISO date, null without one."""
    y, m, d = (F.regexp_extract(text, r"(\d{3})-(\d{1,2})-(\d{1,2})", i) for i in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", (y.cast("int") + ROC_OFFSET).cast("string"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def without_header(body: Column) -> Column:
    """Without the leading lines of a press release that are a label and a colon among their first 12 characters."""
    squeezed = lambda x: F.regexp_replace(x, "[ 　]", "")
    label = lambda x: squeezed(x).rlike("^(?:" + "|".join(HEADER_LABELS) + ")") & F.substring(squeezed(x), 1, 12).rlike("[：:]")
    lines = F.split(body, "\n")

    def rest(x: Column) -> Column:
        head = F.aggregate(x, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, line: F.struct((a["n"] + (a["on"] & label(line)).cast("int")).alias("n"), (a["on"] & label(line)).alias("on")), lambda a: a["n"])
        return F.array_join(F.filter(x, lambda line, i: i >= head), "\n")

    return strip(let(lines, rest))


@dataclass(frozen=True)
class Source:
    """How the rows of a landed table become canonical: column expressions over its columns.

    ``group`` is a column whose values share a limit evenly; ``where`` drops rows first.
    """

    name: str
    language: str
    register: Callable[[], Column]
    text: Callable[[], Column]
    source_id: Callable[[], Column]
    meta: Callable[[Column], dict[str, Column]] = field(default=lambda text: {})
    where: Callable[[], Column] | None = None
    group: str | None = None


def _is(register: str) -> Callable[[], Column]:
    return lambda: F.lit(register)


def _by(column: str, names: dict[str, str]) -> Callable[[], Column]:
    return lambda: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(column)), F.lit("mixed"))


def text_hash(text: Column) -> Column:
    """The id of rows that have none: 16 hex digits of the text's SHA-1."""
    return F.substring(F.sha1(text), 1, 16)


def _trimmed(column: str) -> Callable[[], Column]:
    return lambda: strip(F.coalesce(F.col(column), F.lit("")))


def _joined(column: str) -> Callable[[], Column]:
    return lambda: strip(F.array_join(F.filter(column, lambda p: p != ""), "\n"))


_day = lambda c: F.substring(F.col(c).cast("string"), 1, 10)
_cjk = lambda t: F.regexp_count(t, F.lit(CJK))


def _wiki(language: str) -> Source:
    article = lambda: wiki_article(decoded(F.col("text")))
    return Source(
        f"wiki40b-{language}", language, _is("formal"), lambda: article()["body"], lambda: F.concat_ws("@", decoded(F.col("wikidata_id")), decoded(F.col("version_id"))),
        lambda t: {"topic": article()["title"]},
    )


SOURCES = {
    s.name: s
    for s in (
        Source("editlens", "en", _by("source", REGISTERS), lambda: F.col("text"), lambda: F.col("source_id"), lambda t: {"sub_source": F.col("source")}, lambda: F.col("text_type") == "human_written"),
        _wiki("ja"),
        _wiki("zh-tw"),
        Source("amazon-reviews-ja", "ja", _is("reviews"), lambda: F.coalesce("text", F.lit("")), lambda: F.col("id"), lambda t: {"rating": F.col("label"), "cjk": _cjk(t)}),
        Source("open2ch", "ja", _is("casual"), lambda: F.array_join(F.filter("dialogue.content", lambda c: c != ""), "\n"), lambda: F.col("id"), lambda t: {"board": F.col("board")}),
        Source("wikinews-ja", "ja", _is("journalistic"), lambda: without_dateline(F.col("body")), lambda: F.concat_ws("@", "pageid", "revid"), lambda t: {"topic": F.col("title"), "pub_date": F.coalesce(publication_date(F.col("body")), _day("timestamp")), "cjk": _cjk(t)}),
        Source("ptt", "zh-tw", _by("board", BOARDS), lambda: F.col("body"), lambda: F.concat_ws("/", "board", "post_id"), lambda t: {"board": F.col("board"), "topic": F.col("title")}, lambda: posted_year(F.col("post_id")).between(2015, 2019), "board"),
        Source("twgov", "zh-tw", _is("journalistic"), lambda: without_header(F.col("body")), lambda: F.col("s"), lambda t: {"topic": F.col("title"), "unit": F.col("unit"), "pub_date": F.col("pub_date")}, lambda: F.col("pub_date") < "2022"),
        Source("fineweb", "en", _is("formal"), lambda: F.substring(_trimmed("text")(), 1, 6000), lambda: F.col("id"), lambda t: {"dump": F.col("dump"), "url": F.col("url"), "date": _day("date")}, None, "dump"),
        Source("arxiv-abstracts", "en", _is("formal"), _trimmed("text"), lambda: F.col("id"), lambda t: {"created": _day("created")}),
        Source("wikinews-en", "en", _is("journalistic"), _joined("text"), lambda: F.col("pageid"), lambda t: {"topic": F.col("title"), "date": _day("date")}, lambda: F.col("lang") == "en"),
        Source("gutenberg", "en", _is("creative"), lambda: first_passage(without_licence(decoded(F.col("TEXT")))), lambda: F.coalesce(F.get_json_object("METADATA", "$.text_id"), text_hash(first_passage(without_licence(decoded(F.col("TEXT")))))), lambda t: {"topic": F.get_json_object("METADATA", "$.title"), "issued": F.substring(F.get_json_object("METADATA", "$.issued"), 1, 10)}, lambda: F.coalesce(F.get_json_object("METADATA", "$.language") == "en", F.lit(True))),
        Source("amazon-reviews-en", "en", _is("reviews"), _trimmed("text"), lambda: F.concat_ws("/", "parent_asin", "user_id"), lambda t: {"rating": F.col("rating"), "category": F.col("category")}, None, "category"),
        Source("stackexchange", "en", _is("casual"), _trimmed("RESPONSE"), lambda: text_hash(_trimmed("RESPONSE")()), lambda t: {"site": F.col("SOURCE"), "question": F.substring(F.coalesce("INSTRUCTION", F.lit("")), 1, 200)}),
        Source("reddit-l2", "en", _is("casual"), lambda: F.col("body"), lambda: F.concat_ws("/", "subreddit", "id"), lambda t: {"topic": F.col("title"), "country": F.col("country")}),
    )
}


def limited(rows: DataFrame, limit: int | None, order: list, group: str | None = None) -> DataFrame:
    """The first ``limit`` rows by ``order``; with a ``group`` each value gives at most an even share
    of it, one row at least. Tasks limit their own rows before the shuffle; values are counted, not collected."""
    if limit is None:
        return rows
    if group:
        share = max(1, limit // max(1, rows.select(group).distinct().count()))
        rows = sampling.first_per_group(rows, [group], order, share)
    return rows.orderBy(*order).limit(limit)


def human_rows(raw: DataFrame, source: Source, limit: int | None = None) -> DataFrame:
    """``text``, ``language``, ``source``, ``source_id``, ``text_register``, ``meta`` of the rows that
    reach their language's floor. A limit takes rows in the order of their id's hash, so reruns agree."""
    kept = raw if source.where is None else raw.where(source.where())
    text = F.col("_text")
    kept = kept.withColumn("_text", source.text()).where(gates.passes_floor(text, F.lit(source.language)))
    key = source.source_id().cast("string")
    kept = limited(kept.withColumn("_id", key), limit, [F.sha2("_id", 256), "_id", "_text"], source.group)
    meta = {**source.meta(text), "length": F.length(text)}
    return kept.select(
        text.alias("text"), F.lit(source.language).alias("language"), F.lit(source.name).alias("source"), F.col("_id").alias("source_id"),
        source.register().alias("text_register"), F.struct(*[v.alias(k) for k, v in meta.items()]).alias("meta"),
    )


def machine_rows(raw: DataFrame, source: str, limit: int | None = None, tag: str = "backbone", types: tuple = ("ai_generated", "ai_edited")) -> DataFrame:
    """Generated and edited rows with ``text_id`` and ``cosine_score`` (1 for generated); a limit
    takes an even share of each type."""
    kept = raw.where(F.col("text_type").isin(*types) & gates.passes_floor(F.col("text"), F.lit("en")))
    score = F.when(F.col("text_type") == "ai_generated", 1.0).otherwise(F.col("cosine_score"))
    ids = F.concat_ws("/", F.lit("en"), F.lit(source), "source_id", "text_type", F.lit(tag))
    out = kept.select(ids.alias("text_id"), "text", "text_type", F.lit(source).alias("source"), "source_id", "model", score.alias("cosine_score"))
    return out if limit is None else sampling.first_per_group(out, ["text_type"], [F.sha2("text_id", 256), "text_id"], limit // len(types))


def held_out_rows(raw: DataFrame, source: str, split: str) -> DataFrame:
    """All classes of an evaluation split as they are, tagged with it; humans have no model."""
    kept = raw.where(gates.passes_floor(F.col("text"), F.lit("en")))
    model = F.when(F.col("text_type") != "human_written", F.col("model"))
    ids = F.concat_ws("/", F.lit("en"), F.lit(source), "source_id", "text_type", F.lit(split))
    return kept.select(ids.alias("text_id"), "text", "text_type", F.lit(source).alias("source"), "source_id", model.alias("model"), "cosine_score", F.lit(split).alias("split"))


def reference_humans(rows: DataFrame, order: str) -> DataFrame:
    """``text`` of human rows in English: the first row of a source id by ``order``, if it isn't blank."""
    human = (F.col("model") == "human") & ~F.coalesce(F.col("domain").isin(OTHER_DOMAINS), F.lit(False))
    sid = F.coalesce(F.nullif(F.col("source_id").cast("string"), F.lit("")), F.col("id").cast("string"))
    first = rows.where(human).groupBy(sid.alias("source_id")).agg(F.min_by(F.coalesce("generation", F.lit("")), order).alias("text"))
    return first.select("source_id", strip(F.col("text")).alias("text")).where("text <> ''")


def first_with_body(rows: DataFrame, key: str, body: str, order: str) -> DataFrame:
    """Of each ``key`` the first row by ``order`` among those whose body isn't blank."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    solid = rows.where(F.coalesce(strip(F.col(body)) != "", F.lit(False)))
    return solid.groupBy(F.col(key).alias("_key")).agg(F.min_by(whole, order).alias("r")).select("r.*")


def last_before(rows: DataFrame, key: str, time: str, cutoff, tie: str) -> DataFrame:
    """Of each ``key`` its last row before ``cutoff``, by time and then ``tie``."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.where(F.col(time) < F.lit(cutoff)).groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct(time, tie)).alias("r")).select("r.*")


def work_passages(raw: DataFrame, target: int = 450, most: int = 3) -> DataFrame:
    """``work``, ``p`` (from 0), ``text``: passages of whole works by their CJK characters."""
    cut = passages.chunks(F.col("text"), _cjk, target, most)
    return raw.select("work", F.posexplode(cut).alias("p", "text"))
