"""Text cleaning as columns; Python only where Spark has no function (NFKC, emoji names, unescape)."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkwell.functions import emoji
from inkwell.textfn import CJK, strip

# Openings that mark an assistant's header.
HEADER_STARTS = ["Sure", "Here", "Abstract", "Title", "I'm happy to help", "Certainly"]
# Invisible characters, in order soft hyphen, zero-width space, non-joiner, joiner,
# left-to-right and right-to-left marks, word joiner, Mongolian vowel separator, byte order mark.
INVISIBLE = "­​‌‍‎‏⁠᠎﻿"
# Cyrillic and Greek letters and the Latin ones they look like.
CONFUSABLE = "АВЕКМНОРСТУХЅІЈаеорсухѕіјΑΒΕΖΗΙΚΜΝΟΡΤΥΧορ"
CONFUSABLE_LATIN = "ABEKMHOPCTYXSIJaeopcyxsijABEZHIKMNOPTYXop"


def normalize_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def after_first_think(text: Column) -> Column:
    """The second segment of a split at the closing think tag, stripped."""
    return F.when(F.contains(text, F.lit("</think>")), strip(F.get(F.split(text, "</think>"), F.lit(1)))).otherwise(text)


def after_last_think(text: Column) -> Column:
    last = F.element_at(F.split(text, "</think>"), -1)
    return F.when(F.contains(text, F.lit("</think>")), F.regexp_replace(last, r"(?U)^\s+", "")).otherwise(text)


def drop_header(text: Column) -> Column:
    """Without a first paragraph that opens like an assistant's header, if another follows."""
    paras = F.filter(F.split(text, "\n"), lambda p: strip(p) != "")
    head = F.regexp_replace(F.get(paras, F.lit(0)), "^[^a-zA-Z0-9]*", "")
    opens = F.exists(F.array(*map(F.lit, HEADER_STARTS)), lambda s: F.startswith(head, s))
    return F.when((F.size(paras) > 1) & opens, F.array_join(F.slice(paras, 2, F.greatest(F.size(paras), F.lit(1))), "\n")).otherwise(text)


def clean_ascii(text: Column) -> Column:
    """The cleaning chain without its two Unicode steps: think tag, header, lower case, white space."""
    return normalize_whitespace(F.lower(drop_header(after_first_think(text))))


def fold_lookalikes(text: Column) -> Column:
    return F.translate(F.translate(text, INVISIBLE, ""), CONFUSABLE, CONFUSABLE_LATIN)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def harden(text: Column, flags: dict[str, str] | None = None) -> Column:
    """Invisible characters gone, look-alikes folded, NFKC, emoji by name. Spark runs Python on every row
    whatever the condition around it, so texts that these can't change come to it as nulls."""
    folded = fold_lookalikes(text)
    odd = text.rlike(r"[^\x00-\x{ff}]|[\x{a0}-\x{bf}]")
    return F.coalesce(emoji.emoji_names(nfkc(F.when(odd, folded)), flags=flags), folded)


def clean_text(rows: DataFrame, text_col: str, out_col: str, normalize: bool = True) -> DataFrame:
    """``rows`` with ``out_col``, the whole chain; the Python step is a projection of its own."""
    own = harden(F.col(text_col), emoji.regions(rows.sparkSession)) if normalize else F.col(text_col)
    rows = rows.withColumn(out_col, own)
    return rows.withColumn(out_col, clean_ascii(F.col(out_col)))


def strip_wrapper(text: Column) -> Column:
    """struct(clean, removed): without a short first paragraph that only acknowledges or announces."""
    # Acknowledgements and the cues of an announcement.
    ack = r"(?i)^(sure|of course|certainly|absolutely|got it|okay|ok|はい|もちろん|了解(です|しました)?|承知(しました)?|當然|好的|沒問題)[\s!.。！？：:、，,-]*$"
    cue = r"(?i)(here|below|following|rewrit|revis|edit|version|text|本文|文章|以下|こちら|改寫|改写|修正|修改|潤飾|重寫|版本|內容)"
    paras = F.filter(F.split(text, "\n"), lambda p: strip(p) != "")
    head = F.regexp_replace(F.regexp_replace(F.get(paras, F.lit(0)), r"^[^\p{L}\p{N}_]+", ""), r"[*_# \t]+$", "")
    wrapper = (F.size(paras) >= 2) & (F.length(head) <= 100) & (head.rlike(ack) | (head.rlike("[:：]$") & head.rlike(cue)))
    body = F.regexp_replace(F.array_join(F.slice(paras, 2, F.greatest(F.size(paras), F.lit(1))), "\n"), r"(?U)^\s+", "")
    return F.struct(F.when(wrapper, body).otherwise(text).alias("clean"), F.when(wrapper, F.get(paras, F.lit(0))).alias("removed"))


def clean_post(text: Column) -> Column:
    """Plain prose of a Markdown post: links, headers, quotes, bullets, code and emphasis marks go."""
    # The patterns of links, headers, quotes, bullets, code and emphasis, in this order.
    steps = [
        (r"(?U)https?://\S+", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?mdU)^\s{0,3}#{1,6}\s*", ""), (r"(?mdU)^\s{0,3}>\s?", ""),
        (r"(?mdU)^\s{0,3}[-*+]\s+", ""), (r"`{1,3}", ""), (r"(\*\*\*|\*\*|\*|__|_|~~)", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"),
    ]
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return strip(text)


def plain_markdown(text: Column) -> Column:
    """A detector's plain text: Markdown, tables and tags go, entities are decoded, white space becomes one space."""
    # A published preprocessing's patterns, in its order.
    steps = [
        (r"(?s)```.*?```", ""), (r"`[^`]*`", ""), (r"!\[.*?\]\(.*?\)", ""), (r"\[([^\]]+)\]\(.*?\)", "$1"),
        (r"(\*\*|__)(.*?)\1", "$2"), (r"(\*|_)(.*?)\1", "$2"), (r"#+ ", ""), (r"(?m)^>.*$", ""),
        (r"(?m)^(\s*[-*+]|\d+\.)\s+", ""), (r"(?m)^\s*[-*_]{3,}\s*$", ""), (r"\|.*?\|", ""), (r"<.*?>", ""),
    ]
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    text = F.coalesce(unescape(F.when(F.contains(text, F.lit("&")), text)), text)
    text = F.replace(F.translate(F.replace(text, F.lit("^M"), F.lit(" ")), "\n\t\r", "   "), F.lit(" ,"), F.lit(","))
    return F.regexp_replace(text, " +", " ")


def topic(text: Column, language: Column) -> Column:
    """The first sentence's first 12 words, or 30 characters of the first clause outside English."""
    t = strip(text)
    sentence = F.get(F.split(t, r"(?<=[.!?])\s", 2), F.lit(0))
    english = F.array_join(F.slice(F.filter(F.split(sentence, r"\s+"), lambda w: w != ""), 1, 12), " ")
    return F.when(language == "en", english).otherwise(F.substring(F.get(F.split(t, r"[。！？\n]", 2), F.lit(0)), 1, 30))


def length_hint(text: Column, language: Column) -> Column:
    """At least 50 words in steps of 25, or 150 characters in steps of 50; halves round to even."""
    n_words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    n_words = F.greatest(F.lit(50), (F.bround(n_words / 25) * 25).cast("int"))
    basis = F.when(language == "zh-tw", F.regexp_count(text, F.lit(CJK))).otherwise(F.length(text))
    chars = F.greatest(F.lit(150), (F.bround(basis / 50) * 50).cast("int"))
    return F.when(language == "en", F.concat(n_words.cast("string"), F.lit(" words"))).otherwise(F.concat(chars.cast("string"), F.lit("字")))
