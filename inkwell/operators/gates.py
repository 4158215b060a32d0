"""Quality gates: the first one a row fails names its drop reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell import textfn
from inkwell.functions import grams

# Openings of a refusal, characters of simplified Chinese only, limits.
REFUSALS = [
    "i can't help", "i cannot help", "i can't assist", "i cannot assist",
    "i can't provide", "i cannot provide", "i can't comply", "i cannot comply",
    "i can't fulfill", "i cannot fulfill", "i won't be able to",
    "i'm not able to", "i am not able to", "i'm unable to", "i am unable to", "as an ai",
    "申し訳ありませんが", "申し訳ございませんが", "お手伝いできません", "対応できません",
    "我無法協助", "我無法提供", "我不能提供", "抱歉，我無法", "对不起，我无法",
]
SIMPLIFIED = (
    "们这国说时会个学发经应样见关门问还实现对长书东车马鸟鱼龙头买卖区医华团图块坏备够妈"
    "来过进远爱难钱银铁错间阳阴队际边达运选适网罗习乐飞风馆饭饮验体历厂听单严临为产亲从"
    "价众优传伤软络资讯计划轮铜钢铝镇页顺颗领题骨鸡鸭鹅"
)
SIMPLIFIED_SHARE, LENGTH_BAND, COPY_WORDS, COPY_CHARS = 0.05, (0.33, 3.0), 15, 30


def passes_floor(text: Column, language: Column) -> Column:
    """75 words of English, else 150 CJK characters."""
    return F.when(language == "en", textfn.word_count(text) >= 75).otherwise(F.regexp_count(text, F.lit(textfn.CJK)) >= 150)


def length(text: Column, language: Column) -> Column:
    return F.when(language == "en", textfn.word_count(text)).otherwise(F.regexp_count(text, F.lit(textfn.CJK)))


def drop_reason() -> Column:
    """Over columns text, text_type, language, source_text, finish_reason; null if all gates pass."""
    text, kind, lang, src = (F.col(c) for c in ("text", "text_type", "language", "source_text"))
    ai = kind.isin("ai_generated", "ai_edited")
    has_src = F.coalesce(src, F.lit("")) != ""
    mirror = (kind == "ai_generated") & has_src
    head = F.lower(F.substring(text, 1, 200))
    refusal = F.exists(F.array(*map(F.lit, REFUSALS)), lambda p: F.contains(head, p))
    cjk = F.regexp_count(text, F.lit(textfn.CJK))
    simplified = (F.length(text) - F.length(F.translate(text, SIMPLIFIED, ""))) / F.nullif(cjk, F.lit(0))
    ratio = length(text, lang) / F.nullif(length(src, lang), F.lit(0))
    # pieces between white space in English, else characters, white space included; case and punctuation
    # count. Only mirrors go to Python
    copied = grams.share_a_gram(F.when(mirror, text), F.when(mirror, src), F.coalesce(lang == "en", F.lit(False)), COPY_WORDS, COPY_CHARS)
    gates = [
        ("empty", ai & F.rlike(text, F.lit(r"(?U)\A\s*\z"))),
        ("truncated", ai & (F.col("finish_reason") == "length")),
        ("refusal", ai & refusal),
        ("wrong_script_simplified", ai & (lang == "zh-tw") & (simplified > SIMPLIFIED_SHARE)),
        ("length_mismatch", mirror & ((ratio < LENGTH_BAND[0]) | (ratio > LENGTH_BAND[1]))),
        ("regurgitation", mirror & copied),
        ("noop_edit", (kind == "ai_edited") & has_src & (textfn.strip(text) == textfn.strip(src))),
    ]
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in gates])


def run_gates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with ``drop_reason``)."""
    marked = rows.withColumn("drop_reason", drop_reason())
    return marked.where("drop_reason is null").drop("drop_reason"), marked.where("drop_reason is not null")
