"""Row filters of corpus building and evaluation, and checks that return what violates them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import decode
from inkwell.sources import store
from inkwell.textfn import strip

# Country names looked for in a flair (those with another name follow), and refused ones.
COUNTRIES = [
    "Germany", "France", "Spain", "Italy", "Poland", "Netherlands", "Sweden", "Finland", "Norway", "Denmark", "Portugal", "Greece",
    "Austria", "Czechia", "Hungary", "Romania", "Croatia", "Belgium", "Switzerland", "Bulgaria", "Serbia", "Slovakia", "Slovenia",
    "Lithuania", "Latvia", "Estonia", "Russia", "Ukraine",
]
OTHER_NAMES = {"Czech Republic": "Czechia"}
REFUSED = [
    "United Kingdom", "England", "Scotland", "Wales", "Northern Ireland", "Ireland", "United States",
    "United States of America", "Canada", "Australia", "New Zealand", "Malta",
]
TOMBSTONES = ["[deleted]", "[removed]"]
MIN_POST_CHARS, MIN_ASCII_SHARE = 400, 0.9
#: Columns and meta fields that stay in the working rows.
WORKING_ONLY = ["source_text"]


def by_language(language: Column, values: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), language)


def off_boundary(score: Column, language: Column, margin: float, cuts: dict = decode.BUCKET_CUTS) -> Column:
    """At least ``margin`` from both cuts of the language; null, 0 and 1 pass, as does a language without cuts."""
    low, high = (by_language(language, {k: v[i] for k, v in cuts.items()}) for i in (0, 1))
    near = F.least(F.abs(score - low), F.abs(score - high)) < margin
    return ~F.coalesce(near & ~score.isin(0.0, 1.0), F.lit(False))


def country_from_flair(flair: Column) -> Column:
    """The country whose longest name the flair holds; null if it holds a refused name or none."""
    names = {**{c: c for c in COUNTRIES}, **OTHER_NAMES}
    refused = F.exists(F.array(*map(F.lit, REFUSED)), lambda x: F.contains(flair, x))
    cases = [F.when(F.contains(flair, F.lit(n)), names[n]) for n in sorted(names, key=len, reverse=True)]
    return F.when(~refused, F.coalesce(*cases))


def is_tombstone(text: Column) -> Column:
    """Null, blank, or one of the bodies left where a post was taken away."""
    t = strip(F.coalesce(text, F.lit("")))
    return (t == "") | t.isin(TOMBSTONES)


def looks_english(text: Column) -> Column:
    """At least 0.9 of the word characters are ASCII letters; false without any."""
    share = F.regexp_count(text, F.lit("[A-Za-z]")) / F.nullif(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]")), F.lit(0))
    return F.coalesce(share >= MIN_ASCII_SHARE, F.lit(False))


def usable_post(raw: Column, cleaned: Column) -> Column:
    return ~is_tombstone(raw) & (F.length(cleaned) >= MIN_POST_CHARS) & looks_english(cleaned)


def shippable(rows: DataFrame, flag: str = "shippable_edit") -> DataFrame:
    """Without edits flagged false; a null flag keeps."""
    return rows.where(~((F.col("text_type") == "ai_edited") & F.col(flag).eqNullSafe(F.lit(False))))


def split_rows(rows: DataFrame, meta_fields: list[str], meta: str = "meta") -> DataFrame:
    """The rows as they ship: without working columns and the named fields of ``meta``."""
    there = [f for f in meta_fields if f in rows.schema[meta].dataType.names]
    out = rows.drop(*WORKING_ONLY)
    return out.withColumn(meta, F.col(meta).dropFields(*there)) if there else out


def binary_view(rows: DataFrame) -> DataFrame:
    """Rows with ``y``: human and generated by ``text_type`` where there is one, else all by ``label``."""
    if "text_type" in rows.columns:
        kept = rows.where(F.col("text_type").isin("human_written", "ai_generated"))
        return kept.withColumn("y", (F.col("text_type") == "ai_generated").cast("int"))
    return rows.withColumn("y", F.col("label").cast("int"))


def eligible_models(models: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """``model_id``, ``benchmark_id`` to run: not excluded, and included, multilingual or sharing a
    language. Both are manifests of some dozens of rows, so all combinations are looked at."""
    m = models.select(F.col("id").alias("model_id"), F.col("languages").alias("_ml"), "include_benchmarks", "exclude_benchmarks")
    b = benchmarks.select(F.col("id").alias("benchmark_id"), F.col("languages").alias("_bl"))
    has = lambda c: F.coalesce(F.array_contains(c, F.col("benchmark_id")), F.lit(False))
    fits = has("include_benchmarks") | F.array_contains("_bl", "multilingual") | F.arrays_overlap("_ml", "_bl")
    return b.join(store.small(m, 10_000), ~has("exclude_benchmarks") & fits).select("model_id", "benchmark_id")


def manifest_faults(models: DataFrame, benchmarks: DataFrame, adapters: list[str], kinds: tuple = ("binary", "graded")) -> DataFrame:
    """``id`` and ``fault`` of models: repeated ids, revisions that are no commit, unknown kinds,
    adapters and benchmarks, sizes that are not positive."""
    pinned = lambda c: F.coalesce(F.col(c).rlike("^[0-9a-f]{40}$"), F.lit(False))
    refs = F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("include_benchmarks", "exclude_benchmarks", "trained_on_benchmarks")]))
    checks = [
        (~pinned("revision"), "revision is no commit"),
        (~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "unknown kind"),
        (~F.coalesce(F.col("adapter").isin(*adapters), F.lit(False)), "unknown adapter"),
        (~F.coalesce(F.col("max_length") > 0, F.lit(False)), "max_length is not positive"),
        (F.coalesce(F.col("batch_size") <= 0, F.lit(False)), "batch_size is not positive"),
    ]
    found = F.array_compact(F.array(*[F.when(test, name) for test, name in checks]))
    own = models.select("id", F.explode(found).alias("fault"))
    named = models.select("id", F.explode(refs).alias("_ref")).join(benchmarks.select(F.col("id").alias("_ref")), "_ref", "left_anti")
    unknown = named.select("id", F.lit("unknown benchmark").alias("fault")).distinct()
    twice = lambda df, what: df.groupBy("id").count().where("count > 1").select("id", F.lit(what).alias("fault"))
    return reduce(DataFrame.unionByName, [own, unknown, twice(models, "model id repeats"), twice(benchmarks, "benchmark id repeats")])


def prepared(rows: DataFrame, template: str, clean=None, key: str = "text_id") -> DataFrame:
    """``label`` and ``prompt`` of training rows: ``{text}`` of the template filled; ``clean`` maps a frame."""
    rows = rows if clean is None else clean(rows)
    before, _, after = template.partition("{text}")
    return rows.select(key, F.col("bucket").cast("int").alias("label"), F.concat(F.lit(before), "text", F.lit(after)).alias("prompt"))


def require_humans(rows: DataFrame) -> DataFrame:
    """``rows``, which fails at once if none is human-written: rates at a threshold need some."""
    if rows.where("text_type = 'human_written'").isEmpty():
        raise ValueError("no human rows to set a threshold by")
    return rows
