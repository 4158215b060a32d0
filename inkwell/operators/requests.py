"""Seeded plans of model requests, and the rows that their results become.

Pools are configuration: some dozens of entries a language, in plain dicts. Each choice is the
SHA-256 of its seed parts modulo the pool's size, so reruns and other orders agree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell import hashing, textfn
from inkwell.functions import cleaning
from inkwell.operators import gates

# The ways to ask for Markdown, the reasoning labels that are cheap, edits a document, the band of lengths.
MARKDOWN_MODES = ["default", "suppressed"]
CHEAP = {"none", "off", "low", "minimal"}
EDITS = 2
LENGTH_RATIO = (0.5, 2.0)


@dataclass(frozen=True)
class Pools:
    """``styles``: language to (id, weight). ``generators``: (language, kind) to (slug, weight).
    ``reasoning``: slug to (label, weight). ``edits``: language to (prompt id, split).
    ``mirrors``: language to register to templates. ``ineligible``: sources without mirrors."""

    styles: dict = field(default_factory=dict)
    generators: dict = field(default_factory=dict)
    reasoning: dict = field(default_factory=dict)
    edits: dict = field(default_factory=dict)
    mirrors: dict = field(default_factory=dict)
    ineligible: tuple = ()
    fallback: str = "general"


def _cases(by: Column, choices: dict) -> Column:
    """The choice of the key that ``by`` equals; null for other keys."""
    return F.coalesce(*[F.when(by == k, c) for k, c in choices.items()], F.lit(None).cast("string"))


def safe_slug(slug: Column) -> Column:
    return F.translate(slug, "/:", "__")


def reasoning(pools: Pools, slug: Column, *parts: Column, cheap_only: bool = False) -> Column:
    """The seeded label of a generator's reasoning; only cheap ones for edits, ``none`` if it has none."""

    def pool(pairs: list) -> list:
        return [p for p in pairs if p[0] in CHEAP] or [("none", 1)] if cheap_only else pairs

    return _cases(slug, {g: hashing.weighted_pick(pool(p), *parts, F.lit("reason")) for g, p in pools.reasoning.items()})


def mirror_template(pools: Pools, language: Column, register: Column, *parts: Column) -> Column:
    """struct(template, id ``register/v<i>``); an unknown register is the fallback's."""

    def of(registers: dict) -> Column:
        one = {
            r: hashing.pick([f"{r}/v{i + 1}\0{t}" for i, t in enumerate(ts)], *parts, F.lit("mirror")) for r, ts in registers.items()
        }
        return F.coalesce(_cases(register, one), one[pools.fallback])

    chosen = _cases(language, {lang: of(r) for lang, r in pools.mirrors.items()})
    return F.struct(F.substring_index(chosen, "\0", -1).alias("template"), F.substring_index(chosen, "\0", 1).alias("id"))


def render(template: Column, topic: Column, hint: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{topic}"), topic), F.lit("{length_hint}"), hint)


def edit_prompts(pool: list[tuple[str, str]], source: Column, source_id: Column, k: int = EDITS) -> Column:
    """Array of ``k`` prompt ids of one split, that of the first pick; distinct while it lasts."""
    entries = F.array(*[F.struct(F.lit(p).alias("id"), F.lit(s).alias("split")) for p, s in pool])

    def rest(first: Column) -> Column:
        own = F.filter(entries, lambda e: e["split"] == first["split"])
        chosen = F.array(first)
        for i in range(1, k):
            chosen = textfn.let(F.struct(chosen.alias("c"), own.alias("o")), _one_more(str(i), source, source_id))
        return F.transform(chosen, lambda e: e["id"])

    return textfn.let(F.get(entries, hashing.sha_modulo(len(pool), source, source_id, F.lit("edit0")).cast("int")), rest)


def _one_more(i: str, source: Column, source_id: Column):
    """A function from struct(c: chosen, o: the split's entries) to the chosen and one more."""

    def step(x: Column) -> Column:
        free = F.filter(x["o"], lambda e: ~F.array_contains(x["c"], e))
        free = F.when(F.size(free) > 0, free).otherwise(x["o"])
        at = hashing.sha_modulo(F.size(free).cast("long"), source, source_id, F.lit(f"edit{i}"))
        return F.concat(x["c"], F.array(F.get(free, at.cast("int"))))

    return step


def plan(records: DataFrame, pools: Pools) -> DataFrame:
    """A mirror (unless the source is ineligible) and ``EDITS`` edits of each record (``language``,
    ``source``, ``source_id``, ``text``, ``text_register``): rows with ``kind``, ``slot``,
    ``generator``, ``style``, ``markdown_mode``, ``reasoning``, ``prompt_id`` and ``prompt``."""
    src, sid, lang = F.col("source"), F.col("source_id"), F.col("language")
    edits = _cases_array(lang, {x: edit_prompts(p, src, sid) for x, p in pools.edits.items()})
    style = _cases(lang, {x: hashing.weighted_pick(p, src, sid, F.lit("style")) for x, p in pools.styles.items()})
    base = records.withColumn("style", style).withColumn("_edits", edits)
    mirror = F.when(~F.coalesce(src.isin(*pools.ineligible), F.lit(False)) if pools.ineligible else F.lit(True), F.array(F.lit(-1)))
    slots = F.concat(F.coalesce(mirror, F.array().cast("array<int>")), F.sequence(F.lit(0), F.lit(EDITS - 1)))
    each = base.withColumn("slot", F.explode(slots)).withColumn("kind", F.when(F.col("slot") < 0, "mirror").otherwise("edit"))

    def by_slot(of) -> Column:
        return F.coalesce(*[F.when(F.col("slot") == i, of(i)) for i in range(-1, EDITS)])

    def generator(i: int) -> Column:
        kind, seed = ("mirror", "gen-mirror") if i < 0 else ("edit", f"gen-edit{i}")
        return _cases(lang, {x: hashing.weighted_pick(p, src, sid, F.lit(seed)) for (x, k), p in pools.generators.items() if k == kind})

    each = each.withColumn("generator", by_slot(generator))
    gen = F.col("generator")
    each = each.withColumn("markdown_mode", by_slot(lambda i: hashing.pick(MARKDOWN_MODES, src, sid, gen, F.lit("md" if i < 0 else f"md-edit{i}"))))
    each = each.withColumn("reasoning", by_slot(lambda i: reasoning(pools, gen, src, sid, gen, F.lit("mirror" if i < 0 else f"edit{i}"), cheap_only=i >= 0)))
    template = mirror_template(pools, lang, F.col("text_register"), src, sid, gen)
    each = each.withColumn("_m", F.when(F.col("slot") < 0, template))
    text = F.col("text")
    prompt = F.when(F.col("slot") < 0, render(F.col("_m.template"), cleaning.topic(text, lang), cleaning.length_hint(text, lang))).otherwise(text)
    prompt_id = F.coalesce("_m.id", F.get("_edits", F.col("slot")))
    return each.withColumn("prompt_id", prompt_id).withColumn("prompt", prompt).drop("_m", "_edits")


def _cases_array(by: Column, choices: dict) -> Column:
    return F.coalesce(*[F.when(by == k, c) for k, c in choices.items()], F.lit(None).cast("array<string>"))


def result_rows(results: DataFrame) -> DataFrame:
    """Rows of a plan with ``output`` as corpus rows: the cleaned text, its id, the class's score and bucket."""
    mirror = F.col("kind") == "mirror"
    kind = F.when(mirror, "ai_generated").otherwise("ai_edited")
    clean = cleaning.strip_wrapper(cleaning.after_last_think(F.col("output")))
    tag = F.when(mirror, F.lit(None)).otherwise(F.col("prompt_id"))
    return results.withColumn("_w", clean).select(
        F.concat_ws("/", "language", "source", F.col("source_id").cast("string"), kind, safe_slug(F.col("generator")), "style", tag).alias("text_id"),
        F.col("_w.clean").alias("text"), "language", kind.alias("text_type"), "source", "source_id", F.col("text").alias("source_text"),
        F.col("generator").alias("model"), F.col("style").alias("prompt_id"), "markdown_mode",
        F.when(mirror, 1.0).alias("cosine_score"), F.when(mirror, 3).alias("bucket"),
        F.struct(F.col("_w.removed").alias("stripped_header"), F.col("reasoning").alias("reasoning_request"), F.col("prompt_id").alias("template_id")).alias("meta"),
    )


def paraphrased(rows: DataFrame, output: str, by: Column) -> DataFrame:
    """Rows with their paraphrase as text, id ``/para``; blank ones, echoes, those out of the
    length band and traditional texts turned simplified go. Labels stay."""
    clean = textfn.strip(cleaning.strip_wrapper(cleaning.after_last_think(F.col(output)))["clean"])
    ratio = F.length("_clean") / F.greatest(F.length("text"), F.lit(1))
    cjk = F.regexp_count("_clean", F.lit(textfn.CJK))
    simplified = (F.length("_clean") - F.length(F.translate("_clean", gates.SIMPLIFIED, ""))) / F.nullif(cjk, F.lit(0))
    wrong = (F.col("language") == "zh-tw") & (F.coalesce(simplified, F.lit(0.0)) > gates.SIMPLIFIED_SHARE)
    good = (F.col("_clean") != "") & ~F.col("_clean").eqNullSafe(F.col("text")) & ratio.between(*LENGTH_RATIO) & ~wrong
    kept = rows.withColumn("_clean", clean).where(good).withColumn("paraphrased_by", by)
    return kept.withColumn("text", F.col("_clean")).withColumn("text_id", F.concat("text_id", F.lit("/para"))).drop("_clean", output)


def estimate_cost(rows: DataFrame, models: dict[str, tuple[float, float, bool]], prompt_chars: dict[str, int], key: str = "text_id") -> DataFrame:
    """Rows, tokens in and out and the list-price cost by the seeded model of each row; ``models``
    maps a slug to (price in, price out, half price). Four characters are a token of English, 1.5 elsewhere."""
    lang = F.col("language")
    model = hashing.pick(list(models), F.col(key), F.lit("para"))
    body = F.length("text") / F.when(lang == "en", 4.0).otherwise(1.5)
    head = F.coalesce(*[F.when(lang == x, n / 3.0) for x, n in prompt_chars.items()], F.lit(0.0))
    price = lambda at: F.element_at(F.create_map(*[F.lit(x) for s, m in models.items() for x in (s, float(m[at]))]), F.col("_m"))
    half = F.when(F.col("_m").isin([s for s, m in models.items() if m[2]]), 0.5).otherwise(1.0)
    x = rows.select(model.alias("_m"), body.alias("_out"), (body + head).alias("_in"))
    cost = (F.col("_in") * price(0) + F.col("_out") * price(1)) * half
    return x.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(F.col("_in").cast("long")), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum(F.col("_out").cast("long")), F.lit(0)).alias("tokens_out"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"),
    )


def embedding_cost(rows: DataFrame, price: float) -> DataFrame:
    """``texts`` and ``cost`` of embedding every distinct text of edits and their sources once, four characters a token."""
    edited = rows.where((F.col("text_type") == "ai_edited") & (F.col("source_text") != "") & (F.col("text") != ""))
    texts = edited.select(F.explode(F.array("text", "source_text")).alias("t"))
    each = texts.select(F.sha2("t", 256).alias("h"), F.length("t").alias("n")).distinct()
    return each.agg(F.count("*").alias("texts"), (F.coalesce(F.sum("n"), F.lit(0)) / 4.0 * price).alias("cost"))
