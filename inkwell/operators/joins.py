"""Joins that prove what they cover, and lookups between row sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import decode
from inkwell.operators.sampling import first_per_group
from inkwell.sources import store


def key_faults(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys of ``left`` that ``right`` lacks, of ``right`` that ``left`` lacks, repeated in
    either. Keys are counted before they are shuffled, once for all four."""
    side = lambda df, l, r: df.select(*keys, F.lit(l).alias("_l"), F.lit(r).alias("_r"))  # noqa: E731, E741
    n = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(*keys).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    return n.agg(
        F.count_if(F.expr("r = 0")).alias("missing"), F.count_if(F.expr("l = 0")).alias("unexpected"),
        F.count_if(F.expr("l > 1")).alias("repeated_left"), F.count_if(F.expr("r > 1")).alias("repeated_right"),
    )


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], exact: bool = True) -> DataFrame:
    """The inner join, after a pass over the keys proved it one to one; ``exact`` also demands
    that no key of ``right`` is unexpected. Null keys count as missing."""
    known = " and ".join(f"`{k}` is not null" for k in keys)
    found = key_faults(left, right.where(known), keys).first().asDict()
    faults = {k: v for k, v in found.items() if v and (exact or k != "unexpected")}
    if faults:
        raise ValueError(f"keys don't match one to one: {faults}")
    return left.join(right, keys)


def with_predictions(rows: DataFrame, predictions: dict[str, DataFrame], key: str = "row_id") -> DataFrame:
    """``rows`` with ``score_<name>`` of each prediction set; every row needs one finite score of each."""

    def add(df: DataFrame, item: tuple[str, DataFrame]) -> DataFrame:
        name, scores = item
        bad = scores.where(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")))
        if not bad.isEmpty():
            raise ValueError(f"scores of {name} are null or not finite")
        return one_to_one(df, scores.select(key, F.col("score").alias(f"score_{name}")), [key])

    return reduce(add, predictions.items(), rows)


def latest_text(rows: DataFrame, keys: list[str], order: str, text_col: str = "text") -> DataFrame:
    """The text with the highest ``order`` of each key, ids as strings: the last write wins."""
    named = [F.col(k).cast("string").alias(k) for k in keys]
    return rows.select(*named, text_col, order).groupBy(*keys).agg(F.max_by(text_col, order).alias("source_text"))


def attach_sources(rows: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Edited rows with the ``source_text`` of their key; those without one go, others pass with null."""
    named = reduce(lambda df, k: df.withColumn(k, F.col(k).cast("string")), keys, rows)
    edited = F.col("text_type") == "ai_edited"
    joined = named.join(sources, keys, "left")
    return joined.where(~edited | F.col("source_text").isNotNull()).withColumn("source_text", F.when(edited, F.col("source_text")))


def edit_magnitudes(rows: DataFrame, vectors: DataFrame, clip: int = 8000) -> DataFrame:
    """``rows`` with ``cosine_score``: the distance of the vectors of text and source text, looked
    up by the hash of the clipped texts in ``vectors`` (``text_sha256``, ``vector``). A row without
    a source text gets null; one whose vector is missing fails."""
    sha = lambda c: F.sha2(F.substring(c, 1, clip), 256)
    side = lambda name: vectors.select(F.col("text_sha256").alias(f"_k{name}"), F.col("vector").alias(f"_v{name}"))
    both = rows.join(side("a"), sha("text") == F.col("_ka"), "left").join(side("b"), sha("source_text") == F.col("_kb"), "left")
    lost = F.col("source_text").isNotNull() & (F.col("_va").isNull() | F.col("_vb").isNull())
    score = F.when(lost, F.raise_error(F.lit("no vector for a text")).cast("double")).when(F.col("source_text").isNotNull(), 1 - decode.cosine(F.col("_va"), F.col("_vb")))
    return both.withColumn("cosine_score", score).drop("_ka", "_kb", "_va", "_vb")


def unused_prompts(cached: DataFrame, prompts: DataFrame, k: int, doc: str = "doc_id") -> DataFrame:
    """``k`` more prompts for each document with cached edits (``doc``, ``prompt_id``): of the split of its prompts,
    not used yet, the first by SHA-256 of document and prompt. ``prompts`` is the pool of a
    language (``prompt_id``, ``split``), some dozens of rows."""
    pool = store.small(prompts)
    splits = cached.join(pool, "prompt_id").select(doc, "split").distinct()
    free = splits.join(pool, "split").join(cached.select(doc, "prompt_id"), [doc, "prompt_id"], "left_anti")
    order = F.sha2(F.concat_ws("\0", F.col(doc).cast("string"), "prompt_id"), 256)
    return first_per_group(free, [doc], [order, "prompt_id"], k).select(doc, "prompt_id", "split")


def without_sources_of(rows: DataFrame, invalid: Column, source: str) -> DataFrame:
    """``rows`` without any row of a source that has an ``invalid`` one."""
    return rows.join(rows.where(invalid).select(source).distinct(), source, "left_anti")


def aligned(a: DataFrame, b: DataFrame, key: str, same: str) -> DataFrame:
    """``key``, ``a``, ``b`` (scores) and the other columns of ``a``; keys and the ``same`` column must match."""
    right = b.select(key, F.col(same).alias("_same"), F.col("score").alias("b"))
    both = one_to_one(a.withColumnRenamed("score", "a"), right, [key])
    if not both.where(~F.col(same).eqNullSafe(F.col("_same"))).isEmpty():
        raise ValueError(f"{same} differs between the two results")
    return both.drop("_same")


def covered(rows: DataFrame, subset: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key the subset has; a key of the subset that ``rows`` lack fails."""
    keys = subset.select(key).distinct()
    if not keys.join(rows, key, "left_anti").isEmpty():
        raise ValueError(f"rows don't cover every {key} of the subset")
    return rows.join(keys, key, "left_semi")
