"""Scores from logits, calibrated labels and vector measures, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.textfn import let

# Cuts between the buckets of a language's edit magnitudes.
BUCKET_CUTS = {"en": (0.029, 0.148), "ja": (0.019, 0.111), "zh-tw": (0.018, 0.096)}


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def corn_cumulative(logits: Column) -> Column:
    """Running products of the sigmoids: P(rank > k)."""
    zero = F.struct(F.lit(1.0).alias("p"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        p = acc["p"] / (1 + F.exp(-x))
        return F.struct(p.alias("p"), F.concat(acc["out"], F.array(p)).alias("out"))

    return F.aggregate(logits, zero, step, lambda acc: acc["out"])


def corn_buckets(cumulative: Column) -> Column:
    one, none = F.array(F.lit(1.0)), F.array(F.lit(0.0))
    return F.zip_with(F.concat(one, cumulative), F.concat(cumulative, none), lambda a, b: a - b)


def corn_score(cumulative: Column) -> Column:
    return total(cumulative) / F.size(cumulative)


def corn_rank(cumulative: Column) -> Column:
    return F.size(F.filter(cumulative, lambda p: p > 0.5))


def softmax(logits: Column) -> Column:
    shifted = lambda x: F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return let(let(logits, shifted), lambda e: F.transform(e, lambda v: v / total(e)))


def expected_rank(probabilities: Column) -> Column:
    """The expected bucket over the number of buckets less one."""
    ranks = F.transform(probabilities, lambda p, i: p * i)
    return total(ranks) / (F.size(probabilities) - 1)


def score_to_bucket(score: Column, n: int, low: Column, high: Column) -> Column:
    """0 up to ``low``, n-1 from ``high``, in between 1 and up by equal steps."""
    inner = 1 + F.floor((score - low) / F.nullif(high - low, F.lit(0.0)) * (n - 2))
    return F.when(score <= low, 0).when(score >= high, n - 1).otherwise(F.least(inner, F.lit(n - 2))).cast("int")


def ternary(scaled: Column, human: Column, ai: Column) -> Column:
    """1 above ``ai`` (which wins an overlap), 0 below ``human``, else 2."""
    return F.when(scaled > ai, 1).when(scaled < human, 0).otherwise(2)


def shipped_label(scaled: Column, human: Column, ai: Column) -> Column:
    """As ``ternary``, but human wins an overlap."""
    return F.when(scaled < human, 0).when(scaled > ai, 1).otherwise(2)


def calibrated(scalar: Column, low: float, high: float, flip: bool = False) -> Column:
    """Oriented, scaled to 0..1 and clipped."""
    x = (-scalar if flip else scalar).cast("double")
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when(norm > 0, dot / norm).otherwise(0.0)


def logit_score(logits: Column, ai_label: int | None = None) -> Column:
    """The sigmoid of one logit; of several the probability of ``ai_label``, or the expected rank."""
    p = softmax(logits)
    many = expected_rank(p) if ai_label is None else F.get(p, F.lit(ai_label))
    return F.when(F.size(logits) == 1, 1 / (1 + F.exp(-logits[0]))).otherwise(many)


def graded_score(logits: Column, head: Column) -> Column:
    """The expected rank by the head's kind, ``seqcls`` or ``corn``; other kinds fail."""
    other = F.raise_error(F.concat(F.lit("unknown head "), F.coalesce(head, F.lit("null")))).cast("double")
    return F.when(head == "seqcls", logit_score(logits)).when(head == "corn", corn_score(corn_cumulative(logits))).otherwise(other)


def decoded(logits: Column, calibration: dict, binary: bool = False) -> Column:
    """struct(label, ai_involvement, bucket_probs) by a calibration's head, range, sign and thresholds."""
    if calibration.get("head_type", "seqcls") == "corn":
        scalar, probs = corn_score(corn_cumulative(logits)), corn_buckets(corn_cumulative(logits))
    else:
        scalar, probs = expected_rank(softmax(logits)), softmax(logits)
    scaled = calibrated(scalar, calibration["score_min"], calibration["score_max"], calibration["flip"])
    if binary:
        label = F.when(scaled > calibration["binary_threshold"], "AI").otherwise("human")
    else:
        place = shipped_label(scaled, F.lit(calibration["h_thresh"]), F.lit(calibration["ai_thresh"]))
        label = F.get(F.array(*map(F.lit, calibration["label_names"])), place)
    names = F.array(*map(F.lit, calibration["bucket_descriptions"]))
    return F.struct(
        label.alias("label"), F.bround(scaled, 3).alias("ai_involvement"),
        F.map_from_arrays(names, F.transform(probs, lambda p: F.bround(p, 3))).alias("bucket_probs"),
    )
