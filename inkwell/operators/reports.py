"""Reports over scored release rows: detection, frozen thresholds, correlations, variants, domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import decode
from inkwell.operators import metrics, ranking, requests, sampling
from inkwell.sources import store


def binary_metrics(rows: DataFrame, groups: list[str], threshold: float | None = None) -> DataFrame:
    """Per group with rows of both classes (``label`` 0/1, null left out): ``n``, AUROC, TPR at 1 % and 5 % FPR
    and, for a shipped ``threshold``, the share of each class scored above it."""
    known = store.materialise(rows.where("label is not null").select(*groups, "label", "score"))
    out = metrics.detection(known, groups).where("auroc is not null")
    if threshold is None:
        return out
    above = (F.col("score") > threshold).cast("int")
    rates = known.groupBy(*groups).agg(F.avg(F.when(F.col("label") == 0, above)).alias("shipped_fpr"), F.avg(F.when(F.col("label") == 1, above)).alias("shipped_tpr"))
    if not groups:
        return out.join(F.broadcast(rates))  # one row each
    joined = out.alias("a").join(rates.alias("b"), ranking.same("a", "b", groups))
    return joined.select("a.*", "b.shipped_fpr", "b.shipped_tpr")


def _long(df: DataFrame, section: str, name: Column, values: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
    return df.select(F.lit(section).alias("section"), name.alias("name"), F.explode(pairs).alias("m")).select("section", "name", "m.*")


def release_report(rows: DataFrame, ternary: tuple[float, float] | None = None, threshold: float | None = None) -> DataFrame:
    """``section``, ``name``, ``metric``, ``value`` over rows with ``label_binary``, ``label_ternary``, ``edit_target``,
    ``variant``, ``domain`` and ``score``.

    Sections: ``binary`` and ``by_domain`` as ``binary_metrics``; ``ternary`` macro and class F1 at frozen
    thresholds, if all three classes are there; ``edit_correlation`` with the edit target, of two
    rows at least; ``by_variant`` mean and median score. Sections without rows are left out.
    """
    rows = store.materialise(rows.select("label_binary", "label_ternary", "edit_target", "variant", "domain", "score"))
    labelled = rows.withColumn("label", F.col("label_binary"))
    names = ["n", "auroc", "tpr_at_fpr1", "tpr_at_fpr5", *(["shipped_fpr", "shipped_tpr"] if threshold is not None else [])]
    parts = [
        _long(binary_metrics(labelled, [], threshold), "binary", F.lit("all"), names),
        _long(binary_metrics(labelled, ["domain"], threshold), "by_domain", F.col("domain"), names),
    ]
    by_variant = ranking.counted(rows, ["variant"], "score").groupBy("variant").agg(
        (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean"), ranking.interpolated(0.5, "score").alias("median"), F.sum("n").alias("rows")
    )
    parts.append(_long(by_variant, "by_variant", F.col("variant"), ["mean", "median", "rows"]))
    target = rows.where("edit_target is not null")
    ranks = ranking.with_average_rank(ranking.with_average_rank(target.select(F.lit(1).alias("g"), "edit_target", "score"), ["g"], "edit_target", "ra"), ["g"], "score", "rb")
    correlation = ranks.agg(F.corr("edit_target", "score").alias("pearson"), F.corr("ra", "rb").alias("spearman"), F.count("*").alias("n")).where("n >= 2")
    parts.append(_long(correlation, "edit_correlation", F.lit("all"), ["pearson", "spearman", "n"]))
    if ternary is not None:
        called = rows.where("label_ternary is not null").withColumn("pred", decode.shipped_label(F.col("score"), F.lit(ternary[0]), F.lit(ternary[1])))
        f1 = metrics.class_f1(called, "label_ternary", "pred", [0, 1, 2])
        of = lambda c: F.max(F.when(F.col("class") == c, F.col("f1")))
        one = f1.agg(F.min("support").alias("least"), F.avg("f1").alias("macro_f1"), of(0).alias("f1_human"), of(1).alias("f1_generated"), of(2).alias("f1_edited")).where("least > 0")
        parts.append(_long(one, "ternary", F.lit("all"), ["macro_f1", "f1_human", "f1_generated", "f1_edited"]))
    return reduce(DataFrame.unionByName, parts)


def strata_at_fpr(rows: DataFrame, strata: list[str], by: str = "domain", fpr: float = 0.05, limit: int | None = None, key: str = "row_id") -> DataFrame:
    """``strata``, ``rows``, ``tpr``: machine rows scored above their ``by``'s human quantile. ``limit`` takes so many
    rows in hash order of the key, a mix of all strata, for a trial run."""
    rows = store.materialise(rows if limit is None else rows.orderBy(*sampling.hash_order(key)).limit(limit))
    cuts = metrics.quantile_threshold(rows, [by], fpr).select(F.col(by).alias("_by"), "threshold")
    ai = rows.where("label = 1").join(cuts, F.col(by).eqNullSafe(F.col("_by")))
    return ai.groupBy(*strata).agg(F.count("*").alias("rows"), F.avg((F.col("score") > F.col("threshold")).cast("int")).alias("tpr"))


def compared(rows: DataFrame, scores: list[str], threshold: float, unit: str, samples: int) -> DataFrame:
    """``model``, ``tpr``, ``low``, ``high``, ``samples`` of each score column at ``threshold`` and of the first less the
    second; replicates draw whole units, the same ones for all models."""
    pos = F.col("label") == 1
    sums = {"pos": pos.cast("int")} | {s: (pos & (F.col(s) > threshold)).cast("int") for s in scores}
    reps = store.materialise(metrics.bootstrap_sums(rows, unit, samples, sums))
    point = rows.agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    share = lambda s: metrics.ratio(F.col(s), F.col("pos"))
    shown = {s: share(s) for s in scores} | {f"{scores[0]}-{scores[1]}": share(scores[0]) - share(scores[1])}

    def one(name: str, value: Column) -> DataFrame:
        got = metrics.interval(reps.withColumn("_v", value), "_v")
        return got.join(F.broadcast(point.select(value.alias("tpr")))).select(F.lit(name).alias("model"), "tpr", "low", "high", "samples")

    return reduce(DataFrame.unionByName, [one(n, v) for n, v in shown.items()])


def attack_slice(rows: DataFrame, output: str, by: Column, sources: DataFrame, keys: list[str], humans: DataFrame | None = None) -> DataFrame:
    """Paraphrases of ``rows`` that pass their checks, edits with the text they came from (those without one
    go) and, for slices that are measured, human rows."""
    from inkwell.operators import joins

    kept = joins.attach_sources(requests.paraphrased(rows, output, by).drop("source_text"), sources, keys)
    return kept if humans is None else kept.unionByName(humans, allowMissingColumns=True)
