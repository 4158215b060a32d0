"""Detection metrics as aggregates; all take frames with ``label`` (0/1) and ``score`` and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import decode
from inkwell.operators import ranking
from inkwell.sources import store


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def curve(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Distinct scores of each group with ``p`` and ``neg``, their positive and negative rows, and
    the sums of both before them and in all."""
    v = rows.groupBy(*groups, "score").agg(F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    return ranking.running(v, groups, "score", ["p", "neg"])


def _area() -> Column:
    wins = F.sum(F.col("p") * (F.col("neg_before") + F.col("neg") / 2.0))
    return wins / F.nullif(F.sum("p") * F.sum("neg"), F.lit(0))


def auroc(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Area under the ROC curve by average ranks; null for a group of one class."""
    return curve(rows, groups).groupBy(*groups).agg(_area().alias("auroc"), F.sum("p").alias("n_pos"), F.sum("neg").alias("n_neg"))


def _quantile(fpr: float) -> Column:
    return ranking.interpolated(1 - fpr, "score", "neg")


def quantile_threshold(rows: DataFrame, groups: list[str], fpr: float) -> DataFrame:
    """The interpolated 1 - fpr quantile of human scores."""
    return curve(rows, groups).groupBy(*groups).agg(_quantile(fpr).alias("threshold"))


def conformal_threshold(rows: DataFrame, groups: list[str], fpr: float) -> DataFrame:
    """The ceil((n + 1)(1 - fpr))-th smallest human score, infinite beyond n."""
    rank = F.ceil(F.round((F.col("neg_total") + 1) * F.lit(1 - fpr), 9))
    c = curve(rows.where("label = 0"), groups)
    return c.groupBy(*groups).agg(F.coalesce(ranking.at(rank - 1, "score", "neg"), F.lit(float("inf"))).alias("threshold"))


def hardest_threshold(rows: DataFrame, groups: list[str], fpr: float) -> DataFrame:
    """The largest conformal threshold over the groups and the group that has it."""
    t = conformal_threshold(rows, groups, fpr)
    return t.agg(F.coalesce(F.max("threshold"), F.lit(float("inf"))).alias("threshold"), F.max_by(F.concat_ws("|", *groups), F.struct("threshold", F.concat_ws("|", *groups))).alias("binding"))


def detection(rows: DataFrame, groups: list[str], fprs: tuple = (0.01, 0.05)) -> DataFrame:
    """``n``, AUROC and, at each rate, the TPR above the group's own quantile; null for one class."""
    c = store.materialise(curve(rows, groups))
    cuts = c.groupBy(*groups).agg(*[_quantile(f).alias(f"_t{i}") for i, f in enumerate(fprs)])
    joined = c.alias("c").join(cuts.alias("t"), ranking.same("c", "t", groups)) if groups else c.alias("c").join(F.broadcast(cuts.alias("t")))
    over = [ratio(F.sum(F.when(F.col("score") > F.col(f"_t{i}"), F.col("p")).otherwise(0)), F.sum("p")) for i in range(len(fprs))]
    both = F.sum("p") * F.sum("neg") > 0
    return joined.groupBy(*[F.col(f"c.{g}").alias(g) for g in groups]).agg(
        F.sum(F.col("p") + F.col("neg")).alias("n"), _area().alias("auroc"), *[F.when(both, x).alias(f"tpr_at_fpr{round(f * 100)}") for x, f in zip(over, fprs)]
    )


def tpr_variants(rows: DataFrame, groups: list[str], fpr: float) -> DataFrame:
    """TPR above the quantile, from the quantile on, and the best of the staircase with FPR <= fpr."""
    c = store.materialise(curve(rows, groups))
    cuts = c.groupBy(*groups).agg(_quantile(fpr).alias("_t"))
    joined = c.alias("c").join(cuts.alias("t"), ranking.same("c", "t", groups))
    share = lambda test: ratio(F.sum(F.when(test, F.col("p")).when(F.col("_t").isNotNull(), 0)), F.sum("p"))
    tp = ratio(F.col("p_total") - F.col("p_before"), F.col("p_total"))
    fp = ratio(F.col("neg_total") - F.col("neg_before"), F.col("neg_total"))
    return joined.groupBy(*[F.col(f"c.{g}").alias(g) for g in groups]).agg(
        share(F.col("score") > F.col("_t")).alias("tpr_gt"), share(F.col("score") >= F.col("_t")).alias("tpr_ge"),
        F.coalesce(F.max(F.when(fp <= fpr, tp)), F.lit(0.0)).alias("tpr_stairs"),
    )


def best_thresholds(rows: DataFrame, groups: list[str], steps: int = 1000) -> DataFrame:
    """``best_threshold`` of each group. Thresholds between two scores are alike, so only the grid
    cells that hold scores are looked at, ``steps`` a group at most."""
    last = steps - 1
    cell = F.least(F.greatest(F.floor(F.col("score") * last + 1e-9), F.lit(-1)), F.lit(last)).cast("int")
    hist = rows.groupBy(*groups, cell.alias("cell")).agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    own = Window.partitionBy(*groups)
    up = own.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    f1 = ratio(2.0 * F.sum("p").over(up), F.sum("n").over(up) + F.sum("p").over(own))
    first = F.coalesce(F.lag("cell").over(own.orderBy("cell")) + 1, F.lit(0))
    h = hist.select(*groups, F.when(F.col("cell") < 0, 0.0).otherwise(F.coalesce(F.round(f1, 9), F.lit(0.0))).alias("f1"), first.alias("first"))
    best = h.groupBy(*groups).agg(F.max(F.struct("f1", (-F.col("first")).alias("at"))).alias("b"))
    return best.select(*groups, (-F.col("b.at") / F.lit(float(last))).alias("threshold"), F.col("b.f1").alias("f1"))


def binary_report(rows: DataFrame, groups: list[str], truth: str = "label", predicted: str = "pred") -> DataFrame:
    """``n``, macro-F1 (null for one true class), FPR and FNR (null without rows to err on)."""
    cell = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(predicted) == p))
    c = rows.groupBy(*groups).agg(F.count("*").alias("n"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    f1 = lambda hit: F.coalesce(ratio(2.0 * hit, 2 * hit + fp + fn), F.lit(0.0))
    macro = F.when((tn + fp > 0) & (tp + fn > 0), (f1(tn) + f1(tp)) / 2)
    return c.select(*groups, "n", macro.alias("macro_f1"), ratio(fp, fp + tn).alias("fpr"), ratio(fn, fn + tp).alias("fnr"))


def fit_scale(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Per group the sign that gives label 1 the higher mean (1 if a class is missing) and the
    range ``low`` to ``high`` of the scores so oriented."""
    mean = lambda k: F.avg(F.when(F.col("label") == k, F.col("score")))
    g = rows.groupBy(*groups).agg(F.when(mean(0) > mean(1), -1.0).otherwise(1.0).alias("sign"), F.min("score").alias("_a"), F.max("score").alias("_b"))
    low, high = F.least(F.col("sign") * F.col("_a"), F.col("sign") * F.col("_b")), F.greatest(F.col("sign") * F.col("_a"), F.col("sign") * F.col("_b"))
    return g.select(*groups, "sign", low.alias("low"), high.alias("high"))


def scaled() -> Column:
    """The oriented score over columns ``score``, ``sign``, ``low``, ``high``; 0 if the range is empty."""
    return F.coalesce(ratio(F.col("sign") * F.col("score") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))


def detector_binary(val: DataFrame, split: DataFrame, by: str = "detector") -> DataFrame:
    """Per detector: sign, range and threshold fitted on ``val``, applied to ``split`` (both with
    ``label`` and ``score``), with AUROC and TPR at FPRs of the oriented scores."""
    fit = store.materialise(fit_scale(val, [by]))  # a row a detector
    cut = best_thresholds(val.join(fit, by).withColumn("score", scaled()), [by]).select(by, "threshold")
    applied = split.join(fit.join(cut, by), by)
    inside = F.least(F.greatest(scaled(), F.lit(0.0)), F.lit(1.0))
    report = binary_report(applied.withColumn("pred", (inside >= F.col("threshold")).cast("int")), [by])
    free = detection(applied.withColumn("score", F.col("sign") * F.col("score")).select(by, "label", "score"), [by])
    return report.join(free.drop("n"), by)


def ternary_report(rows: DataFrame, groups: list[str], truth: str, predicted: str) -> DataFrame:
    """``n``, accuracy, F1 of classes 0 to 2 and their mean; a class without rows or guesses has 0."""
    hit = lambda k: F.count_if((F.col(truth) == k) & (F.col(predicted) == k))
    either = lambda k: F.count_if(F.col(truth) == k) + F.count_if(F.col(predicted) == k)
    f1 = [F.coalesce(ratio(2.0 * hit(k), either(k)), F.lit(0.0)) for k in range(3)]
    return rows.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("accuracy"),
        *[x.alias(f"f1_{k}") for k, x in enumerate(f1)], ((f1[0] + f1[1] + f1[2]) / 3).alias("macro_f1"),
    )


def detector_ternary(val: DataFrame, split: DataFrame, by: str = "detector") -> DataFrame:
    """Per detector: sign and two thresholds fitted on ``val`` (``label`` 0 human, 1 generated,
    2 edited), applied to ``split`` scaled by its own range."""
    sign = store.materialise(fit_scale(val, [by]))
    v = val.join(sign, by).withColumn("score", scaled())
    human = best_thresholds(v.withColumn("label", (F.col("label") > 0).cast("int")), [by]).select(by, F.col("threshold").alias("h"))
    ai = best_thresholds(v.withColumn("label", (F.col("label") == 1).cast("int")), [by]).select(by, F.col("threshold").alias("a"))
    oriented = split.join(sign.select(by, "sign"), by).withColumn("score", F.col("sign") * F.col("score")).drop("sign")
    ends = oriented.groupBy(by).agg(F.lit(1.0).alias("sign"), F.min("score").alias("low"), F.max("score").alias("high"))
    applied = oriented.join(ends, by).join(human, by).join(ai, by)
    return ternary_report(applied.withColumn("pred", decode.ternary(scaled(), F.col("h"), F.col("a"))), [by], "label", "pred")


def best_threshold(rows: DataFrame, steps: int = 1000) -> DataFrame:
    """Of ``steps`` even thresholds over 0..1 the first of the best F1 (score >= threshold is 1).

    Scores are counted into the grid's intervals first: the scan over thresholds then reads
    ``steps`` rows, however many scores there are.
    """
    last = steps - 1
    cell = F.least(F.greatest(F.floor(F.col("score") * last + 1e-9), F.lit(-1)), F.lit(last)).cast("int")
    hist = rows.groupBy(cell.alias("cell")).agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    grid = rows.sparkSession.range(-1, steps).select(F.col("id").cast("int").alias("cell")).join(hist, "cell", "left").fillna(0)
    up = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    g = grid.withColumn("tp", F.sum("p").over(up)).withColumn("at", F.sum("n").over(up)).withColumn("pos", F.sum("p").over(Window.partitionBy()))
    f1 = F.coalesce(F.round(ratio(2.0 * F.col("tp"), F.col("at") + F.col("pos")), 9), F.lit(0.0))
    return g.where("cell >= 0").select((F.col("cell") / F.lit(float(last))).alias("threshold"), f1.alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


def domain_protocol(rows: DataFrame, fpr: float, domain: str = "domain") -> DataFrame:
    """Orientation from pooled means; a domain's threshold at ``fpr``, its TPR and FPR; domains of
    one class are left out."""
    means = rows.agg(F.avg(F.when(F.col("label") == 1, F.col("score"))).alias("m1"), F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("m0"))
    oriented = rows.crossJoin(F.broadcast(means)).withColumn("score", F.when(F.col("m0") > F.col("m1"), -F.col("score")).otherwise(F.col("score"))).drop("m0", "m1")
    thr = quantile_threshold(oriented, [domain], fpr)
    rate = lambda k: F.avg(F.when(F.col("label") == k, (F.col("score") > F.col("threshold")).cast("double")))
    return oriented.join(thr, domain).groupBy(domain).agg(F.first("threshold").alias("threshold"), rate(1).alias("tpr"), rate(0).alias("fpr")).where("tpr is not null and fpr is not null")


def class_f1(rows: DataFrame, truth: str, predicted: str, classes: list[int]) -> DataFrame:
    """Per class of ``classes``: support, true positives and F1 (0 if there is none to find)."""
    c = rows.sparkSession.createDataFrame([(x,) for x in classes], "class int")
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    j = c.join(cells, (F.col("class") == F.col("t")) | (F.col("class") == F.col("p")), "left")
    tp = F.coalesce(F.sum(F.when((F.col("class") == F.col("t")) & (F.col("class") == F.col("p")), F.col("n"))), F.lit(0))
    either = F.coalesce(F.sum(F.when(F.col("class") == F.col("t"), F.col("n"))), F.lit(0)) + F.coalesce(F.sum(F.when(F.col("class") == F.col("p"), F.col("n"))), F.lit(0))
    support = F.coalesce(F.sum(F.when(F.col("class") == F.col("t"), F.col("n"))), F.lit(0))
    return j.groupBy("class").agg(support.alias("support"), tp.alias("tp"), F.coalesce(ratio(2.0 * tp, either), F.lit(0.0)).alias("f1"))


def bootstrap_sums(rows: DataFrame, unit: str, samples: int, sums: dict[str, Column], groups: list[str] | None = None) -> DataFrame:
    """The weighted ``sums`` of each replicate (and group): rows are summed to units first, so only
    units are multiplied by replicates."""
    groups = groups or []
    units = rows.groupBy(*groups, unit).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return bootstrap_weights(units, unit, samples).groupBy(*groups, "rep").agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n in sums])


def interval(replicates: DataFrame, column: str, groups: list[str] | None = None) -> DataFrame:
    """``samples`` with a value and their 2.5 % and 97.5 % points."""
    point = lambda q: F.percentile(column, F.lit(q))  # noqa: E731  (a value a replicate)
    return replicates.groupBy(*(groups or [])).agg(F.count(column).alias("samples"), point(0.025).alias("low"), point(0.975).alias("high"))


def bootstrap_weights(rows: DataFrame, unit: str, samples: int) -> DataFrame:
    """Rows times replicates with ``w``, a Poisson(1) weight of (replicate, unit) by hash: units
    draw together, reruns agree, and paired models share draws."""
    rep = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("rep").cast("string"), F.col(unit).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    # The Poisson(1) distribution function at 0, 1, 2, 3, 4 and 5.
    cdf = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    weight = F.lit(0)
    for p in cdf:
        weight = weight + F.when(u >= p, 1).otherwise(0)
    return rep.withColumn("w", weight).where("w > 0")


def slice_auroc(rows: DataFrame, slices: Column, by: str = "slice") -> DataFrame:
    """``by``, ``n``, AUROC of each slice a row is in (``slices``, an array of names) and, for a
    slice of one class, the mean score instead."""
    each = rows.select(F.explode(slices).alias(by), "label", "score")
    c = curve(each, [by])
    mean = F.sum(F.col("score") * (F.col("p") + F.col("neg"))) / F.sum(F.col("p") + F.col("neg"))
    return c.groupBy(by).agg(F.sum(F.col("p") + F.col("neg")).alias("n"), _area().alias("auroc"), F.when(F.sum("p") * F.sum("neg") == 0, mean).alias("mean"))


def agreement(rows: DataFrame, groups: list[str], max_mean: float = 0.01, max_any: float = 0.05) -> DataFrame:
    """How well scores ``a`` and ``b`` of the same rows agree, per group: ``n``, Pearson, mean and
    largest difference, and whether both stay within the limits."""
    gap = F.abs(F.col("a") - F.col("b"))
    r = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.corr("a", "b").alias("pearson"), F.avg(gap).alias("mae"), F.max(gap).alias("max_diff"))
    return r.withColumn("passes", (F.col("mae") <= max_mean) & (F.col("max_diff") <= max_any))


def calibration(val: DataFrame, test: DataFrame, fpr: float = 0.01, least: float | None = None, steps: int = 1000) -> DataFrame:
    """One row: ``flip``, ``score_min``, ``score_max``, ``h_thresh``, ``ai_thresh``, ``binary_threshold``,
    ``binding`` and the ``macro_f1`` on ``test`` (both with ``group``, ``label`` 0 human, 1 generated,
    2 edited, and ``score``).

    Scores are oriented and scaled by the range of ``val``; the binary threshold is the largest of the
    human groups' at ``fpr``, ties to the smaller name. A test macro-F1 of ``least`` or under fails.
    """
    fit = store.materialise(fit_scale(val, []))
    inside = F.least(F.greatest(scaled(), F.lit(0.0)), F.lit(1.0))
    both = [x.join(F.broadcast(fit)).withColumn("score", inside) for x in (val, test)]  # fit is one row
    v = store.materialise(both[0].select("group", "label", "score"))
    human = best_threshold(v.withColumn("label", (F.col("label") > 0).cast("int")), steps).select(F.col("threshold").alias("h_thresh"))
    ai = best_threshold(v.withColumn("label", (F.col("label") == 1).cast("int")), steps).select(F.col("threshold").alias("ai_thresh"))
    cuts = store.materialise(quantile_threshold(v.where("label = 0"), ["group"], fpr))
    top = cuts.orderBy(F.desc("threshold"), "group").limit(1).select(F.col("threshold").alias("binary_threshold"), F.col("group").alias("binding"))
    out = fit.select((F.col("sign") < 0).alias("flip"), F.col("low").alias("score_min"), F.col("high").alias("score_max"))
    for one in (human, ai, top):
        out = out.join(F.broadcast(one))
    out = store.materialise(out)
    called = both[1].join(F.broadcast(out.select("h_thresh", "ai_thresh"))).withColumn("pred", decode.ternary(F.col("score"), F.col("h_thresh"), F.col("ai_thresh")))
    f1 = F.col("macro_f1")
    if least is not None:
        f1 = F.when(f1 > least, f1).otherwise(F.raise_error(F.lit("the calibration misses its check on test")).cast("double"))
    return out.join(F.broadcast(ternary_report(called, [], "label", "pred").select(f1.alias("macro_f1"))))
