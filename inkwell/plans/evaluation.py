"""Queries that evaluate detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import filters, joins, metrics, sampling
from inkwell.plans.registry import LABELLED, SCORE, TYPES, docs_of, labelled, query, score, text_type

_TPR = "round(avg(CASE WHEN y = 1 THEN (score > {t})::INT END), 6)"


@query(f"""WITH x AS ({LABELLED}), h AS (SELECT lang, score, row_number() OVER (PARTITION BY lang ORDER BY score) AS r, count(*) OVER (PARTITION BY lang) AS n FROM x WHERE label = 0),
t AS (SELECT lang, coalesce(max(CASE WHEN r = ceil(round((n + 1) * 0.8, 9)) THEN score END), 'inf'::DOUBLE) AS threshold FROM h GROUP BY lang)
SELECT round(threshold, 9) AS threshold, lang AS binding FROM t ORDER BY t.threshold DESC, lang DESC LIMIT 1""")
def hardest_group_threshold(spark, sf_dir):
    return metrics.hardest_threshold(labelled(spark, sf_dir), ["lang"], 0.2).select(F.round("threshold", 9).alias("threshold"), "binding")


@query(f"""WITH x AS (SELECT lang, (doc_id % 3 > 0)::INT AS y, {SCORE} AS score FROM documents), t AS (SELECT lang, quantile_cont(score, 0.99) AS t1, quantile_cont(score, 0.95) AS t5 FROM x WHERE y = 0 GROUP BY lang),
r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS k FROM x),
a AS (SELECT lang, count(*) AS n, (sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auroc FROM r GROUP BY lang)
SELECT lang, any_value(n)::BIGINT AS n, round(any_value(auroc), 6) AS auroc, {_TPR.format(t='t1')} AS tpr_at_fpr1, {_TPR.format(t='t5')} AS tpr_at_fpr5 FROM x JOIN t USING (lang) JOIN a USING (lang) GROUP BY lang""")
def any_ai_detection(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("lang", (F.col("doc_id") % 3 > 0).cast("int").alias("label"), score().alias("score"))
    r = metrics.detection(d, ["lang"])
    return r.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("auroc", "tpr_at_fpr1", "tpr_at_fpr5")])


@query(f"""WITH x AS (SELECT lang, (doc_id % 3)::INT AS y, ({SCORE} > 0.5)::INT AS p FROM documents WHERE {TYPES} <> 'ai_edited'),
c AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp FROM x GROUP BY lang)
SELECT lang, n::BIGINT AS n, round((2.0 * tn / (2 * tn + fp + fn) + 2.0 * tp / (2 * tp + fp + fn)) / 2, 6) AS macro_f1, round(fp / (fp + tn), 6) AS fpr, round(fn / (fn + tp), 6) AS fnr FROM c""")
def binary_report(spark, sf_dir):
    d = filters.binary_view(docs_of(spark, sf_dir).withColumn("text_type", text_type())).withColumn("pred", (score() > 0.5).cast("int"))
    r = metrics.binary_report(d, ["lang"], "y")
    return r.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("macro_f1", "fpr", "fnr")])


_LONG = f"""WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS val, (doc_id % 3)::INT AS label, unnest([{{'d': 'plain', 's': {SCORE}}}, {{'d': 'mirrored', 's': 1 - (CAST('0x' || substr(md5('m' || doc_id), 1, 8) AS BIGINT) / 4294967296.0) * (doc_id % 3) / 4}}]) AS u FROM documents),
x AS (SELECT val, label, u.d AS detector, u.s::DOUBLE AS score FROM d)"""


def _long(spark, sf_dir):
    """Half of the documents to calibrate on, half to evaluate, under two detectors."""
    d = docs_of(spark, sf_dir).select("doc_id", (F.col("doc_id") % 3).cast("int").alias("label"), score().alias("plain"), (1 - score("m") * (F.col("doc_id") % 3) / 4).alias("mirrored"))
    x = d.unpivot(["doc_id", "label"], ["plain", "mirrored"], "detector", "score")
    return x.where("doc_id % 2 = 0"), x.where("doc_id % 2 = 1")


@query(f"""{_LONG}, b AS (SELECT * FROM x WHERE label < 2), g AS (SELECT detector, CASE WHEN avg(score) FILTER (WHERE label = 0) > avg(score) FILTER (WHERE label = 1) THEN -1 ELSE 1 END AS sign FROM b WHERE val GROUP BY detector),
o AS (SELECT val, label, detector, sign * score AS s FROM b JOIN g USING (detector)), e AS (SELECT detector, min(s) AS lo, max(s) AS hi FROM o WHERE val GROUP BY detector),
z AS (SELECT o.*, (s - lo) / (hi - lo) AS u FROM o JOIN e USING (detector)), f AS (SELECT detector, i, round(coalesce(2.0 * sum((label = 1 AND u >= i / 999.0 - 1e-12)::INT) / nullif(sum((u >= i / 999.0 - 1e-12)::INT) + sum(label), 0), 0), 9) AS f1 FROM z, range(1000) t(i) WHERE val GROUP BY detector, i),
th AS (SELECT detector, min(i) / 999.0 AS t FROM f JOIN (SELECT detector, max(f1) AS f1 FROM f GROUP BY detector) USING (detector, f1) GROUP BY detector),
p AS (SELECT detector, label, s, (least(greatest(u, 0), 1) >= t)::INT AS p FROM z JOIN th USING (detector) WHERE NOT val), q AS (SELECT detector, quantile_cont(s, 0.95) AS t5 FROM p WHERE label = 0 GROUP BY detector)
SELECT detector, count(*)::BIGINT AS n, round(sum((label = 0 AND p = 1)::INT) / sum((label = 0)::INT), 6) AS fpr, round(sum((label = 1 AND p = 0)::INT) / sum((label = 1)::INT), 6) AS fnr, round(avg(CASE WHEN label = 1 THEN (s > t5)::INT END), 6) AS tpr_at_fpr5 FROM p JOIN q USING (detector) GROUP BY detector""")
def detector_binary(spark, sf_dir):
    val, split = (x.where("label < 2") for x in _long(spark, sf_dir))
    r = metrics.detector_binary(val, split)
    return r.select("detector", "n", *[F.round(c, 6).alias(c) for c in ("fpr", "fnr", "tpr_at_fpr5")])


@query(f"""{_LONG}, g AS (SELECT detector, CASE WHEN avg(score) FILTER (WHERE label = 0) > avg(score) FILTER (WHERE label = 1) THEN -1 ELSE 1 END AS sign FROM x WHERE val GROUP BY detector),
o AS (SELECT val, label, detector, sign * score AS s FROM x JOIN g USING (detector)), z AS (SELECT *, (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) AS u FROM o WINDOW w AS (PARTITION BY detector, val)),
f AS (SELECT detector, k, i, round(coalesce(2.0 * sum((CASE WHEN k = 1 THEN label > 0 ELSE label = 1 END AND u >= i / 999.0 - 1e-12)::INT) / nullif(sum((u >= i / 999.0 - 1e-12)::INT) + sum((CASE WHEN k = 1 THEN label > 0 ELSE label = 1 END)::INT), 0), 0), 9) AS f1
 FROM z, range(1000) t(i), range(1, 3) r(k) WHERE val GROUP BY detector, k, i), th AS (SELECT detector, k, min(i) / 999.0 AS t FROM f JOIN (SELECT detector, k, max(f1) AS f1 FROM f GROUP BY ALL) USING (detector, k, f1) GROUP BY detector, k),
p AS (SELECT z.detector, label, CASE WHEN u > a.t THEN 1 WHEN u < h.t THEN 0 ELSE 2 END AS p FROM z JOIN th h ON h.detector = z.detector AND h.k = 1 JOIN th a ON a.detector = z.detector AND a.k = 2 WHERE NOT val)
SELECT detector, count(*)::BIGINT AS n, round(avg((label = p)::INT), 6) AS accuracy, round((coalesce(2.0 * sum((label = 0 AND p = 0)::INT) / nullif(sum((label = 0)::INT) + sum((p = 0)::INT), 0), 0) + coalesce(2.0 * sum((label = 1 AND p = 1)::INT) / nullif(sum((label = 1)::INT) + sum((p = 1)::INT), 0), 0)
 + coalesce(2.0 * sum((label = 2 AND p = 2)::INT) / nullif(sum((label = 2)::INT) + sum((p = 2)::INT), 0), 0)) / 3, 6) AS macro_f1 FROM p GROUP BY detector""")
def detector_ternary(spark, sf_dir):
    r = metrics.detector_ternary(*_long(spark, sf_dir))
    return r.select("detector", "n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


_U = "CAST('0x' || substr(md5(i || '|' || source), 1, 8) AS BIGINT) / 4294967296.0"
_POISSON = " + ".join(f"({_U} >= {p})::INT" for p in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183))


@query(f"""WITH x AS ({LABELLED}), b AS (SELECT *, (CAST('0x' || substr(md5('b' || doc_id), 1, 8) AS BIGINT) / 4294967296.0) AS other, {_POISSON} AS w FROM x, range(40) t(i)),
r AS (SELECT i, sum(w * (label = 1 AND score >= 0.5)::INT) / nullif(sum(w * label), 0) - sum(w * (label = 1 AND other >= 0.5)::INT) / nullif(sum(w * label), 0) AS d FROM b WHERE w > 0 GROUP BY i)
SELECT count(d)::BIGINT AS samples, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM r""")
def paired_differences(spark, sf_dir):
    """Interval of the TPR at 0.5 of one model less another's, both on the same draws of sources."""
    y = F.col("label")
    hit = lambda s: y * (s >= 0.5).cast("int")
    m = metrics.bootstrap_sums(labelled(spark, sf_dir), "source", 40, {"a": hit(F.col("score")), "b": hit(score("b")), "pos": y})
    d = m.withColumn("d", metrics.ratio(F.col("a"), F.col("pos")) - metrics.ratio(F.col("b"), F.col("pos")))
    return metrics.interval(d, "d").select("samples", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""WITH x AS ({LABELLED}), s AS (SELECT *, unnest(['overall', 'domain:' || lang] || CASE WHEN doc_id % 2 = 0 THEN ['attacked', 'attack:' || doc_id % 6] ELSE [] END) AS slice FROM x), b AS (SELECT *, {_POISSON} AS w FROM s, range(20) t(i)),
r AS (SELECT slice, i, sum(w * (label = 1 AND score >= 0.5)::INT) / nullif(sum(w * label), 0) AS v FROM b WHERE w > 0 GROUP BY slice, i)
SELECT slice, count(v)::BIGINT AS samples, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM r GROUP BY slice""")
def slice_bootstrap(spark, sf_dir):
    i = F.col("doc_id")
    always = F.array(F.lit("overall"), F.concat(F.lit("domain:"), F.col("lang")))
    attacked = F.array(F.lit("attacked"), F.concat(F.lit("attack:"), (i % 6).cast("string")))
    x = labelled(spark, sf_dir).withColumn("slice", F.explode(F.when(i % 2 == 0, F.concat(always, attacked)).otherwise(always)))
    m = metrics.bootstrap_sums(x, "source", 20, {"hit": F.col("label") * (F.col("score") >= 0.5).cast("int"), "pos": F.col("label")}, ["slice"])
    r = metrics.interval(m.withColumn("v", metrics.ratio(F.col("hit"), F.col("pos"))), "v", ["slice"])
    return r.select("slice", "samples", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""WITH x AS (SELECT (doc_id % 4)::INT AS t, least(floor({SCORE} * 4), 3)::INT AS p FROM documents), c AS (SELECT unnest([0, 1, 2, 3]) AS k)
SELECT k::INT AS bucket, round(2.0 * sum((t = k AND p = k)::INT) / (sum((t = k)::INT) + sum((p = k)::INT)), 6) AS f1, round(sum((t = k AND p = k)::INT) / sum((t = k)::INT), 6) AS recall FROM c, x GROUP BY k""")
def bucket_f1(spark, sf_dir):
    d = docs_of(spark, sf_dir).select((F.col("doc_id") % 4).cast("int").alias("t"), F.least(F.floor(score() * 4), F.lit(3)).cast("int").alias("p"))
    c = metrics.class_f1(d, "t", "p", [0, 1, 2, 3])
    return c.select(F.col("class").alias("bucket"), F.round("f1", 6).alias("f1"), F.round(metrics.ratio(F.col("tp"), F.col("support")), 6).alias("recall"))


@query(f"""WITH x AS (SELECT source, {TYPES} AS tt, {SCORE} AS s FROM documents) SELECT source, count(*)::BIGINT AS n, count(*) FILTER (WHERE tt = 'ai_generated')::BIGINT AS mirrors, count(*) FILTER (WHERE tt = 'ai_edited')::BIGINT AS edits, round(avg(CASE WHEN tt = 'ai_edited' THEN s END), 6) AS mean_magnitude FROM x GROUP BY source""")
def source_counts(spark, sf_dir):
    x = docs_of(spark, sf_dir).select("source", text_type().alias("tt"), score().alias("s"))
    edit = F.col("tt") == "ai_edited"
    return x.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("tt") == "ai_generated").alias("mirrors"), F.count_if(edit).alias("edits"), F.round(F.avg(F.when(edit, F.col("s"))), 6).alias("mean_magnitude"))


@query(f"""SELECT doc_id, bucket::INT AS bucket FROM (SELECT doc_id, lang, doc_id % 4 AS bucket, row_number() OVER (PARTITION BY lang, doc_id % 4 ORDER BY length(text) DESC, doc_id) AS n, sha256(doc_id::VARCHAR) AS h FROM documents) WHERE n = 1
UNION ALL SELECT doc_id, bucket::INT FROM (SELECT doc_id, bucket, row_number() OVER (PARTITION BY lang, bucket ORDER BY h) AS m FROM (SELECT doc_id, lang, doc_id % 4 AS bucket, row_number() OVER (PARTITION BY lang, doc_id % 4 ORDER BY length(text) DESC, doc_id) AS n, sha256(doc_id::VARCHAR) AS h FROM documents) WHERE n > 1) WHERE m <= 4""")
def equivalence_probe(spark, sf_dir):
    d = docs_of(spark, sf_dir).withColumn("bucket", (F.col("doc_id") % 4).cast("int"))
    return sampling.probe(d, ["lang", "bucket"], F.length("text"), "doc_id", 4).select("doc_id", "bucket")


@query(f"""WITH m AS (SELECT doc_id % 40 AS src, 'g' || doc_id % 5 AS model, ('a' || (doc_id // 40) % 2) AS attack FROM documents), f AS (SELECT src, model FROM m GROUP BY ALL HAVING count(DISTINCT attack) = 2) SELECT src, model, count(*)::BIGINT AS n FROM m SEMI JOIN f USING (src, model) GROUP BY ALL""")
def complete_generations(spark, sf_dir):
    i = F.col("doc_id")
    d = docs_of(spark, sf_dir).select((i % 40).alias("src"), F.concat(F.lit("g"), (i % 5).cast("string")).alias("model"), F.concat(F.lit("a"), (F.floor(i / 40) % 2).cast("string")).alias("attack"))
    return sampling.with_all(d, ["src", "model"], "attack", ["a0", "a1"]).groupBy("src", "model").agg(F.count("*").alias("n"))


@query(f"""WITH x AS ({LABELLED}), s AS (SELECT label, score, unnest(['all', 'lang:' || lang, 'label:' || label]) AS slice FROM x)
SELECT slice, count(*)::BIGINT AS n, min(label) = max(label) AS one_class,
 round(CASE WHEN min(label) = max(label) THEN avg(score) END, 6) AS mean, any_value(p) AS auroc FROM s LEFT JOIN (SELECT a.slice, round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6) AS p FROM s a JOIN s b ON a.slice = b.slice AND a.label = 1 AND b.label = 0 GROUP BY a.slice) USING (slice) GROUP BY slice""")
def slice_auroc(spark, sf_dir):
    names = F.array(F.lit("all"), F.concat(F.lit("lang:"), F.col("lang")), F.concat(F.lit("label:"), F.col("label").cast("string")))
    r = metrics.slice_auroc(labelled(spark, sf_dir), names)
    return r.select("slice", "n", F.col("auroc").isNull().alias("one_class"), F.round("mean", 6).alias("mean"), F.round("auroc", 6).alias("auroc"))


@query(f"""WITH x AS (SELECT lang, {SCORE} AS a, {SCORE} + (doc_id % 7) * 0.002 * (CASE WHEN lang = 'de' THEN 3 ELSE 1 END) AS b FROM documents),
s AS (SELECT lang, count(*)::BIGINT AS n, corr(a, b) AS c, avg(abs(a - b)) AS m, max(abs(a - b)) AS d FROM x GROUP BY lang)
SELECT lang, n, round(c, 6) AS pearson, round(m, 6) AS mae, round(d, 6) AS max_diff, m <= 0.01 AND d <= 0.05 AS passes FROM s""")
def runtime_agreement(spark, sf_dir):
    """Two results of the same rows, aligned by id with the texts' hashes equal."""
    d = docs_of(spark, sf_dir).select("doc_id", "lang", F.sha2("text", 256).alias("sha"), score().alias("score"))
    off = (F.col("doc_id") % 7) * 0.002 * F.when(F.col("lang") == "de", 3).otherwise(1)
    both = joins.aligned(d, d.withColumn("score", F.col("score") + off), "doc_id", "sha")
    r = metrics.agreement(both, ["lang"])
    return r.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("pearson", "mae", "max_diff")], "passes")
