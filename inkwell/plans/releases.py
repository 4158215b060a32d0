"""Queries of request plans, their results, releases and the reports on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import decode
from inkwell.operators import joins, metrics, normalize, reports, requests, sampling
from inkwell.plans.registry import SCORE, TYPES, docs_of, duck_mod, query, score, table, text_type
from inkwell.sources import readers, sinks, store

_KEY = "concat(source, chr(0), doc_id"
_SIDE = "(CAST('0x' || substr(md5('s' || doc_id), 1, 8) AS BIGINT) / 4294967296.0)"


def _scored(spark, sf_dir):
    """Documents as scored release rows: every fifth has no binary label, edits have a target."""
    i = F.col("doc_id")
    return docs_of(spark, sf_dir).select(
        "doc_id", F.when(i % 5 > 0, (i % 3 > 0).cast("int")).alias("label_binary"), (i % 3).cast("int").alias("label_ternary"), F.when(i % 3 == 2, score("s")).alias("edit_target"),
        text_type().alias("variant"), F.col("lang").alias("domain"), score().alias("score"),
    )


def _detection_sql(groups: str) -> str:
    """SQL for ``binary_metrics`` of x(y, score, groups) at 0.6."""
    return f"""t AS (SELECT {groups}, quantile_cont(score, 0.99) AS t1, quantile_cont(score, 0.95) AS t5 FROM x WHERE y = 0 GROUP BY {groups}),
k AS (SELECT *, rank() OVER (PARTITION BY {groups} ORDER BY score) + (count(*) OVER (PARTITION BY {groups}, score) - 1) / 2.0 AS k FROM x),
m AS (SELECT {groups}, count(*)::DOUBLE AS n, (sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auroc,
 avg(CASE WHEN y = 1 THEN (score > t1)::INT END) AS tpr_at_fpr1, avg(CASE WHEN y = 1 THEN (score > t5)::INT END) AS tpr_at_fpr5,
 avg(CASE WHEN y = 0 THEN (score > 0.6)::INT END) AS shipped_fpr, avg(CASE WHEN y = 1 THEN (score > 0.6)::INT END) AS shipped_tpr FROM k JOIN t USING ({groups}) GROUP BY {groups} HAVING sum(y) > 0 AND sum(1 - y) > 0)"""


_REPORT = f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN (doc_id % 3 > 0)::INT END AS label, doc_id % 3 AS c, CASE WHEN doc_id % 3 = 2 THEN {_SIDE} END AS target, {TYPES} AS variant, lang, {SCORE} AS score FROM documents),
x AS (SELECT label AS y, score, unnest([struct_pack(section := 'binary', name := 'all'), struct_pack(section := 'by_domain', name := lang)], recursive := true) FROM r WHERE label IS NOT NULL), {_detection_sql('section, name')},
f AS (SELECT *, CASE WHEN score < 0.3 THEN 0 WHEN score > 0.6 THEN 1 ELSE 2 END AS p FROM r), g AS (SELECT i, 2.0 * sum((c = i AND p = i)::INT) / (sum((c = i)::INT) + sum((p = i)::INT)) AS f1 FROM f, range(3) q(i) GROUP BY i),
e AS (SELECT *, rank() OVER (ORDER BY target) + (count(*) OVER (PARTITION BY target) - 1) / 2.0 AS ra, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rb FROM r WHERE target IS NOT NULL),
v AS (SELECT variant, avg(score) AS mean, median(score) AS median, count(*)::DOUBLE AS n FROM r GROUP BY variant),
a AS (SELECT section, name, unnest([struct_pack(metric := 'n', value := n), struct_pack(metric := 'auroc', value := auroc), struct_pack(metric := 'tpr_at_fpr1', value := tpr_at_fpr1), struct_pack(metric := 'tpr_at_fpr5', value := tpr_at_fpr5), struct_pack(metric := 'shipped_fpr', value := shipped_fpr), struct_pack(metric := 'shipped_tpr', value := shipped_tpr)], recursive := true) FROM m
 UNION ALL SELECT 'by_variant', variant, unnest([struct_pack(metric := 'mean', value := mean), struct_pack(metric := 'median', value := median), struct_pack(metric := 'rows', value := n)], recursive := true) FROM v
 UNION ALL SELECT 'edit_correlation', 'all', unnest([struct_pack(metric := 'pearson', value := corr(target, score)), struct_pack(metric := 'spearman', value := corr(ra, rb)), struct_pack(metric := 'n', value := count(*)::DOUBLE)], recursive := true) FROM e
 UNION ALL SELECT 'ternary', 'all', unnest([struct_pack(metric := 'macro_f1', value := avg(f1)), struct_pack(metric := 'f1_human', value := max(CASE WHEN i = 0 THEN f1 END)), struct_pack(metric := 'f1_generated', value := max(CASE WHEN i = 1 THEN f1 END)), struct_pack(metric := 'f1_edited', value := max(CASE WHEN i = 2 THEN f1 END))], recursive := true) FROM g)
SELECT section, name, metric, round(value, 6) AS value FROM a"""


@query(_REPORT)
def release_report(spark, sf_dir):
    """E18, with E17 and E36 as its binary sections."""
    r = reports.release_report(_scored(spark, sf_dir), (0.3, 0.6), 0.6)
    return r.select("section", "name", "metric", F.round("value", 6).alias("value"))


@query(_REPORT)
def scored_snapshot_report(spark, sf_dir):
    """E37 with K06: scores go to an append-only log in two runs, then the report reads the log."""
    rows, path = _scored(spark, sf_dir), f"{store.folder(spark)}/log"
    score_of = lambda todo: todo.select("doc_id", score().alias("score"))
    sinks.append_scores(rows.where("doc_id % 4 = 0"), score_of, path, {"model": "m", "revision": "1"}, "doc_id")
    logged = sinks.append_scores(rows, score_of, path, {"model": "m", "revision": "1"}, "doc_id")
    r = reports.release_report(joins.with_predictions(rows.drop("score"), {"m": logged}, "doc_id").withColumnRenamed("score_m", "score"), (0.3, 0.6), 0.6)
    return r.select("section", "name", "metric", F.round("value", 6).alias("value"))


@query(f"""WITH x AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN 'ood' ELSE 'attack' END AS split, lang, (doc_id % 3 > 0)::INT AS y, {SCORE} AS score FROM documents), {_detection_sql('split, lang')}
SELECT split, lang, n::BIGINT AS n, {', '.join(f'round({c}, 6) AS {c}' for c in ('auroc', 'tpr_at_fpr1', 'tpr_at_fpr5', 'shipped_fpr', 'shipped_tpr'))} FROM m""")
def benchmark_suite(spark, sf_dir):
    """All splits and languages in one grouped plan."""
    split = F.element_at(F.array(*map(F.lit, ("val", "test", "ood", "attack"))), (F.col("doc_id") % 4 + 1).cast("int"))
    d = docs_of(spark, sf_dir).select(split.alias("split"), "lang", (F.col("doc_id") % 3 > 0).cast("int").alias("label"), score().alias("score"))
    r = reports.binary_metrics(d, ["split", "lang"], 0.6)
    return r.select("split", "lang", "n", *[F.round(c, 6).alias(c) for c in ("auroc", "tpr_at_fpr1", "tpr_at_fpr5", "shipped_fpr", "shipped_tpr")])


@query(f"""WITH x AS (SELECT doc_id, lang, 'a' || (doc_id % 4) AS attack, (doc_id % 3 > 0)::INT AS y, {SCORE} AS score FROM documents ORDER BY sha256(doc_id::VARCHAR), doc_id LIMIT 600), t AS (SELECT lang, quantile_cont(score, 0.95) AS th FROM x WHERE y = 0 GROUP BY lang)
SELECT lang, attack, count(*)::BIGINT AS n, round(avg((score > th)::INT), 6) AS tpr FROM x JOIN t USING (lang) WHERE y = 1 GROUP BY lang, attack""")
def strata_rates(spark, sf_dir):
    """J15."""
    d = docs_of(spark, sf_dir).select("doc_id", "lang", F.concat(F.lit("a"), (F.col("doc_id") % 4).cast("string")).alias("attack"), (F.col("doc_id") % 3 > 0).cast("int").alias("label"), score().alias("score"))
    r = reports.strata_at_fpr(d, ["lang", "attack"], "lang", 0.05, 600, "doc_id")
    return r.select("lang", "attack", F.col("rows").alias("n"), F.round("tpr", 6).alias("tpr"))


_CDF = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]


@query(f"""WITH x AS (SELECT source, (doc_id % 3 > 0)::INT AS y, ({SCORE} > 0.6)::INT AS a, ({_SIDE} > 0.6)::INT AS b FROM documents), s AS (SELECT source, sum(y) AS pos, sum(y * a) AS a, sum(y * b) AS b FROM x GROUP BY source),
u AS (SELECT s.*, i AS rep, CAST('0x' || substr(md5(i || '|' || source), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM s, range(60) r(i)), w AS (SELECT *, {' + '.join(f'(u >= {p})::INT' for p in _CDF)} AS w FROM u),
g AS (SELECT rep, sum(w * a) / sum(w * pos) AS a, sum(w * b) / sum(w * pos) AS b FROM w WHERE w > 0 GROUP BY rep), p AS (SELECT sum(a) / sum(pos) AS a, sum(b) / sum(pos) AS b FROM s),
l AS (SELECT unnest([struct_pack(model := 'a', v := a), struct_pack(model := 'b', v := b), struct_pack(model := 'a-b', v := a - b)], recursive := true) FROM g), q AS (SELECT unnest([struct_pack(model := 'a', tpr := a), struct_pack(model := 'b', tpr := b), struct_pack(model := 'a-b', tpr := a - b)], recursive := true) FROM p)
SELECT model, round(any_value(tpr), 6) AS tpr, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(v)::BIGINT AS samples FROM l JOIN q USING (model) GROUP BY model""")
def model_comparison(spark, sf_dir):
    """Two models at a shipped threshold and their difference, with intervals by source."""
    d = docs_of(spark, sf_dir).select("source", (F.col("doc_id") % 3 > 0).cast("int").alias("label"), score().alias("a"), score("s").alias("b"))
    r = reports.compared(d, ["a", "b"], 0.6, "source", 60)
    return r.select("model", *[F.round(c, 6).alias(c) for c in ("tpr", "low", "high")], "samples")


@query(f"""WITH x AS (SELECT doc_id, lang, text, {TYPES} AS tt, 's' || (doc_id % 30) AS sid, 'Again: ' || text AS para FROM documents), h AS (SELECT sid, arg_max(text, doc_id) AS src FROM x WHERE tt = 'human_written' GROUP BY sid),
p AS (SELECT x.*, src, doc_id % 3 AS k FROM x LEFT JOIN h USING (sid) WHERE tt <> 'human_written' AND length(text) >= 7 AND (tt <> 'ai_edited' OR src IS NOT NULL)), s AS (SELECT CASE doc_id % 2 WHEN 0 THEN 'train_aug' ELSE 'attack_val' END AS part, CASE WHEN tt = 'ai_generated' THEN 3 ELSE 1 END AS bucket FROM p
 UNION ALL SELECT 'attack_val', 0 FROM x WHERE tt = 'human_written' AND doc_id % 5 = 0)
SELECT part, bucket, count(*)::BIGINT AS n FROM s GROUP BY part, bucket""")
def paraphrase_slices(spark, sf_dir):
    """Paraphrased slices, edits with their sources, humans beside the measured one, by bucket."""
    kind = text_type()
    bucket = F.when(kind == "ai_generated", 3).when(kind == "ai_edited", 1).otherwise(0)
    d = docs_of(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("text_id"), "doc_id", F.col("lang").alias("language"), F.concat(F.lit("s"), (F.col("doc_id") % 30).cast("string")).alias("source_id"),
        "text", kind.alias("text_type"), bucket.alias("bucket"), F.lit("").alias("source_text"), F.concat(F.lit("Again: "), "text").alias("para"),
    )
    human = F.col("text_type") == "human_written"
    sources = joins.latest_text(d.where(human), ["source_id"], "doc_id")
    cut = lambda rest: d.where(~human & (F.col("doc_id") % 2 == rest))
    parts = {
        "train_aug": reports.attack_slice(cut(0), "para", F.lit("p1"), sources, ["source_id"]),
        "attack_val": reports.attack_slice(cut(1), "para", F.lit("p2"), sources, ["source_id"], d.where(human & (F.col("doc_id") % 5 == 0)).drop("para", "source_text")),
    }
    one = lambda name: parts[name].groupBy("bucket").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "bucket", "n")
    return one("train_aug").unionByName(one("attack_val"))


@query(rf"""WITH b AS (SELECT doc_id, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, {TYPES} AS variant FROM documents WHERE text <> ''), c AS (SELECT variant, count(*) AS n, sum(count(*)) OVER () AS total FROM b WHERE t <> '' GROUP BY variant),
e AS (SELECT variant, n * 90.0 / total AS exact FROM c), q AS (SELECT variant, floor(exact) + (row_number() OVER (ORDER BY exact - floor(exact) DESC, variant) <= 90 - sum(floor(exact)) OVER ())::INT AS q FROM e)
SELECT row_id, variant FROM (SELECT sha256(concat('bench', chr(0), doc_id, chr(0), variant, chr(0), sha256(t), chr(0), '')) AS row_id, variant, row_number() OVER (PARTITION BY variant ORDER BY sha256(concat('bench', chr(0), doc_id, chr(0), variant, chr(0), sha256(t), chr(0), ''))) AS n FROM b WHERE t <> '') JOIN q USING (variant) WHERE n <= q""")
def frozen_subset(spark, sf_dir):
    """A benchmark's rows in the release schema, a proportional subset of them."""
    d = docs_of(spark, sf_dir).withColumn("v", text_type()).where(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) > 0)
    rows = store.materialise(normalize.release_rows(d, "bench", F.col("doc_id"), F.col("v"), F.col("text")))
    return sampling.proportional(rows, ["variant"], "row_id", 90).select("row_id", "variant")


@query(f"SELECT sha256(doc_id::VARCHAR) AS row_id, {TYPES} AS text_type FROM documents ORDER BY row_id LIMIT 100")
def smoke_rows(spark, sf_dir):
    """The first rows in order of their id."""
    d = docs_of(spark, sf_dir).select(F.sha2(F.col("doc_id").cast("string"), 256).alias("row_id"), text_type().alias("text_type"))
    return d.orderBy("row_id").limit(100)


@query("""SELECT count(*)::BIGINT AS n, sha256(string_agg(sha256(coalesce(text, '')), chr(10) ORDER BY doc_id)) AS texts_sha256,
 sha256(string_agg('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}', chr(10) ORDER BY doc_id)) AS records_sha256 FROM documents""")
def record_digests(spark, sf_dir):
    """Digests of the text hashes and of the canonical records, both in the order of the ids."""
    d = docs_of(spark, sf_dir)
    cols = sorted(c for c in d.columns if c != "text")
    d = d.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("t"), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("r"))
    texts, records = store.ordered_digest(d, "doc_id", "texts_sha256", "t"), store.ordered_digest(d, "doc_id", "records_sha256", "r")
    return texts.join(F.broadcast(records.drop("n")))  # one row each


@query(f"""WITH x AS (SELECT doc_id, 2 - 3 * {SCORE} AS s FROM documents), y AS (SELECT doc_id, least(greatest((-s + 1.5) / 2.5, 0), 1) AS s FROM x)
SELECT doc_id, round(s, 6) AS involvement, CASE WHEN s < 0.5 THEN 0 WHEN s > 0.4 THEN 1 ELSE 2 END::INT AS label FROM y""")
def shipped_labels(spark, sf_dir):
    """Oriented, scaled and clipped; human wins where the thresholds overlap."""
    x = decode.calibrated(2 - 3 * score(), -1.5, 1.0, True)
    return docs_of(spark, sf_dir).select("doc_id", x.alias("x")).select("doc_id", F.round("x", 6).alias("involvement"), decode.shipped_label(F.col("x"), F.lit(0.5), F.lit(0.4)).cast("int").alias("label"))


@query("""WITH x AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), s AS (SELECT *, 1 / (1 + exp(-a)) AS p, 1 / (1 + exp(-b)) AS q, 1 / (1 + exp(-c)) AS r FROM x)
SELECT vec_id, round(CASE vec_id % 2 WHEN 0 THEN (exp(b) + 2 * exp(c)) / (exp(a) + exp(b) + exp(c)) / 2 ELSE (p + p * q + p * q * r) / 3 END, 6) AS graded FROM s""")
def graded_scores(spark, sf_dir):
    """The head's kind decides how logits are read."""
    v = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    head = F.when(F.col("vec_id") % 2 == 0, "seqcls").otherwise("corn")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(decode.graded_score(v, head), 6).alias("graded"))


_LANGUAGES = ("en", "fr", "de", "es")
_POOLS = requests.Pools(
    styles={x: [("plain", 2), ("persona", 1)] if x == "en" else [("plain", 1)] for x in _LANGUAGES},
    generators={("en", "mirror"): [("org/a:x", 1), ("b", 3)], ("en", "edit"): [("b", 1), ("c", 1)]} | {(x, "mirror"): [("b", 1)] for x in _LANGUAGES[1:]} | {(x, "edit"): [("c", 1)] for x in _LANGUAGES[1:]},
    reasoning={"org/a:x": [("high", 1), ("low", 2)], "b": [("high", 1)], "c": [("off", 1), ("high", 1)]},
    edits={x: [(f"e{i}", "train") for i in range(5)] for x in _LANGUAGES},
    mirrors={x: {"general": ["about {topic}", "on {topic}"], "news": ["news: {topic}"]} for x in _LANGUAGES},
    ineligible=("src3",),
)


def _plan(spark, sf_dir):
    register = F.when(F.col("doc_id") % 2 == 0, "news").otherwise("other")
    d = docs_of(spark, sf_dir).where(F.col("lang").isin(*_LANGUAGES))
    return requests.plan(d.select(F.col("lang").alias("language"), "source", F.col("doc_id").cast("string").alias("source_id"), "text", register.alias("text_register")), _POOLS)


def _mod(m: int, *parts: str) -> str:
    return duck_mod(m, "concat(source, chr(0), doc_id" + "".join(f", chr(0), {p}" for p in parts) + ")")


_PLAN_SQL = f"""WITH d AS (SELECT *, doc_id % 2 = 0 AS news, CASE WHEN lang <> 'en' THEN 'plain' ELSE ['plain', 'plain', 'persona'][{_mod(3, "'style'")} + 1] END AS style, {_mod(5, "'edit0'")} AS e0, {_mod(4, "'edit1'")} AS e1 FROM documents WHERE lang IN {_LANGUAGES}),
s AS (SELECT *, unnest([-1, 0, 1]) AS slot FROM d),
g AS (SELECT *, CASE WHEN lang <> 'en' THEN CASE WHEN slot < 0 THEN 'b' ELSE 'c' END WHEN slot < 0 THEN ['org/a:x', 'b', 'b', 'b'][{_mod(4, "'gen-mirror'")} + 1] WHEN slot = 0 THEN ['b', 'c'][{_mod(2, "'gen-edit0'")} + 1] ELSE ['b', 'c'][{_mod(2, "'gen-edit1'")} + 1] END AS generator FROM s WHERE slot >= 0 OR source <> 'src3'),
p AS (SELECT doc_id::VARCHAR AS source_id, slot::INT AS slot, source, lang, text, generator, style, CASE WHEN slot >= 0 THEN CASE generator WHEN 'c' THEN 'off' ELSE 'none' END WHEN generator = 'b' THEN 'high' ELSE ['high', 'low', 'low'][{_mod(3, 'generator', "'mirror'", "'reason'")} + 1] END AS reasoning,
 CASE WHEN slot = 0 THEN 'e' || e0 WHEN slot = 1 THEN 'e' || list_filter([0, 1, 2, 3, 4], lambda x: x <> e0)[e1 + 1] WHEN news THEN 'news/v1' ELSE 'general/v' || ({_mod(2, 'generator', "'mirror'")} + 1) END AS prompt_id FROM g)"""


@query(_PLAN_SQL + " SELECT source_id, slot, generator, style, reasoning, prompt_id FROM p")
def request_plan(spark, sf_dir):
    """A mirror and two edits of each record, with seeded generators, styles and prompts."""
    return _plan(spark, sf_dir).select("source_id", F.col("slot").cast("int").alias("slot"), "generator", "style", "reasoning", "prompt_id")


@query(_PLAN_SQL + """, r AS (SELECT *, CASE WHEN slot < 0 THEN 'ai_generated' ELSE 'ai_edited' END AS tt FROM p)
SELECT concat_ws('/', lang, source, source_id, tt, replace(replace(generator, '/', '_'), ':', '_'), style, CASE WHEN slot >= 0 THEN prompt_id END) AS text_id, tt AS text_type, sha256('Body ' || source_id) AS text_sha256,
 CASE WHEN slot < 0 THEN 1.0 END AS cosine_score, CASE WHEN slot < 0 THEN 3 END::INT AS bucket, 'Sure!' AS removed FROM r""")
def result_rows(spark, sf_dir):
    """M22 with X07, X08 and X14: results of a plan as corpus rows."""
    said = F.concat(F.lit("<think>t</think>\nSure!\n\nBody "), "source_id")
    r = requests.result_rows(_plan(spark, sf_dir).withColumn("output", said))
    return r.select("text_id", "text_type", F.sha2("text", 256).alias("text_sha256"), "cosine_score", "bucket", F.col("meta.stripped_header").alias("removed"))


_PARA = "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN text WHEN 2 THEN 'Other words: ' || text WHEN 3 THEN 'x' ELSE substr(text, 1, (length(text) * 3 // 4)::INT) END"


@query(rf"""WITH x AS (SELECT doc_id, text, regexp_replace({_PARA}, '^\s+|\s+$', '', 'g') AS p FROM documents)
SELECT doc_id || '/para' AS text_id, sha256(p) AS text_sha256 FROM x WHERE p <> '' AND p <> text AND length(p) / greatest(length(text), 1) BETWEEN 0.5 AND 2.0""")
def paraphrase_rows(spark, sf_dir):
    """Blank ones, echoes and those out of the length band go."""
    i, t = F.col("doc_id"), F.col("text")
    out = F.when(i % 5 == 0, "").when(i % 5 == 1, t).when(i % 5 == 2, F.concat(F.lit("Other words: "), t)).when(i % 5 == 3, "x").otherwise(F.substring(t, F.lit(1), F.floor(F.length(t) * 3 / 4).cast("int")))
    d = docs_of(spark, sf_dir).select(i.cast("string").alias("text_id"), "text", F.col("lang").alias("language"), out.alias("out"))
    return requests.paraphrased(d, "out", F.lit("p")).select("text_id", F.sha2("text", 256).alias("text_sha256"))


@query(f"""WITH m AS (SELECT *, {duck_mod(2, "concat(doc_id, chr(0), 'para')")} AS k, length(text) / CASE WHEN lang = 'en' THEN 4.0 ELSE 1.5 END AS o FROM documents), x AS (SELECT k, o, o + CASE lang WHEN 'en' THEN 100 WHEN 'fr' THEN 50 ELSE 0 END AS i FROM m)
SELECT count(*)::BIGINT AS rows, sum(trunc(i))::BIGINT AS tokens_in, sum(trunc(o))::BIGINT AS tokens_out, round(sum(CASE k WHEN 0 THEN i * 2 + o * 8 ELSE (i * 1 + o * 3) * 0.5 END), 2) AS cost FROM x""")
def estimated_cost(spark, sf_dir):
    """E24 with M20: list-price cost by the seeded model of each row."""
    d = docs_of(spark, sf_dir).select(F.col("doc_id").cast("string").alias("text_id"), F.col("lang").alias("language"), "text")
    r = requests.estimate_cost(d, {"m0": (2.0, 8.0, False), "m1": (1.0, 3.0, True)}, {"en": 300, "fr": 150})
    return r.withColumn("cost", F.round("cost", 2))


@query(f"""WITH r AS (SELECT a.text, b.text AS src FROM documents a JOIN documents b ON b.doc_id + 1 = a.doc_id WHERE {TYPES.replace('doc_id', 'a.doc_id')} = 'ai_edited' AND a.text <> '' AND b.text <> ''), t AS (SELECT DISTINCT unnest([text, src]) AS t FROM r)
SELECT count(*)::BIGINT AS texts, round(sum(length(t)) / 4.0 * 0.001, 4) AS cost FROM t""")
def embedding_costs(spark, sf_dir):
    """Every distinct text of edits and their sources once."""
    d = docs_of(spark, sf_dir)
    src = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("source_text"))
    r = requests.embedding_cost(d.join(src, "doc_id", "left").withColumn("text_type", text_type()), 0.001)
    return r.withColumn("cost", F.round("cost", 4))


@query(f"SELECT doc_id, round({SCORE}, 9) AS score_plain, round({_SIDE}, 9) AS score_side, round(1 - {SCORE}, 9) AS score_flipped FROM documents")
def three_predictions(spark, sf_dir):
    """Predictions of several models side by side, each proved one to one."""
    d = docs_of(spark, sf_dir).select("doc_id")
    each = {"plain": score(), "side": score("s"), "flipped": 1 - score()}
    r = joins.with_predictions(d, {n: d.select("doc_id", s.alias("score")) for n, s in each.items()}, "doc_id")
    return r.select("doc_id", *[F.round(f"score_{n}", 9).alias(f"score_{n}") for n in each])


@query("SELECT split, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars, min(source) AS first_source FROM (SELECT *, CASE WHEN doc_id % 10 = 8 THEN 'val' WHEN doc_id % 10 = 9 THEN 'test' ELSE 'train' END AS split FROM documents) GROUP BY split")
def split_files(spark, sf_dir):
    """Splits as CSV with JSON metadata, read again as they were."""
    m, path = F.col("doc_id") % 10, f"{store.folder(spark)}/splits"
    d = docs_of(spark, sf_dir).withColumn("split", F.when(m == 8, "val").when(m == 9, "test").otherwise("train")).withColumn("meta", F.struct("source", "n_chars"))
    counts = sinks.write_splits(d, path, ["doc_id", "text", "meta"])
    back = sinks.read_rows(spark, path, "doc_id long, text string, meta string, split string")
    source = F.get_json_object("meta", "$.source")
    r = back.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.min(source).alias("first_source"))
    return r.where(F.col("n") == F.element_at(F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, v)]), F.col("split")))


@query("SELECT 'system' AS kind, lang AS language, 's' || min(doc_id) AS prompt_id, 'be plain' AS text FROM documents GROUP BY lang UNION ALL SELECT 'edit', lang, 'e' || min(doc_id), 'edit' FROM documents GROUP BY lang UNION ALL SELECT 'mirror', lang, 'm' || min(doc_id), 'write' FROM documents GROUP BY lang")
def prompt_manifest(spark, sf_dir):
    """K02."""
    ids = docs_of(spark, sf_dir).groupBy(F.col("lang").alias("language")).agg(F.min("doc_id").cast("string").alias("i"))
    of = lambda letter, text: ids.select("language", F.concat(F.lit(letter), "i").alias("prompt_id"), F.lit(text).alias("text"))
    return sinks.prompt_manifest(of("s", "be plain"), of("e", "edit"), of("m", "write"))


@query("SELECT 'documents' AS source, 'r1' AS revision, count(*)::VARCHAR AS rows, sha256(string_agg(sha256(doc_id::VARCHAR), chr(10) ORDER BY sha256(doc_id::VARCHAR))) AS rows_sha256, 'row_id,text' AS columns FROM documents")
def snapshot_manifest(spark, sf_dir):
    """A snapshot in the order of its ids with a manifest that binds them."""
    path = f"{store.folder(spark)}/snapshot"
    sinks.write_snapshot(docs_of(spark, sf_dir).select(F.sha2(F.col("doc_id").cast("string"), 256).alias("row_id"), "text"), path, "documents", "r1")
    return spark.read.schema("source string, revision string, rows string, rows_sha256 string, columns string").json(f"{path}.manifest")


@query(f"""WITH d AS (SELECT *, {TYPES} AS tt, CASE WHEN doc_id % 10 = 8 THEN 'val' WHEN doc_id % 10 = 9 THEN 'test' ELSE 'train' END AS split, 'r' || (doc_id % 4) AS reg, 'm' || (doc_id % 5) AS model FROM documents), k AS (SELECT * FROM d WHERE doc_id % 7 > 0), o AS (SELECT * FROM d WHERE doc_id % 7 = 0)
SELECT 'splits' AS part, split AS a, '' AS b, count(*)::DOUBLE AS n FROM k GROUP BY split UNION ALL SELECT 'classes', lang, tt, count(*) FROM k GROUP BY lang, tt UNION ALL SELECT 'registers', lang, reg, count(*) FROM k WHERE tt = 'human_written' GROUP BY lang, reg
 UNION ALL SELECT 'drops', CASE WHEN doc_id % 2 = 0 THEN 'refusal' ELSE 'truncated' END, '', count(*) FROM o GROUP BY 2 UNION ALL SELECT 'overlap', 'max', '', max(doc_id % 9) FROM o UNION ALL SELECT 'cost', model, '', round(sum(n_chars / 1000.0), 3) FROM k WHERE tt <> 'human_written' GROUP BY model""")
def build_report(spark, sf_dir):
    """The tables of a build's report, one below the other."""
    i = F.col("doc_id")
    m = i % 10
    d = docs_of(spark, sf_dir).select(
        "doc_id", F.col("lang").alias("language"), text_type().alias("text_type"), F.when(m == 8, "val").when(m == 9, "test").otherwise("train").alias("split"), F.concat(F.lit("r"), (i % 4).cast("string")).alias("text_register"),
        F.concat(F.lit("m"), (i % 5).cast("string")).alias("model"), (F.col("n_chars") / 1000.0).alias("cost"), F.when(i % 2 == 0, "refusal").otherwise("truncated").alias("drop_reason"), (i % 9).alias("n_shared"),
    )
    gone = d.where("doc_id % 7 = 0")
    r = sinks.build_report(d.where("doc_id % 7 > 0"), gone, gone)
    classes = r["classes"].unpivot(["language"], ["human_written", "ai_generated", "ai_edited"], "text_type", "rows")
    row = lambda df, part, a, b, n: df.select(F.lit(part).alias("part"), F.col(a).alias("a"), (F.col(b) if b else F.lit("")).alias("b"), F.col(n).cast("double").alias("n"))
    parts = [row(r["splits"], "splits", "split", None, "rows"), row(classes.where("rows > 0"), "classes", "language", "text_type", "rows"), row(r["registers"], "registers", "language", "text_register", "rows")]
    parts += [row(r["drops"], "drops", "drop_reason", None, "rows"), row(r["overlap"].withColumn("name", F.lit("max")), "overlap", "name", None, "max"), row(r["cost"].withColumn("cost", F.round("cost", 3)), "cost", "model", None, "cost")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT doc_id, source FROM documents WHERE doc_id % 3 > 0 ORDER BY sha256(doc_id::VARCHAR), doc_id LIMIT 40")
def topped_up(spark, sf_dir):
    """Rows of the pool that are not done, the first in hash order."""
    d = docs_of(spark, sf_dir).select("doc_id", "source")
    return sinks.top_up(d, d.where("doc_id % 3 = 0"), ["source", "doc_id"], 40, sampling.hash_order("doc_id"))


@query("SELECT doc_id, '> ' || text AS output FROM documents WHERE doc_id % 4 <> 1")
def executed_requests(spark, sf_dir):
    """Requests that fail are skipped."""

    def call(prompt: str) -> str:
        if prompt.startswith("fails! "):
            raise TimeoutError
        return f"> {prompt}"

    text = F.col("text")
    d = docs_of(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("fails! "), text)).otherwise(text).alias("prompt"))
    return sinks.run_requests(store.text_batches(d), call, "doc_id").select("doc_id", "output")


@query("SELECT doc_id, source, sha256(text) AS text_sha256 FROM documents")
def jsonl_rows(spark, sf_dir):
    """JSON lines, cut at line feeds only, whatever separators the strings hold."""
    path = f"{store.folder(spark)}/rows.jsonl"
    mark = F.concat("text", F.lit(" \u0085"))
    docs_of(spark, sf_dir).select("doc_id", "source", mark.alias("text")).write.json(path)
    back = readers.read_jsonl(spark, path, "doc_id long, source string, text string")
    return back.select("doc_id", "source", F.sha2(F.substring("text", F.lit(1), F.length("text") - 2), 256).alias("text_sha256"))


@query(f"""WITH l AS (SELECT doc_id FROM labels), t AS (SELECT quantile_cont(score, 0.95) AS t FROM (SELECT {SCORE} AS score FROM documents WHERE doc_id IN (SELECT doc_id FROM l) AND doc_id % 3 = 0))
SELECT count(*)::BIGINT AS n, (SELECT count(*) FROM documents)::BIGINT AS total, round(any_value(t), 6) AS threshold FROM documents, t WHERE doc_id IN (SELECT doc_id FROM l)""")
def covered_predictions(spark, sf_dir):
    """Rows that a subset covers, with the count it covers."""
    d = docs_of(spark, sf_dir).select("doc_id", score().alias("score"), (F.col("doc_id") % 3 > 0).cast("int").alias("label"))
    own = joins.covered(d, table(spark, sf_dir, "labels"), "doc_id")
    cut = metrics.quantile_threshold(own, [], 0.05).select(F.round("threshold", 6).alias("threshold"))
    counts = own.agg(F.count("*").alias("n")).join(F.broadcast(d.agg(F.count("*").alias("total"))))
    return counts.join(F.broadcast(cut))
