"""Queries that join, filter and reshape rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import cleaning, decode
from inkwell.operators import filters, joins, normalize
from inkwell.plans.registry import SCORE, TYPES, docs_of, query, score, table, text_type
from inkwell.sources import sinks, store


def _salted(salt: str) -> str:
    return f"(CAST('0x' || substr(md5('{salt}' || doc_id), 1, 8) AS BIGINT) / 4294967296.0)"


@query(f"SELECT doc_id, round({_salted('a')}, 9) AS score_a, round({_salted('b')}, 9) AS score_b FROM documents")
def prediction_join(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id")
    both = joins.with_predictions(d, {x: d.select("doc_id", score(x).alias("score")) for x in "ab"}, "doc_id")
    return both.select("doc_id", *[F.round(f"score_{x}", 9).alias(f"score_{x}") for x in "ab"])


@query(f"""WITH h AS (SELECT lang, source, arg_max(text, doc_id) AS src FROM documents WHERE doc_id % 3 = 0 AND doc_id % 7 <> 0 GROUP BY ALL)
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN sha256(src) END AS source_sha256 FROM documents LEFT JOIN h USING (lang, source) WHERE {TYPES} <> 'ai_edited' OR src IS NOT NULL""")
def rescore_sources(spark, sf_dir):
    d = docs_of(spark, sf_dir).withColumn("text_type", text_type())
    src = joins.latest_text(d.where("doc_id % 3 = 0 and doc_id % 7 <> 0"), ["lang", "source"], "doc_id")
    return joins.attach_sources(d, src, ["lang", "source"]).select("doc_id", F.sha2("source_text", 256).alias("source_sha256"))


@query("""WITH r AS (SELECT doc_id, doc_id % 50 AS a, CASE WHEN doc_id % 3 = 2 THEN doc_id % 7 END AS b FROM documents), e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT doc_id, round(1 - list_cosine_similarity(x.v, y.v), 6) AS cosine_score FROM r JOIN e x ON x.vec_id = a LEFT JOIN e y ON y.vec_id = b""")
def edit_magnitude_lookup(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.sha2(F.col("vec_id").cast("string"), 256).alias("text_sha256"), F.col("embedding").alias("vector"))
    i = F.col("doc_id")
    d = docs_of(spark, sf_dir).select("doc_id", (i % 50).cast("string").alias("text"), F.when(i % 3 == 2, (i % 7).cast("string")).alias("source_text"))
    return joins.edit_magnitudes(d, vectors).select("doc_id", F.round("cosine_score", 6).alias("cosine_score"))


@query("""WITH p AS (SELECT 'p' || i AS prompt_id, CASE WHEN i < 4 THEN 'train' WHEN i < 7 THEN 'val' ELSE 'test' END AS split FROM range(10) t(i)), c AS (SELECT doc_id, 'p' || (doc_id % 10) AS prompt_id FROM documents WHERE doc_id % 5 < 3),
f AS (SELECT c.doc_id, q.prompt_id, q.split, row_number() OVER (PARTITION BY c.doc_id ORDER BY sha256(concat(c.doc_id, chr(0), q.prompt_id))) AS n FROM c JOIN p USING (prompt_id) JOIN p q ON q.split = p.split AND q.prompt_id <> c.prompt_id)
SELECT doc_id, prompt_id, split FROM f WHERE n <= 2""")
def extra_edit_prompts(spark, sf_dir):
    prompts = spark.createDataFrame([(f"p{i}", "train" if i < 4 else "val" if i < 7 else "test") for i in range(10)], "prompt_id string, split string")
    cached = docs_of(spark, sf_dir).where("doc_id % 5 < 3").select("doc_id", F.concat(F.lit("p"), (F.col("doc_id") % 10).cast("string")).alias("prompt_id"))
    return joins.unused_prompts(cached, prompts, 2)


@query("SELECT l_orderkey, l_linenumber::INT AS l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def sources_without_invalid(spark, sf_dir):
    lines = joins.without_sources_of(table(spark, sf_dir, "lineitem"), F.col("l_quantity") > 45, "l_orderkey")
    return lines.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"))


@query("""SELECT count(*) FILTER (WHERE r = 0)::BIGINT AS missing, count(*) FILTER (WHERE l = 0)::BIGINT AS unexpected, count(*) FILTER (WHERE l > 1)::BIGINT AS repeated_left, count(*) FILTER (WHERE r > 1)::BIGINT AS repeated_right
FROM (SELECT doc_id, sum(l) AS l, sum(r) AS r FROM (SELECT doc_id, 1 AS l, 0 AS r FROM documents UNION ALL SELECT doc_id, 0, 1 FROM labels) GROUP BY doc_id)""")
def join_key_faults(spark, sf_dir):
    return joins.key_faults(docs_of(spark, sf_dir), table(spark, sf_dir, "labels"), ["doc_id"])


_LANG = "CASE lang WHEN 'es' THEN 'ja' WHEN 'fr' THEN 'zh-tw' ELSE lang END"


@query(f"""WITH x AS (SELECT doc_id, {_LANG} AS l, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 9 = 1 THEN 1.0 ELSE {SCORE} / 5 END AS s FROM documents)
SELECT doc_id FROM x LEFT JOIN (VALUES ('en', 0.029, 0.148), ('ja', 0.019, 0.111), ('zh-tw', 0.018, 0.096)) c(l, lo, hi) USING (l) WHERE s IS NULL OR s IN (0, 1) OR lo IS NULL OR least(abs(s - lo::DOUBLE), abs(s - hi::DOUBLE)) >= 0.01""")
def boundary_rows(spark, sf_dir):
    i = F.col("doc_id")
    lang = F.when(F.col("lang") == "es", "ja").when(F.col("lang") == "fr", "zh-tw").otherwise(F.col("lang"))
    s = F.when(i % 9 == 0, None).when(i % 9 == 1, 1.0).otherwise(score() / 5)
    return docs_of(spark, sf_dir).where(filters.off_boundary(s, lang, 0.01)).select("doc_id")


_NAMES = ["Germany", "Czech Republic", "Northern Ireland and France", "nowhere", "Slovakia or Spain"]


@query(f"""WITH x AS (SELECT doc_id, text, {_NAMES}[(doc_id % 5 + 1)::INT] AS f FROM documents)
SELECT doc_id, CASE f WHEN 'Germany' THEN 'Germany' WHEN 'Czech Republic' THEN 'Czechia' WHEN 'Slovakia or Spain' THEN 'Slovakia' END AS country,
 length(text) >= 400 AND len(regexp_extract_all(text, '[A-Za-z]')) / nullif(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]')), 0) >= 0.9 AS usable FROM x""")
def post_filter(spark, sf_dir):
    flair = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % 5 + 1).cast("int"))
    t = F.col("text")
    return docs_of(spark, sf_dir).select("doc_id", filters.country_from_flair(flair).alias("country"), filters.usable_post(t, t).alias("usable"))


@query(f"SELECT doc_id, 'x' AS kept_meta FROM documents WHERE NOT ({TYPES} = 'ai_edited' AND coalesce(doc_id % 4 = 1, false) AND doc_id % 8 <> 1)")
def shippable_rows(spark, sf_dir):
    i = F.col("doc_id")
    flag = F.when(i % 8 == 1, None).otherwise(i % 4 != 1)
    d = docs_of(spark, sf_dir).withColumn("text_type", text_type()).withColumn("shippable_edit", flag).withColumn("source_text", F.lit("s"))
    d = d.withColumn("meta", F.struct(F.lit("x").alias("kept_meta"), F.lit("y").alias("usage")))
    return filters.split_rows(filters.shippable(d), ["usage"]).select("doc_id", "meta.*")


#: Sources stand for models, with what their documents give: a language is a model's if it has 13 % of their characters.
_MANIFEST = """WITH c AS (SELECT coalesce(source, 'none') AS id, lang, sum(coalesce(n_chars, 0))::BIGINT AS n FROM documents GROUP BY ALL), s AS (SELECT id, sum(n)::BIGINT AS n FROM c GROUP BY id),
m AS (SELECT s.id, s.n, list(c.lang) FILTER (WHERE c.lang IS NOT NULL AND c.n >= 0.13 * s.n) AS languages, substr(sha256(s.id), 1, (40 - (s.n % 5 = 2)::INT)::INT) AS revision FROM s JOIN c USING (id) GROUP BY s.id, s.n),
b AS (SELECT DISTINCT 'b' || item_id % 5 AS id, [['en'], ['fr', 'de'], ['es'], ['multilingual'], ['it']][(item_id % 5 + 1)::INT] AS languages FROM benchmark)
"""


def _manifest(spark, sf_dir):
    docs = docs_of(spark, sf_dir).select(F.coalesce("source", F.lit("none")).alias("id"), "lang", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    each = docs.groupBy("id", "lang").agg(F.sum("n_chars").alias("c"))
    models = each.groupBy("id").agg(F.sum("c").alias("n"), F.collect_list(F.struct("lang", "c")).alias("l"))  # a few languages
    n, text = F.col("n"), lambda c: c.cast("string")
    own = F.transform(F.filter("l", lambda x: x["lang"].isNotNull() & (x["c"] >= n * 0.13)), lambda x: x["lang"])
    models = models.select(
        "id", F.substring(F.sha2("id", 256), F.lit(1), F.lit(40) - (n % 5 == 2).cast("int")).alias("revision"), F.when(n % 7 == 3, "other").otherwise("graded").alias("kind"),
        F.when(n % 4 == 1, "none").otherwise("hub").alias("adapter"), (n % 6).cast("int").alias("max_length"), F.when(n % 3 > 0, (n % 3 - 1).cast("int")).alias("batch_size"), own.alias("languages"),
        F.array(F.concat(F.lit("b"), text(n % 5))).alias("include_benchmarks"), F.array(F.concat(F.lit("b"), text(n % 8))).alias("exclude_benchmarks"), F.array().cast("array<string>").alias("trained_on_benchmarks"),
    )
    k = F.col("item_id") % 5
    spoken = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in (["en"], ["fr", "de"], ["es"], ["multilingual"], ["it"])]), (k + 1).cast("int"))
    benchmarks = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), text(k)).alias("id"), spoken.alias("languages")).distinct()
    return models, benchmarks


@query(_MANIFEST + """SELECT m.id AS model_id, b.id AS benchmark_id FROM m CROSS JOIN b WHERE b.id <> 'b' || m.n % 8
 AND (b.id = 'b' || m.n % 5 OR list_contains(b.languages, 'multilingual') OR list_has_any(b.languages, coalesce(m.languages, [])))""")
def model_eligibility(spark, sf_dir):
    return filters.eligible_models(*_manifest(spark, sf_dir))


@query(_MANIFEST + """, r AS (SELECT DISTINCT id, unnest(['b' || n % 5, 'b' || n % 8]) AS ref FROM m)
SELECT id, 'revision is no commit' AS fault FROM m WHERE n % 5 = 2 UNION ALL SELECT id, 'unknown kind' FROM m WHERE n % 7 = 3 UNION ALL SELECT id, 'unknown adapter' FROM m WHERE n % 4 = 1
UNION ALL SELECT id, 'max_length is not positive' FROM m WHERE n % 6 = 0 UNION ALL SELECT id, 'batch_size is not positive' FROM m WHERE n % 3 = 1
UNION ALL SELECT DISTINCT id, 'unknown benchmark' FROM r WHERE ref NOT IN (SELECT id FROM b)""")
def manifest_violations(spark, sf_dir):
    return filters.manifest_faults(*_manifest(spark, sf_dir), ["hub"])


@query("SELECT doc_id AS text_id, (doc_id % 4)::INT AS label, 'Text: ' || text || chr(10) || 'Score:' AS prompt FROM documents")
def prepared_prompts(spark, sf_dir):
    d = docs_of(spark, sf_dir).select(F.col("doc_id").alias("text_id"), "text", (F.col("doc_id") % 4).alias("bucket"), text_type().alias("text_type"))
    return filters.prepared(filters.require_humans(d), "Text: {text}\nScore:")


_STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def _row_id(benchmark: str, source: str, variant: str, salt: str = "''") -> str:
    return f"sha256(concat('{benchmark}', chr(0), {source}, chr(0), {variant}, chr(0), sha256({_STRIPPED}), chr(0), {salt})) AS row_id"


@query(f"""SELECT {_row_id('polish', 'doc_id', "'human'")}, 0.0::DOUBLE AS edit_target, 0 AS label_ternary FROM documents WHERE doc_id % 3 = 0 UNION ALL
SELECT {_row_id('polish', 'doc_id', "'polished:degree:' || CASE WHEN doc_id % 2 = 0 THEN 'major' ELSE (doc_id % 100)::VARCHAR END")}, (doc_id % 100) / 100.0::DOUBLE, 2 FROM documents WHERE doc_id % 3 = 1""")
def normalize_polished(spark, sf_dir):
    i = F.col("doc_id")
    d = docs_of(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("text").alias("generation"), F.col("source").alias("domain"), F.lit("degree").alias("polish_type"),
        F.when(i % 2 == 0, "major").alias("polishing_degree"), (i % 100).alias("polishing_percent"), F.lit("m").alias("polisher"),
    )
    return normalize.polished("polish", d.where("id % 3 = 1"), d.where("id % 3 = 0")).select("row_id", "edit_target", "label_ternary")


_VARIANTS = """WITH x AS (SELECT doc_id, unnest([{'v': 'human', 't': text, 'l': 0}, {'v': 'generated', 't': 'u' || text, 'l': 1}, {'v': 'a:0', 't': 'l' || text, 'l': 2}, {'v': 'a:1', 't': 'z' || text, 'l': 2}, {'v': 'b:0', 't': text, 'l': 2}]) AS r FROM documents),
y AS (SELECT doc_id, r.v AS variant, r.t AS text, r.l::INT AS label_ternary FROM x)"""


@query(f"{_VARIANTS} SELECT {_row_id('expert', 'doc_id', 'variant')}, variant, label_ternary FROM y")
def normalize_variants(spark, sf_dir):
    t = quoted = F.col("text")
    for c, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\r", "\\r"), ("\0", "\\x00")):  # a literal has no line end but \n, and no NUL
        quoted = F.replace(quoted, F.lit(c), F.lit(escaped))
    d = docs_of(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("source").alias("category"), t.alias("human_output"), F.concat(F.lit("u"), t).alias("model_output"), F.lit("m").alias("model"),
        F.array(F.concat(F.lit("l"), t), F.lit(" "), F.concat(F.lit("z"), t)).alias("a"), F.concat(F.lit('["""'), quoted, F.lit('"""]')).alias("b"),
    )
    return normalize.with_variants("expert", d, {"a": ("a", "g1"), "b": ("b", "g2")}, bare=True).select("row_id", "variant", "label_ternary")


@query(f"""SELECT {_row_id('prompted', "concat(source, ':', sha256(coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, text)))", "CASE WHEN doc_id % 4 = 0 THEN 'human' ELSE 'generated:' || lang END", 'doc_id')},
 (doc_id % 4 <> 0)::INT AS label_binary, CASE WHEN doc_id % 4 <> 0 THEN lang END AS generator FROM documents""")
def normalize_prompted(spark, sf_dir):
    i = F.col("doc_id")
    d = docs_of(spark, sf_dir).select("doc_id", "text", F.col("source").alias("domain"), F.col("lang").alias("model"), F.when(i % 2 == 0, F.col("lang")).alias("prompt"), (i % 4 != 0).cast("int").alias("label"))
    return normalize.prompted("prompted", d, "doc_id").select("row_id", "label_binary", "generator")


@query(f"""SELECT {_row_id('threeway', "'dev:' || doc_id", "['human', 'generated', 'refined'][quality + toxic + 1]")}, (quality + toxic > 0)::INT AS label_binary, (quality + toxic)::INT AS label_ternary FROM documents JOIN labels USING (doc_id)""")
def normalize_three_way(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") + F.col("toxic")).alias("label"))
    rows = docs_of(spark, sf_dir).select(F.col("doc_id").alias("id"), "text").join(labels.select("id"), "id", "left_semi")
    return normalize.three_way("threeway", rows, labels, "dev").select("row_id", "label_binary", "label_ternary")


@query()
def detector_text(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", cleaning.plain_markdown(F.col("text")).alias("plain"))


@query("SELECT vec_id, round(CASE WHEN len(e) = 1 THEN 1 / (1 + exp(-e[1])) ELSE list_sum(list_transform(e, lambda x, i: exp(x) * (i - 1))) / list_sum(list_transform(e, lambda x: exp(x))) / (len(e) - 1) END, 6) AS score FROM (SELECT vec_id, embedding[1:CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 4 END]::DOUBLE[] AS e FROM embeddings)")
def scores_from_logits(spark, sf_dir):
    e = F.slice("embedding", F.lit(1), F.when(F.col("vec_id") % 2 == 0, 1).otherwise(4))
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(e, lambda v: v.cast("double")).alias("x"))
    return d.select("vec_id", F.round(decode.logit_score(F.col("x")), 6).alias("score"))


_MADE = "CASE doc_id % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'm1' ELSE 'm_2' END"


@query(f"""SELECT {_row_id('files', "lang || ' news:' || doc_id", f"CASE WHEN doc_id % 3 = 0 THEN 'human' ELSE 'generated:' || {_MADE} END")}, lang || ' news' AS domain, CASE WHEN doc_id % 3 > 0 THEN {_MADE} END AS generator, (doc_id % 3 > 0)::INT AS label_binary FROM documents WHERE lang IS NOT NULL""")
def normalize_files(spark, sf_dir):
    """Documents landed as one CSV a domain and generator, both of which are read from the paths."""
    i = F.col("doc_id")
    by = F.when(i % 3 == 0, "human").when(i % 3 == 1, "m1").otherwise("m_2")
    path = F.concat(F.col("lang"), F.lit(" news/Set_"), F.col("lang"), F.lit("_news_"), by, F.lit(".csv"))
    d = docs_of(spark, sf_dir).where("lang is not null").select(path.alias("path"), i.alias("id"), (i % 3 == 0).cast("int").alias("label"), "text", F.lit(None).cast("string").alias("original_id"))
    root = store.folder(spark)
    sinks.write_named_csv(d, root, "path")
    return normalize.files_by_domain(spark, root, "files", "Set").select("row_id", "domain", "generator", "label_binary")
