"""Queries that read sources into canonical rows and prepare training and calibration."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from inkwell.functions import decode
from inkwell.operators import metrics
from inkwell.plans.registry import SCORE, docs_of, query, score, table, text_type
from inkwell.sources import readers
from inkwell.textfn import word_count

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_FLOOR = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+')) >= 75"


@query(rf"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '_START_ARTICLE__NEWLINE_Title ' || doc_id || '_NEWLINE__START_PARAGRAPH__NEWLINE_' || replace(text, chr(10), '_NEWLINE_') ELSE text END AS t FROM documents),
s AS (SELECT doc_id, replace(t, '_NEWLINE_', chr(10)) AS t FROM r),
p AS (SELECT doc_id, t, list_filter(list_transform(regexp_split_to_array(t, '_START_ARTICLE_|_START_SECTION_|_START_PARAGRAPH_'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS q FROM s)
SELECT doc_id, CASE WHEN contains(t, '_START_') THEN q[1] ELSE '' END AS title, sha256(CASE WHEN NOT contains(t, '_START_') THEN {_STRIP.format('t')} WHEN len(q) > 1 THEN array_to_string(q[2:], chr(10)) ELSE q[1] END) AS body FROM p""")
def wiki_articles(spark, sf_dir):
    i, t = F.col("doc_id").cast("string"), F.col("text")
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("_START_ARTICLE__NEWLINE_Title "), i, F.lit("_NEWLINE__START_PARAGRAPH__NEWLINE_"), F.replace(t, F.lit("\n"), F.lit("_NEWLINE_")))).otherwise(t)
    d = docs_of(spark, sf_dir).select("doc_id", readers.wiki_article(readers.decoded(raw)).alias("a"))
    return d.select("doc_id", "a.title", F.sha2("a.body", 256).alias("body"))


@query(rf"""WITH x AS (SELECT doc_id::VARCHAR AS source_id, source, substring({_STRIP.format('text')}, 1, 6000) AS t FROM documents WHERE text IS NOT NULL), k AS (SELECT * FROM x WHERE {_FLOOR.format('t')}),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256(source_id), source_id) AS r FROM k), q AS (SELECT * FROM n WHERE r <= greatest(1, 60 // (SELECT count(DISTINCT source) + max((source IS NULL)::INT) FROM k)))
SELECT source_id, source AS dump, length(t)::INT AS n_chars FROM (SELECT * FROM q ORDER BY sha256(source_id), source_id LIMIT 60)""")
def dump_quota(spark, sf_dir):
    raw = docs_of(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", F.col("source").alias("dump"), F.lit("").alias("url"), F.lit("").alias("date"))
    r = readers.human_rows(raw, readers.SOURCES["fineweb"], 60)
    return r.select("source_id", "meta.dump", F.col("meta.length").alias("n_chars"))


@query(rf"""WITH x AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents), s AS (SELECT doc_id, {_STRIP.format('t')} AS t FROM x),
p AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda x: {_STRIP.format('x')}), lambda x: x <> '')[4:] AS l FROM s)),
c AS (SELECT *, coalesce(sum(len(regexp_extract_all(p, '\S+'))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT doc_id, sha256(substring(coalesce(string_agg(p, chr(10) || chr(10) ORDER BY i) FILTER (WHERE before < 300), ''), 1, 4000)) AS passage FROM documents LEFT JOIN c USING (doc_id) WHERE text IS NOT NULL GROUP BY doc_id""")
def book_passages(spark, sf_dir):
    book = F.concat(F.lit("Licence\n*** START OF THE PROJECT GUTENBERG EBOOK ***\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n*** end of this Project Gutenberg ebook ***\nmore"))
    d = docs_of(spark, sf_dir).where("text is not null")
    return d.select("doc_id", F.sha2(readers.first_passage(readers.without_licence(book)), 256).alias("passage"))


@query("""SELECT min(doc_id) AS doc_id, (doc_id % 300)::BIGINT AS s FROM documents WHERE doc_id % 4 > 0 AND regexp_matches(text, '\\S') AND 2018 + doc_id % 6 < 2022 GROUP BY doc_id % 300""")
def releases_by_id(spark, sf_dir):
    i = F.col("doc_id")
    d = docs_of(spark, sf_dir).where(2018 + i % 6 < 2022).select("doc_id", (i % 300).alias("s"), F.when(i % 4 > 0, F.col("text")).otherwise(" \n").alias("body"))
    return readers.first_with_body(d, "s", "body", "doc_id").select("doc_id", "s")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts < (SELECT min(ts) + INTERVAL 10 DAY FROM events)) WHERE n = 1""")
def revision_before(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    cutoff = e.agg(F.min("ts")).first()[0]
    return readers.last_before(e, "user_id", "ts", (cutoff or datetime.datetime(1970, 1, 1)) + datetime.timedelta(days=10), "event_id").select("user_id", "event_id")


_DATED = "CASE WHEN doc_id % 3 > 0 THEN '【20' || lpad((10 + doc_id % 12)::VARCHAR, 2, '0') || '年' || (1 + doc_id % 12) || '月' || (1 + doc_id % 28) || '日】' || text ELSE text END"


@query(rf"""WITH x AS (SELECT doc_id, {_DATED} AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN (2010 + doc_id % 12) || '-' || lpad((1 + doc_id % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') END AS published,
 sha256(trim(regexp_replace(t, '【\s*20\d{{2}}年\d{{1,2}}月\d{{1,2}}日\s*】', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS body, CASE WHEN doc_id % 5 > 0 THEN year(make_timestamp(1400000000000000 + doc_id * 86400000000)) END::INT AS posted,
 (1911 + 100 + doc_id % 15) || '-' || lpad((1 + doc_id % 12)::VARCHAR, 2, '0') || '-09' AS minguo FROM x""")
def dated_articles(spark, sf_dir):
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    dated = F.when(i % 3 > 0, F.concat(F.lit("【20"), s(10 + i % 12), F.lit("年"), s(1 + i % 12), F.lit("月"), s(1 + i % 28), F.lit("日】"), "text")).otherwise(F.col("text"))
    post = F.when(i % 5 > 0, F.concat(F.lit("M."), s(1400000000 + i * 86400), F.lit(".A.0AA"))).otherwise("none")
    listed = F.concat(F.lit("row "), s(100 + i % 15), F.lit("-"), s(1 + i % 12), F.lit("-9 unit"))
    return docs_of(spark, sf_dir).select(
        "doc_id", readers.publication_date(dated).alias("published"), F.sha2(readers.without_dateline(dated), 256).alias("body"), readers.posted_year(post).alias("posted"), readers.roc_date(listed).alias("minguo")
    )


@query(r"""SELECT doc_id, sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS body FROM documents""")
def press_bodies(spark, sf_dir):
    head = F.element_at(F.array(F.lit("發稿單位：市府\n聯絡 電話: 02\n"), F.lit("發布日期：1\n"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs_of(spark, sf_dir).select("doc_id", F.sha2(readers.without_header(F.concat(head, "text")), 256).alias("body"))


@query(rf"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'human' ELSE 'm' END AS model, CASE doc_id % 7 WHEN 0 THEN 'code' ELSE 'news' END AS domain, CASE WHEN doc_id % 2 = 0 THEN 's' || doc_id % 100 ELSE doc_id::VARCHAR END AS sid, CASE WHEN doc_id % 12 = 0 THEN '  ' ELSE text END AS g FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY doc_id) AS n FROM x WHERE model = 'human' AND domain <> 'code') SELECT sid AS source_id, sha256({_STRIP.format('g')}) AS text FROM f WHERE n = 1 AND {_STRIP.format("coalesce(g, '')")} <> ''""")
def reference_humans(spark, sf_dir):
    i = F.col("doc_id")
    rows = docs_of(spark, sf_dir).select(
        i.alias("id"), F.when(i % 3 == 0, "human").otherwise("m").alias("model"), F.when(i % 7 == 0, "code").otherwise("news").alias("domain"),
        F.when(i % 2 == 0, F.concat(F.lit("s"), (i % 100).cast("string"))).alias("source_id"), F.when(i % 12 == 0, "  ").otherwise(F.col("text")).alias("generation"),
    )
    return readers.reference_humans(rows, "id").select("source_id", F.sha2("text", 256).alias("text"))


@query(rf"""WITH x AS (SELECT 'en/b/' || doc_id || '/' || CASE doc_id % 3 WHEN 1 THEN 'ai_generated' ELSE 'ai_edited' END || '/backbone' AS text_id, doc_id % 3 AS k, CASE doc_id % 3 WHEN 1 THEN 1.0 ELSE {SCORE} END::DOUBLE AS c FROM documents WHERE doc_id % 3 > 0 AND {_FLOOR.format('text')}),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sha256(text_id), text_id) AS r FROM x) SELECT text_id, round(c, 6) AS cosine_score FROM n WHERE r <= 25""")
def backbone_rows(spark, sf_dir):
    raw = docs_of(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_id"), "text", text_type().alias("text_type"), F.lit("m").alias("model"), score().alias("cosine_score"))
    return readers.machine_rows(raw, "b", 50).select("text_id", F.round("cosine_score", 6).alias("cosine_score"))


@query(rf"""WITH s AS (SELECT doc_id, text, {SCORE} AS c FROM documents ORDER BY sha256(doc_id::VARCHAR), doc_id LIMIT 300),
f AS (SELECT * FROM s WHERE {_FLOOR.format('text')} ORDER BY sha256(doc_id::VARCHAR), doc_id LIMIT 100) SELECT doc_id, (CASE WHEN c <= 0.25 THEN 0 WHEN c >= 0.75 THEN 3 ELSE least(floor((c - 0.25) / 0.25) + 1, 2) END)::INT AS label FROM f""")
def training_rows(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id", "text", score().alias("c"))
    order = [F.sha2(F.col("doc_id").cast("string"), 256), "doc_id"]
    some = d.orderBy(*order).limit(300).where(word_count(F.col("text")) >= 75).orderBy(*order).limit(100)
    return some.select("doc_id", decode.score_to_bucket(F.col("c"), 4, F.lit(0.25), F.lit(0.75)).cast("int").alias("label"))


_DRIFT = f"least({SCORE}, 0.999) * 0.2 + (doc_id % 3 > 0)::INT * 0.3 + (doc_id % 3 = 1)::INT * 0.4"
_F1 = "SELECT {k} AS k, i, round(coalesce(2.0 * sum(({y} AND u >= i / 999.0 - 1e-12)::INT) / nullif(sum((u >= i / 999.0 - 1e-12)::INT) + sum(({y})::INT), 0), 0), 9) AS f1 FROM z, range(1000) t(i) WHERE val GROUP BY i"


@query(f"""WITH x AS (SELECT lang, doc_id % 2 = 0 AS val, (doc_id % 3)::INT AS label, 1 - ({_DRIFT}) AS s FROM documents), o AS (SELECT *, -s AS v FROM x), e AS (SELECT min(v) AS lo, max(v) AS hi FROM o WHERE val),
z AS (SELECT o.*, least(greatest((v - lo) / (hi - lo), 0), 1) AS u FROM o, e), f AS ({_F1.format(k=1, y='label > 0')} UNION ALL {_F1.format(k=2, y='label = 1')}),
th AS (SELECT k, min(i) / 999.0 AS t FROM f JOIN (SELECT k, max(f1) AS f1 FROM f GROUP BY k) USING (k, f1) GROUP BY k), b AS (SELECT lang, quantile_cont(u, 0.99) AS t FROM z WHERE val AND label = 0 GROUP BY lang)
SELECT true AS flip, round(lo, 6) AS score_min, round(hi, 6) AS score_max, round((SELECT t FROM th WHERE k = 1), 6) AS h_thresh, round((SELECT t FROM th WHERE k = 2), 6) AS ai_thresh,
 round((SELECT max(t) FROM b), 6) AS binary_threshold, (SELECT arg_max(lang, t) FROM b) AS binding FROM e""")
def calibration(spark, sf_dir):
    s = 1 - (F.least(score(), F.lit(0.999)) * 0.2 + (F.col("doc_id") % 3 > 0).cast("int") * 0.3 + (F.col("doc_id") % 3 == 1).cast("int") * 0.4)
    d = docs_of(spark, sf_dir).select((F.col("doc_id") % 2 == 0).alias("val"), F.col("lang").alias("group"), (F.col("doc_id") % 3).cast("int").alias("label"), s.alias("score"))
    c = metrics.calibration(d.where("val"), d.where("not val"), 0.01)
    return c.select("flip", *[F.round(x, 6).alias(x) for x in ("score_min", "score_max", "h_thresh", "ai_thresh", "binary_threshold")], "binding")


_POOLED = f"SELECT doc_id, (doc_id % 3)::INT AS label, (CASE WHEN {SCORE} > 0.6 THEN 1 WHEN {SCORE} < 0.3 THEN 0 ELSE 2 END) AS p, unnest(['overall', 'language:' || coalesce(lang, 'none')]) AS part FROM documents"


@query(f"""WITH x AS ({_POOLED}) SELECT part, count(*)::BIGINT AS n, round(avg((label = p)::INT), 6) AS accuracy,
 round((2.0 * sum((label = 0 AND p = 0)::INT) / (sum((label = 0)::INT) + sum((p = 0)::INT)) + 2.0 * sum((label = 1 AND p = 1)::INT) / (sum((label = 1)::INT) + sum((p = 1)::INT)) + 2.0 * sum((label = 2 AND p = 2)::INT) / (sum((label = 2)::INT) + sum((p = 2)::INT))) / 3, 6) AS macro_f1 FROM x GROUP BY part""")
def frozen_thresholds_report(spark, sf_dir):
    """Ternary metrics at frozen thresholds, overall and by language, in one aggregation."""
    d = docs_of(spark, sf_dir).select((F.col("doc_id") % 3).cast("int").alias("label"), decode.ternary(score(), F.lit(0.3), F.lit(0.6)).alias("p"), F.explode(F.array(F.lit("overall"), F.concat(F.lit("language:"), F.coalesce("lang", F.lit("none"))))).alias("part"))
    r = metrics.ternary_report(d, ["part"], "label", "p")
    return r.select("part", "n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query(f"""WITH x AS (SELECT *, doc_id % 3 AS k, doc_id % 4 > 0 AS kept, {SCORE} AS s FROM documents)
SELECT source, count(*) FILTER (WHERE k = 0)::BIGINT AS docs, count(*) FILTER (WHERE k = 1)::BIGINT AS mirrors, count(*) FILTER (WHERE k = 2)::BIGINT AS edits, count(*) FILTER (WHERE kept)::BIGINT AS kept, count(*) FILTER (WHERE NOT kept)::BIGINT AS dropped,
 round(quantile_cont(CASE WHEN k = 2 THEN s END, 0.5), 6) AS median_magnitude FROM x GROUP BY source""")
def smoke_counts(spark, sf_dir):
    k, kept = F.col("doc_id") % 3, F.col("doc_id") % 4 > 0
    d = docs_of(spark, sf_dir).withColumn("s", score())
    return d.groupBy("source").agg(
        *[F.count_if(k == i).alias(n) for i, n in enumerate(("docs", "mirrors", "edits"))], F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), F.round(F.median(F.when(k == 2, F.col("s"))), 6).alias("median_magnitude")
    )


@query("""SELECT doc_id, 'human' AS part, NULL::VARCHAR AS split FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'kept', NULL FROM documents WHERE doc_id % 3 > 0 AND doc_id % 4 > 0 UNION ALL SELECT doc_id, 'held_out', 'ood' FROM documents WHERE doc_id % 17 = 0""")
def corpus_union(spark, sf_dir):
    """Parts of a corpus in one frame; a part without a split has a null one."""
    d, i = docs_of(spark, sf_dir).select("doc_id"), F.col("doc_id")
    part = lambda where, name: d.where(where).withColumn("part", F.lit(name))
    both = part(i % 3 == 0, "human").unionByName(part((i % 3 > 0) & (i % 4 > 0), "kept"))
    return both.unionByName(part(i % 17 == 0, "held_out").withColumn("split", F.lit("ood")), allowMissingColumns=True)
