"""A whole build in one query: gates, decontamination, near copies, splits, copies across splits, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell import hashing, textfn
from inkwell.operators import decontam, dedup, gates
from inkwell.plans import catalog
from inkwell.plans.registry import ORACLES, duck_mod, query, table
from inkwell.sources import sinks, store

_COLUMNS = ["doc_id", "lang", "source", "text_type"]


def run_build(rows: DataFrame, reference: DataFrame, path: str) -> DataFrame:
    """Write the splits of ``rows`` to ``path`` as CSV; returns ``doc_id`` and ``fate``, a split or why a row went.

    ``rows`` have doc_id, text, text_type, lang, source, source_text, finish_reason, judged_text and
    judged_lang, which the gates look at. Each step works on what the steps before it left; texts are written
    once, behind the gates:
    gates, grams shared with ``reference`` (English humans), near copies within a language (the first
    stays), splits by (lang, source), one row a text over splits by train, val, test.
    """
    judged = rows.select(*_COLUMNS, F.col("text").alias("_own"), F.col("judged_text").alias("text"), F.col("judged_lang").alias("language"), "source_text", "finish_reason")
    judged = judged.select(*_COLUMNS, "_own", gates.drop_reason().alias("fate"))
    marked = store.materialise(judged.select(*_COLUMNS, "fate", F.when(F.col("fate").isNull(), F.col("_own")).alias("text")))
    dropped = marked.where("fate is not null").select("doc_id", "fate")
    kept = marked.where("fate is null").select(*_COLUMNS, "text")
    humans = (F.col("lang") == "en") & (F.col("text_type") == "human_written")
    hits = store.materialise(decontam.overlap(kept.where(humans), reference).where(F.col("n_shared") >= decontam.MIN_SHARED).select("doc_id"))
    clean = store.narrowed(kept, hits, "doc_id", "left_anti")
    near = store.materialise(dedup.near_dedup(clean, "doc_id", ["lang"], store.materialise, "lang"))
    m = hashing.sha_modulo(1000, F.col("lang"), F.col("source"))
    split = F.when(m < 800, "train").when(m < 900, "val").otherwise("test")
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    hashed = clean.select(*_COLUMNS, F.sha2(textfn.strip(F.col("text")), 256).alias("text"), split.alias("split"))  # no text is shuffled from here
    alone = hashed.join(store.small(near), hashed["doc_id"] == near["id"], "left_anti")
    shipped = store.materialise(dedup.dedup_splits(alone, rank, F.lit(False), order="doc_id"))
    sinks.write_splits(shipped, path, _COLUMNS)
    written = sinks.read_rows(rows.sparkSession, path, "doc_id long, lang string, source string, text_type string, split string")
    again = alone.select("doc_id").join(shipped.select("doc_id"), "doc_id", "left_anti")
    return (
        dropped.unionByName(hits.withColumn("fate", F.lit("contaminated")))
        .unionByName(near.select(F.col("id").alias("doc_id"), F.lit("near_duplicate").alias("fate")))
        .unionByName(again.withColumn("fate", F.lit("in_another_split")))
        .unionByName(written.select("doc_id", F.col("split").alias("fate")))
    )


_MOD = duck_mod(1000, "CONCAT(lang, chr(0), source)")
_NEAR = catalog._SETS.replace("FROM documents WHERE text IS NOT NULL", "FROM clean WHERE text IS NOT NULL").removeprefix("WITH RECURSIVE ").rstrip().rstrip(",")


@query(
    rf"""WITH RECURSIVE gate AS MATERIALIZED ({ORACLES["gate_first_failure"]}), hit AS MATERIALIZED ({ORACLES["decontam_overlap"]}),
hits AS (SELECT doc_id FROM hit JOIN gate USING (doc_id) WHERE drop_reason IS NULL AND doc_id % 3 = 0),
clean AS MATERIALIZED (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM gate WHERE drop_reason IS NULL) AND doc_id NOT IN (SELECT doc_id FROM hits)),
{_NEAR}, o AS MATERIALIZED (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS n FROM p GROUP BY b),
walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS gone UNION ALL
 SELECT w.n + 1, CASE WHEN len(list_filter(o.earlier, lambda y: NOT list_contains(w.gone, y))) > 0 THEN list_append(w.gone, o.b) ELSE w.gone END FROM walk w JOIN o ON o.n = w.n + 1),
near AS (SELECT doc_id FROM clean WHERE text IS NOT NULL AND doc_id NOT IN (SELECT id FROM k) UNION ALL SELECT unnest(gone) FROM (SELECT gone FROM walk ORDER BY n DESC LIMIT 1)),
parted AS (SELECT doc_id, text, CASE WHEN {_MOD} < 800 THEN 'train' WHEN {_MOD} < 900 THEN 'val' ELSE 'test' END AS split FROM clean WHERE doc_id NOT IN (SELECT doc_id FROM near)),
first AS (SELECT doc_id, split, row_number() OVER (PARTITION BY regexp_replace(text, '^\s+|\s+$', '', 'g') ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, doc_id) AS n FROM parted)
SELECT doc_id, drop_reason AS fate FROM gate WHERE drop_reason IS NOT NULL UNION ALL SELECT doc_id, 'contaminated' FROM hits UNION ALL SELECT doc_id, 'near_duplicate' FROM near
UNION ALL SELECT doc_id, CASE WHEN n = 1 THEN split ELSE 'in_another_split' END FROM first"""
)
def corpus_build(spark, sf_dir):
    """Documents from gates to written splits, with the fate of each."""
    rows = catalog._gate_rows(spark, sf_dir, F.col("text").alias("own_text"), F.col("lang"), F.col("source"))
    rows = rows.withColumnsRenamed({"text": "judged_text", "language": "judged_lang", "own_text": "text"})
    return run_build(rows, decontam.reference(table(spark, sf_dir, "benchmark")), store.folder(spark))
