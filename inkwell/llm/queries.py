"""The registered queries of the training-data operators; each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import ann, decomposition, golden, langid, lexical, lines, mixing, packing, pii, quality, repeats, simhash, tokens
from inkwell.llm.common import materialise, word_count


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.shared_passages(_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("same"))
    mixed = mixing.mix(materialise(docs, "words"), F.col("size"), identity=("same",))
    return mixed.select("doc_id", "size", "mix.source_size", "mix.target", (F.col("size") * F.col("mix.copies")).alias("taken"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_vp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.drop_boilerplate(_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "lines.n_lines", "lines.n_dropped", "text")


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.language_id(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", F.col("langid.lang").alias("lang_pred"), "langid.score", "langid.margin", "langid.rejected")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents")))


def op11_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decomposition.bucketed(decomposition.decompose(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op12_golden_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.golden_records(_table(spark, sf_dir, "clients"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_source_mixing,
        op3_simhash_dedup,
        op4_vp_tree_search,
        op5_best_fit_packing,
        op6_line_dedup,
        op7_compression_quality,
        op8_token_counts,
        op9_language_id,
        op10_pii,
        op11_power_of_two_packing,
        op12_golden_record,
        op13_lexical_search,
    )
}
