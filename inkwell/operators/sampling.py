"""Reproducible samples: by hash order, round-robin over cells, proportional, complete documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(rows: DataFrame, groups: list, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; each task limits its own rows before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def round_robin(rows: DataFrame, group: str, cells: list[str], key: str, n: int) -> DataFrame:
    """``n`` rows a group, one cell after another (cells by their string), each giving its row of
    the largest SHA-256 of ``key`` first; a cell that runs out is passed over."""
    cell = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in cells])
    turn = Window.partitionBy(group, "_cell").orderBy(F.sha2(F.col(key).cast("string"), 256).desc(), F.col(key).desc())
    w = Window.partitionBy(group).orderBy("_turn", "_cell")
    picked = rows.withColumn("_cell", cell).withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= n)
    return picked.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_cell", "_turn", "_n")


def proportional(rows: DataFrame, strata: list[str], key: str, n: int) -> DataFrame:
    """``n`` rows by largest remainder over strata (ties by stratum), the lowest keys of each."""
    named = rows.withColumn("_s", F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in strata]))
    sizes = named.groupBy("_s").agg(F.count("*").alias("_size"))
    everything = Window.partitionBy()
    exact = F.col("_size") * F.lit(float(n)) / F.sum("_size").over(everything)
    quota = sizes.withColumn("_exact", F.least(exact, F.col("_size").cast("double"))).withColumn("_q", F.floor("_exact"))
    left = F.least(F.lit(n), F.sum("_size").over(everything)) - F.sum("_q").over(everything)
    place = F.row_number().over(Window.orderBy((F.col("_exact") - F.col("_q")).desc(), "_s"))
    quota = quota.withColumn("_left", left).withColumn("_q", F.col("_q") + F.when(place <= F.col("_left"), 1).otherwise(0))
    w = Window.partitionBy("_s").orderBy(key)
    ranked = named.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return ranked.join(quota.select("_s", "_q"), "_s").where(F.col("_n") <= F.col("_q")).drop("_s", "_n", "_q")


def complete_documents(rows: DataFrame, doc: str, strata: list[str], key: str, n: int) -> DataFrame:
    """Documents by ``proportional`` of their first row, with all their rows."""
    first = first_per_group(rows, [doc], [key], 1)
    return rows.join(proportional(first, strata, key, n).select(doc).distinct(), doc, "left_semi")


def hash_order(key: str) -> list:
    return [F.sha2(F.col(key).cast("string"), 256), F.col(key)]


def probe(rows: DataFrame, groups: list[str], size, key: str, k: int) -> DataFrame:
    """Of each group the longest row (ties by key) and ``k`` others in hash order of the key."""
    longest = first_per_group(rows, groups, [size.desc(), F.col(key)], 1)
    # the longest is among the first k + 1 of the hash order or not; either way k others are left
    some = first_per_group(rows, groups, hash_order(key), k + 1)
    rest = some.join(longest.select(key), key, "left_anti").select(*rows.columns)
    return longest.select(*rows.columns).unionByName(first_per_group(rest, groups, hash_order(key), k))


def with_all(rows: DataFrame, unit: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """All rows of the units that have a row of every one of ``kinds``."""
    full = rows.where(F.col(kind).isin(kinds)).groupBy(*unit).agg(F.bit_or(_bit(kind, kinds)).alias("_bits"))
    return rows.join(full.where(F.col("_bits") == (1 << len(kinds)) - 1).select(*unit), unit, "left_semi")


def _bit(kind: str, kinds: list[str]):
    return F.coalesce(*[F.when(F.col(kind) == k, F.lit(1 << i).cast("long")) for i, k in enumerate(kinds)])


def balanced_models(candidates: DataFrame, source: str, model: str, n: int) -> dict:
    """A model for each of the first ``n`` sources in hash order, of those the source has, each
    time the least used (ties by hash of source and model). The turn of one source depends on all before, so this runs
    on the driver, over ``n`` sources: the size of a frozen evaluation subset, not of the corpus."""
    options = candidates.select(source, model).distinct()
    chosen = options.select(source).distinct().orderBy(*hash_order(source)).limit(n)
    tie = F.sha2(F.concat_ws("\0", F.col(source).cast("string"), model), 256)
    rows = options.join(chosen, source).groupBy(source).agg(F.array_sort(F.collect_list(F.struct(tie.alias("tie"), F.col(model).alias("model")))).alias("o"))
    used: dict = {}
    out = {}
    for r in rows.orderBy(*hash_order(source)).collect():
        best = min(r["o"], key=lambda o: (used.get(o["model"], 0), o["tie"]))["model"]
        used[best] = used.get(best, 0) + 1
        out[r[source]] = best
    return out
