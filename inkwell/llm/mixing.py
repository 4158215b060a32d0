"""Mixing sources to target weights, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import BROADCAST_ROWS, materialise, small, unit_hash

CYCLE = (1, 2, 3)
#: A document over this share of its source's size is a big one; a source has 200 at most.
BIG_SHARE = 0.005
#: The cut of a source's draws is found by 12 bits of the draw, 12 more, then the whole draw.
_SHIFTS = (41, 29, 0)
_SPREAD = 1024


def cyclic_weight(position: Column, cycle: tuple[int, ...] = CYCLE) -> Column:
    """The weight of the source at ``position`` (from 1): the cycle's values, repeating."""
    values = F.array(*[F.lit(float(x)) for x in cycle])
    return F.element_at(values, ((position - 1) % len(cycle) + 1).cast("int"))


def source_targets(
    sizes: DataFrame, source_col: str = "source", size_col: str = "size", max_repeat: float = 3.0, share: float = 1.0
) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``weight``, ``target``, ``rate``.

    ``sizes`` has a row per document. Sources, in code point order with null last, weigh 1, 2, 3,
    repeating; they share ``share`` of all sizes by weight. A target stops at ``max_repeat``
    times its source's size and the excess is reshared by weight until none is above: sorted by
    size over weight, the capped sources are a prefix, so running sums find the fixed point.
    Null sizes count 0; a source of size 0 has target and rate 0. An empty table gives no row.
    The windows run over one row per source, after a partial aggregation.
    """
    s = sizes.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(F.coalesce(F.col(size_col), F.lit(0))).cast("long").alias("source_size")
    )
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = s.withColumn("weight", cyclic_weight(F.row_number().over(by_name)))
    s = s.withColumn("cap", F.lit(max_repeat) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    so_far = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = (
        s.withColumn("place", F.row_number().over(by_ratio))
        .withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("cap_before", F.sum("cap").over(so_far) - F.col("cap"))
        .withColumn("weight_from", F.sum("weight").over(everything) - F.sum("weight").over(so_far) + F.col("weight"))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_from"))
    )
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    first = F.min(free).over(everything)
    target = F.when(F.col("place") < F.coalesce(first["place"], F.lit(2**31 - 1)), F.col("cap")).otherwise(
        first["level"] * F.col("weight")
    )
    s = s.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return s.select("source", "source_size", "weight", "target", rate.alias("rate"))


def _with_plan(rows: DataFrame, plan: DataFrame, few: bool, on: Column | None = None, how: str = "inner") -> DataFrame:
    """``rows`` (``source``) joined with a plan (``_source``): broadcast if the sources are few."""
    same = F.col("source").eqNullSafe(F.col("_source"))
    return rows.join(F.broadcast(plan) if few else plan, same if on is None else same & on, how)


def _big_picks(draws: DataFrame, seed: int) -> DataFrame:
    """Big documents (``_source``, ``draw``, ``size``, ``n`` alike) with ``k``, how many get a copy more.

    In order of size, a systematic draw: one hash-seeded offset a source, so each document's
    chance is the fraction and the sum misses its share by less than the largest.
    """
    own = Window.partitionBy("_source").orderBy(F.desc("size"), "draw")
    alike = draws.where("big").groupBy("_source", "rest", "size", "draw").agg(F.count("*").alias("n"))
    before = F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    start = unit_hash(seed, F.lit("offset"), F.col("_source"))
    upto = lambda c: F.floor(c * F.col("rest") + start)
    return alike.withColumn("_b", before).select("_source", "size", "draw", "n", (upto(F.col("_b") + F.col("n")) - upto(F.col("_b"))).alias("k"))


def _cut(draws: DataFrame, goals: DataFrame, few: bool) -> DataFrame:
    """Per source (``_source``, ``goal`` words): the ``draw`` of the documents at which the sum of
    the sizes up to it, in order of draws, comes to the goal; ``n`` documents have it, ``k`` of
    them are taken, to the nearest.

    The range of draws that holds the cut is narrowed by bits, so each step sums at most 4,096
    groups a source, and the last one only draws alike in 24 bits, whatever a source's share.
    """
    at = goals.where("goal > 0").select(F.col("_source").alias("_s"), F.lit(0).cast("long").alias("_draw"), "goal", F.lit(0).cast("long").alias("before"))
    last = 53
    for shift in _SHIFTS:
        inside = F.col("_source").eqNullSafe(F.col("_s")) & (F.shiftright("draw", last) == F.col("_draw"))
        part = draws.where("not big and size > 0").join(F.broadcast(at) if few else at, inside)
        part = part.groupBy("_source", "goal", "before", F.shiftright("draw", shift).alias("_draw")).agg(F.sum("size").alias("g"), F.count("*").alias("n"))
        upto = Window.partitionBy("_source").orderBy("_draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        part = part.withColumn("_upto", F.col("before") + F.sum("g").over(upto))
        # the first group that comes to the goal, or the last one where rounding leaves none
        first = F.row_number().over(Window.partitionBy("_source").orderBy(F.col("_upto") < F.col("goal"), F.when(F.col("_upto") < F.col("goal"), -F.col("_draw")).otherwise(F.col("_draw"))))
        part = part.withColumn("_first", first).where("_first = 1")
        at, last = part.select(F.col("_source").alias("_s"), "_draw", "goal", (F.col("_upto") - F.col("g")).alias("before"), "g", "n"), shift
    k = F.least(F.col("n"), F.greatest(F.lit(0), F.round((F.col("goal") - F.col("before")) * F.col("n") / F.col("g")))).cast("long")
    return at.select(F.col("_s").alias("_source"), F.col("_draw").alias("draw"), "n", k.alias("k"))


def _picks(sized: DataFrame, plan: DataFrame, few: bool, seed: int) -> DataFrame:
    """``plan`` with ``cut`` (draws below it get a copy more), ``big`` (draws of big documents that
    do) and ``some`` (draws of which ``k`` of ``n`` documents do)."""
    rest = plan.select(F.col("source").alias("_source"), "source_size", (F.col("rate") - F.floor("rate")).alias("rest"))
    draws = _with_plan(sized, rest, few).withColumn("big", F.col("size") > F.col("source_size") * BIG_SHARE)
    draws = materialise(draws.select("_source", "draw", "size", "big", "rest"), "draws")
    big = materialise(_big_picks(draws, seed), "big")
    taken = big.groupBy("_source").agg(F.sum(F.col("k") * F.col("size")).alias("_taken"))
    goals = rest.withColumnRenamed("_source", "source").join(taken, F.col("source").eqNullSafe(F.col("_source")), "left")
    goal = F.col("rest") * F.col("source_size") - F.coalesce(F.col("_taken"), F.lit(0))
    cuts = materialise(_cut(draws, goals.select(F.col("source").alias("_source"), goal.alias("goal")), few), "cuts")
    part = lambda df: df.where("k > 0 and k < n").select("_source", "draw", "n", "k")
    some = part(big).unionByName(part(cuts)).groupBy("_source").agg(F.collect_list(F.struct("draw", "n", "k")).alias("some"))
    whole = big.where("k = n").groupBy("_source").agg(F.collect_list("draw").alias("big_draws"))
    below = cuts.select("_source", (F.col("draw") + (F.col("k") == F.col("n")).cast("long")).alias("cut"))
    for extra in (below, whole, some):
        plan = plan.join(extra, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return plan


def _alike(rows: DataFrame) -> DataFrame:
    """Of rows that share a draw (``_some``: n, k), k more copies in all: ``_more`` is 0 or 1.

    Rows are counted by number modulo 1,024 in the written frame, and each class takes its part
    of k, so that no task holds them all, however many there are.
    """
    rows = materialise(rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SPREAD))), "alike")
    key = ["source", "draw", "_salt"]
    upto = Window.partitionBy("source", "draw").orderBy("_salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = rows.groupBy(*key, "_some").agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(upto))
    share = lambda c: F.floor(c * F.col("_some.k") / F.col("_some.n"))
    quota = (share(F.col("_upto")) - share(F.col("_upto") - F.col("_c"))).alias("_quota")
    parts = parts.select(F.col("source").alias("_source"), F.col("draw").alias("_own"), F.col("_salt").alias("_class"), quota)
    known = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    number = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(*known)))
    joined = _with_plan(rows.withColumn("_n", number), parts, False, (F.col("draw") == F.col("_own")) & (F.col("_salt") == F.col("_class")))
    return joined.withColumn("_more", (F.col("_n") <= F.col("_quota")).cast("long")).drop("_source", "_own", "_class", "_quota", "_n", "_salt")


def mix(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    seed: int = 42,
    max_repeat: float = 3.0,
    share: float = 1.0,
    identity: tuple[str, ...] = (),
) -> DataFrame:
    """Every row of ``docs`` with the reserved struct column ``mix``.

    ``mix`` holds ``size``, ``source_size``, ``target``, ``rate`` and ``copies`` (how often the
    mix takes the row): floor(rate), and one more with a chance of the fraction, by a draw in
    [0, 1) that is the hash of source, id, size and the ``identity`` columns. Draws of their own
    would leave a source of few or of unequal documents far from its target, so the cut that
    draws are held against is set for the words taken to come to the target: big documents
    (over 0.5 % of their source) are drawn in order of size, and the cut of the others makes up
    for what those miss. A source misses its target by half a document, or by less than its
    largest where nearly all of it is big ones.

    Rows are kept as they are, whatever columns they have (one of theirs named ``mix`` is
    replaced). Null texts and empty ones have size 0 by the usual ``size``. Repeated rows and null
    ids of one size share a draw; where the cut falls on it, as many of them are taken as
    needed. Reruns agree but for which of such rows is taken. An empty table stays empty. A third of all rows in one
    source is no hot key: sizes are summed before they are shuffled, the cut is found by narrowing
    ranges, and no text is shuffled. The plan (a row per source, 200 draws in it at most) is
    broadcast if the sources are few, else joined, both sides read from files.
    """
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(source_col), F.col(id_col), F.col("mix"), *map(F.col, identity)), 11)
    sized = docs.withColumn("mix", F.coalesce(size, F.lit(0)).cast("long"))
    slim = materialise(sized.select(F.col(source_col).alias("source"), draw.alias("draw"), F.col("mix").alias("size")), "sizes")
    plan = materialise(source_targets(slim, max_repeat=max_repeat, share=share), "targets")
    few = plan.count() * (1 + int(1 / BIG_SHARE)) <= 10 * BROADCAST_ROWS  # 16 MB of draws
    plan = materialise(_picks(slim, plan, few, seed), "mix-plan")
    told = plan.select(F.col("source").alias("_mix_source"), F.struct(*[c for c in plan.columns if c not in ("source", "weight")]).alias("_mix_plan"))
    joined = sized.withColumn("_mix_draw", draw).join(
        F.broadcast(told) if few else told, F.col(source_col).eqNullSafe(F.col("_mix_source")), "left"
    ).drop("_mix_source")
    own, p = F.col("_mix_draw"), "_mix_plan"
    more = F.when(
        F.col("mix") > F.col(f"{p}.source_size") * BIG_SHARE, F.coalesce(F.array_contains(f"{p}.big_draws", own), F.lit(False))
    ).otherwise(F.coalesce(own < F.col(f"{p}.cut"), F.lit(False)))

    def finish(rows: DataFrame, more: Column) -> DataFrame:
        out = F.struct(
            F.col("mix").alias("size"), f"{p}.source_size", f"{p}.target", f"{p}.rate", (F.floor(f"{p}.rate") + more.cast("long")).cast("long").alias("copies")
        )
        return rows.withColumn("mix", out).drop("_mix_plan", "_mix_draw")

    if not plan.where("some is not null").limit(1).count():
        return finish(joined, more)
    match = F.filter(F.coalesce(F.col(f"{p}.some"), F.array().cast(plan.schema["some"].dataType)), lambda x: x["draw"] == own)
    shared = (F.size(match) > 0) & (F.col("mix") > 0)
    rows = joined.where(shared).withColumn("_mix_some", F.element_at(match, 1))
    names = [c for c in joined.columns]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(source_col).alias("source"), own.alias("draw"), F.col("_mix_some").alias("_some"))
    back = _alike(packed).select(*[F.col("row").getField(c).alias(c) for c in names], "_more")
    return finish(joined.where(~shared), more).unionByName(finish(back, F.col("_more")).drop("_more"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``mix()`` as many times as it is taken, without ``mix``."""
    times = F.when(F.col("mix.copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("mix.copies")))
    return mixed.withColumn("mix", F.explode(times)).drop("mix")
