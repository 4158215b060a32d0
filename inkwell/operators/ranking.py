"""Order statistics over values of any number: prefix sums over ranges, never a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.sources import store


def same(a: str, b: str, cols: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols])


def running(values: DataFrame, groups: list[str], order: str, sums: list[str]) -> DataFrame:
    """``values`` (one row a group and ``order``) with ``<c>_before``, the sum of ``c`` over smaller
    rows of the group, and ``<c>_total``, for each of ``sums``.

    Rows are cut into ranges, which are written: a range's number must not change afterwards. Only
    the sums of ranges are summed in order; within a range, each task sums its own. A null
    ``order`` comes first.
    """
    cut = store.materialise(values.repartitionByRange(*groups, order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy(*groups)
    upto = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(*groups, "_part").agg(*[F.sum(c).alias(c) for c in sums])
    parts = parts.select(
        *groups, "_part", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"_o_{c}") for c in sums], *[F.sum(c).over(own).alias(f"{c}_total") for c in sums]
    )
    inside = Window.partitionBy(*groups, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{c}") for c in sums])
    joined = local.alias("v").join(parts.alias("p"), same("v", "p", [*groups, "_part"]))
    return joined.select(
        *[F.col(f"v.{c}").alias(c) for c in values.columns], *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"{c}_before") for c in sums], *[F.col(f"{c}_total") for c in sums]
    )


def counted(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Each non-null value of a group once, with ``n``, ``n_before`` and ``n_total``."""
    v = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    return running(v, groups, value, ["n"])


def at(index: Column, value: str, n: str = "n") -> Column:
    """The aggregate that picks the value at 0-based ``index`` of a ``running`` frame's group."""
    return F.max(F.when((F.col(f"{n}_before") <= index) & (index < F.col(f"{n}_before") + F.col(n)), F.col(value)))


def interpolated(q: float, value: str, n: str = "n") -> Column:
    """The aggregate for the q quantile, linear between neighbours; null without values."""
    place = (F.col(f"{n}_total") - 1) * F.lit(float(q))
    low, high = at(F.floor(place), value, n), at(F.ceil(place), value, n)
    return low + (high - low) * F.max(place - F.floor(place))


def with_average_rank(rows: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with the 1-based rank of ``value`` in its group, ties sharing their mean; null stays null."""
    ranks = counted(rows, groups, value).select(*groups, value, (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(out))
    joined = rows.alias("r").join(ranks.alias("k"), same("r", "k", [*groups, value]), "left")
    return joined.select(*[F.col(f"r.{c}").alias(c) for c in rows.columns if c != out], F.col(f"k.{out}").alias(out))
