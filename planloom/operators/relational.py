"""Joins, set operations and constraints over collections of records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.sources.scratch import stage

PART_ROWS = 500_000  # of one group that one task puts in order


def exactly_one(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``left`` with ``status`` (missing, selected, duplicate) and the value of the only match."""
    matches = right.groupBy(key).agg(F.count(F.lit(1)).alias("matches"), F.min(value).alias("_value"))
    n = F.coalesce("matches", F.lit(0))
    return left.join(matches, key, "left").select(
        *left.columns, F.when(n == 0, "missing").when(n > 1, "duplicate").otherwise("selected").alias("status"), F.when(n == 1, F.col("_value")).alias(value))


def paired(left: DataFrame, right: DataFrame, key: str, value: str, strict: bool) -> DataFrame:
    """Values of both sides by key. ``strict``: unequal key sets raise, also a key that repeats."""
    a, b = (df.select(key, F.col(value).cast("int").alias(n)) for df, n in ((left, "left_value"), (right, "right_value")))
    if not strict:
        return a.join(b, key)
    a, b = (df.groupBy(key).agg(F.max(n).alias(n), F.count(F.lit(1)).alias(f"n_{n}")) for df, n in ((a, "left_value"), (b, "right_value")))
    met = a.join(b, key, "full")
    ok = (F.col("n_left_value") == 1) & (F.col("n_right_value") == 1)
    return met.select(key, *[F.when(F.coalesce(ok, F.lit(False)), F.col(c)).otherwise(F.raise_error(F.lit("unpaired or repeated key")).cast("int")).alias(c) for c in ("left_value", "right_value")])


def first_wins(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """First row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``; a repeated key raises when the result is read. Costs one aggregation and no extra job."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"repeated {key}")).cast("boolean")).otherwise(True)).drop("_n")


def both_ways(edges: DataFrame, inverse_share: float = 0.9) -> DataFrame:
    """(``source``, ``relation``, ``target``, ``weight``) and each edge backwards, at a share of its weight; parallel edges stay."""
    back = edges.select(F.col("target").alias("source"), F.concat(F.lit("inverse:"), "relation").alias("relation"), F.col("source").alias("target"), (F.col("weight") * inverse_share).alias("weight"))
    return edges.select("source", "relation", "target", "weight").unionByName(back)


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group with ``rank`` from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def _placed(df: DataFrame, by: list[str], order: list[Column], wanted: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Rows of ``df``, at least those at ``wanted`` (first place, end, size of the group) places, with each row's place ``_i`` from 0 in its group and the group's size ``_n``.

    If a group has more than ``PART_ROWS`` rows, all rows are dealt out by ranges of group
    and order, and a row's place is the one within its range after the ranges before. Only ranges with
    a wanted place are put in order.
    """
    w = Window.partitionBy(*by)
    most, rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (most or 0) <= PART_ROWS:
        return df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    dealt = stage(df.repartitionByRange(-(-rows // PART_ROWS), *by, *order).withColumn("_p", F.spark_partition_id()), "spread-rows")
    ranges = dealt.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_p").alias("_r"), before.alias("_before"), F.sum("_c").over(w).alias("_n"), F.col("_c").alias("_size"))
    ranges = stage(ranges.filter(wanted(F.col("_before"), F.col("_before") + F.col("_size"), F.col("_n"))), "spread-ranges")
    ranges = F.broadcast(ranges) if ranges.count() <= PART_ROWS else ranges
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)], F.col("_p") == F.col("_r"))
    inside = dealt.join(ranges, same).withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order)) - 1 + F.col("_before"))
    return inside.select(*df.columns, "_i", "_n")


def spread_sample(df: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """Evenly spread rows of each group; all where there are no more than ``limit``, or it is not positive.

    Indices are i * (n - 1) / (limit - 1), rounded half to even, once each; a limit of 1
    takes the middle row.
    """
    if limit <= 0:
        chosen = lambda low, end, n: F.lit(True)
    elif limit == 1:
        chosen = lambda low, end, n: (F.floor(n / 2) >= low) & (F.floor(n / 2) < end)
    else:
        # some j of 0..limit-1 rounds to an index from low on and below end
        at = lambda j, n: F.rint(j * ((n - 1) / F.lit(float(limit - 1))))
        chosen = lambda low, end, n: (n <= limit) | F.exists(F.sequence(F.lit(0), F.lit(limit - 1)), lambda j: (at(j, n) >= low) & (at(j, n) < end))
    rows = _placed(df, by, order, chosen)
    keep = chosen(F.col("_i"), F.col("_i") + 1, F.col("_n"))
    return rows.filter(keep).drop("_i", "_n")


def allocate(groups: DataFrame, key: str, n: str, limit: int) -> DataFrame:
    """Proportional seats of strata (``key``, ``n``): at least one each, then trimmed or grown to ``limit``.

    The largest overshoot shrinks first (never below one), the largest deficit grows
    first; ties go to the bigger stratum, then by key. One row per stratum, in windows
    over the strata only.
    """
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.col(n) * F.lit(float(limit)) / F.sum(n).over(everything)
    s = groups.select(key, n, share.alias("share"), F.greatest(F.lit(1), F.floor(share).cast("int")).alias("seats"))
    s = s.withColumn("short", F.lit(limit) - F.sum("seats").over(everything))
    grow = F.row_number().over(Window.orderBy((F.col("share") - F.col("seats")).desc(), F.col(n).desc(), key))
    can = F.when(F.col("seats") > 1, F.col("seats") - F.col("share")).otherwise(F.lit(-1e300))
    shrink = F.row_number().over(Window.orderBy(can.desc(), F.col(n).desc(), key))
    seats = F.col("seats") + F.when(F.col("short") > 0, (grow <= F.col("short")).cast("int")).when(F.col("short") < 0, -((shrink <= -F.col("short")) & (F.col("seats") > 1)).cast("int")).otherwise(0)
    return s.select(key, n, F.least(seats, F.col(n).cast("int")).alias("seats"))


def phase_filter(df: DataFrame, column: str, phase: str, registered: dict[str, list]) -> DataFrame:
    """Rows of the values that belong to ``phase``; a phase that is not registered raises at once."""
    if phase not in registered:
        raise ValueError(f"unknown phase {phase!r}; registered: {', '.join(sorted(registered))}")
    return df.filter(F.col(column).isin(registered[phase]))


def short_list(items: Column, most: int = 8) -> Column:
    """The first ``most`` of an array joined by commas, with ``... (+n)`` for the others."""
    rest = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(rest > 0, F.concat(F.lit(", ... (+"), rest.cast("string"), F.lit(")"))).otherwise(""))
