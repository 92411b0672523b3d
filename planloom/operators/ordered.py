"""Stateful reads of ordered rows, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.sources.scratch import discard, stage


def forward_fill(df: DataFrame, by: list[str], order: list[Column], resets: Column, value: Column) -> DataFrame:
    """``df`` with ``segment`` (counts resets so far) and ``filled``: the last non-null value within the segment."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("segment", F.sum(resets.cast("long")).over(w))
    inner = Window.partitionBy(*by, "segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("filled", F.last(value, ignorenulls=True).over(inner))


def scan_fill(df: DataFrame, by: list[str], order: list[str], resets: Column, value: Column, parts: int | None = None) -> DataFrame:
    """As ``forward_fill``, with no group in one task: staged ``df`` with ``segment`` and ``filled``; ``by`` may be empty, for one log.

    Rows are sorted by ranges of (``by``, ``order``). Each part counts its resets and fills
    on its own; a part's state after its last row is a reset count and the last value
    since the last reset, and such states add up: what a part must add is a running sum
    and a running last over one row for each part and group in it. Equal places in
    ``order`` may go to different parts, so ``order`` should tell rows apart.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select("*", resets.cast("long").alias("_reset"), value.alias("_value")).repartitionByRange(n, *by, *order)
    dealt = stage(dealt.withColumn("_part", F.spark_partition_id()), "scan-parts")
    w = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("_local", F.coalesce(F.sum("_reset").over(w), F.lit(0)))
    inner = Window.partitionBy("_part", *by, "_local").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = stage(local.withColumn("_last", F.last("_value", ignorenulls=True).over(inner)), "scan-local")
    ends = local.groupBy("_part", *by).agg(F.max("_local").alias("_resets"), F.max_by("_last", F.struct("_local", *order)).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part and group
    tells = F.when((F.col("_resets") > 0) | F.col("_end").isNotNull(), F.struct("_end"))
    carried = ends.select("_part", *[F.col(c).alias(f"_by_{c}") for c in by], F.coalesce(F.sum("_resets").over(before), F.lit(0)).alias("_add"), F.last(tells, ignorenulls=True).over(before)["_end"].alias("_carry"))
    same = [local["_part"] == carried["_part"], *[local[c].eqNullSafe(carried[f"_by_{c}"]) for c in by]]
    segment = F.col("_local") + F.col("_add")
    filled = F.coalesce("_last", F.when(F.col("_local") == 0, F.col("_carry")))
    out = stage(local.join(carried, same).select(*[local[c] for c in df.columns], segment.alias("segment"), filled.alias("filled")), "scan-filled")
    discard(dealt), discard(local)
    return out


def last_segment_outcomes(filled: DataFrame, by: list[str], is_outcome: Column, success: Column, order: list[Column]) -> DataFrame:
    """Last outcome of each filled value in the last segment of each group."""
    top = filled.groupBy(*by).agg(F.max("segment").alias("_last"))
    rows = filled.join(top, by).filter((F.col("segment") == F.col("_last")) & is_outcome & F.col("filled").isNotNull())
    return rows.groupBy(*by, "filled").agg(F.max_by(success, F.struct(*order)).alias("success"))


def running_state(df: DataFrame, by: list[str], order: list[Column], spend: Column, limit: int) -> DataFrame:
    """``df`` keys with what was spent so far and whether the limit is passed."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    keys = [*by, *[c for c in df.columns if c not in by][:1]]
    spent = F.sum(spend).over(w)
    return df.select(*keys, spent.alias("spent"), (spent > limit).alias("halted"))
