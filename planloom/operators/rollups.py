"""Outcome roll-ups: rates with intervals, strata, merged maps, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.numeric import ratio, ratio0, wilson


def outcome_rates(df: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """``n`` and, per boolean flag, its rate and Wilson bounds; rates are 0.0 on empty groups."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f).cast("long")).alias(f"_{f}") for f in flags])
    for f in flags:
        ci = wilson(F.col(f"_{f}"), F.col("n"))
        g = g.withColumns({f"{f}_rate": ratio0(F.col(f"_{f}"), F.col("n")), f"{f}_low": ci["low"], f"{f}_high": ci["high"]}).drop(f"_{f}")
    return g


def recovery(df: DataFrame, by: list[str], first_ok: Column, final_ok: Column) -> DataFrame:
    """Initial failures, those recovered, and their share: null where nothing failed at first."""
    g = df.groupBy(*by).agg(F.sum((~first_ok).cast("long")).alias("initial_failures"), F.sum((~first_ok & final_ok).cast("long")).alias("recovered"))
    return g.withColumn("conditional_recovery", ratio(F.col("recovered"), F.col("initial_failures")))


def strata(df: DataFrame, fields: list[str], method: str, aggs: list[Column]) -> DataFrame:
    """One aggregate per (field value, method), for each field on its own, in one pass of grouping sets."""
    sets = [[F.col(f), F.col(method)] for f in fields]
    g = df.groupingSets(sets, *[F.col(f) for f in fields], F.col(method)).agg(F.grouping_id().alias("_g"), *aggs)
    width = len(fields)  # the method is grouped in every set: its bit is 0
    which = F.coalesce(*[F.when(F.expr(f"(_g >> {width - i}) & 1 = 0"), F.lit(f)) for i, f in enumerate(fields)])
    value = F.coalesce(*[F.when(F.expr(f"(_g >> {width - i}) & 1 = 0"), F.coalesce(F.col(f).cast("string"), F.lit("unknown"))) for i, f in enumerate(fields)])
    return g.select(which.alias("field"), value.alias("value"), F.col(method), *[c for c in g.columns if c not in (*fields, method, "_g")])


def merge_maps(df: DataFrame, by: list[str], counts: str) -> DataFrame:
    """Sums of a map column's values by key, as a map in key order."""
    pairs = df.select(*by, F.explode(counts).alias("k", "v")).groupBy(*by, "k").agg(F.sum("v").alias("v"))
    return pairs.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(counts))


def costs(calls: DataFrame, by: list[str], price_in: Column, price_out: Column) -> DataFrame:
    """Tokens and cost of calls (``tokens_in``, ``tokens_out``); the cost is null unless every call has prices."""
    cost = (F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6
    g = calls.withColumn("_cost", cost).groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.bool_and(F.col("_cost").isNotNull()).alias("_priced"), F.sum("_cost").alias("_sum"))
    return g.select(*by, "calls", "tokens_in", "tokens_out", F.when(F.col("_priced"), F.col("_sum")).alias("cost"), F.when(F.col("_priced"), "estimated").otherwise("pricing_not_configured").alias("status"))
