"""Bootstrap intervals from counter-based draws: column expressions that any engine can repeat.

A draw is a function of two counters (a sample and a row, or a sample and a place), so
nothing is seeded by partition, reruns agree, and a lost task repeats its own draws.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
MIXES = ((69_621, 7), (16_807, 11), (39_373, 13))
#: A Poisson(1) count is how many of these a draw reaches.
STEPS = [int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(n + 1))) for n in range(11)]


def drawn(a: Column, b: Column) -> Column:
    """A number from 0 to PRIME - 1 for two counters; every product stays within 64 bits."""
    x = (F.pmod(a, F.lit(PRIME)) * 48_271 + F.pmod(b, F.lit(PRIME)) * 40_692 + 12_345) % PRIME
    for add, more in MIXES:
        x = (x * (x + add) + more) % PRIME
    return x


def drawn_sql(a: str, b: str, out: str) -> str:
    """Select items of SQL for ``drawn``: the steps, then the number as ``out``."""
    steps = [f"((({a} % {PRIME} + {PRIME}) % {PRIME}) * 48271 + (({b} % {PRIME} + {PRIME}) % {PRIME}) * 40692 + 12345) % {PRIME} as {out}_0"]
    steps += [f"({out}_{i} * ({out}_{i} + {add}) + {more}) % {PRIME} as {out}{'' if i + 1 == len(MIXES) else f'_{i + 1}'}" for i, (add, more) in enumerate(MIXES)]
    return ", ".join(steps)


def _samples(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("b")


def _bounds(column: str) -> list[Column]:
    """Interpolated percentiles of one number a sample."""
    ci = F.percentile(column, F.array(F.lit(0.025), F.lit(0.975)))
    return [ci[0].alias(f"{column}_low"), ci[1].alias(f"{column}_high")]


def paired_bounds(diff: DataFrame, by: str, key: str, samples: int = 2_000) -> DataFrame:
    """(``by``, ``uplift``, ``low``, ``high``) of (by, key, ``x``): mean difference and its percentile interval.

    Each row is drawn a Poisson(1) number of times in each sample, by its key (rows of one
    key together), so sums are made where the rows are and only a sum a sample is
    shuffled. Null differences are left out; a sample without rows has the mean 0.
    """
    diff = diff.filter("x is not null").select(by, F.col(key).cast("long").alias("key"), F.col("x").cast("double").alias("x"))
    u = drawn(F.col("b"), F.col("key"))
    times = diff.select(by, "x", _samples(samples), "key").select(by, "b", "x", u.alias("u"))
    w = sum((F.when(F.col("u") >= s, 1).otherwise(0) for s in STEPS[1:]), F.when(F.col("u") >= STEPS[0], 1).otherwise(0))
    means = times.select(by, "b", "x", w.alias("w")).groupBy(by, "b").agg((F.sum(F.col("w") * F.col("x")) / F.greatest(F.sum("w"), F.lit(1))).alias("m"))
    bounds = means.groupBy(by).agg(*_bounds("m"))
    point = diff.groupBy(F.col(by).alias("_by")).agg(F.avg("x").alias("uplift"))
    return point.join(bounds, point["_by"].eqNullSafe(bounds[by])).select(F.col("_by").alias(by), "uplift", F.col("m_low").alias("low"), F.col("m_high").alias("high"))


def paired_bounds_sql(rows: str, by: str, key: str, samples: int = 2_000) -> str:
    """The same over the SQL relation ``rows`` of (by, key, x)."""
    times = " + ".join(f"(u >= {s})::int" for s in STEPS)
    return f"""select {by}, uplift, low, high from (select {by}, avg(x) as uplift from {rows} where x is not null group by 1) p join (
  select {by}, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from (
    select {by}, b, sum(w * x) / greatest(sum(w), 1) as m from (select {by}, b, x, {times} as w from (select {by}, b, x, {drawn_sql('b', key, 'u')} from {rows}, (select range as b from range({samples})) where x is not null)) group by 1, 2) group by 1) c using ({by})"""


def cluster_bounds(families: DataFrame, by: str, family: str, samples: int = 10_000) -> DataFrame:
    """(``by``, ``uplift``, ``low``, ``high``, ``family_uplift``, ``family_low``, ``family_high``) of (by, family, ``total``, ``n``).

    Whole families are drawn with replacement, as many as there are, and both estimands
    are made of each sample: the mean over rows and the mean of the families' means. The
    i-th draw of a sample is the same for every ``by``; it is made by the i-th family, so
    draws are as spread as the families are, and sums are partial before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(by).orderBy(family)) - 1
    own = families.select(by, place.cast("long").alias("i"), F.count(F.lit(1)).over(Window.partitionBy(by)).alias("k"), F.col("total").cast("double").alias("total"), F.col("n").cast("double").alias("n"))
    picks = own.select(by, "i", "k", _samples(samples)).select(by, "b", F.call_function("div", drawn(F.col("b"), F.col("i")) * F.col("k"), F.lit(PRIME)).alias("i"))
    drawn_families = picks.join(own.select(by, "i", "total", "n"), [by, "i"])
    sums = drawn_families.groupBy(by, "b").agg((F.sum("total") / F.sum("n")).alias("task"), F.avg(F.col("total") / F.col("n")).alias("mean"))
    bounds = sums.groupBy(by).agg(*_bounds("task"), *_bounds("mean"))
    point = own.groupBy(by).agg((F.sum("total") / F.sum("n")).alias("uplift"), F.avg(F.col("total") / F.col("n")).alias("family_uplift"))
    return point.join(bounds, by).select(by, "uplift", F.col("task_low").alias("low"), F.col("task_high").alias("high"), "family_uplift", F.col("mean_low").alias("family_low"), F.col("mean_high").alias("family_high"))


def cluster_bounds_sql(families: str, by: str, family: str, samples: int = 10_000) -> str:
    """The same over the SQL relation ``families`` of (by, family, total, n)."""
    own = f"(select {by}, row_number() over (partition by {by} order by {family}) - 1 as i, count(*) over (partition by {by}) as k, total::double as total, n::double as n from {families})"
    return f"""select {by}, uplift, low, high, family_uplift, family_low, family_high from (
  select {by}, sum(total) / sum(n) as uplift, avg(total / n) as family_uplift from {own} group by 1) p join (
  select {by}, quantile_cont(task, 0.025) as low, quantile_cont(task, 0.975) as high, quantile_cont(mean, 0.025) as family_low, quantile_cont(mean, 0.975) as family_high from (
    select {by}, b, sum(total) / sum(n) as task, avg(total / n) as mean from (
      select {by}, b, u * k // {PRIME} as i from (select {by}, b, k, {drawn_sql('b', 'i', 'u')} from {own}, (select range as b from range({samples})))) join {own} using ({by}, i) group by 1, 2) group by 1) c using ({by})"""
