"""Column expressions over numbers, vectors, sets and hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def ratio(top: Column, bottom: Column) -> Column:
    """Null where the denominator is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def ratio0(top: Column, bottom: Column) -> Column:
    """0.0 where the denominator is zero."""
    return F.coalesce(ratio(top, bottom), F.lit(0.0))


def wilson(hits: Column, n: Column, z: float = Z95) -> Column:
    """Score interval of a rate as ``struct<low, high>``, within [0, 1]; (0, 0) for no trials."""
    p, zz = ratio0(hits, n), z * z
    nn = F.greatest(n.cast("double"), F.lit(1.0))
    mid, scale = (p + zz / (2 * nn)), 1 + zz / nn
    half = z * F.sqrt(p * (1 - p) / nn + zz / (4 * nn * nn))
    snap = lambda x: F.when(F.abs(x) < 1e-15, 0.0).when(F.abs(x - 1) < 1e-15, 1.0).otherwise(x)
    low, high = snap(F.greatest(F.lit(0.0), (mid - half) / scale)), snap(F.least(F.lit(1.0), (mid + half) / scale))
    return F.struct(F.when(n > 0, low).otherwise(0.0).alias("low"), F.when(n > 0, high).otherwise(0.0).alias("high"))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts: doubled binomial tail, at most 1; 1 without discordance.

    The tail is summed in logarithms, so it holds for any counts.
    """
    d, least = (b + c).cast("double"), F.least(b, c).cast("int")
    lgamma = lambda x: F.when(x < 15, F.log(F.factorial(x.cast("int")).cast("double"))).otherwise(_stirling(x))
    term = lambda i: F.exp(lgamma(d) - lgamma(i.cast("double")) - lgamma(d - i) - d * F.log(F.lit(2.0)))
    tail = F.aggregate(F.sequence(F.lit(0), least), F.lit(0.0), lambda acc, i: acc + term(i))
    return F.when(d == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def _stirling(x: Column) -> Column:
    """log(x!) for x of 15 and more, to double precision."""
    y = x + 1
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0.0 where both are empty."""
    return ratio0(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    """0.0 on empty vectors or unequal lengths."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, also where lambdas inside ``body`` use it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(v: Column) -> Column:
    """L2-normalised; the zero vector stays."""
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    return let(v, lambda x: let(norm(x), lambda n: F.when(n == 0, x).otherwise(F.transform(x, lambda y: y / n))))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def hash_int(text: Column, digits: int = 8, sha: str = "sha1") -> Column:
    """Leading hex digits of a digest as a number."""
    digest = F.sha1(text) if sha == "sha1" else F.sha2(text, 256)
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def split_of(dataset: Column, key: Column, train_share: float) -> Column:
    """Deterministic ``train`` or ``eval`` from a digest of dataset and key."""
    if train_share <= 0 or train_share >= 1:
        return F.lit("eval" if train_share <= 0 else "train")
    bucket = hash_int(F.concat_ws(":", dataset, key)) % 10000
    return F.when(bucket < int(train_share * 10000), "train").otherwise("eval")


def difficulty(plan_length: Column, goals: Column, objects: Column) -> Column:
    """``easy``, ``medium`` or ``hard`` by three bounds each."""
    return (F.when((plan_length <= 4) & (goals <= 2) & (objects <= 8), "easy")
            .when((plan_length <= 12) & (goals <= 6) & (objects <= 20), "medium").otherwise("hard"))


def or_unknown(x: Column) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("unknown"))


def goal_share(goals: Column, state: Column) -> Column:
    """Share of goals that hold; ``not(f)`` holds if f is absent or the negation is stored; 1.0 without goals."""
    bare = lambda g: F.regexp_replace(g, r"^not\((.*)\)$", "$1")
    holds = lambda g: F.when(g.startswith("not("), ~F.array_contains(state, bare(g)) | F.array_contains(state, g)).otherwise(F.array_contains(state, g))
    return F.when(F.size(goals) == 0, 1.0).otherwise(F.size(F.filter(goals, holds)).cast("double") / F.size(goals))


def apply_effects(state: Column, add: Column, delete: Column) -> Column:
    """State without what is deleted, with what is added, distinct and sorted."""
    return F.array_sort(F.array_union(F.array_except(state, delete), add))


def missing_facts(required: Column, state: Column) -> Column:
    return F.filter(required, lambda f: ~F.array_contains(state, f))
