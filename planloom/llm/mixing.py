"""Operator 8: mix sources to target weights by nested hash-threshold histograms.

Every document has a 60-bit hash of its id. Words are summed by source and hash
bucket; the bucket in which a source's budget runs out is the only one that is cut
finer, twice; a document is then taken when its hash lies below its source's
threshold. Nothing is sorted but the histograms, whose size is fixed per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.columns import table, without, word_count
from planloom.sources.scratch import discard, stage

BITS = 10  # of the hash, per level of the histograms
LEVELS = 3
HASH_BITS = 60


def id_hash(id_col):
    """First 60 bits of SHA-256 over the id as text; a null id counts as an empty text."""
    return F.conv(F.substring(F.sha2(F.coalesce(id_col.cast("string"), F.lit("")), 256), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Word targets of sources (``skey``, ``source``, ``source_size``), weighed by turns in code-point order.

    ``share`` of all words is dealt by weight; a source stops at ``cap`` times its own
    words and the excess goes to the others. The level at which that settles follows
    from one pass over the sources in order of cap per weight: a source is capped
    exactly if the level left by those before it reaches its own cap.
    The two windows run over one row per source, never over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("*", weight.alias("weight"), (F.lit(cap) * F.col("source_size")).alias("most"))
    by_ratio = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select(
        "*",
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("most_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
        (F.lit(share) * F.sum("source_size").over(all_rows)).alias("budget"),
        F.sum("weight").over(all_rows).alias("weight_all"),
    )
    level = (F.col("budget") - F.col("most_before")) / (F.col("weight_all") - F.col("weight_before"))
    s = s.select("*", (level >= F.col("most") / F.col("weight")).alias("capped"))
    spent = F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(all_rows)
    gone = F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0.0)).over(all_rows)
    s = s.select("*", F.try_divide(F.col("budget") - spent, F.col("weight_all") - gone).alias("level"))
    return s.select(
        "skey", "source_size",
        F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * F.col("level")).alias("target"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (words taken, repeats counted).

    A source whose target exceeds its words is taken whole, and again up to the rest.
    The document at the boundary is taken if that brings the source nearer to its target.
    Null texts have size 0; null sources are one source, the last; rows with equal ids
    are taken or left together; an empty table gives an empty result; input columns
    named like an output are replaced.
    """
    kept = without(docs, ["size", "source_size", "target", "taken", "_skey", "_hash"])
    sized = kept.select(
        *[F.col(f"`{c}`") for c in kept.columns],
        word_count(F.col(text_col)).alias("size"),
        F.concat(F.when(F.col(source_col).isNull(), "1").otherwise("0"), F.coalesce(F.col(source_col), F.lit(""))).alias("_skey"),
        id_hash(F.col(id_col)).alias("_hash"),
    )
    sums = stage(sized.select(F.col("_skey").alias("skey"), F.col("_hash").alias("hash"), "size"), "mix-sizes")
    sizes = sums.groupBy("skey").agg(F.sum("size").alias("source_size"))
    sizes = sizes.withColumn("source", F.when(F.col("skey").startswith("0"), F.substring("skey", 2, 1 << 30)))
    targets = stage(source_targets(sizes, weights, share, cap), "mix-targets")
    whole = (F.col("target") >= F.col("source_size")).cast("long")
    edge = targets.select("skey", "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix"))
    spent_tables = []
    for depth in range(1, LEVELS + 1):
        cut = HASH_BITS - BITS * depth
        rows = sums.join(edge.select("skey", "prefix", "left"), "skey").filter(F.shiftright("hash", cut + BITS) == F.col("prefix"))
        hist = rows.groupBy("skey", "left", F.shiftright("hash", cut).alias("bucket")).agg(F.sum("size").alias("words"))
        w = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.select("*", F.sum("words").over(w).alias("up_to"))
        first = F.struct("bucket", "words", "up_to")
        found = (hist.filter(F.col("up_to") > F.col("left")).groupBy("skey").agg(F.min(first).alias("at"))
                 .select("skey", F.col("at.bucket").alias("bucket"), F.col("at.words").alias("words"), F.col("at.up_to").alias("up_to")))
        met = edge.join(found, "skey", "left")
        before = F.col("up_to") - F.col("words")
        # no bucket runs out: everything below the next prefix is within the budget
        nxt = F.coalesce(F.col("bucket"), F.shiftleft(F.col("prefix") + 1, BITS))
        left = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(F.col("left") - before)
        if depth == LEVELS:
            nearer = (F.col("up_to") - F.col("left")) < (F.col("left") - before)
            nxt = nxt + F.coalesce(nearer.cast("long"), F.lit(0))
        edge = stage(met.select("skey", "source_size", "target", "whole", left.alias("left"), nxt.alias("prefix")), "mix-edge")
        spent_tables.append(edge)
    threshold = edge.select(F.col("skey").alias("_skey"), "source_size", "target", "whole", F.col("prefix").alias("_below"))
    taken = F.col("size") * (F.col("whole") + (F.shiftright("_hash", HASH_BITS - BITS * LEVELS) < F.col("_below")).cast("long"))
    out = sized.join(threshold, "_skey", "left").select(
        *[F.col(f"`{c}`") for c in kept.columns], "size", "source_size", "target", taken.alias("taken"))
    for old in [sums, targets, *spent_tables[:-1]]:
        discard(old)
    return out


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The nested histograms pick the same prefix of 30-bit buckets as one running sum over all of them.
OP8_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast('0x' || substr(sha256(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) >> 30 as h
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, 2.0::double * source_size as most,
             cast([5, 2, 1][((row_number() over (order by source nulls last)) - 1) % 3 + 1] as double) as weight from s),
r as (select *, coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as most_before,
             coalesce(sum(weight) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as weight_before,
             1.5::double * sum(source_size) over () as budget, sum(weight) over () as weight_all from w),
c as (select *, (budget - most_before) / (weight_all - weight_before) >= most / weight as capped from r),
l as (select *, (budget - sum(case when capped then most else 0 end) over ()) / nullif(weight_all - sum(case when capped then weight else 0 end) over (), 0) as lvl from c),
t as (select source, source_size, case when capped then most else weight * lvl end as target from l),
b as (select source, source_size, target, case when target >= source_size then 1 else 0 end as whole,
             target - case when target >= source_size then source_size else 0 end as budget_left from t),
g as (select source, h, sum(size) as words from d group by source, h),
u as (select *, sum(words) over (partition by source order by h rows between unbounded preceding and current row) as up_to from g),
e as (select u.source, min(h) as h from u join b on u.source is not distinct from b.source where up_to > budget_left group by u.source),
n as (select b.*, coalesce(e.h + case when u.up_to - b.budget_left < b.budget_left - (u.up_to - u.words) then 1 else 0 end, 1 << 30) as below
      from b left join e on b.source is not distinct from e.source
      left join u on u.source is not distinct from e.source and u.h = e.h)
select d.doc_id, d.size, n.source_size, n.target, cast(d.size * (n.whole + case when d.h < n.below then 1 else 0 end) as bigint) as taken
from d join n on d.source is not distinct from n.source
"""
