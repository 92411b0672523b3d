"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.sources.scratch import discard, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(``a``, ``b``) to (``node``, ``comp``): the smallest node reachable, for every node on an edge.

    Each round hangs neighbours onto the smallest one seen; it ends when a round changes
    nothing. Minima are pre-aggregated per task and the joins are plain equi-joins, so a
    node with very many edges is split by adaptive execution rather than gathered.
    """
    cur = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "comp-edges")
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stage(large, "comp-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(low, "a")
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        nxt = stage(small, "comp-small")
        changed = nxt.exceptAll(cur).limit(1).count() + cur.exceptAll(nxt).limit(1).count()
        discard(large)
        if not changed:
            break
        discard(cur)
        cur = nxt
    out = cur.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    out = stage(out.unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()), "comp-nodes")
    discard(cur)
    discard(nxt)
    return out
