"""Seeded walks, message passing and bounded paths over labelled edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.sources.scratch import discard, stage


def seeded_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 24, cut_every: int = 3) -> DataFrame:
    """(``node``, ``mass``) after ``rounds`` of personalised PageRank; ``edges`` (source, target, weight), ``seeds`` (node, weight).

    Mass of nodes without outgoing edges returns to the seeds. Each round is a join and a
    sum with map-side partials; every few rounds the masses are staged, which cuts the
    lineage and survives lost executors. Where some nodes have no outgoing edges a round
    reads the masses twice, so there each is staged.
    """
    out = edges.groupBy("source").agg(F.sum("weight").alias("out"))
    hops = stage(edges.join(out, "source").groupBy("source", "target").agg(F.sum(F.col("weight") / F.col("out")).alias("p")), "rank-hops")
    total = seeds.agg(F.sum("weight").alias("total"))
    start = stage(seeds.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one").select("node", (F.col("weight") / F.col("total")).alias("seed")), "rank-seeds")
    nodes = hops.select(F.col("target").alias("node")).unionByName(start.select("node")).distinct()
    sinks = stage(nodes.join(hops.select(F.col("source").alias("node")), "node", "left_anti"), "rank-sinks")
    losing = not sinks.isEmpty()
    mass, old = start.select("node", F.col("seed").alias("mass")), None
    for r in range(1, rounds + 1):
        moved = mass.join(hops, mass["node"] == hops["source"]).select(F.col("target").alias("node"), (damping * F.col("mass") * F.col("p")).alias("mass"))
        back = start.select("node", (F.col("seed") * (1 - damping)).alias("mass"))
        if losing:  # the sum is one number, fetched from the staged masses
            lost = mass.join(sinks, "node", "left_semi").agg(F.coalesce(F.sum("mass"), F.lit(0.0))).first()[0]
            back = start.select("node", (F.col("seed") * (1 - damping + damping * lost)).alias("mass"))
        mass = moved.unionByName(back).groupBy("node").agg(F.sum("mass").alias("mass"))
        if losing or r % cut_every == 0 or r == rounds:
            mass = stage(mass, "rank-mass")
            if old is not None:
                discard(old)
            old = mass
    discard(hops), discard(start), discard(sinks)
    return mass


def pass_messages(vectors: DataFrame, edges: DataFrame, layers: int = 2, own: float = 0.5) -> DataFrame:
    """(``node``, ``dim``, ``x``): each layer averages own and neighbours' values by weight, then normalises.

    Vectors come exploded, so sums are plain aggregations however many neighbours a hub has.
    """
    weight = edges.groupBy(F.col("target").alias("node")).agg(F.sum("weight").alias("w"))
    x = vectors
    for _ in range(layers):
        heard = edges.join(x.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node"), "dim").agg(F.sum(F.col("weight") * F.col("x")).alias("heard"))
        both = x.join(heard, ["node", "dim"], "left").join(weight, "node", "left")
        y = both.select("node", "dim", ((own * F.col("x") + F.coalesce("heard", F.lit(0.0))) / (own + F.coalesce("w", F.lit(0.0)))).alias("x"))
        norm = y.groupBy("node").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        x = y.join(norm, "node").select("node", "dim", F.when(F.col("norm") == 0, F.col("x")).otherwise(F.col("x") / F.col("norm")).alias("x"))
    return x


def hops_within(edges: DataFrame, seeds: DataFrame, limit: int = 3) -> DataFrame:
    """(``seed``, ``node``, ``hops``): fewest hops from each seed, up to ``limit``; a first visit ends a path."""
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hops"))
    front = seen
    for h in range(1, limit + 1):
        nxt = front.join(edges.select(F.col("source").alias("node"), "target"), "node").select("seed", F.col("target").alias("node")).distinct()
        front = stage(nxt.join(seen, ["seed", "node"], "left_anti").withColumn("hops", F.lit(h)), "hops-front")
        seen = seen.unionByName(front)
    return seen
