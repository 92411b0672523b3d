"""Knowledge-graph queries: foreign keys and labels as labelled edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom.operators.graph import hops_within, pass_messages, seeded_rank
from planloom.operators.relational import both_ways
from planloom.plans.register import query, table


def key_edges(spark, d):
    """Foreign keys as weighted edges between prefix-typed nodes."""
    n = table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("source"), F.lit("in_region").alias("relation"), F.concat(F.lit("region:"), "n_regionkey").alias("target"), F.lit(1.0).alias("weight"))
    c = table(spark, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("source"), F.lit("lives_in").alias("relation"), F.concat(F.lit("nation:"), "c_nationkey").alias("target"), F.lit(0.5).alias("weight"))
    return n.unionByName(c)


EDGES_SQL = """e as (select 'nation:' || n_nationkey as source, 'in_region' as relation, 'region:' || n_regionkey as target, 1.0::double as weight from nation
  union all select 'customer:' || c_custkey, 'lives_in', 'nation:' || c_nationkey, 0.5::double from customer),
b as (select source, target, weight from e union all select target, source, 0.9::double * weight from e)"""


@query("edge_profile", f"with {EDGES_SQL} select relation, count(*) as n, count(distinct target) as targets from e group by 1")
def edge_profile(spark, d):
    return key_edges(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target").alias("targets"))


def _rank_sql(rounds: int) -> str:
    steps = ["m0 as (select 'region:0' as node, 0.75::double as mass union all select 'nation:1', 0.25::double)"]
    for i in range(1, rounds + 1):
        # every node of the doubled graph has outgoing edges, so no mass is lost
        steps.append(f"""m{i} as (select node, sum(mass) as mass from (select h.target as node, 0.85::double * sum(mass * p) as mass from m{i - 1} join h on node = h.source group by 1
          union all select node, 0.15::double * mass from m0) group by node)""")
    return f"with {EDGES_SQL}, o as (select source, sum(weight) as w from b group by 1), h as materialized (select b.source, b.target, sum(weight / w) as p from b join o on b.source = o.source group by 1, 2), " + ", ".join(
        s.replace(" as (select", " as materialized (select", 1) for s in steps) + f" select node, round(mass, 9) as mass from m{rounds}"


@query("pagerank_seeded", _rank_sql(24))
def pagerank_seeded(spark, d):
    seeds = spark.createDataFrame([("region:0", 3.0), ("nation:1", 1.0)], "node string, weight double")
    return seeded_rank(both_ways(key_edges(spark, d)).select("source", "target", "weight"), seeds).withColumn("mass", F.round("mass", 9))


@query("message_passing", """
with v as (select vec_id as node, label, unnest(range(64)) as dim, unnest(embedding::double[]) as x from embeddings),
n as (select vec_id as node, lag(vec_id) over (partition by label order by vec_id) as prev from embeddings),
e as (select prev as source, node as target, 1.0::double as weight from n where prev is not null union all select node, prev, 0.9::double from n where prev is not null),
w as (select target as node, sum(weight) as w from e group by 1),
h1 as (select e.target as node, dim, sum(weight * x) as heard from e join v on v.node = e.source group by 1, 2),
y1 as (select v.node, v.dim, (0.5::double * x + coalesce(heard, 0)) / (0.5::double + coalesce(w, 0)) as x from v left join h1 on v.node = h1.node and v.dim = h1.dim left join w on v.node = w.node),
x1 as (select node, dim, x / sqrt(sum(x * x) over (partition by node)) as x from y1),
h2 as (select e.target as node, dim, sum(weight * x) as heard from e join x1 on x1.node = e.source group by 1, 2),
y2 as (select v.node, v.dim, (0.5::double * v.x + coalesce(heard, 0)) / (0.5::double + coalesce(w, 0)) as x from x1 v left join h2 on v.node = h2.node and v.dim = h2.dim left join w on v.node = w.node)
select node, cast(dim as integer) as dim, round(x / sqrt(sum(x * x) over (partition by node)), 6) as x from y2""")
def message_passing(spark, d):
    from pyspark.sql import Window

    emb = table(spark, d, "embeddings")
    v = emb.select(F.col("vec_id").alias("node"), F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("dim", "x"))
    prev = emb.select("vec_id", F.lag("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("prev")).filter("prev is not null")
    e = prev.select(F.col("prev").alias("source"), F.col("vec_id").alias("target"), F.lit(1.0).alias("weight")).unionByName(prev.select(F.col("vec_id").alias("source"), F.col("prev").alias("target"), F.lit(0.9).alias("weight")))
    return pass_messages(v, e).withColumn("x", F.round("x", 6))


@query("bounded_paths", f"""
with recursive {EDGES_SQL}, s(seed) as (values ('region:0'), ('nation:3')),
p as (select seed, seed as node, 0 as hops from s union select p.seed, b.target, p.hops + 1 from p join b on b.source = p.node where p.hops < 3)
select seed, node, min(hops) as hops from p group by 1, 2""")
def bounded_paths(spark, d):
    seeds = spark.createDataFrame([("region:0",), ("nation:3",)], "node string")
    return hops_within(both_ways(key_edges(spark, d)).select("source", "target"), seeds)
