"""Retrieval over the driver's tables: benchmark items and parts ask, documents and parts answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom.functions.numeric import clamp01, jaccard, unit
from planloom.functions.text import tokens
from planloom.operators.relational import ranked
from planloom.operators.retrieval import bm25_topk, jaccard_scores, jaccard_topk
from planloom.operators.search import field_topk, unscored, vector_topk
from planloom.plans.register import query, table

TOK = "regexp_extract_all(lower(text), '[a-z0-9_]+')"


def bags(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), tokens(F.col("text")).alias("tokens"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), tokens(F.col("text")).alias("tokens"))
    return q, docs


@query("jaccard_topk", f"""
with q as (select item_id as q, list_distinct({TOK}) as t from benchmark), d as (select doc_id as doc, list_distinct({TOK}) as t from documents),
qt as (select q, len(t) as nq, unnest(t) as term from q), dt as (select doc, len(t) as nd, unnest(t) as term from d),
m as (select q, doc, count(*)::double / (any_value(nq) + any_value(nd) - count(*)) as score from qt join dt using (term) group by 1, 2)
select q, cast(rank as integer) as rank, doc, round(score, 9) as score from (select *, row_number() over (partition by q order by round(score, 9) desc, doc) as rank from m) where rank <= 3""")
def jaccard_topk_query(spark, d):
    return jaccard_topk(*bags(spark, d), 3).select("q", "rank", "doc", F.round("score", 9).alias("score"))


@query("bm25_topk", f"""
with q as (select item_id as q, unnest(list_distinct({TOK})) as term from benchmark), d as (select doc_id as doc, {TOK} as t from documents),
tf as (select doc, term, count(*) as tf from (select doc, unnest(t) as term from d) group by 1, 2), df as (select term, count(*) as df from tf group by 1),
n as (select count(*) as n, avg(len(t)) as mean from d), l as (select doc, len(t) as len from d),
s as (select q, doc, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * len / mean))) as s from q join df using (term) join tf using (term) join l using (doc), n group by 1, 2),
r as (select q, doc, round(s / (s + 1), 6) as score from s)
select q, cast(rank as integer) as rank, doc, score from (select *, row_number() over (partition by q order by score desc, doc) as rank from r) where rank <= 3""")
def bm25_topk_query(spark, d):
    return bm25_topk(*bags(spark, d), 3).select("q", "rank", "doc", "score")


def _with_unscored(found, queries, docs, scored, within, k):
    """The ``k`` best rows of each query of ``found``, then pairs without a score."""
    none = unscored(queries, docs, scored, k, within).withColumn("score", F.lit(None).cast("double"))
    return ranked(found.unionByName(none), ["q"], [F.col("score").desc_nulls_last(), F.col("doc")], k)


def _first_k(queries, docs, texts, equals, scored, within, k, scale):
    """``field_topk`` over the rows that have a score, then pairs without one."""
    found = field_topk(queries.filter(scored), docs.filter(scored), texts, equals, k, scale, within).select("q", "doc", "score")
    return _with_unscored(found, queries, docs, scored, within, k)


@query("structured_topk", """
with p as (select p_partkey, p_brand, p_size, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9_]+')) as n, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9_]+')) as t from part),
s as (select a.p_partkey as q, b.p_partkey as doc, round((0.4::double * len(list_intersect(a.n, b.n)) / len(list_distinct(list_concat(a.n, b.n))) + 0.3::double * len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) + 0.2::double * (a.p_size = b.p_size)::int) / 0.9::double, 6) as score
      from p a join p b on a.p_brand = b.p_brand and a.p_partkey <> b.p_partkey where a.p_partkey % 50 = 0)
select q, cast(rank as integer) as rank, doc, score from (select *, row_number() over (partition by q order by score desc, doc) as rank from s) where rank <= 3""")
def structured_topk(spark, d):
    """Weighted overlap by field, over parts of the query's brand, without the query itself. Queries: keys divisible by 50."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.lit(0).alias("part"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), tokens(F.col("p_name")).alias("n"), tokens(F.col("p_type")).alias("t"))
    return _first_k(p.filter("id % 50 = 0"), p, {"n": 0.4, "t": 0.3}, {"size": 0.2}, F.col("size").isNotNull(), ["brand"], 3, 0.9)


@query("memory_topk", """
with m as (select conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) as t from conversations where text is not null),
s as (select a.conv_id as q, b.conv_id as doc, round(coalesce(len(list_intersect(a.t, b.t))::double / nullif(len(list_distinct(list_concat(a.t, b.t))), 0), 0) + (a.role = b.role)::int + 0.25::double * (a.conv_id % 5 = b.conv_id % 5)::int, 6) as score
      from m a join m b on a.turn = b.turn and a.conv_id <> b.conv_id where a.turn = 0 and a.conv_id % 10 = 0)
select q, doc, score from (select *, row_number() over (partition by q order by score desc, doc) as rank from s) where rank = 1""")
def memory_topk(spark, d):
    m = table(spark, d, "conversations").filter("text is not null and turn = 0").select(F.col("conv_id").cast("long").alias("id"), F.lit(0).alias("part"), F.lit(0).alias("turn"), "role", (F.col("conv_id") % 5).alias("family"), tokens(F.col("text")).alias("t"))
    return _first_k(m.filter("id % 10 = 0"), m, {"t": 1.0}, {"role": 1.0, "family": 0.25}, F.col("role").isNotNull(), ["turn"], 1, 1.0).select("q", "doc", "score")


@query("cosine_topk", """
with v as (select vec_id, embedding::double[] as e from embeddings),
s as (select a.vec_id as q, b.vec_id as doc, round(list_dot_product(a.e, b.e) / nullif(sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)), 0), 6) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
select q, cast(rank as integer) as rank, doc, score from (select *, row_number() over (partition by q order by score desc, doc) as rank from s) where rank <= 3""")
def cosine_topk(spark, d):
    """As ``cosine_topk_all``; pairs in which a vector has no direction have no score and come last."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.lit(0).cast("long").alias("part"), unit(F.transform("embedding", lambda x: x.cast("double"))).alias("e"))
    directed = F.col("e").isNotNull() & F.exists("e", lambda x: x != 0)
    good = v.filter(directed & ~F.exists("e", lambda x: x.isNull() | F.isnan(x)))
    found = vector_topk(good.filter("id % 20 = 0"), good, 3).select("q", "doc", "score")
    return _with_unscored(found, v.filter("id % 20 = 0"), v, directed, [], 3)


_P_TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]+'))"
_JAC = "coalesce(len(list_intersect(a.{0}, b.{0}))::double / nullif(len(list_distinct(list_concat(a.{0}, b.{0}))), 0), 0)"


@query("structured_topk_all", f"""
with p as (select p_partkey, p_size, {_P_TOK.format('p_name')} as n, {_P_TOK.format('p_type')} as t from part),
s as (select a.p_partkey as q, b.p_partkey as doc, round((0.4::double * {_JAC.format('n')} + 0.3::double * {_JAC.format('t')} + 0.2::double * (a.p_size = b.p_size)::int) / 0.9::double, 6) as score from p a join p b on a.p_partkey <> b.p_partkey where a.p_partkey % 20 = 0)
select q, cast(rank as integer) as rank, doc, score from (select *, row_number() over (partition by q order by score desc, doc) as rank from s) where rank <= 3""")
def structured_topk_all(spark, d):
    """As ``structured_topk``, against parts of every brand. Queries: keys divisible by 20."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(0).alias("part"), F.col("p_size").alias("size"), tokens(F.col("p_name")).alias("n"), tokens(F.col("p_type")).alias("t"))
    return field_topk(p.filter("id % 20 = 0"), p, {"n": 0.4, "t": 0.3}, {"size": 0.2}, 3, 0.9).select("q", "rank", "doc", "score")


@query("memory_topk_all", f"""
with m as (select conv_id, turn, role, conv_id % 5 as family, {_P_TOK.format('text')} as t from conversations where text is not null),
s as (select a.conv_id as q, a.turn as q_turn, b.conv_id as doc, b.turn as doc_turn, round({_JAC.format('t')} + coalesce((a.role = b.role)::int, 0) + 0.25::double * (a.family = b.family)::int, 6) as score
      from m a join m b on a.conv_id <> b.conv_id where a.conv_id % 20 = 0)
select q, q_turn, doc, doc_turn, score from (select *, row_number() over (partition by q, q_turn order by score desc, doc, doc_turn) as rank from s) where rank = 1""")
def memory_topk_all(spark, d):
    """As ``memory_topk``, every turn against every turn of the other conversations. Queries: conversations divisible by 20."""
    m = table(spark, d, "conversations").filter("text is not null").select(F.col("conv_id").alias("id"), F.col("turn").alias("part"), "role", (F.col("conv_id") % 5).alias("family"), tokens(F.col("text")).alias("t"))
    return field_topk(m.filter("id % 20 = 0"), m, {"t": 1.0}, {"role": 1.0, "family": 0.25}, 1).select("q", F.col("q_part").alias("q_turn"), "doc", F.col("doc_part").alias("doc_turn"), "score")


@query("cosine_topk_all", """
with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and not list_contains(list_transform(embedding, lambda x: x is null or isnan(x)), true)),
s as (select a.vec_id as q, b.vec_id as doc, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
select q, cast(rank as integer) as rank, doc, score from (select *, row_number() over (partition by q order by score desc, doc) as rank from s) where rank <= 3""")
def cosine_topk_all(spark, d):
    """As ``cosine_topk``, against vectors of every label; those without a direction have no score. Queries: ids divisible by 20."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.lit(0).cast("long").alias("part"), unit(F.transform("embedding", lambda x: x.cast("double"))).alias("e")).filter("e is not null and not exists(e, x -> x is null or isnan(x))")
    return vector_topk(v.filter("id % 20 = 0"), v, 3).select("q", "rank", "doc", "score")


@query("state_alignment", """
with u as (select user_id, list_sort(list_distinct(list(event_type))) as k from events where value > 90 group by 1)
select a.user_id as a, b.user_id as b, round(len(list_intersect(a.k, b.k))::double / len(list_distinct(list_concat(a.k, b.k))), 9) as alignment, round(len(list_intersect(a.k, b.k))::double / len(a.k), 9) as overlap
from u a join u b on b.user_id = a.user_id + 1""")
def state_alignment(spark, d):
    u = table(spark, d, "events").filter("value > 90").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    a, b = u.select(F.col("user_id").alias("a"), F.col("k").alias("ka")), u.select(F.col("user_id").alias("b"), F.col("k").alias("kb"))
    j = a.join(b, F.col("b") == F.col("a") + 1)
    return j.select("a", "b", F.round(jaccard(F.col("ka"), F.col("kb")), 9).alias("alignment"), F.round(F.size(F.array_intersect("ka", "kb")) / F.size("ka"), 9).alias("overlap"))


@query("hybrid_rerank", f"""
with q as (select item_id as q, list_distinct({TOK}) as t from benchmark), d as (select doc_id as doc, list_distinct({TOK}) as t, n_chars, quality from documents left join labels using (doc_id)),
qt as (select q, len(t) as nq, unnest(t) as term from q), dt as (select doc, len(t) as nd, n_chars, quality, unnest(t) as term from d),
m as (select q, doc, count(*)::double as both_, any_value(nq) as nq, any_value(nd) as nd, any_value(n_chars) as n_chars, any_value(quality) as quality from qt join dt using (term) group by 1, 2),
s as (select q, doc, round(0.6::double * both_ / (nq + nd - both_) + 0.25::double * least(1.0::double, greatest(0.0::double, n_chars / 20000.0::double)) + 0.15::double * coalesce(quality, 0), 6) as score from m)
select q, cast(rank as integer) as rank, doc, score from (select *, row_number() over (partition by q order by score desc, doc) as rank from s) where rank <= 3""")
def hybrid_rerank(spark, d):
    q, docs = bags(spark, d)
    lexical = jaccard_scores(q, docs)
    info = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), clamp01(F.col("n_chars") / 20000.0).alias("mass"))
    good = table(spark, d, "labels").select(F.col("doc_id").alias("doc"), "quality")
    s = lexical.join(info, "doc").join(good, "doc", "left")
    score = 0.6 * F.col("score") + 0.25 * F.col("mass") + 0.15 * F.coalesce("quality", F.lit(0))
    return ranked(s.select("q", "doc", F.round(score, 6).alias("score")), ["q"], [F.col("score").desc(), F.col("doc")], 3)


@query("entity_linking", """
with m as (select user_id, event_type as node, max(case event_type when 'purchase' then 1.0::double when 'click' then 0.8::double else 0.4::double end) as weight from events group by 1, 2)
select user_id, node, weight, cast(rank as integer) as rank from (select *, row_number() over (partition by user_id order by weight desc, node) as rank from m) where rank <= 2""")
def entity_linking(spark, d):
    w = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "click", 0.8).otherwise(0.4)
    m = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("node")).agg(F.max(w).alias("weight"))
    return ranked(m, ["user_id"], [F.col("weight").desc(), F.col("node")], 2)
