"""Joins, set operations, filters and constraints on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom.functions.numeric import hash_int, split_of
from planloom.functions.text import normalised
from planloom.operators.relational import both_ways, exactly_one, first_wins, paired, ranked, require_unique
from planloom.plans.register import query, table


@query("split_filter", "select doc_id, lang, n_chars from documents where lang <> 'en' and n_chars > 500")
def split_filter(spark, d):
    return table(spark, d, "documents").filter((F.col("lang") != "en") & (F.col("n_chars") > 500)).select("doc_id", "lang", "n_chars")


@query("executable_filter", "select o_orderkey, count(*) as plan_length from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'O' group by 1")
def executable_filter(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(li, "o_orderkey").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("plan_length"))


@query("dataset_filter", "select event_id, coalesce(nullif(event_type, ''), 'unknown') as dataset from events where event_type = 'click' or value > 99")
def dataset_filter(spark, d):
    return table(spark, d, "events").filter((F.col("event_type") == "click") | (F.col("value") > 99)).select("event_id", F.coalesce(F.nullif("event_type", F.lit("")), F.lit("unknown")).alias("dataset"))


@query("cell_filter", "select o_orderkey, o_orderpriority from orders where o_orderstatus = 'F' and o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def cell_filter(spark, d):
    chosen = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").filter("o_orderstatus = 'F'").join(chosen, "o_custkey", "left_semi").select("o_orderkey", "o_orderpriority")


@query("score_threshold_after_topk", """select l_suppkey, l_orderkey, l_linenumber, rank from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rank from lineitem)
where rank <= 5 and l_discount >= 0.05""")
def score_threshold_after_topk(spark, d):
    """The threshold stands above the cut, so fewer than k rows may be left."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    top = ranked(li, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 5)
    return top.filter("l_discount >= 0.05D").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("successful_repair_filter", """select conv_id, min(turn) as turn from conversations where role = 'assistant' and text is not null and length(text) > 20 group by conv_id""")
def successful_repair_filter(spark, d):
    c = table(spark, d, "conversations").filter((F.col("role") == "assistant") & F.col("text").isNotNull() & (F.length("text") > 20))
    return c.groupBy("conv_id").agg(F.min("turn").alias("turn"))


@query("head_limit", "select p_partkey, p_name from part order by p_partkey limit 25")
def head_limit(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name").orderBy("p_partkey").limit(25)


@query("exactly_one_join", """
with e as (select user_id as doc_id, count(*) as n, min(event_id) as event_id from events where event_type = 'purchase' and value > 40 group by 1)
select d.doc_id, case when n is null then 'missing' when n > 1 then 'duplicate' else 'selected' end as status, case when n = 1 then event_id end as event_id
from (select doc_id from documents) d left join e using (doc_id)""")
def exactly_one_join(spark, d):
    runs = table(spark, d, "events").filter((F.col("event_type") == "purchase") & (F.col("value") > 40)).select(F.col("user_id").alias("doc_id"), "event_id")
    return exactly_one(table(spark, d, "documents").select("doc_id"), runs, "doc_id", "event_id")


@query("double_lookup_audit", """
select n_name as family, count(*) as n, count(*) filter (where c_mktsegment = 'BUILDING') as same_family, count(*) filter (where o_orderpriority = '1-URGENT') as exact
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1""")
def double_lookup_audit(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return o.join(c, "c_custkey").join(n, "n_nationkey").groupBy(F.col("n_name").alias("family")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("same_family"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("exact"))


@query("paired_strict", "select cast(quality as integer) as left_value, cast(toxic as integer) as right_value, count(*) as n from labels group by 1, 2")
def paired_strict(spark, d):
    l = table(spark, d, "labels")
    return paired(l.select("doc_id", "quality"), l.select("doc_id", F.col("toxic").alias("quality")), "doc_id", "quality", True).groupBy("left_value", "right_value").agg(F.count(F.lit(1)).alias("n"))


@query("paired_lenient", """select count(*) as n, cast(sum(l.quality - r.toxic) as bigint) as uplift from labels l join (select * from labels where doc_id % 3 <> 0) r using (doc_id)""")
def paired_lenient(spark, d):
    l = table(spark, d, "labels")
    p = paired(l.select("doc_id", "quality"), l.filter("doc_id % 3 <> 0").select("doc_id", F.col("toxic").alias("quality")), "doc_id", "quality", False)
    return p.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("left_value") - F.col("right_value")).cast("long").alias("uplift"))


@query("default_left_join", "select doc_id, coalesce(quality = 1, false) as success from documents left join labels using (doc_id)")
def default_left_join(spark, d):
    l = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("success"))
    return table(spark, d, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", F.coalesce("success", F.lit(False)).alias("success"))


@query("design_cross_join", "select r_name, s as c_mktsegment, p as o_orderpriority from region, (select distinct c_mktsegment as s from customer), (select distinct o_orderpriority as p from orders)")
def design_cross_join(spark, d):
    """Three small dimensions: levels are folded into two arrays, then exploded beside each region."""
    s = table(spark, d, "customer").agg(F.collect_set("c_mktsegment").alias("s"), F.lit(1).alias("k"))
    p = table(spark, d, "orders").agg(F.collect_set("o_orderpriority").alias("p"), F.lit(1).alias("k"))
    r = table(spark, d, "region").select("r_name", F.lit(1).alias("k"))
    both = r.join(s, "k").join(p, "k").select("r_name", F.explode("s").alias("c_mktsegment"), "p")
    return both.select("r_name", "c_mktsegment", F.explode("p").alias("o_orderpriority"))


@query("typed_grounding", """
select r.r_name as kind, p.n_name as a, q.n_name as b from region r join nation p on p.n_regionkey = r.r_regionkey join nation q on (q.n_regionkey = r.r_regionkey or r.r_name = 'ASIA') and q.n_nationkey <> p.n_nationkey""")
def typed_grounding(spark, d):
    """Arguments of a matching type; the type ``ASIA`` stands for any. Two equi-joins, so no nested loop."""
    n = table(spark, d, "nation")
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("kind"))
    a = n.join(r, "n_regionkey").select("kind", F.col("n_nationkey").alias("ka"), F.col("n_name").alias("a"))
    typed = n.join(r, "n_regionkey").select("kind", F.col("n_nationkey").alias("kb"), F.col("n_name").alias("b")).filter("kind <> 'ASIA'")
    anything = n.select(F.lit("ASIA").alias("kind"), F.col("n_nationkey").alias("kb"), F.col("n_name").alias("b"))
    return a.join(typed.unionByName(anything), "kind").filter("ka <> kb").select("kind", "a", "b")


@query("bounded_product", "select count(*) > 1200 as overflow, least(count(*), 1201) as candidates from nation a join nation b on a.n_regionkey = b.n_regionkey join supplier on s_nationkey = a.n_nationkey")
def bounded_product(spark, d):
    n = table(spark, d, "nation")
    pairs = n.select("n_regionkey", F.col("n_nationkey").alias("s_nationkey")).join(n.select("n_regionkey", F.col("n_name").alias("other")), "n_regionkey")
    found = pairs.join(table(spark, d, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey").limit(1201)
    return found.agg((F.count(F.lit(1)) > 1200).alias("overflow"), F.count(F.lit(1)).alias("candidates"))


@query("name_to_id_lookup", """
with n as (select p_name, count(*) as ids, min(p_partkey) as id from part group by p_name)
select l_orderkey, l_linenumber, case when ids is null then 'missing' when ids > 1 then 'ambiguous' else 'resolved' end as code, case when ids = 1 then id end as id
from lineitem join part on l_partkey = p_partkey left join n using (p_name)""")
def name_to_id_lookup(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    ids = part.groupBy("p_name").agg(F.count(F.lit(1)).alias("ids"), F.min("p_partkey").alias("id"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    code = F.when(F.col("ids").isNull(), "missing").when(F.col("ids") > 1, "ambiguous").otherwise("resolved")
    return li.join(part.join(ids, "p_name", "left"), "p_partkey").select("l_orderkey", "l_linenumber", code.alias("code"), F.when(F.col("ids") == 1, F.col("id")).alias("id"))


@query("side_table_enrich", """select c_custkey, coalesce(n_name, 'unknown') as family, coalesce(r_name, 'unknown') as dataset from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def side_table_enrich(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return table(spark, d, "customer").join(n, "c_nationkey", "left").join(table(spark, d, "region"), "r_regionkey", "left").select(
        "c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("family"), F.coalesce("r_name", F.lit("unknown")).alias("dataset"))


@query("heldout_anti", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 250000)")
def heldout_anti(spark, d):
    used = table(spark, d, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return require_unique(table(spark, d, "customer").select("c_custkey"), "c_custkey").join(used, "c_custkey", "left_anti")


@query("split_disjointness", "select count(*) as overlap from (select c_nationkey from customer intersect select s_nationkey from supplier)")
def split_disjointness(spark, d):
    a, b = table(spark, d, "customer").select("c_nationkey"), table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))
    return a.intersect(b).agg(F.count(F.lit(1)).alias("overlap"))


NORM_SQL = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query("overlap_rates", f"""
with t as (select distinct {NORM_SQL} as k from documents where doc_id % 2 = 0), h as (select {NORM_SQL} as k, source from documents where doc_id % 2 = 1)
select count(*) as heldout, count(*) filter (where k in (select k from t)) as seen, round(count(*) filter (where k in (select k from t))::double / count(*), 9) as rate from h""")
def overlap_rates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("k"))
    train = docs.filter("doc_id % 2 = 0").select("k").distinct().withColumn("seen", F.lit(1))
    h = docs.filter("doc_id % 2 = 1").join(train, "k", "left")
    return h.agg(F.count(F.lit(1)).alias("heldout"), F.count("seen").alias("seen"), F.round(F.count("seen") / F.count(F.lit(1)), 9).alias("rate"))


@query("family_coverage", """
with t as (select distinct source from documents where doc_id % 7 = 0), h as (select distinct source from documents where doc_id % 7 = 1)
select count(*) as families, count(*) filter (where source in (select source from t)) as covered, round(coalesce(count(*) filter (where source in (select source from t))::double / nullif(count(*), 0), 0), 9) as coverage from h""")
def family_coverage(spark, d):
    docs = table(spark, d, "documents")
    t = docs.filter("doc_id % 7 = 0").select("source").distinct().withColumn("seen", F.lit(1))
    h = docs.filter("doc_id % 7 = 1").select("source").distinct().join(t, "source", "left")
    return h.agg(F.count(F.lit(1)).alias("families"), F.count("seen").alias("covered"), F.round(F.coalesce(F.try_divide(F.count("seen"), F.count(F.lit(1))), F.lit(0.0)), 9).alias("coverage"))


@query("first_wins_dedupe", f"select min(doc_id) as doc_id, substr(sha256({NORM_SQL}), 1, 16) as id from documents group by 2")
def first_wins_dedupe(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.substring(F.sha2(normalised(F.col("text")), 256), 1, 16).alias("id"))
    return first_wins(docs, "id", [F.col("doc_id")])


@query("union_all_sources", "select 'customer' as origin, count(*) as n from customer union all select 'supplier', count(*) from supplier")
def union_all_sources(spark, d):
    a = table(spark, d, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("key"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("key"))
    return a.unionByName(b).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("ordered_distinct", """select user_id, string_agg(event_type, ',' order by first_id) as kinds from (select user_id, event_type, min(event_id) as first_id from events group by 1, 2) group by user_id""")
def ordered_distinct(spark, d):
    """First-seen order: reduced to one row per kind before anything is collected."""
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    kinds = F.array_sort(F.collect_list(F.struct("first_id", "event_type")))
    return first.groupBy("user_id").agg(F.array_join(F.transform(kinds, lambda x: x["event_type"]), ",").alias("kinds"))


@query("uniqueness_violations", "select p_name, count(*) as n from part group by p_name having count(*) > 1")
def uniqueness_violations(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("bidirectional_edges", """
with e as (select 'nation:' || n_nationkey as source, 'in_region' as relation, 'region:' || n_regionkey as target, 1.0::double as weight from nation
           union all select 'customer:' || c_custkey, 'lives_in', 'nation:' || c_nationkey, 0.5::double from customer)
select source, relation, target, weight from e union all select target, 'inverse:' || relation, source, round(0.9::double * weight, 9) from e""")
def bidirectional_edges(spark, d):
    from planloom.plans.graph_queries import key_edges

    return both_ways(key_edges(spark, d)).withColumn("weight", F.round("weight", 9))


@query("required_cells", """select priority, status from (values ('1-URGENT','F'),('1-URGENT','X'),('9-NONE','O'),('5-LOW','P')) v(priority, status) where not exists (select 1 from orders where o_orderpriority = priority and o_orderstatus = status)""")
def required_cells(spark, d):
    need = spark.createDataFrame([("1-URGENT", "F"), ("1-URGENT", "X"), ("9-NONE", "O"), ("5-LOW", "P")], "priority string, status string")
    have = table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).distinct()
    return need.join(have, ["priority", "status"], "left_anti")


@query("remainder_fill", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def remainder_fill(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("hash_split", "select doc_id, case when ('0x' || substr(sha1('docs:' || doc_id), 1, 8))::bigint % 10000 < 3000 then 'train' else 'eval' end as split from documents")
def hash_split(spark, d):
    return table(spark, d, "documents").select("doc_id", split_of(F.lit("docs"), F.col("doc_id").cast("string"), 0.3).alias("split"))


@query("entry_identity", "select p_partkey, substr(sha256(p_name || '|' || p_brand), 1, 16) as id, ('0x' || substr(sha256(p_name), 1, 8))::bigint % 64 as bucket from part")
def entry_identity(spark, d):
    return table(spark, d, "part").select("p_partkey", F.substring(F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256), 1, 16).alias("id"), (hash_int(F.col("p_name"), sha="sha256") % 64).alias("bucket"))
