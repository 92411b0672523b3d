"""Queries whose answer depends on the order of rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planloom.operators.ordered import forward_fill, last_segment_outcomes, running_state, scan_fill
from planloom.operators.relational import allocate, ranked, spread_sample
from planloom.plans.register import query, table

LOG_SQL = """
with s as (select user_id, event_id, ts, event_type, sum(case when event_type = 'signup' then 1 else 0 end) over w as segment from events
           window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)),
f as (select *, last_value(case when event_type in ('click', 'view') then event_id end ignore nulls) over (partition by user_id, segment order by ts, event_id rows between unbounded preceding and current row) as current_id from s)"""


@query("log_forward_fill", LOG_SQL + "select event_id, cast(segment as bigint) as segment, current_id from f")
def log_forward_fill(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    filled = forward_fill(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "signup", F.when(F.col("event_type").isin("click", "view"), F.col("event_id")))
    return filled.select("event_id", "segment", F.col("filled").alias("current_id"))


@query("log_outcomes", LOG_SQL + """, l as (select user_id, max(segment) as last_segment from f group by 1),
o as (select f.user_id, current_id, arg_max(event_type = 'purchase', (ts, event_id)) as success from f join l on f.user_id = l.user_id and f.segment = l.last_segment
      where event_type in ('purchase', 'error') and current_id is not null group by 1, 2)
select user_id, current_id, success from o""")
def log_outcomes(spark, d):
    """A segment resets a user's outcomes: only the last one counts, and in it the last outcome of each id."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    filled = forward_fill(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "signup", F.when(F.col("event_type").isin("click", "view"), F.col("event_id")))
    out = last_segment_outcomes(filled, ["user_id"], F.col("event_type").isin("purchase", "error"), F.col("event_type") == "purchase", [F.col("ts"), F.col("event_id")])
    return out.withColumnRenamed("filled", "current_id")


ONE_LOG_SQL = """
with s as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (order by ts, event_id rows between unbounded preceding and current row) as segment from events),
f as (select *, last_value(case when event_type in ('click', 'view') then event_id end ignore nulls) over (partition by segment order by ts, event_id rows between unbounded preceding and current row) as current_id from s)"""


def one_log(spark, d):
    """All events as one log: a signup opens the segment of a model, a click or view names an id."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return scan_fill(e, [], ["ts", "event_id"], F.col("event_type") == "signup", F.when(F.col("event_type").isin("click", "view"), F.col("event_id")))


@query("one_log_fill", ONE_LOG_SQL + "select event_id, cast(segment as bigint) as segment, current_id from f")
def one_log_fill(spark, d):
    """Segment and current id of every row of one log that no key divides."""
    return one_log(spark, d).select("event_id", "segment", F.col("filled").alias("current_id"))


@query("one_log_outcomes", ONE_LOG_SQL + """, m as (select segment, user_id % 7 as model from s where event_type = 'signup'), l as (select model, max(segment) as segment from m group by 1)
select model, current_id as task_id, arg_max(event_type = 'purchase', (ts, event_id)) as success from f join l using (segment) where event_type in ('purchase', 'error') and current_id is not null group by 1, 2""")
def one_log_outcomes(spark, d):
    """A model named again starts afresh: its last segment counts, and in it the last outcome of each id."""
    rows = one_log(spark, d)
    models = rows.filter("event_type = 'signup'").groupBy((F.col("user_id") % 7).alias("model")).agg(F.max("segment").alias("segment"))
    told = rows.join(models, "segment").filter(F.col("event_type").isin("purchase", "error") & F.col("filled").isNotNull())
    return told.groupBy("model", F.col("filled").alias("task_id")).agg(F.max_by(F.col("event_type") == "purchase", F.struct("ts", "event_id")).alias("success"))


@query("next_action_pairs", """select prev as a, event_type as b, count(*) as n from (select event_type, lag(event_type) over (partition by user_id order by ts, event_id) as prev from events) where prev is not null group by 1, 2""")
def next_action_pairs(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return e.withColumn("a", F.lag("event_type").over(w)).filter("a is not null").groupBy("a", F.col("event_type").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("spread_sample", """
with o as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by o_orderkey) - 1 as i, count(*) over (partition by o_orderpriority) as n from orders)
select o_orderkey, o_orderpriority from o where n <= 25 or exists (select 1 from range(25) r(j) where round_even(j * ((n - 1) / 24.0::double), 0) = i)""")
def spread_sample_query(spark, d):
    return spread_sample(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], [F.col("o_orderkey")], 25)


@query("balanced_sample", """
with o as (select l_orderkey, l_linenumber, l_returnflag, l_linestatus, row_number() over w - 1 as i, count(*) over (partition by l_returnflag, l_linestatus) as n from lineitem
           window w as (partition by l_returnflag, l_linestatus order by l_quantity, l_orderkey, l_linenumber))
select l_orderkey, l_linenumber, l_returnflag, l_linestatus from o where i = floor(n / 2)""")
def balanced_sample(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    return spread_sample(li, ["l_returnflag", "l_linestatus"], [F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")], 1).drop("l_quantity")


@query("stratified_allocation", """
with g as (select c_mktsegment, count(*) as n from customer group by 1), s as (select *, n * 37.0::double / sum(n) over () as share, greatest(1, floor(n * 37.0::double / sum(n) over ())::int) as seats from g),
r as (select *, 37 - sum(seats) over () as short, row_number() over (order by share - seats desc, n desc, c_mktsegment) as rk from s)
select c_mktsegment, n, cast(seats + case when rk <= short then 1 else 0 end as integer) as seats from r""")
def stratified_allocation(spark, d):
    return allocate(table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), "c_mktsegment", "n", 37)


@query("first_last_attempt", """select conv_id, arg_min(role, turn) as first_role, arg_max(role, turn) as last_role, arg_max(length(text), turn) as last_chars, count(*) as attempts from conversations group by 1""")
def first_last_attempt(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.max_by(F.length("text").cast("long"), "turn").alias("last_chars"), F.count(F.lit(1)).alias("attempts"))


@query("topk_per_query", """select l_suppkey, l_orderkey, l_linenumber, rank from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rank from lineitem) where rank <= 3""")
def topk_per_query(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return ranked(li, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 3).select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("composite_sort", "select p_partkey, p_size, row_number() over (order by p_size desc, lower(p_brand), p_partkey) as place from part order by place limit 32")
def composite_sort(spark, d):
    """Cut first (a top-k per task), numbered after."""
    top = table(spark, d, "part").select("p_partkey", "p_size", "p_brand").orderBy(F.col("p_size").desc(), F.lower("p_brand"), "p_partkey").limit(32)
    w = Window.orderBy(F.col("p_size").desc(), F.lower("p_brand"), "p_partkey")
    return top.select("p_partkey", "p_size", F.row_number().over(w).cast("long").alias("place"))


@query("shortest_branch", "select l_orderkey, arg_min(l_linenumber, (l_quantity, l_linenumber)) as branch from lineitem group by 1")
def shortest_branch(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct("l_quantity", "l_linenumber")).alias("branch"))


@query("running_budget", """
with r as (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and current row) as spent from conversations)
select conv_id, turn, cast(spent as bigint) as spent, spent > 2000 as halted from r""")
def running_budget(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"))
    return running_state(c, ["conv_id"], [F.col("turn")], F.col("chars"), 2000)
