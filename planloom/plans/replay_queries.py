"""Replays, goals, repairs and searches; event streams and conversations stand in for traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planloom.functions.numeric import goal_share
from planloom.operators import replay as R
from planloom.plans.register import query, table


@query("state_fold", """
with s as (select user_id, event_id, event_type, row_number() over w as step, max(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as signed,
            max(case when event_type = 'click' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as clicked from events window w as (partition by user_id order by ts, event_id)),
v as (select *, case when event_type = 'error' then 'hallucination' when event_type = 'signup' and coalesce(signed, 0) = 1 then 'additional_step' when event_type = 'purchase' and coalesce(clicked, 0) = 0 then 'missing_step' end as violation from s)
select user_id, arg_min(violation, step) as violation, cast(min(step) as integer) as failed_step from v where violation is not null group by 1""")
def state_fold(spark, d):
    """First violation of each user's events: unknown action, step that adds nothing, missing precondition."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    had = lambda k: F.coalesce(F.max((F.col("event_type") == k).cast("int")).over(past), F.lit(0)) == 1
    e = table(spark, d, "events").select("user_id", "event_type", F.row_number().over(w).alias("step"), had("signup").alias("signed"), had("click").alias("clicked"))
    v = F.when(F.col("event_type") == "error", "hallucination").when((F.col("event_type") == "signup") & F.col("signed"), "additional_step").when((F.col("event_type") == "purchase") & ~F.col("clicked"), "missing_step")
    return e.withColumn("violation", v).filter("violation is not null").groupBy("user_id").agg(F.min_by("violation", "step").alias("violation"), F.min("step").alias("failed_step"))


@query("goal_satisfaction", """
with u as (select user_id, list_distinct(list(event_type)) as k from events where value > 95 group by 1)
select user_id, round((list_contains(k, 'purchase')::int + list_contains(k, 'click')::int + (not list_contains(k, 'error'))::int) / 3.0::double, 9) as share from u""")
def goal_satisfaction(spark, d):
    goals = F.array(F.lit("purchase"), F.lit("click"), F.lit("not(error)"))
    u = table(spark, d, "events").filter("value > 95").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return u.select("user_id", F.round(goal_share(goals, F.col("k")), 9).alias("share"))


@query("recovery_pass", """
with a as (select conv_id, turn, length(text) as n, row_number() over (partition by conv_id order by turn) as i from conversations where role = 'assistant')
select conv_id, arg_min(n > 200, i) as initial_success, max(case when n > 200 then 1 else 0 end) = 1 as task_success, coalesce(min(case when n > 200 then i end), count(*)) as attempts from a where i <= 2 group by 1""")
def recovery_pass(spark, d):
    """At most one retry: an attempt is kept if it is long enough."""
    a = table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", (F.length("text") > 200).alias("ok"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("i")).filter("i <= 2")
    return a.groupBy("conv_id").agg(F.min_by("ok", "i").alias("initial_success"), F.bool_or("ok").alias("task_success"), F.coalesce(F.min(F.when(F.col("ok"), F.col("i"))), F.count(F.lit(1))).cast("long").alias("attempts"))


def order_tasks(spark, d):
    """Orders as flat-model tasks: each line is a step that needs the part picked, and ships it."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct("l_linenumber", "l_returnflag"))).alias("lines"))
    name = lambda x: F.concat(F.lit("ship("), x["l_linenumber"].cast("string"), F.lit(")"))
    pre = lambda x: F.when(x["l_returnflag"] == "R", F.array(F.lit("approved()"))).otherwise(F.array().cast("array<string>"))
    fact = lambda x: F.concat(F.lit("shipped("), x["l_linenumber"].cast("string"), F.lit(")"))
    none = F.array().cast("array<string>")
    once = F.filter("lines", lambda x, i: (i == 0) | (F.get("lines", i - 1)["l_linenumber"] != x["l_linenumber"]))  # the first of a line's entries wins
    model = F.map_from_entries(F.transform(once, lambda x: F.struct(name(x).alias("key"), F.struct(pre(x).alias("preconditions"), F.array(fact(x)).alias("add_effects"), none.alias("del_effects")).alias("value"))))
    return li.select(
        F.col("l_orderkey").cast("string").alias("id"), F.array_distinct(F.transform("lines", name)).alias("plan"), F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit("approved()"))).otherwise(none).alias("initial_facts"),
        F.array_distinct(F.transform("lines", fact)).alias("goal_facts"), none.alias("forbidden"), F.lit(False).alias("should_reject"), model.alias("action_model"))


@query("plan_replay", """
with l as (select l_orderkey, l_linenumber, min(l_returnflag) as flag from lineitem group by 1, 2), n as (select l_orderkey, count(*) as n from l group by 1),
f as (select l_orderkey, min(l_linenumber) as bad from l where flag = 'R' and l_orderkey % 2 = 1 group by 1),
s as (select n.l_orderkey, n, bad, (select count(*) from l where l.l_orderkey = n.l_orderkey and (bad is null or l_linenumber < bad)) as done from n left join f using (l_orderkey))
select l_orderkey::varchar as id, case when bad is null then 'success' else 'failed' end as status, case when bad is not null then 'missing_step' end as violation, cast(done as integer) as steps, round(done::double / n, 9) as goal_share from s""")
def plan_replay(spark, d):
    t = R.replay(order_tasks(spark, d))
    return t.select("id", "status", "violation", "steps", F.round("goal_share", 9).alias("goal_share"))


@query("producers", "select distinct l_orderkey::varchar as id, 'shipped(' || l_linenumber || ')' as fact, 'ship(' || l_linenumber || ')' as action from lineitem")
def producers(spark, d):
    return R.producers(order_tasks(spark, d))


@query("run_evaluation", """
with l as (select l_orderkey, l_linenumber, min(l_returnflag) as flag from lineitem group by 1, 2),
f as (select l_orderkey, count(*) as n, min(case when flag = 'R' and l_orderkey % 2 = 1 then l_linenumber end) as bad from l group by 1),
s as (select f.l_orderkey, n, bad, (select count(*) from l where l.l_orderkey = f.l_orderkey and (bad is null or l_linenumber < bad)) as done from f)
select l_orderkey::varchar as id, bad is null as initial_success, bad is null as task_success, bad is null as execution_success, bad is null as safe_success, false as risk, false as rejected, round(done::double / n, 9) as partial_goal, false as recovered from s""")
def run_evaluation(spark, d):
    """Outcome flags of every run, from replays of its plan before and after the rule's repair."""
    return R.rerun(order_tasks(spark, d)).drop("plan", "repaired").withColumn("partial_goal", F.round("partial_goal", 9))
