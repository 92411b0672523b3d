"""Runs in which rules fire, validator records, comparisons with telemetry, and the smaller projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom.functions.canonical import canonical_row
from planloom.functions.numeric import mcnemar, or_unknown
from planloom.functions.text import split_action
from planloom.operators import replay as R
from planloom.operators.relational import phase_filter, short_list
from planloom.plans.outcome_queries import DIFFICULTY_SQL, PLANS_SQL, order_plans
from planloom.plans.register import query, table
from planloom.plans.replay_queries import order_tasks


def risky_tasks(spark, d):
    """Approved orders, some with a forbidden first step, a first step repeated at the end, or a request to refuse."""
    key, none = F.col("id").cast("long"), F.array().cast("array<string>")
    first = F.array(F.get("plan", 0))
    return order_tasks(spark, d).withColumns({
        "initial_facts": F.array(F.lit("approved()")), "forbidden": F.when(key % 7 == 0, first).otherwise(none), "should_reject": key % 5 == 0,
        "plan": F.when(key % 3 == 0, F.concat("plan", first)).otherwise(F.col("plan"))})


@query("harness_runs", """
with o as (select distinct l_orderkey as k, l_orderkey % 7 = 0 as forbidden, l_orderkey % 5 = 0 as refuse, l_orderkey % 3 = 0 as twice from lineitem)
select k::varchar as id, case when refuse then 'reject' when twice and not forbidden then 'drop_step' end as patch, not (forbidden or refuse or twice) as initial_success, refuse or not forbidden as task_success,
  refuse or not forbidden as execution_success, refuse or not forbidden as safe_success, not refuse and forbidden as risk, refuse as rejected, case when refuse or forbidden then 0.0::double else 1.0::double end as partial_goal, refuse or (twice and not forbidden) as recovered from o""")
def harness_runs(spark, d):
    """Every run with the repair that a rule made of its plan, and its outcome before and after."""
    patch = F.when(F.col("repaired") != F.col("plan"), F.when(F.col("repaired") == F.array(F.lit("reject()")), "reject").otherwise("drop_step")).alias("patch")
    return R.rerun(risky_tasks(spark, d)).select("id", patch, "initial_success", "task_success", "execution_success", "safe_success", "risk", "rejected", "partial_goal", "recovered")


@query("validator_records", """
with l as (select l_orderkey, l_linenumber, min(l_returnflag) as flag from lineitem group by 1, 2),
f as (select l_orderkey, count(*) as n, min(case when flag = 'R' and l_orderkey % 2 = 1 then l_linenumber end) as bad from l group by 1),
s as (select o_orderkey, n, bad, (select count(*) from l where l.l_orderkey = o_orderkey and (bad is null or l_linenumber < bad)) as done from orders left join f on l_orderkey = o_orderkey)
select o_orderkey::varchar as id, n is not null and bad is null as valid, case when n is null then 'no_plan' when bad is not null then 'missing_step' end as violation,
  case when bad is not null then cast(done + 1 as integer) end as failed_step, case when bad is not null then 'ship(' || bad || ')' end as failed_action from s""")
def validator_records(spark, d):
    """One row a task: whether its own plan runs to its goals, and the first step that fails; a task without a plan has a row too."""
    t = R.replay(order_tasks(spark, d))
    failed = F.col("violation").isNotNull()
    ran = t.select("id", ((F.col("status") == "success") & (F.col("goal_share") == 1)).alias("valid"), "violation", F.when(failed, F.col("steps") + 1).alias("failed_step"), F.when(failed, F.get("plan", F.col("steps"))).alias("failed_action"))
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit(1).alias("one"))
    return tasks.join(ran, "id", "left").select("id", F.coalesce("valid", F.lit(False)).alias("valid"), F.when(F.col("valid").isNull(), "no_plan").otherwise(F.col("violation")).alias("violation"), "failed_step", "failed_action")


@query("planner_comparison", """
with o as (select lang, source, quality, toxic, n_chars from documents left join labels using (doc_id)),
s as (select lang, count(quality) as n, sum(quality)::bigint as left_successes, sum(1 - toxic)::bigint as right_successes, count(*) filter (where quality = 1 and toxic = 1) as b, count(*) filter (where quality = 0 and toxic = 0) as c,
  count(*) as calls, sum(n_chars)::bigint as volume, round(avg(n_chars), 6) as mean_volume, max(n_chars) as largest, count(distinct case when quality is not null then source end) = count(distinct source) as complete from o group by 1)
select lang, n, left_successes, right_successes, b, c, round(case when b + c = 0 then 1.0::double else least(1.0::double,
  2 * list_sum(list_transform(range(0, (least(b, c) + 1)::bigint), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::double))))) end, 8) as p_value, calls, volume, mean_volume, largest, complete from s""")
def planner_comparison(spark, d):
    """Two planners on the same tasks for each model, with an exact test and the telemetry of its calls; ``complete`` where every family has runs."""
    o = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    s = o.groupBy("lang").agg(
        F.count("quality").alias("n"), F.sum("quality").alias("left_successes"), F.sum(1 - F.col("toxic")).alias("right_successes"), F.count_if(F.expr("quality = 1 and toxic = 1")).alias("b"), F.count_if(F.expr("quality = 0 and toxic = 0")).alias("c"),
        F.count(F.lit(1)).alias("calls"), F.sum("n_chars").alias("volume"), F.round(F.avg("n_chars"), 6).alias("mean_volume"), F.max("n_chars").alias("largest"),
        (F.count_distinct(F.when(F.col("quality").isNotNull(), F.col("source"))) == F.count_distinct("source")).alias("complete"))
    return s.select("lang", "n", "left_successes", "right_successes", "b", "c", F.round(mcnemar(F.col("b"), F.col("c")), 8).alias("p_value"), "calls", "volume", "mean_volume", "largest", "complete")


@query("source_digests", """
with j as (select 'labels' as name, '{"doc_id":' || coalesce(doc_id::varchar, 'null') || ',"quality":' || coalesce(quality::varchar, 'null') || ',"toxic":' || coalesce(toxic::varchar, 'null') || '}' as row_json from labels
  union all select 'nation', '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' from nation
  union all select 'region', '{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}' from region)
select name, count(*) as rows, cast(sum(('0x' || substr(sha256(row_json), 1, 11))::bigint) as bigint) as digest from j group by 1""")
def source_digests(spark, d):
    """Rows and an order-free digest of each source of the audit: a sum of the first 44 bits of SHA-256 of canonical rows."""
    out = None
    for name in ("labels", "nation", "region"):
        df = table(spark, d, name)
        part = df.select(F.conv(F.substring(F.sha2(canonical_row(df.schema), 256), 1, 11), 16, 10).cast("long").alias("x")).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum("x").alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


PHASES = {"pilot": ["1-URGENT", "2-HIGH"], "main": ["3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}


@query("model_phase_filter", "select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_custkey % 4 <> 0")
def model_phase_filter(spark, d):
    """Runs of enabled models in one registered phase."""
    return phase_filter(table(spark, d, "orders").filter("o_custkey % 4 <> 0"), "o_orderpriority", "pilot", PHASES).select("o_orderkey", "o_orderpriority")


@query("split_profile", f"""
with p as (select case when o_orderkey % 10 < 8 then 'train' else 'eval' end as split, coalesce(nullif(o_orderpriority, ''), 'unknown') as dataset, {DIFFICULTY_SQL} as label from ({PLANS_SQL}))
select split, 'dataset' as field, dataset as value, count(*) as n from p group by 1, 3 union all select split, 'difficulty', label, count(*) from p group by 1, 3""")
def split_profile(spark, d):
    """Tasks of each split by dataset and by difficulty, in one pass; what is not named counts as unknown."""
    split = F.when(F.col("o_orderkey") % 10 < 8, "train").otherwise("eval")
    fields = F.explode(F.create_map(F.lit("dataset"), or_unknown(F.col("o_orderpriority")), F.lit("difficulty"), F.expr(DIFFICULTY_SQL))).alias("field", "value")
    return order_plans(spark, d).select(split.alias("split"), fields).groupBy("split", "field", "value").agg(F.count(F.lit(1)).alias("n"))


@query("action_schema_context", """
with s as (select s_nationkey as k, list(s_name order by s_name) as names from supplier group by 1), c as (select c_nationkey as k, list(c_name order by c_name) as names from customer group by 1)
select n_name, 'deliver(from: supplier, to: customer) from: ' || array_to_string(s.names[1:8], ', ') || case when len(s.names) > 8 then ', ... (+' || len(s.names) - 8 || ')' else '' end
  || ' to: ' || array_to_string(c.names[1:8], ', ') || case when len(c.names) > 8 then ', ... (+' || len(c.names) - 8 || ')' else '' end as line from nation join s on s.k = n_nationkey join c on c.k = n_nationkey""")
def action_schema_context(spark, d):
    """A typed action of each nation with up to eight objects a parameter; one with a parameter that nothing fills is dropped."""
    # a group is the objects of one type in one nation, which the prompt lists
    of = lambda name, p: table(spark, d, name).groupBy(F.col(f"{p}_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(f"{p}_name")).alias(f"{p}_names"))
    both = table(spark, d, "nation").join(of("supplier", "s"), "n_nationkey").join(of("customer", "c"), "n_nationkey")
    line = F.concat(F.lit("deliver(from: supplier, to: customer) from: "), short_list(F.col("s_names")), F.lit(" to: "), short_list(F.col("c_names")))
    return both.select("n_name", line.alias("line"))


@query("nested_defaults", "select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), -1) as k, coalesce(json_extract_string(props, '$.difficulty.label'), 'unknown') as label from events")
def nested_defaults(spark, d):
    """Entries of a nested record, with defaults for what is missing at any depth."""
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_variant_get(v, "$.k", "bigint"), F.lit(-1).cast("long")).alias("k"), F.coalesce(F.try_variant_get(v, "$.difficulty.label", "string"), F.lit("unknown")).alias("label"))


@query("action_splits", """
with a as (select event_id, case event_id % 3 when 0 then event_type || '(' || user_id || ', at(' || event_id || '))' when 1 then event_type || '(' || user_id else ' ' || event_type || ' ' end as action from events)
select event_id, case when contains(action, '(') and ends_with(action, ')') then split_part(action, '(', 1) else trim(action) end as name, case when contains(action, '(') and ends_with(action, ')') then action[instr(action, '(') + 1 : len(action) - 1] end as inner_text from a""")
def action_splits(spark, d):
    """Name and inside of actions, cut at the first bracket; what does not end in one stays whole."""
    kind = F.col("event_id") % 3
    action = (F.when(kind == 0, F.concat("event_type", F.lit("("), "user_id", F.lit(", at("), "event_id", F.lit("))"))).when(kind == 1, F.concat("event_type", F.lit("("), "user_id")).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" "))))
    s = split_action(action)
    return table(spark, d, "events").select("event_id", s["name"].alias("name"), s["inner"].alias("inner_text"))
