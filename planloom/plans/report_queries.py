"""Composed reports: long tables of metrics from the roll-ups, contrasts of cells, screens and prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planloom.functions.numeric import mcnemar
from planloom.operators.replay import replay
from planloom.operators.resampling import cluster_bounds, cluster_bounds_sql
from planloom.plans import outcome_queries, relational_queries, replay_queries, text_queries  # noqa: F401  what reports are made of
from planloom.plans.register import ORACLE_SQL, QUERIES, query, table

#: Section of a report, query behind it, columns that name a row, columns that are metrics.
RESEARCH = [
    ("methods", "method_summary", ["lang"], ["n", "success_rate", "risk_rate"]),
    ("paired", "all_pairs_mcnemar", ["left_method", "right_method"], ["n", "b", "c", "p_value"]),
    ("differences", "paired_difference", ["lang"], ["n", "mean_difference"]),
    ("costs", "cost_rollup", ["conv_id"], ["calls", "tokens_in", "tokens_out", "cost"]),
]
AUDIT = [
    ("gaps", "metric_gap", [], ["coverage", "gap", "guarded"]),
    ("duplicates", "uniqueness_violations", ["*"], []),
    ("exports", "translate_exclude", ["code"], []),
]


def _long(spark, d, section, name, keys, metrics):
    df = QUERIES[name](spark, d)
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys and keys != ["*"] else F.lit("all")
    if not metrics:  # a metric of its own: how many rows the query finds under each key
        return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(section).alias("section"), "key", F.lit("rows").alias("metric"), "value")
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    return df.select(F.lit(section).alias("section"), key.alias("key"), cells.alias("m")).select("section", "key", "m.metric", "m.value")


def _long_sql(section, name, keys, metrics):
    key = f"concat_ws('/', {', '.join(f'{k}::varchar' for k in keys)})" if keys and keys != ["*"] else "'all'"
    if not metrics:
        return f"select '{section}' as section, {key} as key, 'rows' as metric, count(*)::double as value from ({ORACLE_SQL[name]}) group by 1, 2, 3"
    return " union all ".join(f"select '{section}' as section, {key} as key, '{m}' as metric, {m}::double as value from ({ORACLE_SQL[name]})" for m in metrics)


def _report(spark, d, parts):
    out = None
    for part in parts:
        df = _long(spark, d, *part)
        out = df if out is None else out.unionByName(df)
    return out


@query("research_analysis", " union all ".join(_long_sql(*p) for p in RESEARCH))
def research_analysis(spark, d):
    """Rates by method, paired tests, mean differences and costs as one long table."""
    return _report(spark, d, RESEARCH)


@query("validity_audit", " union all ".join(_long_sql(*p) for p in AUDIT))
def validity_audit(spark, d):
    """Coverage and gaps of the metrics, repeated identities and plans that cannot be exported, as one long table."""
    return _report(spark, d, AUDIT)


METHODS = ["view", "click", "purchase", "signup", "refund"]  # in the order in which they are compared; not all need have a cell
HARNESSES = ["any", "strong"]


def _contrasts():
    """(contrast, left cell, right cell): neighbouring methods under each harness, harnesses of each method."""
    rows = [(f"{h}__{a}_to_{b}", f"{a}__{h}", f"{b}__{h}") for h in HARNESSES for a, b in zip(METHODS, METHODS[1:])]
    return rows + [(f"{m}__{a}_to_{b}", f"{m}__{a}", f"{m}__{b}") for m in METHODS for a, b in zip(HARNESSES, HARNESSES[1:])]


_CELLS_SQL = ", ".join(f"max(case when event_type = '{m}'{' and value > 50' if h == 'strong' else ''} then 1 else 0 end) as {m}__{h}" for h in HARNESSES for m in METHODS)
_PAIRS_SQL = " union all ".join(f"select user_id % 10 as family, '{c}' as contrast, {a} as l, {b} as r from w where '{a.split('__')[0]}' in (select event_type from events) and '{b.split('__')[0]}' in (select event_type from events)" for c, a, b in _contrasts())


@query("official_results", f"""
with w as (select user_id, {_CELLS_SQL} from events where user_id is not null group by user_id), p as ({_PAIRS_SQL}),
f as (select contrast, family, count(*) as n, sum(l) as l, sum(r) as r, count(*) filter (where l = 1 and r = 0) as b, count(*) filter (where l = 0 and r = 1) as c from p group by 1, 2),
g as (select contrast, sum(n)::bigint as n, sum(l)::bigint as left_successes, sum(r)::bigint as right_successes, sum(b)::bigint as b, sum(c)::bigint as c, count(*) as families, round(avg((r - l)::double / n), 9) as family_mean from f group by 1)
select contrast, n, left_successes, right_successes, b, c, families, family_mean, round(case when b + c = 0 then 1.0::double else least(1.0::double,
  2 * list_sum(list_transform(range(0, (least(b, c) + 1)::bigint), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::double))))) end, 8) as p_value, round(low, 9) as family_low, round(high, 9) as family_high
from g join (select contrast, family_low as low, family_high as high from ({cluster_bounds_sql("(select contrast, family, r - l as total, n from f)", "contrast", "family")})) using (contrast)""")
def official_results(spark, d):
    """Every contrast of two cells that both have runs: successes, exact McNemar, the mean over families and its interval.

    One pass makes a row per user with its outcome in each cell; pairs are then sums by
    contrast and family, so nothing is joined with itself.
    """
    e = table(spark, d, "events").filter("user_id is not null")
    cell = lambda m, h: (F.col("event_type") == m) & (F.col("value") > 50 if h == "strong" else F.lit(True))
    wide = e.groupBy("user_id").agg(*[F.coalesce(F.max(cell(m, h).cast("int")), F.lit(0)).alias(f"{m}__{h}") for h in HARNESSES for m in METHODS])
    seen = e.select(F.col("event_type").alias("method")).distinct()
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("contrast"), F.lit(a.split("__")[0]).alias("left"), F.lit(b.split("__")[0]).alias("right"), F.col(a).alias("l"), F.col(b).alias("r")) for c, a, b in _contrasts()]))
    f = wide.select((F.col("user_id") % 10).alias("family"), pairs.alias("p")).select("family", "p.*").groupBy("contrast", "left", "right", "family").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l").alias("l"), F.sum("r").alias("r"), F.count_if(F.expr("l = 1 and r = 0")).alias("b"), F.count_if(F.expr("l = 0 and r = 1")).alias("c"))
    for side in ("left", "right"):  # a contrast with a missing cell is left out
        f = f.join(seen.withColumnRenamed("method", side), side, "left_semi")
    g = f.groupBy("contrast").agg(
        F.sum("n").alias("n"), F.sum("l").alias("left_successes"), F.sum("r").alias("right_successes"), F.sum("b").alias("b"), F.sum("c").alias("c"),
        F.count(F.lit(1)).alias("families"), F.round(F.avg((F.col("r") - F.col("l")) / F.col("n")), 9).alias("family_mean"))
    bounds = cluster_bounds(f.select("contrast", "family", (F.col("r") - F.col("l")).alias("total"), "n"), "contrast", "family")
    bounds = bounds.select("contrast", F.round("family_low", 9).alias("family_low"), F.round("family_high", 9).alias("family_high"))
    return g.select("*", F.round(mcnemar(F.col("b"), F.col("c")), 8).alias("p_value")).join(bounds, "contrast")


@query("model_generalisation", """
with o as (select lang, source, quality, toxic, n_chars from documents left join labels using (doc_id)),
s as (select lang, count(distinct case when quality is not null then source end) as done, count(*) filter (where quality is not null) as runs, avg(quality::double) as base, avg(1 - toxic::double) as other, count(*) as calls, sum(n_chars)::bigint as volume from o group by 1)
select lang, runs, calls, volume, round(base, 9) as base_rate, round(other, 9) as other_rate, round(other - base, 9) as uplift, done = (select count(distinct source) from documents) as complete from s""")
def model_generalisation(spark, d):
    """Per model: its two rates and their difference, the volume of its calls, and whether it has runs in every family."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    o = docs.join(table(spark, d, "labels"), "doc_id", "left")
    s = o.groupBy("lang").agg(
        F.count_distinct(F.when(F.col("quality").isNotNull(), F.col("source"))).alias("done"), F.count("quality").alias("runs"), F.count(F.lit(1)).alias("calls"), F.sum("n_chars").alias("volume"),
        F.avg("quality").alias("base"), F.avg(1 - F.col("toxic")).alias("other"))
    families = docs.agg(F.count_distinct("source").alias("families"), F.lit(1).alias("k"))  # one row
    return s.withColumn("k", F.lit(1)).join(families, "k").select(
        "lang", "runs", "calls", "volume", F.round("base", 9).alias("base_rate"), F.round("other", 9).alias("other_rate"), F.round(F.col("other") - F.col("base"), 9).alias("uplift"), (F.col("done") == F.col("families")).alias("complete"))


@query("cohort_screen", """
with s as (select l_orderkey, l_linenumber, case when l_quantity > 45 then 'unsupported' when l_discount > 0.095::double then 'ambiguous' end as code from lineitem)
select l_orderkey, count(*) as steps, coalesce(arg_min(code, (l_linenumber, code)) filter (where code is not null), 'kept') as verdict from s group by 1""")
def cohort_screen(spark, d):
    """Every plan with its verdict: kept if each step translates, else the code of the first step that does not."""
    code = F.when(F.col("l_quantity") > 45, "unsupported").when(F.col("l_discount") > 0.095, "ambiguous")
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code"))
    first = F.min(F.when(F.col("code").isNotNull(), F.struct("l_linenumber", "code")))
    return s.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("steps"), first.alias("first")).select("l_orderkey", "steps", F.coalesce("first.code", F.lit("kept")).alias("verdict"))


@query("pattern_flags", """
with k as (select user_id, list(distinct event_type) as k from events where event_type is not null group by 1)
select user_id, array_to_string(list_filter([case when list_contains(k, 'signup') and list_has_any(k, ['click', 'purchase']) then 'engaged' end, case when list_contains(k, 'error') then 'failing' end, case when not list_contains(k, 'purchase') then 'no_purchase' end], lambda x: x is not null), ',') as flags from k""")
def pattern_flags(spark, d):
    """Flags that a user's set of event types raises: all of one and any of others, one alone, none of one."""
    k = table(spark, d, "events").filter("event_type is not null").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    has = lambda x: F.array_contains("k", x)
    engaged = has("signup") & F.arrays_overlap("k", F.array(F.lit("click"), F.lit("purchase")))
    return k.select("user_id", F.concat_ws(",", F.when(engaged, "engaged"), F.when(has("error"), "failing"), F.when(~has("purchase"), "no_purchase")).alias("flags"))


@query("repair_prompts", """
with l as (select l_orderkey, l_linenumber, min(l_returnflag) as flag from lineitem group by 1, 2),
f as (select l_orderkey, string_agg('ship(' || l_linenumber || ')', ', ' order by l_linenumber) as plan, min(case when flag = 'R' and l_orderkey % 2 = 1 then l_linenumber end) as bad, list(l_linenumber order by l_linenumber) as lines from l group by 1)
select l_orderkey::varchar as id, 'Plan: ' || plan || chr(10) || 'Feedback: {"step":' || list_position(lines, bad) || ',"violation":"missing_step"}' || chr(10) || 'Return a corrected plan.' as prompt from f where bad is not null""")
def repair_prompts(spark, d):
    """A prompt for each failed run: its plan, the feedback of the replay as JSON, and what is asked."""
    t = replay(replay_queries.order_tasks(spark, d)).filter("status = 'failed'")
    feedback = F.to_json(F.struct((F.col("steps") + 1).alias("step"), "violation"))
    return t.select("id", F.concat_ws("\n", F.concat(F.lit("Plan: "), F.array_join("plan", ", ")), F.concat(F.lit("Feedback: "), feedback), F.lit("Return a corrected plan.")).alias("prompt"))


@query("graph_context", """
with e as (select distinct l_orderkey, l_suppkey from lineitem where l_orderkey is not null and l_suppkey is not null),
s as (select l_orderkey, string_agg('order:' || l_orderkey || ' -supplied_by-> supplier:' || l_suppkey, '; ' order by l_suppkey) as triples from e group by 1),
c as (select l_orderkey, string_agg(distinct 'ship(' || l_linenumber || ')', ' -> ' order by 'ship(' || l_linenumber || ')') as chain from lineitem group by 1)
select l_orderkey, triples, chain from s join c using (l_orderkey)""")
def graph_context(spark, d):
    """The triples of each node in order, and the chain of its actions, as text; one pass over the edges."""
    li = table(spark, d, "lineitem").filter("l_orderkey is not null")
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"), F.array_sort(F.collect_set(F.concat(F.lit("ship("), F.col("l_linenumber").cast("string"), F.lit(")")))).alias("a")).filter(F.size("s") > 0)
    triple = F.transform("s", lambda x: F.concat(F.lit("order:"), F.col("l_orderkey").cast("string"), F.lit(" -supplied_by-> supplier:"), x.cast("string")))
    return g.select("l_orderkey", F.array_join(triple, "; ").alias("triples"), F.array_join("a", " -> ").alias("chain"))


@query("repeated_plans", """
with p as (select l_orderkey, list(l_linenumber order by l_linenumber) as plan from lineitem group by 1),
o as (select o_orderkey, o_custkey, plan, lag(plan) over (partition by o_custkey order by o_orderkey) as before from orders join p on l_orderkey = o_orderkey)
select o_orderkey, plan = before as repeated from o where before is not null""")
def repeated_plans(spark, d):
    """Whether an order's steps equal, in order, those of its customer's order before."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("plan"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(p, "o_orderkey")
    before = F.lag("plan").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.withColumn("before", before).filter("before is not null").select("o_orderkey", (F.col("plan") == F.col("before")).alias("repeated"))
