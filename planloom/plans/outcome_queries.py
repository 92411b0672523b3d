"""Roll-ups of outcomes: labels are outcomes, languages methods, sources families."""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom.functions.numeric import difficulty, mcnemar, or_unknown, ratio0
from planloom.operators.resampling import cluster_bounds, cluster_bounds_sql, paired_bounds, paired_bounds_sql
from planloom.operators.rollups import costs, merge_maps, outcome_rates, recovery, strata
from planloom.plans.register import query, table

WILSON_SQL = """
case when n > 0 then greatest(0.0::double, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4.0::double*n*n))) / (1 + z*z/n)) else 0 end as {0}_low,
case when n > 0 then least(1.0::double, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4.0::double*n*n))) / (1 + z*z/n)) else 0 end as {0}_high"""


def outcomes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return docs.join(labels, "doc_id")


@query("method_summary_ci", f"""
with g as (select lang, count(*) as n, sum(quality) as k, sum(quality)::double / count(*) as p, 1.959963984540054::double as z from documents join labels using (doc_id) group by lang)
select lang, cast(n as bigint) as n, round(p, 9) as good_rate, round(good_low, 9) as good_low, round(good_high, 9) as good_high
from (select *, {WILSON_SQL.format('good')} from g)""")
def method_summary_ci(spark, d):
    g = outcome_rates(outcomes(spark, d), ["lang"], ["good"])
    return g.select("lang", "n", *[F.round(c, 9).alias(c) for c in ("good_rate", "good_low", "good_high")]).orderBy("lang")


@query("method_summary", """
select lang, count(*) as n, round(avg(quality::double), 9) as success_rate, round(avg(toxic::double), 9) as risk_rate,
       cast(sum(case when quality = 0 then 1 else 0 end) as bigint) as initial_failures,
       cast(sum(case when quality = 0 and toxic = 0 then 1 else 0 end) as bigint) as recovered,
       round(sum(case when quality = 0 and toxic = 0 then 1 else 0 end)::double / nullif(sum(case when quality = 0 then 1 else 0 end), 0), 9) as conditional_recovery
from documents join labels using (doc_id) group by lang""")
def method_summary(spark, d):
    o = outcomes(spark, d)
    rates = o.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("good").cast("double")), 9).alias("success_rate"), F.round(F.avg(F.col("toxic").cast("double")), 9).alias("risk_rate"))
    rec = recovery(o, ["lang"], F.col("good"), ~F.col("toxic"))
    return rates.join(rec, "lang").withColumn("conditional_recovery", F.round("conditional_recovery", 9))


@query("stratified_summary", """
select 'lang' as field, lang as value, toxic = 1 as method, count(*) as n, cast(sum(quality) as bigint) as good from documents join labels using (doc_id) group by 2, 3
union all select 'source', source, toxic = 1, count(*), cast(sum(quality) as bigint) from documents join labels using (doc_id) group by 2, 3""")
def stratified_summary(spark, d):
    o = outcomes(spark, d).withColumnRenamed("toxic", "method")
    return strata(o, ["lang", "source"], "method", [F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good")])


@query("map_merge_counts", """
select region, string_agg(event_type || '=' || n, ',' order by event_type) as counts
from (select user_id % 10 as region, event_type, count(*) as n from events group by 1, 2) group by region""")
def map_merge_counts(spark, d):
    per_user = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = per_user.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts"))
    merged = merge_maps(maps.withColumn("region", F.col("user_id") % 10), ["region"], "counts")
    text = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return merged.select("region", text.alias("counts"))


@query("cost_rollup", """
select conv_id, count(*) as calls, cast(sum(case when role = 'user' then length(text) else 0 end) as bigint) as tokens_in,
       cast(sum(case when role = 'user' then 0 else length(text) end) as bigint) as tokens_out,
       case when bool_and(role <> 'system') then round(sum((case when role = 'user' then length(text) else 0 end * 2.0::double + case when role = 'user' then 0 else length(text) end * 6.0::double) / 1e6::double), 9) end as cost,
       case when bool_and(role <> 'system') then 'estimated' else 'pricing_not_configured' end as status
from conversations group by conv_id""")
def cost_rollup(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "role", F.length("text").cast("long").alias("chars"))
    asked = F.col("role") == "user"
    calls = c.select("conv_id", F.when(asked, F.col("chars")).otherwise(0).alias("tokens_in"), F.when(asked, 0).otherwise(F.col("chars")).cast("long").alias("tokens_out"), (F.col("role") != "system").alias("priced"))
    return costs(calls, ["conv_id"], F.when(F.col("priced"), 2.0), F.lit(6.0)).withColumn("cost", F.round("cost", 9))


@query("search_effort", """select l_suppkey, cast(sum(l_linenumber) as bigint) as explored, round(sum(l_tax), 6) as seconds from lineitem group by l_suppkey""")
def search_effort(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_linenumber").alias("explored"), F.round(F.sum("l_tax"), 6).alias("seconds"))


@query("validation_summary", """
select coalesce(o_orderstatus, 'all') as stratum, count(*) as n, round(avg(case when o_totalprice > 100000 then 1.0::double else 0 end), 9) as executable_rate,
       round(avg(o_totalprice), 4) as mean_size from orders group by grouping sets ((), (o_orderstatus))""")
def validation_summary(spark, d):
    o = table(spark, d, "orders")
    g = o.groupingSets([[], [F.col("o_orderstatus")]], F.col("o_orderstatus"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("o_totalprice") > 100000).cast("double")), 9).alias("executable_rate"), F.round(F.avg("o_totalprice"), 4).alias("mean_size")).select(
        F.coalesce("o_orderstatus", F.lit("all")).alias("stratum"), "n", "executable_rate", "mean_size")


PLANS_SQL = """select o_orderkey, o_orderpriority, count(l_linenumber) as plan_length, count(distinct l_suppkey) as objects, count(distinct l_returnflag) as goals
from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2"""


def order_plans(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("plan_length"), F.count_distinct("l_suppkey").alias("objects"), F.count_distinct("l_returnflag").alias("goals"))
    return o.join(li, "o_orderkey", "left").fillna(0, ["plan_length", "objects", "goals"])


DIFFICULTY_SQL = "case when plan_length <= 4 and goals <= 2 and objects <= 8 then 'easy' when plan_length <= 12 and goals <= 6 and objects <= 20 then 'medium' else 'hard' end"


@query("difficulty_label", f"select o_orderkey, 'difficulty:' || {DIFFICULTY_SQL} as tag from ({PLANS_SQL})")
def difficulty_label(spark, d):
    return order_plans(spark, d).select("o_orderkey", F.concat(F.lit("difficulty:"), difficulty(F.col("plan_length"), F.col("goals"), F.col("objects"))).alias("tag"))


@query("taskset_profile", f"""select {DIFFICULTY_SQL} as label, count(*) as n, round(coalesce(avg(plan_length), 0), 9) as mean_length, cast(coalesce(max(plan_length), 0) as bigint) as max_length
from ({PLANS_SQL}) group by 1""")
def taskset_profile(spark, d):
    p = order_plans(spark, d).withColumn("label", difficulty(F.col("plan_length"), F.col("goals"), F.col("objects")))
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg("plan_length"), F.lit(0.0)), 9).alias("mean_length"), F.coalesce(F.max("plan_length"), F.lit(0)).cast("long").alias("max_length"))


@query("telemetry_conditional", """
select user_id, count(*) as calls, count(*) filter (where event_type = 'error') as failed, count(*) filter (where event_type = 'purchase') as succeeded, round(sum(value), 6) as latency,
       case when bool_and(value > 0) then round(sum(value) / 100, 6) end as cost from events group by user_id""")
def telemetry_conditional(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "purchase").alias("succeeded"),
        F.round(F.sum("value"), 6).alias("latency"), F.round(F.when(F.bool_and(F.col("value") > 0), F.sum("value") / 100), 6).alias("cost"))


@query("score_distribution", """
select l_returnflag, min(l_discount) as least, quantile_cont(l_discount, 0.5) as median, round(quantile_cont(l_discount, 0.9), 9) as p90, max(l_discount) as most,
       count(*) filter (where l_discount = 0) as zeros from lineitem group by 1""")
def score_distribution(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.min("l_discount").alias("least"), F.percentile("l_discount", 0.5).alias("median"), F.round(F.percentile("l_discount", 0.9), 9).alias("p90"), F.max("l_discount").alias("most"), F.count_if(F.col("l_discount") == 0).alias("zeros"))


@query("family_two_level_mean", """
with f as (select s_nationkey, s_suppkey, avg(l_discount - l_tax) as uplift, count(*) as n, sum(l_discount - l_tax) as total from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2)
select s_nationkey, round(sum(total) / sum(n), 9) as task_weighted, round(avg(uplift), 9) as equal_family, count(*) as families from f group by 1""")
def family_two_level_mean(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_discount") - F.col("l_tax")).alias("u"))
    f = li.groupBy("l_suppkey").agg(F.sum("u").alias("total"), F.count(F.lit(1)).alias("n"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return f.join(s, "l_suppkey").groupBy("s_nationkey").agg(
        F.round(F.sum("total") / F.sum("n"), 9).alias("task_weighted"), F.round(F.avg(F.col("total") / F.col("n")), 9).alias("equal_family"), F.count(F.lit(1)).alias("families"))


@query("call_budget", """
select cast(t * s * p as bigint) as first_calls, cast(t * s * 2 * 1 * p as bigint) as retry_calls, cast(t * s * p * 3 as bigint) as worst_case
from (select (select count(*) from customer) as t, (select count(distinct c_mktsegment) from customer) as s, (select count(distinct o_orderpriority) from orders) as p)""")
def call_budget(spark, d):
    c = table(spark, d, "customer").agg(F.count(F.lit(1)).alias("t"), F.count_distinct("c_mktsegment").alias("s"), F.lit(1).alias("k"))
    o = table(spark, d, "orders").agg(F.count_distinct("o_orderpriority").alias("p"), F.lit(1).alias("k"))
    return c.join(o, "k").select((F.col("t") * F.col("s") * F.col("p")).alias("first_calls"), (F.col("t") * F.col("s") * 2 * F.col("p")).alias("retry_calls"), (F.col("t") * F.col("s") * F.col("p") * 3).alias("worst_case"))


@query("failure_profile", """select coalesce(nullif(event_type, ''), 'unknown') as error_type, count(*) as n, bool_and(value >= 0) as all_scored from events group by 1""")
def failure_profile(spark, d):
    return table(spark, d, "events").groupBy(or_unknown(F.col("event_type")).alias("error_type")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("value") >= 0).alias("all_scored"))


@query("status_counts", """select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as failed, count(*) filter (where o_orderstatus <> 'F') as succeeded,
case when count(*) filter (where o_orderstatus = 'F') = 0 then 'succeeded' else 'partial' end as final_status from orders group by 1""")
def status_counts(spark, d):
    failed = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(failed.alias("failed"), F.count_if(F.col("o_orderstatus") != "F").alias("succeeded"), F.when(failed == 0, "succeeded").otherwise("partial").alias("final_status"))


@query("metric_gap", """
with o as (select count(*) as n, sum(quality) as q, sum(toxic) as t from labels), d as (select count(*) as docs from documents)
select round(n::double / docs, 9) as coverage, round(abs(q - t)::double / n, 9) as gap, round(coalesce(t::double / nullif(q, 0), 0), 9) as guarded from o, d""")
def metric_gap(spark, d):
    o = table(spark, d, "labels").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("q"), F.sum("toxic").alias("t"), F.lit(1).alias("k"))
    docs = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("docs"), F.lit(1).alias("k"))
    return o.join(docs, "k").select(F.round(F.col("n") / F.col("docs"), 9).alias("coverage"), F.round(F.abs(F.col("q") - F.col("t")) / F.col("n"), 9).alias("gap"), F.round(ratio0(F.col("t"), F.col("q")), 9).alias("guarded"))


TYPES_SQL = "select user_id, max(case when event_type = 'click' and value > 50 then 1 else 0 end) as click, max(case when event_type = 'view' and value > 50 then 1 else 0 end) as view, max(case when event_type = 'purchase' and value > 50 then 1 else 0 end) as purchase, max(case when event_type = 'error' and value > 50 then 1 else 0 end) as error from events group by user_id"


@query("all_pairs_mcnemar", f"""
with w as ({TYPES_SQL}), l as (unpivot w on click, view, purchase, error into name method value ok),
p as (select a.method as left_method, b.method as right_method, count(*) as n, count(*) filter (where a.ok = 1 and b.ok = 0) as b, count(*) filter (where a.ok = 0 and b.ok = 1) as c
      from l a join l b on a.user_id = b.user_id and a.method < b.method group by 1, 2)
select left_method, right_method, n, b, c, round(case when b + c = 0 then 1.0::double else least(1.0::double,
  2 * list_sum(list_transform(range(0, (least(b, c) + 1)::bigint), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::double))))) end, 8) as p_value from p""")
def all_pairs_mcnemar(spark, d):
    names = ["click", "view", "purchase", "error"]
    e = table(spark, d, "events")
    wide = e.groupBy("user_id").agg(*[F.max(((F.col("event_type") == n) & (F.col("value") > 50)).cast("int")).alias(n) for n in names])
    long = wide.unpivot("user_id", names, "method", "ok")
    a, b = (long.select("user_id", F.col("method").alias(f"{s}_method"), F.col("ok").alias(f"{s}_ok")) for s in ("left", "right"))
    p = a.join(b, "user_id").filter("left_method < right_method").groupBy("left_method", "right_method").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.expr("left_ok = 1 and right_ok = 0")).alias("b"), F.count_if(F.expr("left_ok = 0 and right_ok = 1")).alias("c"))
    return p.select("*", F.round(mcnemar(F.col("b"), F.col("c")), 8).alias("p_value"))


EFFECTS_SQL = "select source as family, avg(quality::double) - avg(1 - toxic::double) as effect, row_number() over (order by source) - 1 as i from documents join labels using (doc_id) where source < 'src17' group by source"


@query("sign_flip", f"""
with e as ({EFFECTS_SQL}), k as (select count(*) as k, abs(avg(effect)) as seen from e), m as (select unnest(range(0, (1 << k)::bigint)) as mask, seen from k),
s as (select mask, abs(avg(case when (mask >> i) & 1 = 1 then -effect else effect end)) as mean, any_value(seen) as seen from m, e group by mask)
select (select k from k) as families, round(count(*) filter (where mean >= seen - 1e-12)::double / count(*), 9) as p_value from s""")
def sign_flip(spark, d):
    """Exact: every sign pattern of the families' effects; at most a few dozen families make sense."""
    o = outcomes(spark, d).filter(F.col("source") < "src17")
    e = o.groupBy("source").agg((F.avg(F.col("good").cast("double")) - F.avg(1 - F.col("toxic").cast("double"))).alias("effect"))
    arr = e.agg(F.transform(F.array_sort(F.collect_list(F.struct("source", "effect"))), lambda x: x["effect"]).alias("effects"))
    masks = arr.select("effects", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, size(effects)) - 1"))).alias("mask"))
    mean = F.expr("abs(aggregate(transform(effects, (x, i) -> if(shiftright(mask, i) & 1 = 1, -x, x)), 0D, (s, x) -> s + x)) / size(effects)")
    seen = F.expr("abs(aggregate(effects, 0D, (s, x) -> s + x)) / size(effects)")
    return masks.agg(F.max(F.size("effects")).cast("long").alias("families"), F.round(F.avg((mean >= seen - 1e-12).cast("double")), 9).alias("p_value"))


def sign_flip_share(spark, effects: list[float]) -> float:
    """Share of all 2^k sign patterns whose mean is at least as far from 0 as the one seen; exact.

    The sums of up to 20 effects are sorted once; the patterns of the others are a
    distributed table, and each finds by bisection how many of the sorted sums go with it.
    """
    import numpy as np
    import pyarrow as pa

    k = len(effects)
    if not k:
        return float("nan")
    if k > 60:
        raise ValueError(f"{k} families have too many sign patterns for the exact test")
    values = np.array(effects, float)
    near = min(k // 2, 20)
    sums = lambda masks, x: (1 - 2 * ((masks[:, None] >> np.arange(len(x))) & 1)).astype(float) @ x
    least = abs(values.sum()) - 1e-12 * k
    if least <= 0:
        return 1.0
    known = spark.sparkContext.broadcast((np.sort(np.concatenate([sums(np.arange(a, min(a + 65_536, 1 << near)), values[:near]) for a in range(0, 1 << near, 65_536)])), values[near:], least))

    def count(batches):
        known_sums, far, bound = known.value
        for batch in batches:
            a = sums(batch.column("id").to_numpy(), far)
            above = len(known_sums) - np.searchsorted(known_sums, bound - a, "left")
            below = np.searchsorted(known_sums, -bound - a, "right")
            yield pa.RecordBatch.from_arrays([pa.array([int(above.sum() + below.sum())], pa.int64())], ["n"])

    n = spark.range(1 << (k - near)).mapInArrow(count, "n long").agg(F.sum(F.col("n").cast("decimal(38,0)"))).first()[0]
    return int(n) / (1 << k)


@query("sign_flip_all")
def sign_flip_all(spark, d):
    """As ``sign_flip``, over every source: its SQL, which makes each pattern, keeps to the first of them."""
    e = outcomes(spark, d).groupBy("source").agg((F.avg(F.col("good").cast("double")) - F.avg(1 - F.col("toxic").cast("double"))).alias("effect"))
    effects = [r["effect"] for r in e.filter("effect is not null").orderBy("source").collect()]
    return spark.createDataFrame([(len(effects), round(sign_flip_share(spark, effects), 9))], "families long, p_value double")


@query("paired_difference", """select lang, round(avg(quality - toxic), 9) as mean_difference, count(*) as n from documents join labels using (doc_id) group by lang""")
def paired_difference(spark, d):
    o = outcomes(spark, d)
    return o.groupBy("lang").agg(F.round(F.coalesce(F.avg(F.col("good").cast("int") - F.col("toxic").cast("int")), F.lit(0.0)), 9).alias("mean_difference"), F.count(F.lit(1)).alias("n"))


_ROUNDED = ", ".join(f"round({c}, 9) as {c}" for c in ("uplift", "low", "high", "family_uplift", "family_low", "family_high"))
FAMILIES_SQL = "(select lang, source, sum(quality - toxic) as total, count(*) as n from documents join labels using (doc_id) group by 1, 2)"


@query("cluster_bootstrap", f"select lang, {_ROUNDED} from ({cluster_bounds_sql(FAMILIES_SQL, 'lang', 'source')})")
def cluster_bootstrap(spark, d):
    """Mean difference by language with the interval of 10,000 draws of whole sources, over rows and over sources."""
    f = outcomes(spark, d).groupBy("lang", "source").agg(F.sum(F.col("good").cast("int") - F.col("toxic").cast("int")).alias("total"), F.count(F.lit(1)).alias("n"))
    c = cluster_bounds(f, "lang", "source")
    return c.select("lang", *[F.round(x, 9).alias(x) for x in c.columns if x != "lang"])


def paired(spark, d):
    return outcomes(spark, d).select("lang", "doc_id", (F.col("good").cast("int") - F.col("toxic").cast("int")).cast("double").alias("x"))


_PAIRED_SQL = "(select lang, doc_id, (quality - toxic)::double as x from documents join labels using (doc_id))"


@query("paired_bootstrap_bounds", f"select lang, round(uplift, 9) as uplift, round(low, 9) as low, round(high, 9) as high from ({paired_bounds_sql(_PAIRED_SQL, 'lang', 'doc_id')})")
def paired_bootstrap_bounds(spark, d):
    """Mean difference by language with the percentile interval of 2,000 samples of its rows."""
    c = paired_bounds(paired(spark, d), "lang", "doc_id")
    return c.select("lang", *[F.round(x, 9).alias(x) for x in ("uplift", "low", "high")])


@query("paired_bootstrap", f"select lang, round(uplift, 9) as uplift, uplift between low and high as inside from ({paired_bounds_sql(_PAIRED_SQL, 'lang', 'doc_id')})")
def paired_bootstrap(spark, d):
    """Whether the mean difference lies in the interval of ``paired_bootstrap_bounds``."""
    return paired_bounds(paired(spark, d), "lang", "doc_id").select("lang", F.round("uplift", 9).alias("uplift"), ((F.col("uplift") >= F.col("low")) & (F.col("uplift") <= F.col("high"))).alias("inside"))


@query("contrast_catalogue", """
with o as (select lang, 'quality' as metric, quality::double as x from documents join labels using (doc_id) union all select lang, 'safe', 1 - toxic::double from documents join labels using (doc_id)),
r as (select lang, metric, count(*) as n, avg(x) as rate from o group by 1, 2)
select a.metric, a.lang as left_group, b.lang as right_group, a.n as left_n, b.n as right_n, round(a.rate, 9) as left_rate, round(b.rate, 9) as right_rate, round(a.rate - b.rate, 9) as difference,
  round(sqrt(a.rate * (1 - a.rate) / a.n + b.rate * (1 - b.rate) / b.n), 9) as standard_error from r a join r b on a.metric = b.metric and a.lang < b.lang""")
def contrast_catalogue(spark, d):
    """Every pair of groups by every metric. The documents are read once; pairs are made of their few sums."""
    o = outcomes(spark, d)
    long = o.select("lang", F.explode(F.create_map(F.lit("quality"), F.col("good").cast("double"), F.lit("safe"), 1 - F.col("toxic").cast("double"))).alias("metric", "x"))
    rates = long.groupBy("lang", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("rate"))
    a, b = (rates.select("metric", F.col("lang").alias(f"{side}_group"), F.col("n").alias(f"{side}_n"), F.col("rate").alias(f"{side}_rate")) for side in ("left", "right"))
    variance = lambda side: F.col(f"{side}_rate") * (1 - F.col(f"{side}_rate")) / F.col(f"{side}_n")
    met = a.join(b, "metric").filter("left_group < right_group")
    return met.select("metric", "left_group", "right_group", "left_n", "right_n", F.round("left_rate", 9).alias("left_rate"), F.round("right_rate", 9).alias("right_rate"),
                      F.round(F.col("left_rate") - F.col("right_rate"), 9).alias("difference"), F.round(F.sqrt(variance("left") + variance("right")), 9).alias("standard_error"))


@query("cell_export", """select doc_id, lang, source, case when quality is null then 'unlabelled' when toxic = 1 then 'unsafe' when quality = 1 then 'pass' else 'fail' end as verdict, coalesce(quality = 1 and toxic = 0, false) as in_cohort from documents left join labels using (doc_id)""")
def cell_export(spark, d):
    """Every row with its verdict, labelled or not, and whether the cohort takes it."""
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    verdict = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("toxic") == 1, "unsafe").when(F.col("quality") == 1, "pass").otherwise("fail")
    return rows.select("doc_id", "lang", "source", verdict.alias("verdict"), F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)).alias("in_cohort"))


@query("ordered_equality", """select l_orderkey, list(l_linenumber order by l_linenumber) = list(l_linenumber order by l_shipdate, l_linenumber) as in_order, count(*) as lines from lineitem group by 1""")
def ordered_equality(spark, d):
    """Whether an order's lines ship in the order of their numbers: two lists are equal if they are so place by place."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("a"), F.array_sort(F.collect_list(F.struct("l_shipdate", "l_linenumber"))).alias("b"))
    return lines.select("l_orderkey", (F.col("a") == F.transform("b", lambda x: x["l_linenumber"])).alias("in_order"), F.size("a").cast("long").alias("lines"))
