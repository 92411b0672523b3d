"""Scalar functions over text, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom.functions import numeric as N
from planloom.functions import text as X
from planloom.operators.relational import ranked
from planloom.plans.register import query, table

CALL_SQL = r"""'^\s*([A-Za-z0-9_\-]+)\s*\((.*)\)\s*$'"""


@query("call_parse", rf"""
with c as (select event_id, event_type || '(' || user_id || ', ' || round(value, 0)::bigint || ')' as call from events)
select event_id, regexp_extract(call, {CALL_SQL}, 1) as name, list_transform(string_split(regexp_extract(call, {CALL_SQL}, 2), ','), lambda x: trim(x))[1] as first_arg, len(string_split(regexp_extract(call, {CALL_SQL}, 2), ',')) as args from c""")
def call_parse(spark, d):
    call = X.format_call(F.col("event_type"), F.array(F.col("user_id").cast("string"), F.rint("value").cast("long").cast("string")))
    e = table(spark, d, "events").select("event_id", call.alias("call"))
    return e.select("event_id", X.call_name(F.col("call")).alias("name"), F.get(X.call_args(F.col("call")), 0).alias("first_arg"), F.size(X.call_args(F.col("call"))).cast("long").alias("args"))


@query("predicate_names", r"""
with f as (select event_id, case when event_id % 2 = 0 then 'not(' || event_type || '(' || user_id || '))' else upper(event_type) || ' (x)' end as fact from events)
select event_id, trim(string_split(regexp_replace(trim(fact), '^not\((.*)\)$', '\1'), '(')[1]) as bare, string_split(trim(string_split(lower(fact), '(')[1]), ' ')[1] as linked from f""")
def predicate_names(spark, d):
    fact = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("not("), "event_type", F.lit("("), F.col("user_id").cast("string"), F.lit("))"))).otherwise(F.concat(F.upper("event_type"), F.lit(" (x)")))
    e = table(spark, d, "events").select("event_id", fact.alias("fact"))
    return e.select("event_id", X.inner_predicate(F.col("fact")).alias("bare"), X.linked_predicate(F.col("fact")).alias("linked"))


@query("tokenise", "select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) as tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) as distinct_tokens from documents")
def tokenise(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"))


@query("normalise", r"select page_id, trim(regexp_replace(lower(url), '\s+', ' ', 'g')) as url from pages")
def normalise(spark, d):
    return table(spark, d, "pages").select("page_id", X.normalised(F.col("url")).alias("url"))


@query("humanise", r"select p_partkey, trim(regexp_replace(translate(p_type, '_-', '  '), '\s+', ' ', 'g')) as label, coalesce(nullif(trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') as id from part")
def humanise(spark, d):
    return table(spark, d, "part").select("p_partkey", X.humanised(F.col("p_type")).alias("label"), X.clean_id(F.lower(F.concat_ws(" ", "p_brand", "p_name"))).alias("id"))


@query("plan_steps", "select o_orderkey, lower(o_orderstatus) || '(' || o_orderpriority || ', ' || o_custkey || ')' as step from orders where o_orderpriority not like '% %' union all select o_orderkey, lower(o_orderstatus) || '(' || replace(o_orderpriority, ' ', ', ') || ', ' || o_custkey || ')' from orders where o_orderpriority like '% %'")
def plan_steps(spark, d):
    step = F.concat_ws(" ", F.lower("o_orderstatus"), "o_orderpriority", F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", X.plan_step(step).alias("step"))


@query("affordance_flag", r"select event_id, regexp_matches(event_type || '(x)', '^(click|view)\(') as affordance from events")
def affordance_flag(spark, d):
    return table(spark, d, "events").select("event_id", X.is_affordance(F.concat("event_type", F.lit("(x)")), ["click", "view"]).alias("affordance"))


@query("slot_substitution", "select c_custkey, replace(replace('move(' || c_name || ', ' || c_mktsegment || ')', c_mktsegment, 'DEPOT'), c_name, 'cup') as action from customer")
def slot_substitution(spark, d):
    action = F.format_string("move(%s, %s)", "c_name", "c_mktsegment")
    old = F.create_map(F.lit("destination"), F.col("c_mktsegment"), F.lit("object"), F.col("c_name"), F.lit("tool"), F.lit("none"))
    new = F.create_map(F.lit("destination"), F.lit("DEPOT"), F.lit("object"), F.lit("cup"))
    return table(spark, d, "customer").select("c_custkey", X.substitute_slots(action, old, new).alias("action"))


@query("payload_extraction", r"""
with r as (select event_id, case event_id % 3 when 0 then 'Plan: ```json' || chr(10) || '["a"]' || chr(10) || '``` done' when 1 then 'so [' || event_type || '] ok' else ' plain ' end as t from events)
select event_id, coalesce(nullif(trim(regexp_extract(t, '(?is)```(?:json|python)?\s*(.*?)```', 1), chr(10) || ' '), ''), nullif(regexp_extract(t, '(?s)(\[.*\])', 1), ''), trim(t)) as payload from r""")
def payload_extraction(spark, d):
    m = F.col("event_id") % 3
    t = F.when(m == 0, F.lit('Plan: ```json\n["a"]\n``` done')).when(m == 1, F.concat(F.lit("so ["), "event_type", F.lit("] ok"))).otherwise(F.lit(" plain "))
    p = table(spark, d, "events").select("event_id", X.payload(t).alias("payload"))
    return p.select("event_id", F.btrim("payload", F.lit("\n ")).alias("payload"))


@query("json_parse_actions", """select event_id, case when json_valid(props) then 'object' else 'bad' end as kind, len(json_keys(props)) as fields from events where json_valid(props)""")
def json_parse_actions(spark, d):
    """Bad JSON gives an issue row, not an error."""
    v = F.try_parse_json("props")
    e = table(spark, d, "events").select("event_id", "props", v.alias("v")).filter("v is not null")
    return e.select("event_id", F.when(F.schema_of_variant("v").startswith("OBJECT"), "object").otherwise("bad").alias("kind"), F.size(F.json_object_keys("props")).cast("long").alias("fields"))


@query("candidate_list", """select p_brand, string_agg(p_partkey::varchar, ', ' order by p_partkey) filter (where i <= 8) || case when max(n) > 8 then ', ... (+' || (max(n) - 8) || ')' else '' end as candidates
from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) as i, count(*) over (partition by p_brand) as n from part) group by 1""")
def candidate_list(spark, d):
    """First eight ids and how many more; only those eight are gathered."""
    part = table(spark, d, "part").select("p_brand", "p_partkey")
    n = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    top = ranked(part, ["p_brand"], [F.col("p_partkey")], 8).groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("ids"))
    more = F.when(F.col("n") > 8, F.concat(F.lit(", ... (+"), (F.col("n") - 8).cast("string"), F.lit(")"))).otherwise("")
    return top.join(n, "p_brand").select("p_brand", F.concat(F.array_join(F.transform("ids", lambda x: x.cast("string")), ", "), more).alias("candidates"))


@query("retrieval_document", """select doc_id, array_to_string(list_filter([lang, source, case when quality = 1 then 'good' else '' end, coalesce(n_chars::varchar, '')], lambda x: x is not null and x <> ''), ' ') as text from documents left join labels using (doc_id)""")
def retrieval_document(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    parts = F.array("lang", "source", F.when(F.col("quality") == 1, "good").otherwise(""), F.coalesce(F.col("n_chars").cast("string"), F.lit("")))
    return docs.select("doc_id", F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ").alias("text"))


@query("prompt_projection", r"""select o_orderkey, 'Task: ' || o_orderpriority || chr(10) || 'Goal: ' || o_orderstatus || chr(10) || 'Return a list of actions.' as prompt from orders""")
def prompt_projection(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws("\n", F.concat(F.lit("Task: "), "o_orderpriority"), F.concat(F.lit("Goal: "), "o_orderstatus"), F.lit("Return a list of actions.")).alias("prompt"))


@query("usage_fallback", "select event_id, coalesce(try_cast(json_extract_string(props, '$.tokens') as bigint), try_cast(json_extract_string(props, '$.page') as bigint), 0) as tokens, round((value * 2.0::double + user_id * 6.0::double) / 1e6::double, 12) as cost from events")
def usage_fallback(spark, d):
    v = lambda k: F.get_json_object("props", f"$.{k}").try_cast("bigint")
    return table(spark, d, "events").select("event_id", F.coalesce(v("tokens"), v("page"), F.lit(0).cast("long")).alias("tokens"), F.round((F.col("value") * 2.0 + F.col("user_id") * 6.0) / 1e6, 12).alias("cost"))


@query("feature_hash_embedding", """
with t as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) as token from documents),
h as (select doc_id, ('0x' || substr(sha256(token), 1, 8))::bigint % 64 as i, sum(case when ('0x' || substr(sha256(token), 9, 2))::bigint % 2 = 0 then 1 else -1 end) as x from t group by 1, 2)
select doc_id, i, round(x / nullif(sqrt(sum(x * x) over (partition by doc_id)), 0), 6) as v from h where x <> 0""")
def feature_hash_embedding(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token"))
    sign = F.when(F.conv(F.substring(F.sha2("token", 256), 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    h = t.groupBy("doc_id", (N.hash_int(F.col("token"), sha="sha256") % 64).alias("i")).agg(F.sum(sign).alias("x")).filter("x <> 0")
    norm = h.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return h.join(norm, "doc_id").select("doc_id", "i", F.round(F.col("x") / F.col("norm"), 6).alias("v"))


@query("contract_rules", """
select event_id, code from (select event_id, unnest([case when props is null then 'missing_output' end, case when props is not null and not json_valid(props) then 'invalid_json' end,
  case when event_type not in ('click', 'view', 'purchase', 'signup') then 'unsupported_action' end, case when value < 1 then 'name_id_pairs_required' end]) as code from events) where code is not null""")
def contract_rules(spark, d):
    """One row per broken rule."""
    rules = [F.when(F.col("props").isNull(), "missing_output"), F.when(F.col("props").isNotNull() & F.try_parse_json("props").isNull(), "invalid_json"),
             F.when(~F.col("event_type").isin("click", "view", "purchase", "signup"), "unsupported_action"), F.when(F.col("value") < 1, "name_id_pairs_required")]
    return table(spark, d, "events").select("event_id", F.explode(F.array_compact(F.array(*rules))).alias("code"))


@query("translate_exclude", """
with s as (select l_orderkey, l_linenumber, case when l_quantity > 45 then 'unsupported' when l_discount > 0.095::double then 'ambiguous' end as code from lineitem)
select l_orderkey, arg_min(code, (l_linenumber, code)) as code, min(l_linenumber) as step from s where code is not null group by 1""")
def translate_exclude(spark, d):
    """First failing step of each plan; plans without one are exportable."""
    code = F.when(F.col("l_quantity") > 45, "unsupported").when(F.col("l_discount") > 0.095, "ambiguous")
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code")).filter("code is not null")
    return s.groupBy("l_orderkey").agg(F.min_by("code", F.struct("l_linenumber", "code")).alias("code"), F.min("l_linenumber").alias("step"))


@query("prompt_object_ids", r"""select page_id, len(regexp_extract_all(html, 'href="/([^"]+)"', 1)) as links, len(list_distinct(regexp_extract_all(html, 'href="/([^"]+)"', 1))) as names from pages""")
def prompt_object_ids(spark, d):
    links = F.regexp_extract_all("html", F.lit(r'href="/([^"]+)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("links"), F.size(F.array_distinct(links)).cast("long").alias("names"))


@query("report_lines", """select lang, '| ' || lang || ' | ' || printf('%.3f', avg(quality::double)) || ' | ' || count(*) || ' |' as line from documents join labels using (doc_id) group by lang""")
def report_lines(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.format_string("| %s | %.3f | %d |", F.first("lang"), F.avg(F.col("quality").cast("double")), F.count(F.lit(1))).alias("line"))
