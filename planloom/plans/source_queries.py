"""Readers and sinks over files that Spark writes from the driver's tables into the shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from planloom.functions.canonical import canonical_row
from planloom.operators.graph_search import task_edges
from planloom.plans.graph_search_queries import TASKS_SQL, customer_tasks
from planloom.plans.register import query, table
from planloom.sources import cells, records
from planloom.sources.scratch import shared_dir


def _folder(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("task_jsonl_scan", f"""with {TASKS_SQL} select family, 'eval' as split, count(*) as n, cast(sum(coalesce(len_, 0)) as bigint) as steps from cu left join (select id, count(*) as len_ from st group by 1) using (id) group by 1""")
def task_jsonl_scan(spark, d):
    """Tasks written as JSON lines and read back typed, with defaults for what they leave out."""
    path = _folder(spark, "tasks-jsonl")
    tasks = customer_tasks(spark, d).select("id", "instruction", F.create_map(F.lit("task_family"), "family").alias("slots"), "initial_facts", "goal_facts", "allowed_actions", F.when(F.size("gold_plan") > 0, F.col("gold_plan")).alias("gold_plan"))
    records.write_jsonl(tasks, path)
    t = records.read_tasks(spark, path)
    return t.groupBy(t["slots"]["task_family"].alias("family"), "split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("gold_plan")).alias("steps"))


@query("edge_jsonl_scan", f"with {TASKS_SQL} select relation, count(*) as n, count(distinct id) as tasks from ed group by 1")
def edge_jsonl_scan(spark, d):
    """Edges of the task graph written as JSON lines and read back; one without a required key would raise."""
    path = _folder(spark, "edges-jsonl")
    records.write_jsonl(task_edges(customer_tasks(spark, d)), path)
    return records.read_edges(spark, path).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("task_id").alias("tasks"))


@query("strict_jsonl_scan", "select ('0' || json_extract_string(props, '$.k'))::bigint % 10 as digit, count(*) as n from events where props is not null group by 1")
def strict_jsonl_scan(spark, d):
    """Untyped JSON objects, a line each; any other line would raise."""
    path = _folder(spark, "props-jsonl")
    table(spark, d, "events").filter("props is not null").select(F.col("props").alias("value")).write.text(path)
    k = F.coalesce(F.try_variant_get("record", "$.k", "bigint"), F.lit(0))
    return records.read_strict(spark, path).groupBy((k % 10).alias("digit")).agg(F.count(F.lit(1)).alias("n"))


@query("canonical_json_digest", """
with l as (select l_orderkey, string_agg('{"flag":"' || l_returnflag || '","line":' || l_linenumber || ',"ship":{"status":"' || l_linestatus || '"}}', ',' order by l_linenumber, l_returnflag, l_linestatus) as lines from lineitem group by 1)
select l_orderkey, sha256('{"key":' || l_orderkey || ',"lines":[' || lines || '],"none":null}') as sha256 from l""")
def canonical_json_digest(spark, d):
    """SHA-256 of each order's canonical JSON: keys sorted at every depth, whatever the order of columns and fields."""
    line = F.struct("l_linenumber", "l_returnflag", "l_linestatus")
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("s"))
    nested = F.transform("s", lambda x: F.struct(F.struct(x["l_linestatus"].alias("status")).alias("ship"), x["l_linenumber"].cast("double").alias("line"), x["l_returnflag"].alias("flag")))
    o = o.select(nested.alias("lines"), F.lit(None).cast("string").alias("none"), F.col("l_orderkey").alias("key"))
    return o.select(F.col("key").alias("l_orderkey"), F.sha2(canonical_row(o.schema), 256).alias("sha256"))


@query("checked_write", "select count(*) as rows, count(distinct event_id) as keys, false as written_again from events")
def checked_write(spark, d):
    """Events written with unique keys and required fields checked by the job that writes them, and written again, which changes nothing."""
    path, e = _folder(spark, "events-checked"), table(spark, d, "events")
    first = records.write_checked(e, path, unique="event_id", required=["event_type"])
    again = records.write_checked(e.select(*reversed(e.columns)), path)
    assert first["digest"] == again["digest"]
    return spark.read.schema(e.schema).parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("keys")).withColumn("written_again", F.lit(again["written"]))


@query("export_manifest", "select o_orderstatus, count(*) as n from orders group by 1")
def export_manifest(spark, d):
    """Orders exported as JSON lines by status, and the counts of what was written."""
    return records.export_by(table(spark, d, "orders"), _folder(spark, "orders-export"), "o_orderstatus")


@query("write_once_rows", "select c_mktsegment, count(*) as n, cast(sum(c_nationkey) as bigint) as nations from customer group by 1")
def write_once_rows(spark, d):
    """Customers written by the sink that commits once, confirmed by a second write, and read back from its lines."""
    cells.register(spark)
    path, c = _folder(spark, "customers-once"), table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    for part in (c, c.repartition(3)):
        part.write.format("write_once").mode("append").save(path)
    back = spark.read.schema(c.schema).option("pathGlobFilter", "part-*").json(path)
    return back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_nationkey").alias("nations"))
