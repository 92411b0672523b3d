"""Plans replayed, repaired and replayed again in one row, against the join of two replays; each replay is one fold."""

from pyspark.sql import functions as F

from planloom.operators import replay as R
from planloom.plans.replay_queries import order_tasks


def test_rerun_equals_joined_replays_and_folds_once(spark):
    spec = lambda pre, add, gone=(): (list(pre), list(add), list(gone))
    model = {"a": spec([], ["x"]), "b": spec(["x"], ["y"], ["x"]), "c": spec(["openable(z)"], ["w"])}
    plans = [None, [], ["a"], ["a", "a", "b"], ["b"], ["a", "b", "b"], ["c"], ["nowhere"], ["reject()"], ["a", "b", "a", "a"]]
    rows = [(f"{i}-{j}-{n}", "s", "i", p, ["x"] if i % 2 else None, ["y"] if i % 3 else None, f, r, model)
            for i, p in enumerate(plans) for j, f in enumerate((None, ["a"])) for n, r in enumerate((None, True, False))]
    tasks = spark.createDataFrame(rows, R.TASK_SCHEMA)
    first = R.replay(tasks)
    final = R.replay(R.repair(first).withColumn("plan", F.col("repaired")).select(*tasks.columns))
    want = R.evaluate(first, final)
    got = R.rerun(tasks)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    folds = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")
    assert folds(R.replay(tasks).filter("status = 'failed'")) == 1
    assert folds(got) == 2


def test_orders_are_read_once(spark):
    plan = R.rerun(order_tasks(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
