"""A group of more rows than one task may put in order is dealt out by ranges, with the same sample."""

import random

import pytest
from pyspark.sql import functions as F

from planloom.operators import relational


@pytest.mark.parametrize("limit", [1, 7, 0])
def test_large_groups_are_dealt_out(spark, monkeypatch, limit):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randrange(9) if i % 8 else None, i) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, x int, id int")
    sample = lambda: sorted(map(tuple, relational.spread_sample(df, ["g"], [F.col("x").desc(), F.col("id")], limit).collect()), key=repr)
    whole = sample()
    monkeypatch.setattr(relational, "PART_ROWS", 40)
    assert sample() == whole
    plan = relational.spread_sample(df, ["g"], [F.col("x").desc(), F.col("id")], limit)._jdf.queryExecution().optimizedPlan().toString()
    assert "_p" in plan  # no window over a whole group of rows
