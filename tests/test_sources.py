"""Data sources, constraints checked in the writing pass, and canonical JSON."""

import json
import os

import pytest
from pyspark.sql import functions as F

from planloom.functions.canonical import canonical_json, canonical_row, canonical_text
from planloom.sources import cells
from planloom.sources.records import content_digest, write_checked, write_once


@pytest.fixture
def formats(spark):
    cells.register(spark)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_cells_are_read_and_chosen_by_name(formats, tmp_path):
    texts = {"m1__p0__open": '{"rate": 0.5}', "m1__p1__open": '{"rate": 0.25}', "m2__p0__loop__x": "[1]", "m3": "{bad"}
    for name, text in texts.items():
        os.makedirs(tmp_path / name)
        (tmp_path / name / "summary.json").write_text(text)
    os.makedirs(tmp_path / "empty__cell__x")
    df = formats.read.format("result_cells").load(str(tmp_path))
    got = {(r.model, r.planner, r.harness, r.issue) for r in df.collect()}
    assert got == {("m1", "p0", "open", None), ("m1", "p1", "open", None), ("m2", "p0", "loop__x", "no_object"), ("m3", None, None, "invalid_json")}
    some = df.filter("model = 'm1' and planner in ('p1', 'p9')")
    assert [json.loads(r.summary) for r in some.collect()] == [{"rate": 0.25}]
    (tmp_path / "m1__p0__open" / "summary.json").unlink()
    os.mkdir(tmp_path / "m1__p0__open" / "summary.json")  # reading it would fail
    assert some.count() == 1 and df.filter("model = 'none'").count() == 0
    reader = cells.CellReader({"path": f"file://{tmp_path}"})
    assert list(reader.pushFilters([cells.EqualTo(("model",), "m1"), cells.EqualTo(("issue",), "x")])) == [cells.EqualTo(("issue",), "x")]
    assert len(reader.partitions()) == 2


def test_write_once_confirms_and_refuses(formats, tmp_path):
    path = str(tmp_path / "frozen")
    df = formats.createDataFrame([(i, "é" * (i % 3), None if i % 5 else 0.1 * i) for i in range(40)], "id long, text string, x double")
    save = lambda d: d.write.format("write_once").mode("append").save(path)
    save(df.repartition(3))
    files = sorted(os.listdir(path))
    save(df.orderBy(F.desc("id")).coalesce(2))  # the same rows in another order
    assert sorted(os.listdir(path)) == files and os.listdir(tmp_path) == ["frozen"]
    with pytest.raises(Exception, match="holds other rows"):
        save(df.withColumn("x", F.lit(1.0)))
    with pytest.raises(Exception, match="holds other rows"):
        save(df.limit(39))
    assert sorted(os.listdir(path)) == files and os.listdir(tmp_path) == ["frozen"]
    back = formats.read.schema(df.schema).json(path, pathGlobFilter="part-*")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(Exception, match="does not overwrite"):
        df.write.format("write_once").mode("overwrite").save(path)


def test_a_failing_task_leaves_nothing(formats, tmp_path):
    bad = formats.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("write_once").mode("append").save(str(tmp_path / "frozen"))
    assert not (tmp_path / "frozen").exists()


# --- constraints in the writing pass
def test_write_checked_counts_digests_and_refuses(spark, tmp_path):
    df, path = spark.range(50).select("id", (F.col("id") % 7).alias("k"), F.create_map(F.lit("b"), "id", F.lit("a"), "id").alias("m")), str(tmp_path / "t")
    first = write_checked(df, path, unique="id", required=["k"])
    assert first == {"rows": 50, "digest": content_digest(df), "written": True}
    again = df.select("m", "k", "id").orderBy(F.desc("id")).withColumn("m", F.create_map(F.lit("a"), "id", F.lit("b"), "id"))
    assert write_checked(again, path) == first | {"written": False} and not write_once(again, path)
    assert sorted(spark.read.parquet(path).select("id").toPandas()["id"]) == list(range(50))
    for bad, what in ((df.unionByName(df.limit(3)), "3 rows repeated id"), (df.withColumn("k", F.when(F.col("id") > 1, F.col("k"))), "2 rows without k")):
        with pytest.raises(ValueError, match=what):
            write_checked(bad, str(tmp_path / "bad"), unique="id", required=["k"])
    with pytest.raises(ValueError, match="holds other rows"):
        write_checked(df.limit(49), path)
    assert os.listdir(tmp_path) == ["t"]
    assert write_checked(df.limit(0), str(tmp_path / "none"), unique="id")["rows"] == 0


def test_write_checked_makes_one_job_of_the_rows(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    write_checked(spark.range(30).mapInArrow(count, "id long"), str(tmp_path / "t"), unique="id")
    assert read.value == 30


# --- canonical JSON
def test_canonical_json_equals_sorted_dumps(spark):
    rows = [(1, "a\"é\n", {"z": [1.0, 2.5, None], "a": []}, (True, None, 3.0)), (None, None, None, None), (-5, "", {}, (None, {"y": 1, "x": 2}, -0.0))]
    df = spark.createDataFrame(rows, "n long, s string, m map<string,array<double>>, t struct<ok:boolean,inner:map<string,int>,x:double>")
    whole = lambda v: {k: whole(x) for k, x in v.items()} if isinstance(v, dict) else [whole(x) for x in v] if isinstance(v, list) else int(v) if isinstance(v, float) and v.is_integer() else v
    want = [json.dumps(whole(r.asDict(recursive=True)), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in df.collect()]
    assert [r[0] for r in df.select(canonical_row(df.schema)).collect()] == want
    assert [r[0] for r in df.select("t", "s", "n", "m").select(canonical_row(df.schema)).collect()] == want
    assert [r[0] for r in df.select(canonical_text(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))).collect()] == want
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e16,), (0.1,)], "x double")
    assert [r[0] for r in odd.select(canonical_json(F.col("x"), odd.schema["x"].dataType)).collect()] == ["null", "null", "1.0E16", "0.1"]
    ones = spark.sql("select 1 as i, 1.0D as d, cast(1 as decimal(20,5)) as e, cast('12345678901234567890.50' as decimal(30,2)) as f")
    assert [ones.select(canonical_json(F.col(f.name), f.dataType)).first()[0] for f in ones.schema] == ["1", "1", "1", "12345678901234567890.5"]
    assert spark.createDataFrame([("{bad",), (None,), ('{"b":{"d":1,"c":[2.0]},"a":null}',)], "s string").select(canonical_text(F.col("s"))).collect()[2][0] == '{"a":null,"b":{"c":[2],"d":1}}'
