"""Readers and write-once sinks for task, edge and outcome records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from planloom.functions.canonical import canonical_row

TASK_DDL = """id string, split string, source string, instruction string, tags array<string>, slots map<string,string>, initial_facts array<string>, goal_facts array<string>,
allowed_actions array<string>, gold_plan array<string>, action_model map<string,struct<preconditions:array<string>,add_effects:array<string>,del_effects:array<string>>>,
safety_rules struct<should_reject:boolean,forbidden_actions:array<string>,forbidden_goal_facts:array<string>,hazard_keywords:array<string>>"""

EDGE_DDL = "task_id string, source string, relation string, target string"


def _required(df: DataFrame, names: list[str]) -> DataFrame:
    """A row without one of ``names`` raises when it is read."""
    for n in names:
        df = df.withColumn(n, F.coalesce(F.col(n), F.raise_error(F.lit(f"record without {n}")).cast("string")))
    return df


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; bad lines raise, optional fields get defaults, ``id`` and ``instruction`` are required."""
    df = spark.read.schema(TASK_DDL).option("mode", "FAILFAST").json(path)
    for c, t in df.dtypes:
        if t.startswith("array"):
            df = df.withColumn(c, F.coalesce(F.col(c), F.array().cast(t)))
        elif t.startswith("map"):
            df = df.withColumn(c, F.coalesce(F.col(c), F.create_map().cast(t)))
    return _required(df.withColumns({"split": F.coalesce("split", F.lit("eval")), "source": F.coalesce("source", F.lit("jsonl"))}), ["id", "instruction"])


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return _required(spark.read.schema(EDGE_DDL).option("mode", "FAILFAST").json(path), ["task_id", "source", "relation", "target"])


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """Untyped objects as VARIANT; a line that is no JSON object raises. Blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    v = F.try_parse_json("value")
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return lines.select(F.when(ok, v).otherwise(F.raise_error(F.lit("line is no JSON object")).cast("variant")).alias("record"))


def read_cells(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<model>__<planner>__<harness>/summary.json`` with the three parts of the cell's name."""
    df = spark.read.option("multiLine", True).json(f"{root}/*/summary.json")
    parts = F.split(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), "__")
    return df.select("*", *[F.get(parts, i).alias(n) for i, n in enumerate(("model", "planner", "harness"))])


def _digest_metrics(df: DataFrame) -> list[Column]:
    """Row count and sums of two 64-bit hashes of each row's canonical JSON: no order of rows, columns or keys changes them."""
    row = canonical_row(df.schema)
    return [F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit("b"), row).cast("decimal(38,0)")).alias("b")]


def content_digest(df: DataFrame) -> str:
    """Digest of all rows as ``rows-a-b``; equal for equal rows in any order."""
    return "-".join(str(x) for x in df.agg(*_digest_metrics(df)).first())


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, keys sorted."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode(mode).text(path)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _noted(spark: SparkSession, path: str) -> str | None:
    """The digest that ``write_checked`` left in the folder."""
    at, fs = _hadoop(spark, f"{path}/_digest")
    return spark.read.text(f"{path}/_digest/*").first()[0] if fs.exists(at) else None


def write_checked(df: DataFrame, path: str, unique: str | None = None, required: list[str] | None = None) -> dict:
    """Write Parquet whose constraints, row count and digest come from the job that writes it.

    The rows go to a folder beside ``path``; observed metrics of that one job say how many
    rows repeat the key ``unique`` and how many lack one of ``required``. With any of
    these, or where ``path`` holds other rows, the folder is deleted and ValueError raised;
    the same rows leave ``path`` alone. Returns ``rows``, ``digest`` and whether it was ``written``.
    """
    spark, pending = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    seen, counted = Observation(), df
    checks = [F.coalesce(F.count_if(F.col(f"`{c}`").isNull()), F.lit(0)).alias(f"without {c}") for c in required or []]
    if unique:  # the rows after the first of each key
        first = F.row_number().over(Window.partitionBy(unique).orderBy(F.lit(1)))
        counted = counted.withColumn("_nth", first)
        checks.append(F.coalesce(F.count_if(F.col("_nth") > 1), F.lit(0)).alias(f"repeated {unique}"))
    counted.observe(seen, *_digest_metrics(df), *checks).select(*[F.col(f"`{c}`") for c in df.columns]).write.parquet(pending)
    got = seen.get
    digest, broken = "-".join(str(got[k]) for k in ("rows", "a", "b")), {k: v for k, v in got.items() if k not in ("rows", "a", "b") and v}
    here, fs = _hadoop(spark, pending)
    there, _ = _hadoop(spark, path)
    if broken or fs.exists(there):
        fs.delete(here, True)
        if broken:
            raise ValueError(", ".join(f"{v} rows {k}" for k, v in sorted(broken.items())))
        old = _noted(spark, path) or content_digest(spark.read.parquet(path))
        if old != digest:
            raise ValueError(f"{path} holds other rows")
        return {"rows": got["rows"], "digest": digest, "written": False}
    spark.createDataFrame([(digest,)], "digest string").coalesce(1).write.text(f"{pending}/_digest")
    if not fs.rename(here, there):
        raise ValueError(f"{path} could not be put in place")
    return {"rows": got["rows"], "digest": digest, "written": True}


def write_once(df: DataFrame, path: str) -> bool:
    """Write Parquet; an existing table of the same rows is left alone (False), any other raises."""
    return write_checked(df, path)["written"]


def file_digests(spark: SparkSession, glob: str) -> DataFrame:
    """(``path``, ``length``, ``sha256``) of files."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """Records of a repair memory, each with the ``sha256`` of the file that holds it."""
    rows = spark.read.option("mode", "FAILFAST").json(path).withColumn("path", F.col("_metadata.file_path"))
    names = F.col("_metadata.file_path").alias("path")
    digests = spark.read.format("binaryFile").load(path).select(names, F.sha2("content", 256).alias("sha256"))
    return rows.join(digests, "path")


def read_responses(spark: SparkSession, root: str) -> DataFrame:
    """(``path``, ``dataset``, ``module``, ``record``, ``issue``) of ``<root>/<dataset>/<module>/*_outputs.json``.

    A file that holds no JSON array or object is a row with an issue, not an error.
    """
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*_outputs.json").text(f"{root}/*/*")
    path = F.col("_metadata.file_path")
    parts = F.split(path, "/")
    rows = files.select(path.alias("path"), F.element_at(parts, -3).alias("dataset"), F.element_at(parts, -2).alias("module"), F.try_parse_json("value").alias("record"))
    shape = F.schema_of_variant("record")
    holds = F.coalesce(shape.startswith("ARRAY") | shape.startswith("OBJECT"), F.lit(False))
    return rows.withColumn("issue", F.when(F.col("record").isNull(), "invalid_json").when(~holds, "no_records"))


def export_by(df: DataFrame, path: str, by: str, mode: str = "errorifexists") -> DataFrame:
    """JSON lines in one folder per value of ``by``; returns the manifest (``by``, ``n``) of what was written."""
    df.write.mode(mode).partitionBy(by).json(path)
    return df.sparkSession.read.schema(df.schema).json(path).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
