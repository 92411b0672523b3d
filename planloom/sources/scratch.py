"""Intermediate tables in the folder that the whole cluster shares.

A staged table cuts lineage the way ``checkpoint()`` does, but stays columnar, and
its size is known to Catalyst when the next plan is made, so a small one is
broadcast and a large one is shuffled without a hint from us.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode where the session names no folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; in local mode set to ``FALLBACK_DIR`` where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = FALLBACK_DIR
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage(df: DataFrame, label: str, by: str | None = None, group_bytes: int | None = None, large_rows: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, in folders by column ``by`` if it is given, and return a reader of that copy.

    ``group_bytes`` bounds a row group, so that more tasks can share a file that is dear to work on.
    With ``large_rows`` it holds for groups of fewer than 100 rows too, all of which a reader has in memory at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    if large_rows:
        writer = writer.option("parquet.page.size.row.check.min", 1)
    (writer.option("parquet.block.size", group_bytes) if group_bytes else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for parent in parents:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)
