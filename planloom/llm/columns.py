"""Column expressions shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between words: space, tab, line feed, vertical tab, form feed and carriage return.
GAPS = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the cheaper built-in, which agrees there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null and empty texts."""
    return F.coalesce(F.array_size(F.array_remove(F.split(text, GAPS, -1), "")), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """128-bit identity of a text, null included, so that a join needs neither ids nor texts."""
    return F.struct(
        F.xxhash64(text).alias("a"), F.xxhash64(F.lit("b"), text, F.length(text)).alias("b")
    )


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns that an operator is about to add under the same names."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
