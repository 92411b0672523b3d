"""From raw documents to a mixed training corpus, in named stages.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns the
columns of ``documents``; the last adds how the mix takes each document. SQL can
express neither the classifier nor the components, so there is no ORACLE_SQL; each
stage and the whole are held against brute-force versions in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm.decontaminate import find_contamination
from planloom.llm.jaccard_join import keep_first
from planloom.llm.line_dedup import drop_boilerplate
from planloom.llm.mixing import mix
from planloom.llm.quality import score_quality
from planloom.sources.scratch import stage

ORACLE_SQL = None
LINE_PAGES = 5  # fewer documents that share a line are copies, which the next stage tells apart


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant accepts; it learns from the labels of rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels).filter("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that too many documents of their source carry."""
    left = drop_boilerplate(docs, host_col="source", min_pages=LINE_PAGES)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by a similarity of 0.8 of five-word shingles."""
    return keep_first(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_contamination(docs, benchmark).filter("not contaminated").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their words, the words taken of them and their source's target."""
    return mix(docs).filter("taken > 0").select(*docs.columns, "size", "source_size", "target", "taken")


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("mix_to_target_weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each one's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage_fn in STAGES[:-1]:
        docs = stage(stage_fn(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
