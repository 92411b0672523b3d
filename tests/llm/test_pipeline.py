"""Stages of the pipeline on small tables."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from planloom.llm import jaccard_join, line_dedup, quality  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates_keep_the_first_of_each_group(spark):
    rnd, texts = random.Random(11), []
    for i in range(120):
        w = texts[rnd.randrange(len(texts))].split() if i > 30 and rnd.random() < 0.6 else [str(rnd.randrange(400)) for _ in range(rnd.choice([3, 20, 60, 150]))]
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            w[rnd.randrange(len(w))] = str(rnd.randrange(400))
        texts.append(" ".join(w))
    docs = [*enumerate(texts), (500, None), (501, "")]
    want = {i for i, (_, comp) in brute.components(docs, 5, 80, 100).items() if comp == i or i >= 500}
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], DOCS)
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns
    rows = {r.doc_id: r.text for r in got.collect()}
    assert set(rows) == want and rows == {i: t for i, t in docs if i in want}


def test_near_duplicates_tell_rows_apart(spark):
    long = " ".join(str(i) for i in range(60))
    near = long.replace(" 30 ", " x ", 1)
    rows = [(1, long), (1, long), (None, long), (None, near), (2, near), (2, "another text of six plain words"), (None, "b c d e f g"), (None, "b c d e f g"), (4, None), (4, ""), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    want = [(1, long), (2, "another text of six plain words"), (None, "b c d e f g"), (4, None), (4, ""), (4, "")]
    assert got == sorted((i is None, i or 0, t or "") for i, t in want)


def test_labels_that_disagree_teach_nothing(spark):
    docs = [(i, ("Plain words of a text. " if i % 2 else "@@ ## 00 ") * (1 + i % 7), "en", "s", 0) for i in range(120)]
    df = spark.createDataFrame(docs, DOCS)
    marks = [(i, i % 2) for i in range(120)]
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    mixed = marks + [(i, 1 - i % 2) for i in range(0, 30)] + [(40, 0), (41, None), (42, 7), (None, 1)]
    want = {r.doc_id: r.score for r in quality.score_quality(df, label(marks[30:])).collect()}
    got = {r.doc_id: r.score for r in quality.score_quality(df, label(mixed)).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_every_stage_equals_brute_force(spark):
    """Stage by stage, then the whole, over all documents of a small table."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    have = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality").collect()]
    items = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]

    scores = brute.quality_scores([(i, t) for i, _, t in have], labels, quality.statistics, quality.SHRINK, quality.TEMPERATURE)
    got = {r.doc_id: r.score for r in quality.op7_quality(spark, d).collect()}
    assert got == pytest.approx(scores, abs=1e-6)
    have = [x for x in have if scores[x[0]] >= 0.5]
    lines = dict(brute.without_boilerplate([(i, s, t) for i, s, t in have], line_dedup.RATIO, corpus_pipeline.LINE_PAGES))
    have = [(i, s, lines[i]) for i, s, _ in have]
    first = brute.components([(i, t) for i, _, t in have], 5, 80, 100)
    have = [x for x in have if first[x[0]][1] == x[0]]
    hit = brute.contaminated([t for _, _, t in have], items)
    have = [x for x, bad in zip(have, hit) if not bad]
    assert 0 < len(have) and any(hit)
    want = {i: v for i, v in brute.mixed(have).items() if v[3] > 0}
    texts = {i: t for i, _, t in have}
    rows = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id: (r["size"], r.source_size, pytest.approx(r.target), r.taken) for r in rows} == want
    assert all(r.text == texts[r.doc_id] for r in rows)


def test_stages_take_nulls_empty_tables_and_extra_columns(spark):
    d = "/root/testdata/sf0.001"
    texts = [None, "", "x", "A plain text of some words.\nAnd a line more.", "A plain text of some words.\nAnd a line more."]
    df = spark.createDataFrame([(i if i % 2 else None, t, None, None if i == 3 else "s", None) for i, t in enumerate(texts)], DOCS)
    clash = df.withColumns({"score": F.lit("mine"), "_row": F.lit(1), "size": F.lit("mine"), "contaminated": F.lit("x")})
    for name, fn in corpus_pipeline.STAGES:
        for one in (df, df.filter("false")):
            out = fn(spark, one, d)
            assert out.columns[:5] == df.columns and out.count() <= one.count(), name
    assert line_dedup.drop_boilerplate(clash, host_col="source").count() == 5
    assert sorted(jaccard_join.keep_first(clash.drop("_row")).columns) == sorted(clash.drop("_row").columns)


def test_op4_rounds_and_long_key_lists(spark, monkeypatch):
    """Several rounds of candidates, and no key lists at hand, give the same components."""
    rounds, plain = [], jaccard_join.stage
    monkeypatch.setattr(jaccard_join, "stage", lambda df, label: (rounds.append(label), plain(df, label))[1])
    monkeypatch.setattr(jaccard_join, "PAIR_BUDGET", 200)
    monkeypatch.setattr(jaccard_join, "LISTED", 3)
    monkeypatch.setattr(jaccard_join, "HEAVY", 3)
    rnd, texts = random.Random(5), []
    for i in range(90):
        w = texts[rnd.randrange(len(texts))].split() if i > 12 else [str(rnd.randrange(300)) for _ in range(rnd.choice([40, 90, 120]))]
        for _ in range(rnd.choice([0, 1, 2, 3])):
            w[rnd.randrange(len(w))] = str(rnd.randrange(300))
        texts.append(" ".join(w))
    want = brute.components(list(enumerate(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in jaccard_join.link_documents(df).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
    assert rounds.count("link-round") > 1
