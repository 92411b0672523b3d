"""Operator 7: quality scores from a regularised quadratic discriminant.

Document statistics are made inside Arrow batches; class means and covariances are
sums over labelled rows, added up on the executors; the driver only sees two sums of a
fixed size, factors them once, and sends the factors along with the scoring tasks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.columns import table, without

FEATURES = 16
TRAIN_ROWS = 40_000  # at most this many labelled rows fit the two covariances
SHRINK = 0.15  # towards the covariance of both classes, and that towards its diagonal
TEMPERATURE = 4.0  # log-density differences are flattened by this, as statistics are not independent

_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,'-")
_HARD = b"#$%&*|!"
_SPACE = b" \t\n\r\x0b\x0c"


def statistics(text: bytes) -> list[float]:
    """Shape of a text, before transformation; defined for the empty text too."""
    n = len(text)
    words = text.split()
    w = len(words)
    per = 1.0 / (n + 1)
    count = lambda chars: n - len(text.translate(None, chars))
    lines = text.split(b"\n")
    distinct = len(set(words))
    zipped = len(zlib.compress(text, 1)) if n else 0
    lengths = np.fromiter(map(len, words), np.float64, w) if w else np.zeros(1)
    shared = sum(1 for a, b in zip(words, words[1:]) if a == b)
    return [
        math.log1p(n),
        count(_UPPER) * per,
        count(_DIGIT) * per,
        math.sqrt(count(_SYMBOL) * per),
        math.sqrt(count(_HARD) * per),
        count(_SPACE) * per,
        (text.count(b".") + text.count(b",")) * per,
        float(lengths.mean()),
        math.log1p(float(lengths.std())),
        math.log1p(float(lengths.max())),
        distinct / math.sqrt(w + 1),
        distinct / (w + 1),
        math.sqrt(shared / (w + 1)),
        zipped / (n + 16),
        len(set(lines)) / len(lines),
        math.log1p(w / len(lines)),
    ]


def _stats_of(column) -> np.ndarray:
    return np.array([statistics(x or b"") for x in column.cast(pa.large_binary()).to_pylist()], np.float64).reshape(-1, FEATURES)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class: number, sums and sums of products."""
    total = np.zeros((2, 1 + FEATURES + FEATURES * FEATURES))
    for batch in batches:
        x = _stats_of(batch.column("text"))
        y = batch.column("label").to_numpy()
        for c in (0, 1):
            z = x[y == c]
            total[c] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["label", "sums"])


class Discriminant:
    """Two Gaussian classes with cached Cholesky factors."""

    def __init__(self, sums: np.ndarray, shrink: float = SHRINK, temperature: float = TEMPERATURE):
        n = sums[:, 0]
        self.temperature = temperature
        self.constant = 0.5 if n.sum() == 0 else float((n[1] + 1) / (n.sum() + 2))
        self.ready = bool((n > FEATURES).all())
        if not self.ready:
            return
        mean = sums[:, 1 : 1 + FEATURES] / n[:, None]
        second = sums[:, 1 + FEATURES :].reshape(2, FEATURES, FEATURES) / n[:, None, None]
        cov = second - mean[:, :, None] * mean[:, None, :]
        pooled = (cov * n[:, None, None]).sum(axis=0) / n.sum()
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        self.mean, self.scale = mean / scale, scale
        cov, pooled = cov / np.outer(scale, scale), pooled / np.outer(scale, scale)
        target = (1 - shrink) * pooled + shrink * np.eye(FEATURES)
        factors = [np.linalg.cholesky((1 - shrink) * c + shrink * target + 1e-6 * np.eye(FEATURES)) for c in cov]
        self.inverse = np.stack([np.linalg.inv(f) for f in factors])
        self.logdet = np.array([2 * np.log(np.diag(f)).sum() for f in factors])
        self.prior = np.log(n / n.sum())

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.constant)
        z = x / self.scale
        logs = [self.prior[c] - 0.5 * (((z - self.mean[c]) @ self.inverse[c].T) ** 2).sum(axis=1) - 0.5 * self.logdet[c] for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) / self.temperature, -50, 50)))


def held_out(id_col) -> F.Column:
    """Rows that labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Discriminant:
    """Learn from at most ``rows`` labelled rows, those of smallest id hash.

    Labels other than 0 and 1 are left out, and so are ids whose labels disagree.
    """
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    chosen = marked.filter(~held_out(F.col("_id")) & F.col("_id").isNotNull()).groupBy("_id").agg(F.min("label").alias("label"), F.max("label").alias("top"))
    chosen = chosen.filter("label = top").select("_id", "label").orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    parts = texts.join(F.broadcast(chosen), "_id").select("text", "label").mapInArrow(_moments, "label int, sums array<double>")
    summed = parts.select("label", F.posexplode_outer("sums").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((2, 1 + FEATURES + FEATURES * FEATURES))
    for r in summed:
        if r["i"] is not None:
            total[r["label"], r["i"]] = r["x"]
    return Discriminant(total)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  rows: int = TRAIN_ROWS) -> DataFrame:
    """All rows of ``docs`` with ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``.

    Scores come from the text alone. Null texts count as empty. Without enough labels of
    both classes every score is the share of label 1 (one half without any). Rows with a
    null id are scored and not held out. Repeated rows get equal scores; input columns
    named like an output are replaced; an empty table gives an empty result.
    """
    model = fit(docs, labels, id_col, text_col, label_col, rows)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t.encode() if t else b"") for t in texts], np.float64).reshape(-1, FEATURES)
        return pd.Series(model.scores(x))

    kept = without(docs, ["held_out", "score", "predicted"])
    out = kept.select("*", held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels"))
