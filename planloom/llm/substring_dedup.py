"""Operator 3: remove words that lie in a repeated window of words.

The windows of ``window`` words are the edges of a De Bruijn graph over the corpus,
kept in minimizer space. Each window has an anchor, its smallest word k-gram (the
leftmost of equals); neighbouring windows mostly share theirs, and the run of windows
around one anchor is one edge between anchors. It is known by a 128-bit digest of the
words at its source coordinates, so what two texts share is verified by their words and
not by the hashes that chose the anchors. Joins and counts then go over these edges:

* an edge that occurs twice has only repeated windows;
* an anchor that occurs once has only unique windows;
* where one anchor has several edges the graph branches (or a text ends). Only
  there are single windows counted: those of each edge that occurs once, and those of
  one representative of every edge that occurs more often.

Repeated edges that follow each other wherever either occurs are a nonbranching path:
joins compact it, so that a long copied passage is one span per text that has it. Spans
and single windows are mapped back to source coordinates, and only the texts that are
neither untouched nor covered whole are read again to rebuild what is left of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xxhash import xxh3_128_digest

from planloom.llm.columns import table, without
from planloom.llm.tokens import Runs, WordHashes, as_long, byte_texts
from planloom.sources.scratch import discard, stage

WINDOW = 35
ANCHOR = 16  # words of an anchor
BROADCAST_ROWS = 1 << 20  # keys of 16 bytes: at most some 50 MB as a hashed relation

BASE_SCHEMA = "row_key binary, n_words long, sha string"
PATH_SCHEMA = "anchor long, path binary, row_key binary, lo int, hi int"


def _scan(hashes: np.ndarray, window: int, anchor: int):
    """Anchor position of each run of windows with one anchor, and the run's bounds."""
    runs = Runs(hashes)
    grams = runs.fixed(anchor)
    per = window - anchor + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, per).argmin(axis=1) + np.arange(len(hashes) - window + 1)
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    hi = np.concatenate([lo[1:], [len(at)]]) - 1
    return runs, grams, at[lo], lo, hi


def row_identity(id_col: Column, text_col: Column) -> Column:
    """128 bits of a row's id and text: repeated rows have one identity."""
    ident = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(ident).cast("string"), F.lit(":"), ident, F.coalesce(text_col, F.lit("")))))


def _digests(words: list[bytes], lo, hi) -> list[bytes]:
    """128-bit digest of the words of each span [lo, hi)."""
    return [xxh3_128_digest(b" ".join(words[a:b])) for a, b in zip(lo.tolist(), hi.tolist())]


def _paths(window: int, anchor: int, hash_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            parts, digests = [], []
            for i, text in enumerate(byte_texts(batch.column("text"))):
                words = text.split()
                if len(words) >= window:
                    _, grams, pos, lo, hi = _scan(cache.of(words) >> np.uint64(64 - hash_bits), window, anchor)
                    # the words fix where the anchor stands among them
                    digests += _digests(words, lo, hi + window)
                    parts.append((grams[pos], np.full(len(pos), i), lo, hi))
            if parts:
                a, i, lo, hi = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([as_long(a), pa.array(digests, pa.binary()), batch.column("row_key").take(pa.array(i)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["anchor", "path", "row_key", "lo", "hi"])

    return run


def _bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, shas = [], []
        for text in byte_texts(batch.column("text")):
            words = text.split()
            counts.append(len(words))
            shas.append(sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(counts, pa.int64()), pa.array(shas)], ["row_key", "n_words", "sha"])


def _windows(window: int):
    """Digests of the single windows lo..hi of the texts that carry ``runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, digests = [], []
            for i, (text, spans) in enumerate(zip(byte_texts(batch.column("text")), batch.column("runs").to_pylist())):
                words = text.split()
                for s in spans:
                    start = np.arange(s["lo"], s["hi"] + 1)
                    digests += _digests(words, start, start + window)
                    parts.append((np.full(len(start), s["anchor"]), np.full(len(start), i), start))
            if parts:
                a, i, start = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(digests, pa.binary()), batch.column("row_key").take(pa.array(i)), pa.array(start, pa.int32())], ["anchor", "window", "row_key", "at"])

    return run


def _covered(n: int, spans, window: int) -> np.ndarray:
    """Which of n words the windows lo..hi of each span cover."""
    steps = np.zeros(n + 1, np.int64)
    for lo, hi in spans:
        steps[lo] += 1
        steps[hi + window] -= 1
    return np.cumsum(steps[:-1]) > 0


def _rebuild(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, shas, gone = [], [], []
            for text, spans in zip(byte_texts(batch.column("text")), batch.column("spans").to_pylist()):
                words = text.split()
                covered = _covered(len(words), [(s["lo"], s["hi"]) for s in spans], window)
                gone.append(int(covered.sum()))
                left = b" ".join([words[i] for i in np.flatnonzero(~covered)])
                shas.append(sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "replace") if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(gone, pa.int64()), pa.array(shas), pa.array(kept, pa.string())], ["row_key", "n_removed", "left_sha", "kept"])

    return run


def _semi(df: DataFrame, keys: DataFrame, on: str = "row_key") -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``, a staged table; broadcast only after its rows are counted."""
    few = keys.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if few else keys, on, "left_semi")


def compact(hits: DataFrame) -> DataFrame:
    """Spans (``row_key``, ``lo``, ``hi``) of the repeated edges (``row_key``, ``path``, ``n``, ``lo``, ``hi``).

    The node between two edges has one way in and one way out if either edge is met as
    often as the two are met in a row. Every occurrence then runs through the whole
    nonbranching path, so the path is compacted where it occurs: a span reaches from an
    edge that no such node precedes to one that none follows. Turns of a loop, the same
    edge again and again, are one span too.
    """
    along = Window.partitionBy("row_key").orderBy("lo")
    ahead = hits.withColumn("next", F.lead(F.struct("path", "n", "lo")).over(along)).withColumn("next", F.when(F.col("next.lo") == F.col("hi") + 1, F.col("next")))
    pairs = ahead.filter("next is not null").groupBy("path", F.col("next.path").alias("to")).agg(F.count(F.lit(1)).alias("met"), F.max(F.greatest("n", "next.n")).alias("n"))
    inner = stage(pairs.filter("met = n or path = to").select("path", "to", F.lit(True).alias("inner")), "repeat-inner")
    marked = ahead.select("row_key", "lo", "hi", "path", F.col("next.path").alias("to")).join(inner, ["path", "to"], "left")
    opens = marked.withColumn("opens", F.when(F.lag("inner").over(along), 0).otherwise(1)).withColumn("stretch", F.sum("opens").over(along))
    spans = stage(opens.groupBy("row_key", "stretch").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("stretch"), "repeat-stretches")
    discard(inner)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR,
                   with_text: bool = True, hash_bits: int = 64) -> DataFrame:
    """All rows of ``docs`` with ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked for, ``kept``.

    Words are runs of anything but ASCII white space, unchanged. A word goes if a
    window of ``window`` words that covers it starts at any other place too, in the same
    text or another; a repeated row is another place. Windows are judged on the input.
    ``kept`` is null where nothing was removed (the text then stands as it is). Null and
    empty texts have no words. ``hash_bits`` of a word's hash choose the anchors: fewer make
    more candidates and the same result. Input columns named like an output are replaced; empty
    tables give empty results.
    """
    kept_cols = without(docs, ["n_words", "n_removed", "kept_sha256", "kept", "row_key"])
    key = row_identity(F.col(id_col), F.col(text_col).cast("string"))
    rows = kept_cols.select(key.alias("row_key"), F.col(text_col).cast("string").alias("text"))
    base = stage(rows.mapInArrow(_bases, BASE_SCHEMA).distinct(), "repeat-base")
    paths = stage(rows.mapInArrow(_paths(window, anchor, hash_bits), PATH_SCHEMA), "repeat-paths")

    anchors = paths.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    anchors = stage(anchors, "repeat-anchors")
    shared = stage(_semi(paths, anchors, "anchor"), "repeat-shared")
    per_path = shared.groupBy("anchor", "path").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_key", "lo", "hi")).alias("one"))
    per_path = stage(per_path, "repeat-kinds")
    branching = per_path.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
    branching = stage(branching.select("anchor"), "repeat-branching")

    hits = shared.distinct().join(per_path.filter("n > 1").select("anchor", "path", "n"), ["anchor", "path"]).select("row_key", "path", "n", "lo", "hi")
    hits = stage(hits, "repeat-hits")
    stretches = compact(hits)
    covered = stretches.groupBy("row_key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    open_runs = _semi(per_path, branching, "anchor").select("one.row_key", F.struct("anchor", "one.lo", "one.hi").alias("run"))
    by_text = open_runs.groupBy("row_key").agg(F.collect_set("run").alias("runs"))
    by_text = stage(by_text, "repeat-open")
    opened = _semi(rows, by_text.select("row_key")).join(by_text, "row_key")
    single = stage(opened.mapInArrow(_windows(window), "anchor long, window binary, row_key binary, at int"), "repeat-windows")
    twice = single.groupBy("anchor", "window").agg(F.min(F.struct("row_key", "at")).alias("a"), F.max(F.struct("row_key", "at")).alias("b")).filter("a <> b").select("anchor", "window")
    more = single.join(twice, ["anchor", "window"], "left_semi").groupBy("row_key").agg(F.collect_set(F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"))).alias("spans"))
    spans = covered.unionByName(more).groupBy("row_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = stage(spans, "repeat-spans")

    touched = _semi(rows, spans.select("row_key")).join(spans, "row_key")
    left = touched.mapInArrow(_rebuild(window, with_text), "row_key binary, n_removed long, left_sha string, kept string")
    left = stage((left if with_text else left.drop("kept")).dropDuplicates(["row_key"]), "repeat-left")
    result = base.join(left, "row_key", "left")
    out = kept_cols.withColumn("row_key", key).join(result, "row_key", "left").select(
        *[F.col(f"`{c}`") for c in kept_cols.columns], "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("left_sha", "sha").alias("kept_sha256"), *(["kept"] if with_text else []))
    for old in (paths, anchors, shared, per_path, branching, hits, stretches, by_text, single, spans):
        discard(old)
    return out


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
