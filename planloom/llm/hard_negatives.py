"""Operator 13: hard negatives from vantage-point trees over norm-augmented vectors.

A tree grown on a bounded sample sends every vector to a region; vectors in order of
region and distance are packed into blocks, each with a tree of its own. Anchors go out
in chunks of a bounded number of bytes. Inner products are distances there, so a window of
scores is an annulus: for each anchor (its positives) or anchor and positive (its
negatives) a task visits the leaves of its blocks from the inner radius outwards, leaves
out those that lie inside it, and stops at those beyond the k-th vector found. Distances
only choose leaves, with room for rounding; scores are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.columns import table
from planloom.llm.topk import _exact
from planloom.llm.vantage import Tree
from planloom.sources.scratch import discard, stage

SCALE = 256
SAMPLE = 2048  # vectors that the first tree is grown on
SAMPLE_BYTES = 1 << 16  # longer vectors are not sampled
LEAST_REGION = 16  # sampled vectors
BLOCK = 1024  # vectors
BLOCK_BYTES = 4 << 20
CHUNK_BYTES = 4 << 20  # of anchors that travel with the tasks at a time
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

BLOCK_SCHEMA = "ids array<long>, labels array<long>, data binary, points array<long>, shells array<double>, leaves int, most double"
FOUND_SCHEMA = "probe long, found_id long, score long"


def _whole(scale: int):
    """Rows with a vector of finite whole numbers once scaled, the vector as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("vec")
            x = np.floor(scale * pc.fill_null(column.flatten(), np.nan).to_numpy(zero_copy_only=False))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            begins = np.concatenate([[0], ends])[:-1]
            ok = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[begins])
            raw = x.astype(np.float64).tobytes()
            data = pa.array([raw[8 * s : 8 * e] for s, e in zip(begins[ok].tolist(), ends[ok].tolist())], pa.binary())
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(keep), b.column("label").filter(keep), data], ["id", "label", "data"])

    return run


def _matrix(data: list[bytes]) -> np.ndarray:
    """Vectors as rows, the shorter ones ending in zeros."""
    out = np.zeros((len(data), max((len(d) // 8 for d in data), default=0)))
    for row, d in zip(out, data):
        row[: len(d) // 8] = np.frombuffer(d)
    return out


def _regions(tree: Tree, points: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("data").to_pylist())
            d = min(x.shape[1], points.shape[1])
            leaf, distance = tree.leaf_of(x[:, :d], points[:, :d]) if len(x) else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(np.nan_to_num(distance))], [*b.schema.names, "leaf", "distance"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to blocks with a tree each, rows in the order of its leaves."""
    ids, labels, data, widest = [], [], [], 0

    def block() -> pa.RecordBatch:
        x = _matrix(data)
        tree = Tree.grow(x)
        place = np.empty(len(x), np.int64)
        place[tree.order] = np.arange(len(x))
        values = [np.array(ids, np.int64)[tree.order].tolist(), np.array(labels, np.int64)[tree.order].tolist(), x[tree.order].tobytes(),
                  place[tree.points].tolist(), tree.shells.ravel().tolist(), tree.leaves, tree.most]
        ids.clear(), labels.clear(), data.clear()
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["ids", "labels", "data", "points", "shells", "leaves", "most"]).cast(
            pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("data", pa.binary()), ("points", pa.list_(pa.int64())),
                       ("shells", pa.list_(pa.float64())), ("leaves", pa.int32()), ("most", pa.float64())]))

    for b in batches:
        for i, label, d in zip(b.column("id").to_pylist(), b.column("label").to_pylist(), b.column("data").to_pylist()):
            if ids and (len(ids) == BLOCK or (len(ids) + 1) * max(widest, len(d)) > BLOCK_BYTES):
                yield block()
                widest = 0
            ids.append(i), labels.append(label), data.append(d)
            widest = max(widest, len(d))
    if ids:
        yield block()


class Block:
    """A block as tasks read it; ``x`` and ids are in the order of the tree's leaves."""

    def __init__(self, row: dict):
        self.ids, self.labels = np.array(row["ids"], np.int64), np.array(row["labels"], np.int64)
        self.x = np.frombuffer(row["data"]).reshape(len(self.ids), -1)
        self.tree = Tree(np.arange(len(self.ids)), np.array(row["points"], np.int64), np.array(row["shells"]).reshape(-1, 4), row["leaves"], row["most"])


class Probes:
    """Searches from anchors of one dimension: the ``k`` best scores in each probe's window, ties to the smaller id.

    ``anchor`` says whose vector a probe starts from; what it finds has that anchor's label
    (``same``) or another, and never its id.
    """

    def __init__(self, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, anchor: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.q, self.ids, self.labels, self.anchor, self.names, self.high, self.same, self.k = q, ids, labels, anchor, names, high, same, k
        self.floor = low.copy()
        self.scores = [np.zeros(0, np.int64)] * len(names)
        self.found = [np.zeros(0, np.int64)] * len(names)
        self.square = (q * q).sum(axis=1)

    def _radius(self, reach: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distance at which a vector of the tree has the score; none is too far for the least score."""
        return np.where(scores == LEAST, np.inf, np.sqrt(np.maximum(reach - 2.0 * scores, 0.0)))

    def meet(self, block: Block) -> None:
        tree, d = block.tree, min(self.q.shape[1], block.x.shape[1])
        q, x = self.q[:, :d], block.x[:, :d]
        reach = self.square + tree.most**2
        from_points = np.sqrt(np.maximum(reach[:, None] - 2 * (q @ x[tree.points].T), 0.0))
        radius = np.sqrt(self.square) + tree.most
        low, high = tree.bounds(from_points, radius)
        room = 1e-6 * radius[self.anchor] + 1e-6
        low, high, reach = low[self.anchor] - room[:, None], high[self.anchor] + room[:, None], reach[self.anchor]
        inner = self._radius(reach, self.high)
        order = np.argsort(np.maximum(low, inner[:, None]), axis=1, kind="stable")
        ranges, every = tree.ranges(), np.arange(len(self.names))
        for turn in range(tree.leaves):
            leaf = order[:, turn]
            outer = self._radius(reach, self.floor)
            go = ~((low[every, leaf] > outer) | (high[every, leaf] < inner))  # what is no number is visited
            for one in np.unique(leaf[go]):
                self._score(np.flatnonzero(go & (leaf == one)), q, x, block, *ranges[one])

    def _score(self, probes: np.ndarray, q: np.ndarray, x: np.ndarray, block: Block, start: int, end: int) -> None:
        anchors, at = np.unique(self.anchor[probes], return_inverse=True)
        scores = _exact(q[anchors], x[start:end])[at]
        ids, alike = block.ids[start:end], block.labels[None, start:end] == self.labels[self.anchor[probes]][:, None]
        fits = (scores >= self.floor[probes, None]) & (scores <= self.high[probes, None]) & (alike == self.same) & (ids[None, :] != self.ids[self.anchor[probes]][:, None])
        for row in np.flatnonzero(fits.any(axis=1)):
            p = probes[row]
            s, i = np.concatenate([self.scores[p], scores[row][fits[row]]]), np.concatenate([self.found[p], ids[fits[row]]])
            best = np.lexsort((i, ~s))[: self.k]  # ~s falls as s rises, at every s of 64 bits
            self.scores[p], self.found[p] = s[best], i[best]
            if len(best) == self.k:
                self.floor[p] = max(self.floor[p], s[best][-1])

    def rows(self) -> pa.RecordBatch:
        sizes = [len(s) for s in self.scores]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.names, sizes)), pa.array(np.concatenate(self.found)), pa.array(np.concatenate(self.scores))], ["probe", "found_id", "score"])


def _search(shared):
    """Blocks against the chunk's probes; yields what each task finds for each probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = [Probes(**p) for p in shared.value]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for p in probes:
                    p.meet(block)
        yield from (p.rows() for p in probes if any(len(s) for s in p.scores))

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.col("score").desc(), "found_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _ask(blocks: DataFrame, probes: list[dict], k: int, label: str) -> DataFrame:
    """Staged (``probe``, ``rank``, ``found_id``, ``score``) over all blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast(probes)
    out = stage(_best(blocks.mapInArrow(_search(shared), FOUND_SCHEMA), k), label)
    shared.destroy()
    return out


def packed_blocks(known: DataFrame) -> DataFrame:
    """Staged blocks of ``known`` (``id``, ``label``, ``data``), near vectors together."""
    sample = known.filter(F.octet_length("data") <= SAMPLE_BYTES).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("data").toArrow()["data"].to_pylist()
    x = _matrix(sample)
    tree = Tree.grow(x, max(LEAST_REGION, -(-len(x) // 128)))
    routed = known.mapInArrow(_regions(tree, x[tree.points]), "id long, label long, data binary, leaf long, distance double")
    by = ["leaf", "distance", "id"]
    dealt = routed.repartitionByRange(max(1, min(-(-known.count() // (4 * BLOCK)), 100_000)), *by).sortWithinPartitions(*by)
    return stage(dealt.select("id", "label", "data").mapInArrow(_pack, BLOCK_SCHEMA), "negative-blocks")


def _anchors(mine: pa.Table) -> list[dict]:
    """Anchors of a chunk by dimension, with their places in the chunk."""
    data, by = mine["data"].to_pylist(), {}
    for i, d in enumerate(data):
        by.setdefault(len(d), []).append(i)
    ids, labels = mine["id"].to_numpy(), mine["label"].to_numpy()
    return [{"q": _matrix([data[i] for i in rows]), "ids": ids[rows], "labels": labels[rows], "places": np.array(rows, np.int64)} for rows in by.values()]


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = 100, positives: int = 5,
                   negatives: int = 5, low: int = 80, high: int = 100, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``).

    Anchors are the rows whose id is divisible by ``every``; an anchor's positives are its
    ``positives`` best rows of its label and another id; for each, the ``negatives`` best
    rows of another label whose score is at least ``low`` and at most ``high`` per cent of
    the positive's. Components are floor(256 x), scores inner products, ties go to the
    smaller id. Rows with a null id, label or vector, or a component that is null or not
    finite (once scaled), take no part; shorter vectors count as padded with zeros, empty
    ones as zero. Scores that 64 bits cannot hold are the nearest number that they can. A
    repeated row counts each time, also as an anchor. A positive without such rows gives
    none, as does an empty table. Other columns are not read.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    known = stage(src.filter("id is not null and label is not null and vec is not null").mapInArrow(_whole(SCALE), "id long, label long, data binary"), "negative-vectors")
    blocks = packed_blocks(known)
    ask = known.filter(F.col("id") % every == 0)
    size = ask.agg(F.sum(F.octet_length("data") + 64)).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    ask = stage(ask.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")), "negative-anchors")
    parts = []
    for chunk in range(chunks):
        mine = ask.filter(F.col("chunk") == chunk).select("id", "label", "data").toArrow()
        if not mine.num_rows:
            continue
        groups = _anchors(mine)
        own = lambda g, n: {"q": g["q"], "ids": g["ids"], "labels": g["labels"], "anchor": np.arange(n)}
        first = [own(g, len(g["ids"])) | {"names": g["places"], "low": np.full(len(g["ids"]), LEAST), "high": np.full(len(g["ids"]), MOST), "same": True, "k": positives} for g in groups]
        found = _ask(blocks, first, positives, "negative-positives")
        near = found.select("probe", "found_id", "score").toArrow()  # at most ``positives`` rows an anchor of the chunk
        discard(found)
        place, score = near["probe"].to_numpy(), near["score"].to_numpy()
        least = np.array([-((-low * s) // 100) for s in score.tolist()], np.int64)
        most = np.array([(high * s) // 100 for s in score.tolist()], np.int64)
        second, names = [], np.arange(len(place), dtype=np.int64)
        for g in groups:
            at = np.full(mine.num_rows, -1, np.int64)
            at[g["places"]] = np.arange(len(g["places"]))
            of = np.flatnonzero((at[place] >= 0) & (least <= most))
            second.append(own(g, 0) | {"anchor": at[place[of]], "names": names[of], "low": least[of], "high": most[of], "same": False, "k": negatives})
        told = spark.createDataFrame(pa.table({"probe": names, "anchor_id": mine["id"].to_numpy()[place], "positive_id": near["found_id"].to_numpy(), "positive_score": score}))
        found = _ask(blocks, second, negatives, "negative-found")
        parts.append(stage(found.join(told, "probe").select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negative-part"))
        discard(found)
    for old in (known, blocks, ask):
        discard(old)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"))


OP13_SQL = r"""
with v as (select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
                  list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as e from embeddings
           where vec_id is not null and label is not null and embedding is not null
             and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)),
s as (select q.vec_id as anchor_id, c.vec_id, q.label = c.label as same, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
      from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score),
r as (select *, row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id) as rank from n)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from r where rank <= 5
"""
