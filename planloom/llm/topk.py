"""Operator 5: exact top-k inner products over norm-sorted, rotated vectors.

Vectors are dealt out by descending length and packed into blocks of one number of
components and a bounded number of bytes. The rotation comes from the sum of outer
products of the leading coordinates, which has a fixed size. Queries go out in chunks of
a bounded number of bytes, and the vectors are read once for each chunk. The block of the
longest vectors gives every query a first k-th score; then each task takes its blocks
in order of length: one whose longest vector cannot reach a query's k-th score
(Cauchy-Schwarz) is left out for it, and within a block the leading rotated coordinates
plus the product of what is left of both lengths bound each score; only what the bound
lets through is scored, in integers. Tasks return at most k rows a query, and these are
merged.
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
from planloom.sources.scratch import discard, stage

SCALE = 1024
VECTOR_BLOCK = 1024
QUERY_BLOCK = 256
BLOCK_BYTES = 8 << 20
ROTATED = 512  # leading coordinates that are rotated; those after them count in the bound as they are
HEAD = 16  # rotated coordinates summed before the first bound
LIMIT = 1 << 53  # products up to this are exact doubles
CHUNK_BYTES = 32 << 20  # of query vectors that travel with the tasks at a time

BLOCK_SCHEMA = "longest double, width int, ids array<long>, data binary"


def _vectors(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows that take part, and their scaled vectors of whole numbers as doubles, for each number of components."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    ends = np.cumsum(size)
    scaled = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(scaled))])
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - size])
    for width in np.unique(size[ok]):
        rows = np.flatnonzero(ok & (size == width))
        yield rows, scaled[(ends - size)[rows, None] + np.arange(width)]


def _outer(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            for _, x in _vectors(b.column("vec")):
                x = x[:, :dim]
                total[: x.shape[1], : x.shape[1]] += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows, x in _vectors(b.column("vec")):
            width = pa.array(np.full(len(x), x.shape[1], np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(rows)), pa.array(np.sqrt((x**2).sum(axis=1))), width, pa.array([r.tobytes() for r in x], pa.binary())],
                ["id", "length", "width", "data"])


def _pack(size: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # by number of components: longest, ids, vectors

        def block(width: int):
            longest, ids, data = held.pop(width)
            return pa.RecordBatch.from_arrays(
                [pa.array([longest]), pa.array([width], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(data)], pa.binary())],
                ["longest", "width", "ids", "data"])

        for b in batches:
            for i, n, w, d in zip(*(b.column(c).to_pylist() for c in ("id", "length", "width", "data"))):
                _, ids, data = held.setdefault(w, [n, [], []])
                ids.append(i), data.append(d)
                if len(ids) == size or len(ids) * 8 * w >= most:
                    yield block(w)
        for w in list(held):
            yield block(w)

    return run


def _apart(x: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading rotated coordinates of rows, and the length of all that is left of them."""
    lead = x[:, : len(rotation)]
    r = lead @ rotation[: lead.shape[1]]
    return r[:, :HEAD], np.sqrt((r[:, HEAD:] ** 2).sum(axis=1) + (x[:, len(rotation) :] ** 2).sum(axis=1))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products of rows: by doubles where they are exact, else by whole numbers of any size, held to 64 bits."""
    width = min(q.shape[1], x.shape[1])  # the shorter one goes on in zeros
    q, x = q[:, :width], x[:, :width]
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < LIMIT:
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    full = whole(q) @ whole(x).T
    return np.vectorize(lambda v: max(-(1 << 63), min((1 << 63) - 1, v)), otypes=[np.int64])(full)


class Best:
    """The k best of each query so far: scores descending, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, rotation: np.ndarray):
        self.ids, self.q, self.floor, self.k = ids, q, floor.copy(), k
        self.scores = [np.zeros(0, np.int64)] * len(ids)
        self.found = [np.zeros(0, np.int64)] * len(ids)
        self.head, self.rest = _apart(q, rotation)
        self.length = np.sqrt((q**2).sum(axis=1))

    def meet(self, ids: np.ndarray, x: np.ndarray, longest: float, rotation: np.ndarray) -> None:
        slack = 1 + 1e-9 * self.length * longest
        alive = np.flatnonzero(~(self.length * longest + slack < self.floor))
        if not len(alive):
            return
        head, rest = _apart(x, rotation)
        bound = self.head[alive] @ head.T + np.outer(self.rest[alive], rest)
        near = ~(bound + slack[alive, None] < self.floor[alive, None])  # what is no number is scored
        rows = np.flatnonzero(near.any(axis=1))
        cols = np.flatnonzero(near.any(axis=0))
        if not len(rows):
            return
        scores = _exact(self.q[alive[rows]], x[cols])
        for row, a in enumerate(alive[rows]):
            take = (scores[row] >= self.floor[a]) & (ids[cols] != self.ids[a])
            if take.any():
                s, i = np.concatenate([self.scores[a], scores[row][take]]), np.concatenate([self.found[a], ids[cols][take]])
                order = np.lexsort((i, ~s))[: self.k]  # ~s falls as s rises, at every s of 64 bits
                self.scores[a], self.found[a] = s[order], i[order]
                if len(order) == self.k:
                    self.floor[a] = max(self.floor[a], float(s[order][-1]))


def _search(k: int, shared):
    """Blocks of vectors, longest first, against the chunk of queries; yields the best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, rotation = shared.value
        best = [Best(ids[i : i + QUERY_BLOCK], q[i : i + QUERY_BLOCK], floors[i : i + QUERY_BLOCK], k, rotation) for ids, q, floors in asked for i in range(0, len(ids), QUERY_BLOCK)]
        for batch in batches:
            for longest, width, members, data in zip(*(batch.column(c) for c in ("longest", "width", "ids", "data"))):
                these = np.array(members.as_py(), np.int64)
                x = np.frombuffer(data.as_buffer(), np.float64).reshape(len(these), width.as_py())
                for b in best:
                    b.meet(these, x, longest.as_py(), rotation)
        for b in best:
            sizes = [len(s) for s in b.scores]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.ids, sizes)), pa.array(np.concatenate(b.found)), pa.array(np.concatenate(b.scores))], ["query_id", "vec_id", "score"])

    return run


FOUND_SCHEMA = "query_id long, vec_id long, score long"


def top_products(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the ``k`` best of each query among all other rows.

    Components are floor(1024 * x); queries are the rows whose id is divisible by
    ``every``. Vectors that are null or hold null or non-finite components (once scaled)
    take no part; shorter vectors, empty ones too, go on in zeros, at no cost to the others
    if one vector is very long. Scores that 64 bits cannot hold
    are the nearest number that they can. Rows with a null id take no part. A row with
    the query's id is the query's own. Ties go to the smaller id. Fewer than ``k`` others
    give fewer ranks; no queries, no rows.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(F.col("id").isNotNull())
    spark = vectors.sparkSession
    dim = max(1, min(ROTATED, src.agg(F.max(F.size("vec"))).first()[0] or 0))
    parts = src.select("vec").mapInArrow(_outer(dim), "sums array<double>")
    sums = parts.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    outer = np.zeros(dim * dim)
    outer[sums["i"].to_numpy()] = sums["x"].to_numpy()
    outer = np.nan_to_num(outer.reshape(dim, dim))
    rotation = np.ascontiguousarray(np.linalg.eigh((outer + outer.T) / 2)[1][:, ::-1])

    known = stage(src.mapInArrow(_lengths, "id long, length double, width int, data binary"), "top-vectors")
    by_length = [F.col("length").desc(), F.col("id")]
    total = known.count()
    dealt = known.repartitionByRange(max(1, min(-(-total // (4 * VECTOR_BLOCK)), 100_000)), *by_length).sortWithinPartitions(*by_length)
    blocks = stage(dealt.mapInArrow(_pack(VECTOR_BLOCK, BLOCK_BYTES), BLOCK_SCHEMA), "top-blocks")
    # a chunk of queries is of bounded size; each is made by the hash of the id, so none is sorted for
    ask = known.filter(F.col("id") % every == 0)
    size = ask.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    ask = stage(ask.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).select("chunk", "id", "width", "data"), "top-queries")
    longest = stage(blocks.orderBy((F.size("ids") > k).desc(), F.col("longest").desc(), "ids").limit(1), "top-longest")
    parts = []
    for chunk in range(chunks):
        mine = ask.filter(F.col("chunk") == chunk).select("id", "width", "data").toArrow()
        if not mine.num_rows:
            continue
        widths, asked = mine["width"].to_numpy(), []
        for width in np.unique(widths).tolist():
            these = mine.filter(pa.array(widths == width))
            q = np.frombuffer(b"".join(these["data"].to_pylist()), np.float64).reshape(these.num_rows, width)
            asked.append((these["id"].to_numpy(), q, np.full(these.num_rows, -np.inf)))
        first = spark.sparkContext.broadcast((asked, rotation))
        seen: dict[int, list[int]] = {}
        for r in longest.mapInArrow(_search(k, first), FOUND_SCHEMA).select("query_id", "score").toArrow().to_pylist():
            seen.setdefault(r["query_id"], []).append(r["score"])
        first.destroy()
        for ids, _, floors in asked:
            for i, one in enumerate(ids.tolist()):
                if len(seen.get(one, ())) >= k:
                    floors[i] = float(sorted(seen[one], reverse=True)[k - 1])
        shared = spark.sparkContext.broadcast((asked, rotation))
        parts.append(stage(blocks.mapInArrow(_search(k, shared), FOUND_SCHEMA), "top-part"))
        shared.destroy()
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FOUND_SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    out = stage(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top-found")
    for old in (known, blocks, ask, longest, *parts):
        discard(old)
    return out


def op5_top_k(spark, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


OP5_SQL = r"""
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * x::double) as bigint)) as e from embeddings
           where embedding is not null and vec_id is not null and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)),
s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10
"""
