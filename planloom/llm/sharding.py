"""Operator 12: documents dealt to shards by longest-processing-time scheduling.

Equal texts stay together. Spark sums the bytes of each group and counts the groups of
each total; groups of one total are interchangeable, so the heap takes these totals in
descending order, each with its number of groups. Totals that differ number at most
sqrt(2 x bytes): k of them add up to k (k + 1) / 2 bytes or more. What the heap decides,
how many groups of a total each shard gets, returns to the groups by a join. Places in a
global order (of groups within a total, of rows within a shard) come from a range
partitioning whose order ends in a number of each row's own, so no value is too frequent.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.columns import table, without
from planloom.sources.scratch import discard, stage

SHARDS = 24
ROW_BYTES = 8  # besides those of the text


class Loads:
    """Loads of the shards; the least loaded one, of several the first, gets the next group."""

    def __init__(self, shards: int):
        self.heap = [(0, i) for i in range(shards)]

    def deal(self, size: int, groups: int) -> list[int]:
        """How many of ``groups`` groups of ``size`` bytes each shard gets, as if they came one by one."""
        got = [0] * len(self.heap)
        if groups > 2 * len(got):
            # poured over the shards, the bytes come up to a level; nobody ends a whole group below it
            levels, total = sorted(self.heap), 0
            for m, (load, _) in enumerate(levels, 1):
                total += load
                if m == len(levels) or total + groups * size <= m * levels[m][0]:
                    break
            for load, i in levels[:m]:
                got[i] = max(0, (total + groups * size - m * load) // (m * size))
            self.heap = [(load + got[i] * size, i) for load, i in levels]
            heapq.heapify(self.heap)
            groups -= sum(got)
        for _ in range(groups):
            load, i = self.heap[0]
            heapq.heapreplace(self.heap, (load + size, i))
            got[i] += 1
        return got


def _schedule(shards: int):
    """Totals in descending order with their numbers of groups, to the place at which each shard's groups end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = Loads(shards)
        for b in batches:
            got = [loads.deal(s, n) for s, n in zip(b.column("total").to_pylist(), b.column("groups").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("total"), pa.array([np.cumsum(g).tolist() for g in got], pa.list_(pa.int64()))], ["total", "ends"])

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: adds their part and their place among the rows of their ``_in`` in it."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), {}
    for b in batches:
        key = b.column("_in").to_numpy()
        if not len(key):
            continue
        order = np.argsort(key, kind="stable")
        values, first, counts = np.unique(key[order], return_index=True, return_counts=True)
        place = np.empty(len(key), np.int64)
        begun = np.array([seen.get(v, 0) for v in values.tolist()], np.int64)
        place[order] = np.arange(len(key)) - np.repeat(first - begun, counts)
        # rows come in order of _in: only the last value can go on in the next batch
        seen = {int(v): int(n) for v, n in zip(values, begun + counts)}
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(key), part, np.int32)), pa.array(place)], [*b.schema.names, "_part", "_place"])


def place_within(df: DataFrame, within: str, order: list[str], name: str, label: str) -> DataFrame:
    """Staged ``df`` with ``name``: the place from 0 of each row among those of the same ``within`` (a long) by ``order``.

    Rows are sorted by ranges; each part counts on its own, and what stands before it is
    a running sum over one row for each part and value in it.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("_in", F.col(within).cast("long")).repartitionByRange(parts, "_in", *order).sortWithinPartitions("_in", *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", _part int, _place long"
    local = stage(dealt.mapInArrow(_placed, schema), f"{label}-local")
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("_in").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = local.groupBy("_in", "_part").agg((F.max("_place") + 1).alias("rows")).select("_in", "_part", before.alias("_before"))
    out = stage(local.join(starts, ["_in", "_part"]).withColumn(name, F.col("_place") + F.col("_before")).drop("_in", "_part", "_place", "_before"), label)
    discard(local)
    return out


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all, if none are named) with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    The law is ``bytes``: sizes (UTF-8 bytes of the text plus 8) of the shards come out
    near equal. Rows of equal texts are in one shard; a null text is an empty one. Among
    groups of one total those whose text has the smaller SHA-256 go to the smaller shard.
    A shard's slots run from 0 without gaps, by id (nulls first), then SHA-256; full
    copies of a row get theirs in any order. ``grown_shard`` is null, as a further shard
    would change every assignment. An empty table gives no rows; input columns named like
    an output are replaced.
    """
    outputs = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "_sha", "_id", "_row", "_in", "_part", "_place"]
    kept = [c for c in without(docs, outputs).columns if columns is None or c in columns]
    text = text_of(F.col(f"`{text_col}`"))
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept], F.col(f"`{id_col}`").alias("_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_sha"), F.monotonically_increasing_id().alias("_row"))
    rows = stage(rows, "shard-rows")
    groups = rows.groupBy("_sha").agg(F.sum("size").alias("total"))
    ranked = place_within(groups, "total", ["_sha"], "place", "shard-groups")
    totals = stage(ranked.groupBy("total").agg(F.count(F.lit(1)).alias("groups")), "shard-totals")
    plan = stage(totals.repartition(1).sortWithinPartitions(F.col("total").desc()).mapInArrow(_schedule(shards), "total long, ends array<long>"), "shard-plan")
    shard = F.size(F.filter("ends", lambda end: end <= F.col("place"))).cast("int")
    where = ranked.join(plan, "total").select("_sha", shard.alias("shard"))
    dealt = rows.join(where, "_sha")
    slotted = place_within(dealt, "shard", ["_id", "_sha", "_row"], "slot", "shard-slots")
    for old in (rows, ranked, totals, plan):
        discard(old)
    return slotted.select(*[F.col(f"`{c}`") for c in kept], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """Parquet folders ``shard=0`` and so on, each sorted by slot in every file; tasks of a shard share it out by ranges of slots."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"])


#: One group after the other meets the least loaded shard; shards then take the groups of one total by their SHA-256.
OP12_SQL = r"""
with recursive d as (select doc_id, coalesce(text, '') as text from documents),
s as (select doc_id, text, cast(strlen(text) + 8 as bigint) as size, sha256(text) as sha from d),
g as (select sha, cast(sum(size) as bigint) as total from s group by sha),
o as (select *, row_number() over (order by total desc, sha) as i, row_number() over (partition by total order by sha) as place from g),
deal(i, pick, loads) as (
  select cast(0 as bigint), cast(0 as bigint), list_transform(range(24), lambda x: cast(0 as bigint))
  union all
  select o.i, p.pick, list_transform(p.loads, lambda x, j: case when j = p.pick then x + o.total else x end)
  from (select i, loads, cast(list_position(loads, list_min(loads)) as bigint) as pick from deal) p join o on o.i = p.i + 1),
n as (select total, pick, count(*) as got from deal join o using (i) group by total, pick),
e as (select total, pick, sum(got) over (partition by total order by pick) as upto, sum(got) over (partition by total order by pick) - got as since from n),
bits as (select i, list_reduce(range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), i) as v from (select cast(range as bigint) as i from range(256))),
tab as (select list(v order by i) as tab from bits),
crc as (select sha, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: cast('0x' || h as bigint)),
                                    lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295), 4294967295) as text_crc32
        from (select sha, any_value(text) as text from s group by sha), tab),
w as (select o.sha, cast(e.pick - 1 as integer) as shard from o join e on e.total = o.total and o.place > e.since and o.place <= e.upto)
select s.doc_id, s.size, t.text_crc32, 'bytes' as law, w.shard, cast(row_number() over (partition by w.shard order by s.doc_id nulls first, s.sha) - 1 as bigint) as slot,
       cast(null as integer) as grown_shard
from s join w using (sha) join crc t on t.sha = s.sha
"""
