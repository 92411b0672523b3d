"""Operator 4: link documents whose sets of word n-grams overlap enough, exactly.

Candidates. Two sets of sizes a <= b with Jaccard similarity of at least num / den
differ in at most d = (a + b)(den - num) / (den + num) elements. Cut the hash range
into more than d buckets: some bucket then holds the same elements in both. Every set
posts the hash of each bucket's content, so a pair that qualifies always meets, and a
passage that very many documents share brings nobody together, since a bucket mixes
it with what is theirs alone. Sizes are banded, so that a pair uses one bucket count.

With more buckets than differences such a pair even shares many keys, at least T: the
candidates are a T-occurrence search over the keys' inverted lists. Who meets others
under fewer than T keys is out, and of the others only the rarest keys are searched,
as many as leave fewer than T: two documents that share T keys share one of these.

Verification. Under each key all others first meet the one with the most company; its
elements query an inverted index over blocks of the others (DivideSkip: merge the
short lists with a heap, probe the longest ones, keep those that reach the overlap).
That connects a group of copies with one comparison each. Then the search is run once
more, over pairs in different components only; in rounds of a bounded number of
candidates, should there be very many. There a sketch of 1,024 parity bits per set
leaves out whom it proves too different: an element of one set only turns one bit, so
as many bits as two sketches differ in, the sets differ in elements at least. Every
pair that can qualify is thus either compared or connected.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from planloom.llm.columns import table, without
from planloom.llm.components import connected_components
from planloom.llm.tokens import Runs, WordHashes, as_long, byte_texts, scramble
from planloom.sources.scratch import discard, stage

BLOCK = 64  # documents behind one inverted index
PAIR_BUDGET = 1 << 26  # candidate pairs that one round of the second phase may list
PRUNE_ROUNDS = 2
LISTED = 128  # keys of a document that travel with each of its candidates
HEAVY = 256  # rows of a key that are not brought together to be joined
SKETCH = 1024  # parity bits of a set
BROADCAST_ROWS = 3_000_000  # keys of 8 bytes: some 70 MB as a hashed relation

SET_SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, sketch array<long>, posts array<struct<band:int,need:int,keys:array<long>>>"

POSTS = pa.list_(pa.struct([("band", pa.int32()), ("need", pa.int32()), ("keys", pa.list_(pa.int64()))]))


def shingles(text: bytes, size: int, cache: WordHashes) -> np.ndarray:
    """Distinct hashes, ascending, of all runs of ``size`` words; of the whole text if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = Runs(cache.of(words))
    if len(words) < size:
        return runs.between(np.array([0]), np.array([len(words)]))
    return np.unique(runs.fixed(size))


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """One bit per class of hashes: whether a set holds an odd number of them."""
    odd = np.bincount((scramble(s) >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_starts(limit: int = 1 << 40) -> list[int]:
    starts = [1]
    while starts[-1] < limit:
        starts.append(max(starts[-1] + 1, starts[-1] * 3 // 2))
    return starts


class Signatures:
    """Bucket keys of a set, for similarities of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.starts = num, den, band_starts()

    def differ(self, a: int, b: int) -> int:
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def largest_partner(self, a: int) -> int:
        return a * self.den // self.num

    def buckets(self, band: int) -> int:
        """Bucket count for pairs whose smaller set lies in ``band``; 0 if they must be equal."""
        a = self.starts[band + 1] - 1
        d = self.differ(a, self.largest_partner(a))
        return d and d + 1 + (1 if d < 8 else 2)

    def of(self, s: np.ndarray) -> list[dict]:
        """Per band that a partner can share: the keys, and how many of them any partner must share."""
        n, out = len(s), []
        if not n:
            return out
        band = bisect_right(self.starts, n) - 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(scramble(s), out=sums[1:])
        partner = self.largest_partner(n)
        while True:
            if m := self.buckets(band):
                at = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
                edges = np.searchsorted(at, np.arange(m + 1, dtype=np.uint64))
                content = sums[edges[1:]] - sums[edges[:-1]]
                keys = scramble(content + np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(band * 0xABC98388FB8FAC03 % (1 << 64)))
                filled = edges[1:] > edges[:-1]
                need = int(filled.sum()) - self.differ(n, partner)
                # an empty bucket is posted only where the full ones could all differ
                out.append({"band": band, "need": max(need, 1), "keys": (keys[filled] if need > 0 else keys).view(np.int64)})
            partner = self.starts[band] - 1
            if not band or self.largest_partner(partner) < n:
                return out
            band -= 1


def _sets(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, signatures = WordHashes(), Signatures(num, den)
        for batch in batches:
            counts, ids, posts, sketches = [], [], [], []
            for text in byte_texts(batch.column("text")):
                s = shingles(text, size, cache)
                counts.append(len(s))
                ids.append(divmod(xxh3_128_intdigest(s.tobytes()), 1 << 64) if len(s) else (0, 0))
                sketches.append(parity_sketch(s))
                posts.append(signatures.of(s))
            pair = np.array(ids, np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), as_long(np.ascontiguousarray(pair[:, 0])), as_long(np.ascontiguousarray(pair[:, 1])), pa.array(sketches, pa.list_(pa.int64())), pa.array(posts, POSTS)],
                ["doc_id", "n_shingles", "set_a", "set_b", "sketch", "posts"])

    return run


class Inverted:
    """Inverted lists of a block of sets: under each element, ascending, the members that hold it."""

    def __init__(self, members: list[np.ndarray]):
        elements = np.concatenate(members)
        owners = np.repeat(np.arange(len(members)), [len(m) for m in members])
        order = np.argsort(elements, kind="stable")
        self.owners = owners[order].tolist()
        self.elements, starts = np.unique(elements[order], return_index=True)
        self.edges = np.append(starts, len(elements))

    def lists(self, query: np.ndarray) -> list[list[int]]:
        """The lists of those elements of ``query`` that have one, longest first."""
        at = np.searchsorted(self.elements, query)
        at = at[self.elements[np.minimum(at, len(self.elements) - 1)] == query]
        size = self.edges[at + 1] - self.edges[at]
        at = at[np.argsort(-size, kind="stable")]
        return [self.owners[a:b] for a, b in zip(self.edges[at].tolist(), self.edges[at + 1].tolist())]


def divide_skip(lists: list[list[int]], needed: list[int], longest: int) -> list[int]:
    """Members that are on ``needed`` of them of the inverted ``lists``, longest first, or more.

    A heap merges the short lists; whoever is within ``longest`` of what it needs is then
    looked up in the ``longest`` long ones by bisection, until it has enough or cannot.
    """
    long_lists, found = lists[:longest], []
    merged = groupby(heapq.merge(*lists[longest:]))
    short = {member: sum(1 for _ in run) for member, run in merged}
    # who needs no more than there are long lists may be on none of the short ones
    for member in range(len(needed)) if min(needed, default=1) <= longest else short:
        have = short.get(member, 0)
        for left, each in zip(range(len(long_lists), 0, -1), long_lists):
            if have >= needed[member] or have + left < needed[member]:
                break
            i = bisect_left(each, member)
            have += i < len(each) and each[i] == member
        if have >= needed[member]:
            found.append(member)
    return found


def overlapping(query: np.ndarray, members: list[np.ndarray], num: int, den: int) -> list[int]:
    """Which of ``members`` have a similarity of at least num / den to ``query``: a T-occurrence search in their lists."""
    if not len(query):
        return []
    # den * both >= num * (a + b - both)
    needed = [-(-num * (len(query) + len(s)) // (num + den)) for s in members]
    lists = Inverted(members).lists(query)
    # as many long lists as pay: DivideSkip's T / (mu log M + 1), M the longest list, mu 0.1
    longest = min(len(lists), int(min(needed) / (0.1 * math.log(len(lists[0]) + 1) + 1))) if lists else 0
    return divide_skip(lists, needed, longest)


def _verify(size: int, num: int, den: int):
    """Rows sorted by (leader, block, role, id), the leader's own row first; yields verified links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        head, query, ids, sets = None, None, [], []
        links: list[tuple[int, int]] = []

        def flush():
            if ids:
                links.extend((head[0], ids[i]) for i in overlapping(query, sets, num, den))
            ids.clear()
            sets.clear()

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("leader", "block", "role", "id")]
            for leader, block, role, doc, text in zip(*cols, byte_texts(batch.column("text"))):
                if role == 0:
                    flush()
                    if head is None or head[0] != leader:
                        query = shingles(text, size, cache)
                    head = (leader, block)
                elif not ids or ids[-1] != doc:  # repeated rows
                    if len(ids) == BLOCK:
                        flush()
                    ids.append(doc)
                    sets.append(shingles(text, size, cache))
            if len(links) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])
                links.clear()
        flush()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])

    return run


def _semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Broadcast only after the rows of ``keys``, a staged table, are counted."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, "left_semi")


def _able(members: DataFrame) -> DataFrame:
    """Members with at least as many met keys in a band as any partner must share; staged."""
    able = members.groupBy("id", "band").agg(F.count(F.lit(1)).alias("has"), F.max("need").alias("least")).filter("has >= least").select("id", "band")
    return stage(members.join(able, ["id", "band"], "left_semi"), "link-members")


def _join_spread(rows: DataFrame, keyed: DataFrame, on: str) -> DataFrame:
    """``rows`` with the columns of ``keyed``, a staged table of one row a key that says in ``n`` how many rows have it.

    Keys of HEAVY rows or more are at most the rows' number over HEAVY: they are broadcast
    when counted to be few, and the rows under them stay where they are.
    """
    heavy = keyed.filter(F.col("n") >= HEAVY)
    if heavy.count() > BROADCAST_ROWS:
        return rows.join(keyed, on)
    names = F.broadcast(heavy)
    return rows.join(names, on).unionByName(rows.join(names.select(on), on, "left_anti").join(keyed.filter(F.col("n") < HEAVY), on))


def _rarest(members: DataFrame, listed: bool = False) -> DataFrame:
    """Of each document's keys the rarest, as many as leave fewer than it needs.

    Two documents that share what they need share one of these, as both use one order.
    ``company`` is how many members a document's keys bring together. ``listed`` adds all
    its keys in that order, for documents of up to LISTED of them.
    """
    counts = stage(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "link-counts")
    mine = Window.partitionBy("id", "band")
    ranked = _join_spread(members, counts, "key").select(
        "key", "id", "band", "size", "need", "n", F.row_number().over(mine.orderBy("n", "key")).alias("rank"),
        F.count(F.lit(1)).over(mine).alias("has"), F.sum("n").over(mine).alias("company"))
    kept = ranked.filter("rank <= has - need + 1").select("key", "id", "band", "size", "need", "company")
    if not listed:
        return kept.drop("band", "need")
    lists = ranked.filter(F.col("has") <= LISTED).groupBy("id", "band").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "key"))), lambda x: x["key"]).alias("keys"))
    return kept.join(lists, ["id", "band"], "left").drop("band")


def _bits_apart(a: str, b: str) -> F.Column:
    words = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH // 64)]
    return reduce(lambda x, y: x + y, words)


def _with_comp(members: DataFrame, comp: DataFrame) -> DataFrame:
    return members.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _check_pairs(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(``leader``, ``id``) to the links among them, in blocks of some 32 members a leader."""
    blocks = stage(pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK // 2)).cast("long").alias("blocks")), "link-blocks")
    dealt = _join_spread(pairs, blocks, "leader")
    members = dealt.select("leader", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("long").alias("block"), F.lit(1).alias("role"), "id")
    leads = blocks.select("leader", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("leader").alias("id"))
    rows = members.unionByName(leads).join(texts, "id")
    rows = rows.repartition("leader", "block").sortWithinPartitions("leader", "block", "role", "id")
    return rows.select("leader", "block", "role", "id", "text").mapInArrow(_verify(size, num, den), "a long, b long")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(``doc_id``, ``n_shingles``, ``component_id``) of every row.

    A set holds the distinct runs of ``size`` words after lower-casing A-Z; a shorter
    text is one run. Null, empty and blank texts have empty sets and link with nothing.
    Ids name texts: repeated rows are harmless, and rows with a null id take the
    component of an equal set that has an id, else null. An empty table gives an empty
    result. Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = stage(rows.mapInArrow(_sets(size, num, den), SET_SCHEMA), "link-sets")
    classes = stage(sets.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "link-classes")

    # one document of each class posts keys; the others are few, or else leave by a join
    copies = sets.filter("n_shingles > 0").join(classes.filter("n > 1"), ["set_a", "set_b"]).filter("doc_id <> rep").select("doc_id").distinct()
    copies = stage(copies, "link-copies")
    few = copies.count() <= BROADCAST_ROWS
    alone = sets.filter("doc_id is not null").join(F.broadcast(copies) if few else copies, "doc_id", "left_anti")
    posts = alone.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), F.explode_outer("posts").alias("p")).filter("p is not null")
    posts = posts.select("id", "size", F.col("p.band").alias("band"), F.col("p.need").alias("need"), F.explode_outer("p.keys").alias("key"))
    met = stage(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "link-keys")
    few = met.count() <= BROADCAST_ROWS
    members = stage(posts.join(F.broadcast(met) if few else met, "key", "left_semi").distinct(), "link-met")
    discard(met)
    discard(copies)
    members = _able(members)
    ids = stage(members.select("id").distinct(), "link-ids")
    texts = _semi(rows.withColumnRenamed("doc_id", "id"), ids, "id")
    texts = stage(texts.dropDuplicates(["id"]), "link-texts")

    # first everybody against the one with the most company under each key ...
    first = stage(_rarest(members), "link-first")
    heads = first.groupBy("key").agg(F.max(F.struct("company", (-F.col("id")).alias("neg"))).alias("p"), F.count(F.lit(1)).alias("n")).select("key", (-F.col("p.neg")).alias("leader"), "n")
    heads = stage(heads, "link-heads")
    pairs = stage(_join_spread(first.select("key", "id"), heads, "key").filter("id <> leader").select("leader", "id").distinct(), "link-pairs")
    links = stage(_check_pairs(pairs, texts, size, num, den), "link-found")
    comp = connected_components(links)
    # ... then what can still be open: pairs of different components that share enough keys
    for _ in range(PRUNE_ROUNDS):
        now = _with_comp(members, comp)
        keys = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
        still = stage(members.join(keys, "key", "left_semi"), "link-open")
        discard(members)
        members = _able(still)
        discard(still)
    rest = _rarest(members, listed=True)
    sketches = _semi(sets.select(F.col("doc_id").alias("id"), "sketch"), stage(rest.select("id").distinct(), "link-ids"), "id").dropDuplicates(["id"])
    rest = stage(rest.join(sketches, "id"), "link-rest")
    load = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("load")).first()["load"]
    chunks = int(load // PAIR_BUDGET) + 1
    for chunk in range(chunks if load else 0):
        now = stage(_with_comp(rest, comp).select("key", "id", "size", "need", "keys", "sketch", "comp"), "link-round")
        lead = now.filter(F.pmod(F.xxhash64("id"), F.lit(chunks)) == chunk).select("key", F.col("id").alias("leader"), F.col("size").alias("l_size"), F.col("need").alias("l_need"), F.col("keys").alias("l_keys"), F.col("sketch").alias("l_sketch"), F.col("comp").alias("l_comp"))
        fits = (F.least("size", "l_size") * den >= F.greatest("size", "l_size") * num) & (F.col("comp") != F.col("l_comp")) & (F.col("leader") < F.col("id"))
        fits = fits & (_bits_apart("sketch", "l_sketch") * (den + num) <= (F.col("size") + F.col("l_size")) * (den - num))
        # where both lists are at hand: enough keys in common, and each pair under the first of them only
        both = F.array_intersect("keys", "l_keys")
        fits = fits & F.coalesce((F.size(both) >= F.greatest("need", "l_need")) & (F.get(both, F.lit(0)) == F.col("key")), F.lit(True))
        pairs = stage(now.join(lead, "key").filter(fits).select("leader", "id").distinct(), "link-pairs")
        found = stage(_check_pairs(pairs, texts, size, num, den), "link-found")
        if not found.isEmpty():
            links = links.unionByName(found)
            comp = connected_components(links)
        discard(now)
        discard(pairs)
    for old in (first, members, rest):
        discard(old)
    discard(texts)
    out = sets.select("doc_id", "n_shingles", "set_a", "set_b").join(classes.drop("n"), ["set_a", "set_b"], "left")
    out = out.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("comp", "rep", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less every row that is not the first of its component.

    Rows are linked by a number of their own, so repeated rows, rows with a null id and an
    id with several texts are told apart: of each component one row stays, that of the
    smallest id, nulls last, and of these the one whose text has the smallest hash. Texts
    without words stay.
    """
    rows = stage(without(docs, ["_row"]).withColumn("_row", F.monotonically_increasing_id()), "link-rows")
    found = stage(link_documents(rows.select("_row", text_col), "_row", text_col, size, num, den).select(F.col("doc_id").alias("_row"), "component_id"), "link-comps")
    several = stage(found.filter("component_id <> _row").select("component_id").distinct(), "link-several")
    group = _semi(found, several, "component_id")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"), F.col("_row"))
    group = stage(group.join(rows.select("_row", order.alias("place")), "_row"), "link-group")
    first = group.groupBy("component_id").agg(F.min("place").alias("p")).select(F.col("p._row").alias("_row"))
    later = stage(group.select("_row").join(first, "_row", "left_anti"), "link-later")
    for old in (found, several, group):
        discard(old)
    few = later.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(later) if few else later, "_row", "left_anti").drop("_row")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return link_documents(docs)
