"""Operator 9: score texts by word counts and by a causal self-attention model.

Counts. Words are counted over all training texts. The most frequent ones, a bounded
number, travel with the tasks that cut texts; the occurrences of all others meet the
full count table in a join.

Model. Words are cut once into subword ids of a given vocabulary, which are staged, and
one layer of masked self-attention (``attention.py``) predicts each id from the 9 to 32
before it in its window; windows overlap, and each id is scored once. The counts of all
ids of all training texts shape the model's output; its weights are fitted on every
window of every training text, so each training id is a target once. Texts are dealt by
hash to ROUNDS rounds. In each, every task goes over its windows by Adagrad steps from
common weights, then the executors average what the tasks found, each weight by the
squared gradients that the tasks saw of it.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planloom.llm.attention import Attention, window_parts
from planloom.llm.columns import table, without
from planloom.sources.scratch import discard, stage

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the vocabulary's own splitter cuts a word before merging: letters, digits and the rest apart.
PATTERN = r""" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOP_WORDS = 150_000  # at most this many counts travel with the tasks
COUNT_BYTES, CUT_BYTES = 16 << 20, 8 << 20  # of texts that are counted, and cut, at a time
CUT_WORDS = 2_000  # words that are cut by one call
ROUNDS = 4
STEP, POOL = 128, 8_192  # windows of an Adagrad step, and windows among which steps are drawn
GROUP_BYTES = 2 << 20  # of a row group of staged ids, so that few large files still make many tasks
MOST_IDS = 65_000  # two bytes hold an id
PIECE = 1_024  # weights a row while tasks' results are averaged

_PIECES = "at long, tasks long, places long, sums binary"
_TAIL = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("tf", T.LongType())]))


def held_out(id_col) -> F.Column:
    """Texts that nothing is learned from: crc32 of the id as text (null: empty), modulo 10, is 0."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 10 == 0


def read_vocabulary(path: str) -> bytes:
    """Read where the job is started; tasks get the bytes, so executors need no file."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except FileNotFoundError as e:
        raise FileNotFoundError(f"no vocabulary file at {path}: name one of tiktoken's format by the parameter vocabulary") from e


@lru_cache(maxsize=2)
def encoder(raw: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def subwords(enc: tiktoken.Encoding, word: bytes) -> list[int]:
    return enc.encode_ordinary(" " + word.decode("utf-8", "replace"))


class Cutter:
    """Cuts words into subword ids, many by one call."""

    def __init__(self, raw: bytes):
        self.enc = encoder(raw)
        self.opens = np.array([self.enc.decode_single_token_bytes(i)[:1] == b" " for i in range(self.enc.n_vocab)])

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.array(self.enc.encode_ordinary((b" " + b" ".join(words)).decode("utf-8", "replace")), np.int32)

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` end to end, and how many each has: a word begins at an id that opens with a space."""
        ids = self.ids(words)
        at = np.flatnonzero(self.opens[ids])
        if len(at) == len(words):
            return ids, np.diff(at, append=len(ids))
        # blanks that Unicode knows, and the operator does not, were merged over
        each = [subwords(self.enc, w) for w in words]
        return np.array([i for c in each for i in c], np.int32), np.array([len(c) for c in each])


def pieces_of(column: pa.Array, most: int) -> Iterator[pa.Array]:
    """``column`` in slices of whole texts of some ``most`` bytes, a longer text alone; null becomes the empty text."""
    texts = column.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of ``texts`` end to end, A-Z lowered, and how many each text has. Arrow cuts where ``bytes.split`` does."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    size, words = np.diff(found.offsets.to_numpy()).astype(np.int64), found.flatten()
    real = pc.binary_length(words).to_numpy() > 0  # a blank at either end of a text leaves an empty word there
    if not real.all():
        size = np.bincount(np.repeat(np.arange(len(size)), size)[real], minlength=len(size))
        words = words.filter(pa.array(real))
    return words, size


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in pieces_of(batch.column("text"), COUNT_BYTES):
            found = words_of(texts)[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], ["word", "n"])


def _count_ids(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(vocabulary.value)
        total = np.zeros(cutter.enc.n_vocab, np.int64)
        for batch in batches:
            ids, size = cutter.cut(batch.column("word").to_pylist())
            np.add.at(total, ids, np.repeat(batch.column("n").to_numpy(), size))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    return run


def _learn(shared):
    """Goes over its windows; yields the weights, times the squared gradients seen of them, and these sums, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Attention = pickle.loads(shared.value)
        before, draw, places, pool, held = model.flat(model.s), np.random.default_rng(5), 0, [], 0

        def steps() -> int:
            found = draw.permutation(np.concatenate(pool))
            pool.clear()
            return sum(model.learn(found[i : i + STEP]) for i in range(0, len(found), STEP))

        for batch in batches:
            for seqs in several(batch.column("ids")):
                for part in window_parts(seqs, model.pad - 1, model.pad):
                    pool.append(part)
                    held += len(part)
                    if held >= POOL:
                        places += steps()
                        held = 0
        if held:
            places += steps()
        if places:
            seen = model.flat(model.s) - before
            both = np.stack([model.flat(model.p) * seen, seen])
            yield from _pieces(((at, 1, places if at == 0 else 0), both[:, at : at + PIECE]) for at in range(0, both.shape[1], PIECE) if both[1, at : at + PIECE].any() or at == 0)

    return run


def _pieces(found) -> Iterator[pa.RecordBatch]:
    found = list(found)
    if found:
        keys = [pa.array(k, pa.int64()) for k in zip(*(key for key, _ in found))]
        yield pa.RecordBatch.from_arrays([*keys, pa.array([x.astype(np.float32).tobytes() for _, x in found], pa.binary())], ["at", "tasks", "places", "sums"])


def _add_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for at, tasks, places, raw in zip(*(batch.column(c).to_pylist() for c in ("at", "tasks", "places", "sums"))):
            x = np.frombuffer(raw, np.float32).reshape(2, -1).astype(np.float64)
            old = sums.setdefault(at, [0, 0, 0])
            sums[at] = [old[0] + tasks, old[1] + places, old[2] + x]
    yield from _pieces(((at, t, p), x) for at, (t, p, x) in sorted(sums.items()))


def fit(train: DataFrame, model: Attention) -> int:
    """Fit ``model`` to every window of the texts of ``train`` (round, ids); the places that were learned from."""
    spark = train.sparkSession
    learned = 0
    for now in range(ROUNDS):
        shared = spark.sparkContext.broadcast(pickle.dumps(model))
        found = train.filter(F.col("round") == now).select("ids").mapInArrow(_learn(shared), _PIECES)
        # every piece is added up on one task of many; the driver gets each of them once
        pieces = found.repartition("at").mapInArrow(_add_pieces, _PIECES).toArrow().to_pylist()
        weights, sums = model.flat(model.p), model.flat(model.s)
        tasks = max((r["tasks"] for r in pieces), default=1)
        for r in pieces:
            moved, seen = np.frombuffer(r["sums"], np.float32).reshape(2, -1)
            span = slice(r["at"], r["at"] + len(seen))
            weights[span] = np.where(seen > 0, moved / np.maximum(seen, 1e-30), weights[span])
            sums[span] += seen / tasks
            learned += r["places"]
        model.load(weights, sums)
        shared.destroy()
    return learned


def staged_ids(value: pa.Scalar) -> np.ndarray:
    """Ids of a text as they were staged, its end the last of them."""
    return np.frombuffer(value.as_buffer(), np.uint16).astype(np.int32)


def _cut(vocabulary, shared, names: list[str]):
    """Counts' part of each text's results, the words that only the count table knows, and the text's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, end_log = shared.value
        top = top[0].cast(pa.large_binary()), top[1]
        cutter = Cutter(vocabulary.value)
        last = cutter.enc.n_vocab

        def results(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            n = part.num_rows
            words, size = words_of(texts)
            told = words.dictionary_encode()
            kinds, at = told.dictionary.cast(pa.large_binary()), told.indices.to_numpy()
            text = np.repeat(np.arange(n), size)
            # counts: words that only the count table knows are told by text
            place = pc.index_in(kinds, value_set=top[0]).fill_null(-1).to_numpy()
            far = (place < 0)[at]
            log = np.append(top[1], 0.0)[place][at]
            base = np.bincount(text, log, minlength=n) + end_log
            known = size - np.bincount(text[far], minlength=n)
            keys, tf = np.unique(text[far] * len(kinds) + at[far], return_counts=True)
            tails = np.searchsorted(keys, np.arange(n + 1) * len(kinds)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([kinds.take(pa.array(keys % max(1, len(kinds)))).cast(pa.binary()), pa.array(tf)], ["word", "tf"])
            # ids: each kind is cut once; a text is its words' ids and the end
            kinds = kinds.to_pylist()
            cuts = [cutter.cut(kinds[i : i + CUT_WORDS]) for i in range(0, len(kinds), CUT_WORDS)]
            flat = np.concatenate([np.array([last], np.int32), *(ids for ids, _ in cuts)]).astype(np.uint16)
            many = np.concatenate([np.ones(1, np.int64), *(each for _, each in cuts)])
            begin = np.cumsum(many) - many
            ends = np.cumsum(size)
            at = np.insert(at + 1, ends, 0)  # kind 0 is the end of a text
            many, begin = many[at], begin[at]
            upto = np.cumsum(many)
            ids = flat.take(np.arange(upto[-1]) + np.repeat(begin - upto + many, many))
            offsets = np.append(0, upto[ends + np.arange(n)]) * 2
            ids = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            return pa.RecordBatch.from_arrays(
                [part.column(i) for i in range(len(names))] + [pa.array(size + 1), pa.array(known), pa.array(base), pa.ListArray.from_arrays(tails, pairs), ids],
                [*names, "n_tokens", "known", "base", "tail", "ids"])

        for batch in batches:
            done = 0
            for texts in pieces_of(batch.column("_text"), CUT_BYTES):
                yield results(batch.slice(done, len(texts)), texts)
                done += len(texts)

    return run


def several(column: pa.Array, most: int = 60_000) -> Iterator[list[np.ndarray]]:
    """The staged ids of texts, for some ``most`` ids at a time."""
    seqs, held = [], 0
    for text in column:
        seqs.append(staged_ids(text))
        held += len(seqs[-1])
        if held > most:
            yield seqs
            seqs, held = [], 0
    if seqs:
        yield seqs


def _score(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [np.zeros(0)]
            for seqs in several(batch.column("ids")):
                value = np.concatenate([model.score(w) for w in window_parts(seqs, model.pad - 1, model.pad)]).astype(np.float64)
                scores.append(np.add.reduceat(value, np.cumsum([0, *map(len, seqs[:-1])])))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [pa.array(np.concatenate(scores))], [*names, "score"])

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, keep: list[str] | None = None,
                top_words: int = TOP_WORDS) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all, if none are named) with ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` and ``score``.

    Null texts are empty: one end token. Rows with a null id count as held out. Without
    any training text every base score is 0 and the model is as it was initialised. Both
    scores sum over the whole text. Repeated rows are counted as often as they occur and
    give equal results; input columns named like an output are replaced; an empty table
    gives an empty result. ``vocabulary`` is a file of the driver, of up to 65,000 ids;
    more raise an error. A very long text is laid out some thousands of windows at a time.
    """
    spark = docs.sparkSession
    kept = without(docs, ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "_text", "_row", "_round", "known", "base", "tail", "ids"])
    names = keep if keep is not None else kept.columns
    text = F.col(text_col).cast("string")
    learn = docs.filter(~held_out(F.col(id_col)))
    counted = learn.select(text.alias("text")).mapInArrow(_count_words, "word binary, n long")
    vocab = stage(counted.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    ends = learn.count()
    sums = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, kinds = sums["n"] + ends, sums["v"] + (ends > 0)
    norm = np.log10(total + 0.1 * (kinds + 1))
    # counts in steps of a quarter: at most some hundreds of steps
    steps = vocab.groupBy(F.floor(F.log(1.25, "n")).alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    cutoff, room = 1 << 62, top_words
    for r in sorted(steps, key=lambda r: -r["step"]):
        room -= r["words"]
        if room < 0:
            break
        cutoff = r["least"]
    frequent = vocab.filter(F.col("n") >= cutoff).toArrow().combine_chunks()
    n_top = frequent["n"].to_numpy().astype(np.float64)
    top = (frequent["word"].combine_chunks() if frequent.num_rows else pa.array([], pa.binary()), np.log10(n_top + 0.1) - norm)

    raw = read_vocabulary(vocabulary)
    if encoder(raw).n_vocab > MOST_IDS:
        raise ValueError(f"{vocabulary} has more than {MOST_IDS} ids")
    words = spark.sparkContext.broadcast(raw)
    counts = np.full(encoder(raw).n_vocab + 1, 0.1)
    for r in vocab.mapInArrow(_count_ids(words), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] += r["n"]
    counts[-1] += ends
    shared = spark.sparkContext.broadcast((top, float(np.log10(ends + 0.1) - norm)))
    key = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text), F.lit(ROUNDS)).cast("int")
    src = kept.select(*[F.col(f"`{c}`") for c in names], held_out(F.col(id_col)).alias("held_out"), F.monotonically_increasing_id().alias("_row"), key.alias("_round"), text.alias("_text"))
    carried = [*names, "held_out", "_row", "_round"]
    schema = src.drop("_text").schema.add("n_tokens", "long").add("known", "long").add("base", "double").add("tail", _TAIL).add("ids", "binary")
    cut = stage(src.mapInArrow(_cut(words, shared, carried), schema), "lm-cut", group_bytes=GROUP_BYTES)
    model = Attention(counts)
    fit(cut.filter(~F.col("held_out")).select(F.col("_round").alias("round"), "ids"), model)
    model.prepare()

    fitted = spark.sparkContext.broadcast(model)
    carried = [*names, "held_out", "_row", "n_tokens", "known", "base"]
    told = cut.select(*[F.col(f"`{c}`") for c in carried], "ids")
    scored = stage(told.mapInArrow(_score(fitted, carried), told.drop("ids").schema.add("score", "double")), "lm-scored")
    rare = cut.select("_row", F.explode_outer("tail").alias("t")).filter("t is not null").select("_row", F.col("t.word").alias("word"), F.col("t.tf").alias("tf"))
    met = rare.join(vocab.filter(F.col("n") < cutoff), "word", "left")
    value = F.col("tf") * (F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1)) - F.lit(float(norm)))
    tail = stage(met.groupBy("_row").agg(F.sum(value).alias("tail_score"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("tail_known")), "lm-tail")
    out = scored.join(tail, "_row", "left").select(
        *[F.col(f"`{c}`") for c in names], "held_out", "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_score", F.lit(0.0))).alias("base_score"), "score")
    for old in (vocab, cut):
        discard(old)
    for old in (words, shared, fitted):
        old.destroy()
    return out


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), keep=["doc_id"])
