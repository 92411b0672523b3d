"""Collocations, sharding and hard negatives against brute force, and their edge cases."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from planloom.llm import collocations, hard_negatives, sharding, vantage

DOCS = "doc_id long, text string, lang string, source string, rank long, shard string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, text, lang, "s", 7, "x") for i, text, lang in rows], DOCS)


# --- 11 collocations
def phrases(rows, least=10, per_lang=2000):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f[lang or "und"].update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        best = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and b >= least and 100 * b >= 50 * a for q, b in c.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:per_lang], 1)]
    return sorted(out)


def test_op11_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice(["a b c", "d e", "A", "b", "c d", "é ü,", "x\ty.", "z  z z", "q\x0cq"]) for _ in range(rnd.randrange(40))) for _ in range(120)]
    rows = [(i, t, ("en", "de", None, "und")[i % 4]) for i, t in enumerate(texts)] + [(500 + i, "Same piece here. Same piece here!", "en") for i in range(30)]
    rows += [(900, None, "en"), (901, "", "fr"), (902, " \t ,.", "fr"), (903, "long words " * 700, "en"), (903, "w" * 50_000, "en")]
    monkeypatch.setattr(collocations, "LONG", 16)
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 512)
    got = collocations.collocations(docs_of(spark, rows))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == phrases(rows)
    assert sorted(tuple(r) for r in collocations.collocations(docs_of(spark, rows), least=3, per_lang=5).collect()) == phrases(rows, 3, 5)


def test_op11_long_pieces_and_many_flushes_count_the_same(spark, monkeypatch):
    import pyarrow as pa

    rnd = random.Random(1)
    words = [rnd.choice("abcd") for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"lang": ["x", "x"], "piece": [" ".join(words), "a b"], "n": [2, 5], "words": [300, 2]})
    for limit, size in ((1 << 20, 1 << 20), (7, 1)):
        monkeypatch.setattr(collocations, "LONG", limit)
        monkeypatch.setattr(collocations, "FLUSH_BYTES", size)
        blocks = sorted((r for b in collocations._grams(3)(iter([batch])) for r in b.to_pylist()), key=lambda r: r["bucket"])
        summed = collocations._sums(1)(iter([pa.RecordBatch.from_pylist(blocks, pa.schema([("bucket", pa.int32()), ("block", pa.binary())]))]))
        got = {r["phrase"]: r["f"] for b in summed for r in b.to_pylist()}
        want = Counter(" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(301 - k))
        assert got == Counter({p: 2 * c for p, c in want.items()}) + Counter({"a": 5, "b": 5, "a b": 5})


def test_op11_counts_beyond_64_bits_and_empty_table(spark):
    from pyspark.sql import functions as F

    a = 4_000_000_000_000
    row = spark.createDataFrame([(a, a + 1, a + 3)], "a long, l long, r long")
    dec = [F.col(c).cast("decimal(16,0)") for c in "alr"]
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * dec[0] * dec[0], dec[1] * dec[2])
    assert row.select(score).first()[0] == 1_000_000 * a * a // ((a + 1) * (a + 3))
    assert collocations.collocations(docs_of(spark, [])).collect() == []


# --- 12 sharding
def shards_of(texts, shards):
    groups = Counter()
    for t in texts:
        groups[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 8
    heap, got = [(0, i) for i in range(shards)], defaultdict(Counter)
    for sha, size in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        load, i = heapq.heappop(heap)
        got[size][i] += 1
        heapq.heappush(heap, (load + size, i))
    out = {}
    for size, by in got.items():
        order = sorted(s for s, x in groups.items() if x == size)
        out |= dict(zip(order, [i for i in sorted(by) for _ in range(by[i])]))
    return out, sorted(load for load, _ in heap)


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_op12_equals_brute_force(spark, shards):
    rnd = random.Random(shards)
    texts = [rnd.choice(["", None, "é" * 5, "same text", "x" * rnd.randrange(400), str(rnd.random())[:6], "y" * 3 + str(rnd.randrange(90))]) for _ in range(500)] + ["z" * 90_000] * 2
    rows = [(i % 480, t, "en") for i, t in enumerate(texts)] + [(None, "same text", "en")] * 40
    out = sharding.assign_shards(docs_of(spark, rows), shards)
    assert out.columns == ["doc_id", "text", "lang", "source", "rank", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got, (want, loads) = out.collect(), shards_of([r[1] for r in rows], shards)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in rows)
    seen, by = Counter(), defaultdict(list)
    for r in got:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert r.shard == want[hashlib.sha256(raw).hexdigest()]
        seen[r.shard] += r.size
        by[r.shard].append((r.slot, r.doc_id is not None, r.doc_id or 0, hashlib.sha256(raw).digest()))
    for slots in by.values():
        assert sorted(s[0] for s in slots) == list(range(len(slots)))
        assert [s[1:] for s in sorted(slots)] == sorted(s[1:] for s in slots)
    assert sorted(seen[i] for i in range(shards)) == loads


def test_op12_pours_like_one_by_one():
    rnd = random.Random(3)
    for _ in range(60):
        many, single = sharding.Loads(5), sharding.Loads(5)
        for size, n in [(rnd.randrange(1, 500), rnd.choice([1, 3, 11, 200])) for _ in range(12)]:
            one = [single.deal(size, 1) for _ in range(n)]
            assert many.deal(size, n) == [sum(x) for x in zip(*one)]
        assert sorted(many.heap) == sorted(single.heap)


def test_op12_empty_table_and_files(spark, tmp_path):
    assert sharding.assign_shards(docs_of(spark, [])).collect() == []
    out = sharding.assign_shards(docs_of(spark, [(i, f"text {i}", "en") for i in range(50)]), 4)
    sharding.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(tuple, back.select("doc_id", "text", "shard", "slot").collect())) == sorted(map(tuple, out.select("doc_id", "text", "shard", "slot").collect()))


# --- 13 hard negatives
def negatives(rows, scale=256, every=100):
    ok = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(scale * x) for x in v], label))
    out = []
    for i, q, label in ok:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, x)), j, other) for j, x, other in ok if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k, _) in enumerate(fit, 1)]
    return sorted(out)


def test_op13_equals_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(13)
    centres = rnd.normal(size=(12, 8))
    rows = [(int(i), (centres[i % 12] + 0.2 * rnd.normal(size=8)).tolist(), int(rnd.integers(3))) for i in range(700)]
    rows += [(700 + i, rows[i % 5][1], i % 3) for i in range(60)] + [rows[100], rows[100], rows[7]]
    rows += [(2000, [1.0, 2.0], 0), (2001, [0.5] * 40, 1), (2100, [], 1), (2003, None, 1), (2200, [1.0, None], 1), (2005, [float("nan")] * 8, 2), (2300, [float("inf")] * 8, 2), (2400, [0.1] * 8, None),
             (None, [0.1] * 8, 1), (2500, [30.0] * 8, 2), (2501, [-30.0] * 8, 2)]
    df = spark.createDataFrame([(i, v, label, 5) for i, v, label in rows], "vec_id long, embedding array<double>, label int, score int")
    monkeypatch.setattr(hard_negatives, "BLOCK", 128)
    for chunk in (4 << 20, 300):
        got = hard_negatives.hard_negatives(df, chunk_bytes=chunk)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, got.collect())) == negatives(rows)
    assert hard_negatives.hard_negatives(df.limit(0)).collect() == []


def test_op13_leaves_out_what_lies_outside_the_annulus():
    rnd = np.random.default_rng(2)
    x = np.floor(256 * (np.repeat(np.eye(16), 64, axis=0) + 0.02 * rnd.normal(size=(1024, 16))))
    tree = vantage.Tree.grow(x)
    place = np.empty(len(x), np.int64)
    place[tree.order] = np.arange(len(x))
    block = hard_negatives.Block({"ids": tree.order.tolist(), "labels": (tree.order % 2).tolist(), "data": x[tree.order].tobytes(), "points": place[tree.points].tolist(),
                                  "shells": tree.shells.ravel().tolist(), "leaves": tree.leaves, "most": tree.most})
    q, one = x[:1], np.zeros(1, np.int64)
    probes = hard_negatives.Probes(q, np.array([0]), one, one, one, np.array([30_000]), np.array([60_000]), False, 5)
    visited, score = [], probes._score
    probes._score = lambda *a: (visited.append(a[-2:]), score(*a))
    probes.meet(block)
    want = sorted((-int(s), int(i)) for i, s in enumerate((x @ q[0])) if i % 2 and 30_000 <= s <= 60_000)[:5]
    assert [(-int(s), int(i)) for s, i in zip(probes.scores[0], probes.found[0])] == want
    assert len(visited) < tree.leaves
