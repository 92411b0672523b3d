"""Small fixtures that pin semantics."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from planloom.functions import numeric as N
from planloom.functions import text as X
from planloom.operators import relational, replay
from planloom.operators.graph import seeded_rank
from planloom.sources import records
from planloom.streaming import windowed_outcomes

one = lambda df: tuple(df.first())


def task(spark, **k):
    base = {"id": "t", "split": "eval", "instruction": "", "plan": ["open(box)", "put(cup)"], "initial_facts": ["have(cup)"], "goal_facts": ["in(cup, box)"], "forbidden": [], "should_reject": False,
            "action_model": {"open(box)": (["have(cup)"], ["opened(box)"], []), "put(cup)": (["opened(box)"], ["in(cup, box)"], ["have(cup)"])}}
    return spark.createDataFrame([tuple({**base, **k}.values())], replay.TASK_SCHEMA)


def test_wilson_and_mcnemar(spark):
    r = spark.range(1).select(N.wilson(F.lit(8), F.lit(10)).alias("w"), N.wilson(F.lit(0), F.lit(0)).alias("z"), N.mcnemar(F.lit(0), F.lit(2)).alias("p"), N.mcnemar(F.lit(0), F.lit(0)).alias("q"), N.mcnemar(F.lit(40), F.lit(60)).alias("r")).first()
    assert r.w.low == pytest.approx(0.4901625) and r.w.high == pytest.approx(0.9433178)
    assert tuple(r.z) == (0.0, 0.0) and r.p == pytest.approx(0.5) and r.q == 1.0
    assert r.r == pytest.approx(min(1, 2 * sum(math.comb(100, i) for i in range(41)) / 2**100), rel=1e-9)


def test_calls_and_predicates(spark):
    r = spark.createDataFrame([("not(inside(a, b))",), ("walk",), (" go( x , y) ",)], "c string").select(X.call_name(F.col("c")).alias("n"), X.call_args(F.col("c")).alias("a"), X.inner_predicate(F.col("c")).alias("i")).collect()
    assert (r[0].n, r[0].a, r[0].i) == ("not", ["inside(a", "b)"], "inside")
    assert (r[1].n, r[1].a) == ("walk", [])
    assert (r[2].n, r[2].a) == ("go", ["x", "y"])


def test_plan_success_and_goal(spark):
    r = replay.replay(task(spark)).first()
    assert (r.status, r.violation, r.steps, r.goal_share) == ("success", None, 2, 1.0)
    assert r.final_state == ["in(cup, box)", "opened(box)"]


@pytest.mark.parametrize("plan,violation", [
    (["put(cup)"], "missing_step"), (["fly()"], "hallucination"), (["open(box)", "open(box)"], "additional_step"), (["open(box)", "put(cup)", "put(cup)"], "additional_step"), (None, "parse_error")])
def test_violations(spark, plan, violation):
    r = replay.replay(task(spark, plan=plan)).first()
    assert (r.status, r.violation) == ("failed", violation)


def test_wrong_order_and_rejection_and_safety(spark):
    m = {"drop(cup)": (["have(cup)"], ["free()"], ["have(cup)"]), "use(cup)": (["have(cup)"], ["used()"], [])}
    assert replay.replay(task(spark, plan=["drop(cup)", "use(cup)"], action_model=m)).first().violation == "wrong_order"
    assert replay.replay(task(spark, plan=["reject()"])).first().status == "rejected"
    r = replay.replay(task(spark, forbidden=["open(box)"])).first()
    assert (r.violation, r.risk) == ("safety", True)
    r = replay.replay(task(spark, forbidden=["open(box)"]), stop_on_safety=False).first()
    assert (r.status, r.risk) == ("success", True)


def test_negated_goal(spark):
    r = spark.range(1).select(N.goal_share(F.array(F.lit("not(open(light))"), F.lit("on(x)")), F.array(F.lit("on(x)"))).alias("s"), N.goal_share(F.array().cast("array<string>"), F.array(F.lit("a"))).alias("e")).first()
    assert tuple(r) == (1.0, 1.0)


def test_repair_and_evaluation(spark):
    t = task(spark, plan=["open(box)", "open(box)", "put(cup)"])
    first = replay.replay(t)
    fixed = replay.repair(first)
    assert fixed.first().repaired == ["open(box)", "put(cup)"]
    final = replay.replay(t.drop("plan").join(fixed.select("id", F.col("repaired").alias("plan")), "id"))
    e = replay.evaluate(first, final).first()
    assert e.recovered and e.task_success and not e.initial_success


def test_search_finds_the_plan(spark):
    assert replay.search_plans(task(spark, plan=[]), 4).first().plan == ["open(box)", "put(cup)"]
    assert replay.search_plans(task(spark, plan=[], forbidden=["open(box)"]), 4).count() == 0


def test_knowledge_edges(spark):
    e = {(r.relation, r.target) for r in replay.knowledge_edges(task(spark)).collect()}
    assert ("next_action", "action_call:put(cup)") in e and ("goal_predicate", "predicate:in") in e


def test_constraints_raise(spark):
    a = spark.createDataFrame([(1, 1), (2, 0)], "id int, v int")
    with pytest.raises(Exception, match="unpaired"):
        relational.paired(a, a.filter("id = 1"), "id", "v", True).collect()
    with pytest.raises(Exception, match="repeated"):
        relational.require_unique(a.union(a), "id").collect()


def test_spread_and_allocation(spark):
    df = spark.range(11).withColumn("g", F.lit(1))
    assert sorted(r.id for r in relational.spread_sample(df, ["g"], [F.col("id")], 3).collect()) == [0, 5, 10]
    g = spark.createDataFrame([("a", 90), ("b", 9), ("c", 1)], "k string, n int")
    seats = {r.k: r.seats for r in relational.allocate(g, "k", "n", 10).collect()}
    assert seats == {"a": 8, "b": 1, "c": 1}


def test_rank_keeps_mass(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "source string, target string, weight double")
    m = seeded_rank(e, spark.createDataFrame([("a", 1.0)], "node string, weight double"), rounds=8)
    assert m.agg(F.sum("mass")).first()[0] == pytest.approx(1.0)


def test_records(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id": "a", "instruction": "x"}\n\n{"id": "b", "instruction": "y", "slots": {"k": "v"}}\n')
    r = records.read_tasks(spark, str(tmp_path / "t.jsonl")).filter("id is not null").collect()
    assert [(x.id, x.split, x.goal_facts) for x in r] == [("a", "eval", []), ("b", "eval", [])]
    (tmp_path / "bad.jsonl").write_text('[1]\n')
    with pytest.raises(Exception, match="no JSON object"):
        records.read_strict(spark, str(tmp_path / "bad.jsonl")).collect()
    df, other = spark.range(3), spark.range(4)
    assert records.write_once(df, str(tmp_path / "w")) and not records.write_once(df, str(tmp_path / "w"))
    with pytest.raises(ValueError):
        records.write_once(other, str(tmp_path / "w"))


def test_stream(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(src).schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(src).repartition(2).write.parquet(str(tmp_path / "in" / "e"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "e"))
    q = windowed_outcomes(s, "ts", ["event_type"], F.col("event_type") == "purchase").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("w").agg(F.sum("n")).first()[0] == spark.read.parquet(src).count()


def test_sign_flip_counts_every_pattern(spark):
    import itertools

    from planloom.plans.outcome_queries import sign_flip_share

    for effects in ([0.3], [0.5, -0.25, 0.125, 0.25, 0.25], [0.1 * i - 0.3 for i in range(11)], [0.0, 0.0]):
        sums = [abs(sum(s * x for s, x in zip(signs, effects))) for signs in itertools.product((1, -1), repeat=len(effects))]
        assert sign_flip_share(spark, effects) == sum(x >= abs(sum(effects)) - 1e-12 * len(effects) for x in sums) / len(sums)
    assert sign_flip_share(spark, [1.0] * 30) == 2 / 2**30


def test_sign_flip_all_takes_every_source(spark):
    from planloom.catalog import QUERIES

    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    assert QUERIES["sign_flip_all"](spark, d).first()["families"] == docs.join(labels, "doc_id").select("source").distinct().count()


def test_paired_bounds(spark):
    import numpy as np

    from planloom.operators.resampling import paired_bounds

    x = np.random.default_rng(4).integers(-1, 2, 400).astype(float)
    rows = [("en", 7 * i - 900, float(v)) for i, v in enumerate(x)] + [("en", 1, None), ("one", 5, 0.5), (None, 3, 1.0), (None, 4, -1.0)]
    got = {r.lang: r for r in paired_bounds(spark.createDataFrame(rows, "lang string, doc_id long, x double"), "lang", "doc_id").collect()}
    r, half = got["en"], 1.96 * x.std() / np.sqrt(len(x))
    assert abs(r["uplift"] - x.mean()) < 1e-9 and got[None]["uplift"] == 0 and (got["one"]["low"], got["one"]["high"]) == (0.0, 0.5)
    assert abs(r["low"] - (x.mean() - half)) < half / 6 and abs(r["high"] - (x.mean() + half)) < half / 6


def test_cluster_bounds_equal_a_plain_bootstrap(spark):
    import numpy as np

    from planloom.operators.resampling import MIXES, PRIME, cluster_bounds

    rnd = np.random.default_rng(5)
    rows = [("a", f"f{i:02}", float(rnd.integers(-9, 10)), float(rnd.integers(10, 30))) for i in range(12)] + [("b", "only", 3.0, 4.0)]
    got = {r.cell: r for r in cluster_bounds(spark.createDataFrame(rows, "cell string, family string, total double, n double"), "cell", "family", 3_000).collect()}
    b, j = np.meshgrid(np.arange(3_000), np.arange(12), indexing="ij")
    u = (b * 48_271 + j * 40_692 + 12_345) % PRIME
    for add, more in MIXES:
        u = (u * (u + add) + more) % PRIME
    pick = u * 12 // PRIME
    total, n = np.array([r[2] for r in rows[:12]]), np.array([r[3] for r in rows[:12]])
    by_task, by_family = total[pick].sum(1) / n[pick].sum(1), (total / n)[pick].mean(1)
    want = [total.sum() / n.sum(), *np.percentile(by_task, [2.5, 97.5]), (total / n).mean(), *np.percentile(by_family, [2.5, 97.5])]
    assert np.allclose(list(got["a"])[1:], want) and list(got["b"])[1:] == [0.75] * 6
    counts = np.bincount(pick.ravel(), minlength=12)
    assert abs(counts / 3_000 - 1).max() < 0.08 and abs(by_family.std() - (total / n).std() / 12**0.5) < 0.01


def test_searches_meet_every_row(spark):
    """Vectors of every label, parts of every brand and every turn are met, against brute force."""
    import numpy as np

    from planloom.catalog import QUERIES

    d = "/root/testdata/sf0.001"
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    got = sorted((r["q"], r["rank"], r["doc"]) for r in QUERIES["cosine_topk_all"](spark, d).collect())
    cos = lambda a, b: round(float(a @ b) / float(np.sqrt(a @ a) * np.sqrt(b @ b)), 6)
    want = [(q, n + 1, j) for q in vectors if q % 20 == 0 for n, (_, j) in enumerate(sorted((-cos(vectors[q], v), j) for j, v in vectors.items() if j != q)[:3])]
    assert got == sorted(want)

    words = lambda x: set(re.findall("[a-z0-9_]+", (x or "").lower()))
    over = lambda a, b: len(a & b) / max(len(a | b), 1)
    turns = [(r["conv_id"], r["turn"], r["role"], words(r["text"])) for r in spark.read.parquet(f"{d}/conversations.parquet").collect() if r["text"] is not None]
    got = sorted((r["q"], r["q_turn"], r["doc"], r["doc_turn"]) for r in QUERIES["memory_topk_all"](spark, d).collect())
    score = lambda a, b: round(over(a[3], b[3]) + (a[2] == b[2]) + 0.25 * (a[0] % 5 == b[0] % 5), 6)
    assert got == sorted((*a[:2], *min((-score(a, b), *b[:2]) for b in turns if b[0] != a[0])[1:]) for a in turns if a[0] % 20 == 0)

    parts = [(r["p_partkey"], r["p_size"], words(r["p_name"]), words(r["p_type"])) for r in spark.read.parquet(f"{d}/part.parquet").collect()]
    got = sorted((r["q"], r["rank"], r["doc"]) for r in QUERIES["structured_topk_all"](spark, d).collect())
    score = lambda a, b: round((0.4 * over(a[2], b[2]) + 0.3 * over(a[3], b[3]) + 0.2 * (a[1] == b[1])) / 0.9, 6)
    want = [(a[0], n + 1, j) for a in parts if a[0] % 20 == 0 for n, (_, j) in enumerate(sorted((-score(a, b), b[0]) for b in parts if b[0] != a[0])[:3])]
    assert got == sorted(want)


def test_calls_ids_and_payloads_by_case(spark):
    from planloom.functions import text as X

    calls = ["go(a, b)", "2go(x)", "go (x)", " _a-b() ", "plain"]
    got = [(r.n, r.a) for r in spark.createDataFrame([(c,) for c in calls], "c string").select(X.call_name(F.col("c")).alias("n"), X.call_args(F.col("c")).alias("a")).collect()]
    assert got == [("go", ["a", "b"]), ("2go(x)", []), ("go (x)", []), ("_a-b", []), ("plain", [])]
    ids = spark.createDataFrame([("  Red Cup-2 ",), ("--",)], "c string").select(X.clean_id(F.col("c")).alias("i")).collect()
    assert [r.i for r in ids] == ["Red_Cup_2", "unknown"]
    cases = {"a ```json\n[1]\n``` b": "[1]", "x ``` ``` [2]": "", "so [a] and [b] end": "[a] and [b]", " ] plain [ ": "] plain [", "```PYTHON x``` y": "x"}
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", X.payload(F.col("c")).alias("p")).collect()
    assert {r.c: r.p for r in rows} == cases


def test_seeded_rank_returns_lost_mass_to_the_seeds(spark):
    from planloom.operators.graph import seeded_rank

    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("b", "a", 1.0)], "source string, target string, weight double")
    seeds = spark.createDataFrame([("a", 2.0)], "node string, weight double")
    mass = {"a": 1.0, "b": 0.0, "c": 0.0}
    for _ in range(5):
        mass = {"a": 0.15 + 0.85 * (mass["b"] + mass["c"]), "b": 0.85 * mass["a"] / 4, "c": 0.85 * mass["a"] * 3 / 4}
    got = {r.node: r.mass for r in seeded_rank(edges, seeds, rounds=5).collect()}
    assert got == pytest.approx(mass)


def test_memory_responses_and_export(spark, tmp_path):
    (tmp_path / "memory.jsonl").write_text('{"id":"a","fix":"x"}\n{"id":"b","fix":"y"}\n')
    rows = records.read_memory(spark, str(tmp_path / "memory.jsonl")).collect()
    digest = hashlib.sha256((tmp_path / "memory.jsonl").read_bytes()).hexdigest()
    assert {r.id for r in rows} == {"a", "b"} and {r.sha256 for r in rows} == {digest}
    for name, text in (("m1_outputs.json", '[{"identifier":"1"}]'), ("m2_outputs.json", "{oops"), ("m3_outputs.json", "3"), ("notes.json", "[]")):
        (tmp_path / "tree" / "home" / "actions").mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / "home" / "actions" / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1][:2]: (r.dataset, r.module, r.issue) for r in records.read_responses(spark, str(tmp_path / "tree")).drop("record").collect()}
    assert got == {"m1": ("home", "actions", None), "m2": ("home", "actions", "invalid_json"), "m3": ("home", "actions", "no_records")}
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "dataset string, id int")
    assert {tuple(r) for r in records.export_by(df, str(tmp_path / "out"), "dataset").collect()} == {("a", 2), ("b", 1)}
    edges = tmp_path / "edges.jsonl"
    edges.write_text('{"task_id":"t","source":"s","relation":"r","target":"x"}\n')
    assert [tuple(r) for r in records.read_edges(spark, str(edges)).collect()] == [("t", "s", "r", "x")]
    edges.write_text('{"task_id":"t","source":"s"}\n')
    with pytest.raises(Exception, match="record without relation"):
        records.read_edges(spark, str(edges)).collect()


def test_scan_fill_equals_forward_fill(spark):
    import random

    from planloom.operators.ordered import forward_fill, scan_fill

    rnd = random.Random(6)
    rows = [(rnd.choice([1, 1, 1, 2, None]), i, rnd.choice(["reset"] + ["none"] * 30 + ["value"] * 2)) for i in range(900)] + [(3, 5_000, "none")]
    df = spark.createDataFrame(rows, "user long, at long, kind string")
    resets, value = F.col("kind") == "reset", F.when(F.col("kind") == "value", F.col("at"))
    for by in ([], ["user"]):
        want = forward_fill(df.withColumn("one", F.lit(1)), by or ["one"], [F.col("at")], resets, value)
        key = lambda out: sorted((r["at"], r["segment"], r["filled"]) for r in out.collect())
        for parts in (1, 7, 40):
            assert key(scan_fill(df, by, ["at"], resets, value, parts)) == key(want)
    assert scan_fill(df.limit(0), ["user"], ["at"], resets, value).collect() == []
