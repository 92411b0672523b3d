"""Operator 10: benchmark decontamination by winnowed fingerprints.

A window is ``window`` consecutive words. With grams of k words, the smallest gram
hash of every w neighbouring grams is kept, where k + w - 1 = window: two texts that
share a window share all its grams, so they share the kept one. Fingerprints of
documents meet those of the benchmark by hash; only texts with a meeting are read
again, and only windows around the met grams are compared, by their words.

Joins are keyed by the identity of a text, not by id: copies are compared once, and
null or repeated ids need no special case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.columns import ascii_lower, table, text_key, without
from planloom.sources.scratch import discard, stage

WINDOW = 10
#: A word: a run of digits, letters a-z and anything beyond ASCII, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OUT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS, -1), "")


def _grams(hashes: Column, size: int, *salt: Column) -> Column:
    """Hashes of all runs of ``size`` neighbours; null where there are fewer."""
    at = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)], *salt)
    return F.when(F.size(hashes) >= size, F.transform(F.sequence(F.lit(0), F.size(hashes) - size), at))


def _winnowed(grams: Column, span: int) -> Column:
    """Smallest of every ``span`` neighbours, once each; null where there are fewer."""
    low = lambda i: F.least(*[F.get(grams, i + j) for j in range(span)]) if span > 1 else F.get(grams, i)
    return F.when(F.size(grams) >= span, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(grams) - span), low)))


def _place(length: int):
    """Builder of a window's place and words from its start; made where the words are, so no row of a window carries them all."""
    return lambda s: F.struct(s.alias("s"), F.lit(length).alias("len"), F.array_join(F.slice("_words", s + 1, length), " ").alias("key"))


def _with_grams(df: DataFrame, text_col: str, gram: int) -> DataFrame:
    df = df.withColumn("_words", word_list(F.col(text_col)))
    df = df.withColumn("_wh", F.transform("_words", lambda w: F.xxhash64(w)))
    return df.withColumn("_grams", _grams(F.col("_wh"), gram))


def _fingerprints(df: DataFrame, window: int, short: list[int]) -> Column:
    """Winnowed grams, and for each length in ``short`` all runs of that length."""
    gram = (window + 1) // 2
    parts = [_winnowed(F.col("_grams"), window - gram + 1)]
    parts += [F.array_distinct(_grams(F.col("_wh"), n, F.lit(n))) for n in short]
    empty = F.array().cast("array<bigint>")
    return F.concat(*[F.coalesce(p, empty) for p in parts])


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows of ``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``.

    A benchmark text of fewer than ``window`` words, but not none, is one window of
    its own length. A word is hit if it lies in any occurrence of a window. Null and
    empty texts have no words; null item ids hit words but are not listed; equal item
    ids are listed once. Input columns named like an output are replaced; empty tables
    on either side give no hits.
    """
    gram = (window + 1) // 2
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    items = stage(_with_grams(items, "text", gram).filter(F.size("_words") > 0).withColumn("n", F.size("_words")), "bench-items")
    # at most window - 1 different lengths
    short = sorted(r[0] for r in items.filter(F.col("n") < window).select("n").distinct().collect())
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))
    own = F.least(F.col("n"), F.lit(window))
    windows = items.select("item", own.alias("len"), F.explode_outer(F.transform(starts, lambda s: F.array_join(F.slice("_words", s + 1, own), " "))).alias("key"))
    windows = stage(windows.distinct(), "bench-windows")
    small = F.when(F.col("n") < window, F.array(F.xxhash64(F.lit(0), F.lit(0))))
    for n in short:
        small = F.when(F.col("n") == n, _grams(F.col("_wh"), n, F.lit(n))).otherwise(small)
    prints = F.coalesce(F.when(F.col("n") < window, small).otherwise(_winnowed(F.col("_grams"), window - gram + 1)), F.array().cast("array<bigint>"))
    bench_prints = stage(items.select(F.explode_outer(prints).alias("print")).distinct(), "bench-prints")

    kept = without(docs, [*OUT, "_key", "_words", "_wh", "_grams"])
    texts = kept.select(F.col(text_col).alias("text"))
    rows = _with_grams(texts, "text", gram).select(text_key(F.col("text")).alias("_key"), _fingerprints(texts, window, short).alias("prints"))
    met = rows.select("_key", F.explode_outer("prints").alias("print")).join(bench_prints, "print")
    met = stage(met.groupBy("_key").agg(F.collect_set("print").alias("prints")), "bench-met")

    # the texts with a meeting, once each, and the windows around the met grams
    again = texts.select(text_key(F.col("text")).alias("_key"), "text").join(met, "_key")
    again = again.groupBy("_key").agg(F.min(F.struct("text")).alias("t"), F.first("prints").alias("prints"))
    again = _with_grams(again.select("_key", F.col("t.text").alias("text"), "prints"), "text", gram)
    last = F.size("_words") - window
    near = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("_grams") - 1), lambda i: F.array_contains(F.col("prints"), F.get(F.col("_grams"), i))),
        lambda i: F.sequence(F.greatest(i - (window - gram), F.lit(0)), F.least(i, last)))
    places = [F.when(last >= 0, F.transform(F.array_distinct(F.flatten(near)), _place(window)))]
    places += [F.when(F.size("_words") >= n, F.transform(F.sequence(F.lit(0), F.size("_words") - n), _place(n))) for n in short]
    none = F.array().cast("array<struct<s:int,len:int,key:string>>")
    again = again.select("_key", F.explode_outer(F.concat(*[F.coalesce(p.cast("array<struct<s:int,len:int,key:string>>"), none) for p in places])).alias("p"))
    again = again.filter("p is not null").select("_key", F.struct("p.s", "p.len").alias("at"), "p.len", "p.key")
    found = again.join(windows, ["len", "key"]).groupBy("_key").agg(F.collect_set("at").alias("at"), F.collect_set("item").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a["s"], a["s"] + a["len"] - 1))))
    found = stage(found.select(
        "_key", F.size(covered).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256")), "bench-found")

    out = kept.withColumn("_key", text_key(F.col(text_col))).join(found, "_key", "left").select(
        *[F.col(f"`{c}`") for c in kept.columns],
        F.coalesce(F.array_size(word_list(F.col(text_col))), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
    for old in (items, windows, bench_prints, met):
        discard(old)
    return out


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", *OUT)


OP10_SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select distinct item, least(len(w), 10) as n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') as k
       from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from i where len(w) > 0)),
ns as (select distinct n from iw),
dw as (select rid, s, n, array_to_string(w[s:s + n - 1], ' ') as k
       from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as s from d cross join ns where len(w) >= n)),
h as (select distinct rid, s, dw.n, item from dw join iw on dw.n = iw.n and dw.k = iw.k),
c as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(s, s + n)) as p from h) group by rid),
l as (select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (rid) left join l using (rid)
"""
