"""Operator 11: phrase collocations by lang, counted out-of-core per hash bucket.

Texts are cut into pieces by Spark, and identical pieces of a lang become one row with
their multiplicity. Tasks turn pieces into weighted n-grams of one to three words with
DuckDB, a bounded amount of text at a time, and send them as packed blocks to the hash
bucket of (lang, phrase); the task of a bucket sums its blocks in DuckDB, which spills
to the task's scratch folder beyond its memory, and keeps the phrases that are frequent
enough to be a candidate or part of one. A candidate then asks for the counts of its
parts: the requests are shuffled to where the counts are, and the answers back.
"""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from planloom.llm.columns import ascii_lower, table
from planloom.sources.scratch import discard, stage

LONG = 2048  # words; longer pieces are counted in stretches that begin so many words apart
FLUSH_BYTES = 8 << 20  # of pieces that a task turns into n-grams at a time
BUCKET_BYTES = 8 << 20  # of distinct pieces for each hash bucket
MOST_BUCKETS = 1 << 16  # larger inputs have larger buckets, which spill
MEMORY = "300MB"  # of DuckDB in a task
SALTS = 64  # shares of a lang that are ranked apart first

ENDS = r"[.,;:!?\x0A-\x0D]"
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

#: ``own`` is how many n-grams may begin in a stretch; the words after those only end them.
GRAMS = """
select lang, phrase, cast(sum(n) as bigint) as f, cast(hash(lang, phrase) % {buckets} as integer) as bucket
from (select lang, n, unnest(list_concat(w[1:own],
             list_transform(range(1, least(own + 1, len(w))), lambda i: w[i] || ' ' || w[i + 1]),
             list_transform(range(1, least(own + 1, len(w) - 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as phrase
      from (select lang, n, own, string_split(piece, ' ') as w from pieces))
group by lang, phrase
"""
SUMS = "select lang, phrase, cast(sum(f) as bigint) as f from blocks group by lang, phrase having sum(f) >= {least}"


def split_pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(``lang``, ``piece``, ``n``, ``words``): distinct pieces of at least a word, words joined by one space."""
    spaced = F.explode(F.split(F.replace(ascii_lower(F.col(text_col)), F.lit("\t"), F.lit(" ")), ENDS))
    pieces = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), spaced.alias("piece"))
    pieces = pieces.select("lang", F.trim("piece").alias("piece")).filter("piece <> ''")
    single = F.when(F.instr("piece", "  ") > 0, F.regexp_replace("piece", " +", " ")).otherwise(F.col("piece"))
    distinct = pieces.select("lang", single.alias("piece")).groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("n"))
    return distinct.select("*", (F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1).cast("long").alias("words"))


def _connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute(f"set threads=1; set memory_limit='{MEMORY}'; set temp_directory='{folder}'; set preserve_insertion_order=false")
    return con


def _stretches(batch: pa.RecordBatch) -> pa.Table:
    """Rows of (lang, piece, n, own), pieces of many words cut into stretches that share two words with the next."""
    t = pa.Table.from_batches([batch])
    few = pc.less_equal(t["words"], LONG)
    short = t.filter(few)
    short = short.select(["lang", "piece", "n"]).append_column("own", short["words"])
    rows = []
    for r in t.filter(pc.invert(few)).to_pylist():
        words = r["piece"].split(" ")
        rows += [{"lang": r["lang"], "piece": " ".join(words[i : i + LONG + 2]), "n": r["n"], "own": min(LONG, len(words) - i)} for i in range(0, len(words), LONG)]
    return pa.concat_tables([short, pa.Table.from_pylist(rows, short.schema)]) if rows else short


def _packed(t: pa.Table) -> bytes:
    """Sorted phrases by what each adds to the one before, counts and lengths in few bits."""
    sink = pa.BufferOutputStream()
    pq.write_table(t, sink, use_dictionary=["lang"], column_encoding={"phrase": "DELTA_BYTE_ARRAY", "f": "DELTA_BINARY_PACKED"}, compression="zstd", write_statistics=False)
    return sink.getvalue().to_pybytes()


def _grams(buckets: int):
    """Pieces to blocks of counted n-grams, a row for each flush and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            held: list[pa.Table] = []

            def flush() -> Iterator[pa.RecordBatch]:
                with _connect(folder) as con:
                    con.register("pieces", pa.concat_tables(held))
                    t = con.sql(GRAMS.format(buckets=buckets)).to_arrow_table()
                held.clear()
                t = t.take(pc.sort_indices(t, [("bucket", "ascending"), ("phrase", "ascending")])).combine_chunks()
                runs = pc.run_end_encode(t["bucket"].chunk(0)) if t.num_rows else None
                at = 0
                for bucket, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()) if runs else ():
                    block = _packed(t.slice(at, end - at).select(COUNTS.names).cast(COUNTS))
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], pa.binary())], ["bucket", "block"])
                    at = end

            size = 0
            for batch in batches:
                rows = max(1, batch.num_rows * FLUSH_BYTES // max(batch.nbytes, 1))
                for at in range(0, batch.num_rows, rows):
                    part = _stretches(batch.slice(at, rows))
                    held.append(part)
                    size += part.nbytes
                    if size >= FLUSH_BYTES:
                        yield from flush()
                        size = 0
            if held:
                yield from flush()

    return run


def _sums(least: int):
    """Blocks in order of bucket to the phrases of each bucket that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (pair for b in batches for pair in zip(b.column("bucket").to_pylist(), b.column("block")))
        with tempfile.TemporaryDirectory() as folder, _connect(folder) as con:
            for _, blocks in itertools.groupby(rows, key=lambda pair: pair[0]):
                read = (batch for _, block in blocks for batch in pq.ParquetFile(pa.BufferReader(block.as_buffer())).iter_batches())
                con.register("blocks", pa.RecordBatchReader.from_batches(COUNTS, read))
                yield from con.sql(SUMS.format(least=least)).to_arrow_table().cast(COUNTS).to_batches(max_chunksize=1 << 16)
                con.unregister("blocks")

    return run


def count_phrases(pieces: DataFrame, size: int, least: int) -> DataFrame:
    """(``lang``, ``phrase``, ``f``): phrases of one to three words with at least ``least`` occurrences; ``size`` is the bytes of ``pieces``."""
    buckets = max(1, min(MOST_BUCKETS, -(-size // BUCKET_BYTES)))
    blocks = pieces.mapInArrow(_grams(buckets), "bucket int, block binary")
    dealt = blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_sums(least), "lang string, phrase string, f long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, per_lang: int = 2000) -> DataFrame:
    """The ``per_lang`` best phrases of two or three words of each lang, with their counts and scores.

    Columns: ``lang``, ``rank``, ``phrase``, ``a`` (its occurrences), ``l`` and ``r`` (those
    of the parts at its lowest-scoring cut), ``n`` (words of the lang), ``score``
    (floor(1000000 a a / (l r)), exact in decimals of 38 digits). A phrase of fewer than
    ``least`` occurrences is none; one inside a longer candidate with at least half its
    occurrences is dropped. Ties go to the larger count, then to the phrase that comes
    first in UTF-8. Null texts hold no words, a null lang is ``und``, repeated rows count
    each time, an empty table gives no rows; other columns are not read.
    """
    seen = Observation()
    found = split_pieces(docs, text_col, lang_col).observe(seen, F.sum(F.octet_length("piece") + 16).alias("size"))
    pieces = stage(found, "phrase-pieces")
    totals = pieces.groupBy("lang").agg(F.sum(F.col("n") * F.col("words")).alias("n"))
    counts = stage(count_phrases(pieces, seen.get["size"] or 0, least), "phrase-counts")
    length = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit("")))
    longer = counts.filter(length == 2)
    inner = F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)))
    holders = longer.select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("holder"))
    candidates = counts.filter(length >= 1).join(holders, ["lang", "phrase"], "left").filter("holder is null or 100 * holder < 50 * f")

    def part(k: int, n: int) -> Column:
        return F.struct(F.lit(k).alias("cut"), F.substring_index("phrase", " ", k).alias("first"), F.substring_index("phrase", " ", k - n).alias("rest"))

    cuts = F.explode(F.when(length == 1, F.array(part(1, 2))).otherwise(F.array(part(1, 3), part(2, 3))))
    asked = candidates.select("lang", "phrase", F.col("f").alias("a"), cuts.alias("c")).select("lang", "phrase", "a", "c.*")
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("part")) for s in ("first", "rest")]))
    requests = asked.select("lang", "phrase", "a", "cut", sides.alias("s")).select("lang", "phrase", "a", "cut", "s.*")
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    cut = answers.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("side") == "first", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "rest", F.col("f"))).alias("r"))
    a, l, r = (F.col(c).cast("decimal(16,0)") for c in "alr")
    parted = cut.select("*", F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, l * r).alias("score"))
    lowest = F.min(F.struct("score", "cut", "l", "r"))
    scored = parted.groupBy("lang", "phrase", "a").agg(lowest.alias("low")).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt")  # the best of a lang are among the best of its shares
    share = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    shares = scored.select("*", salt).select("*", share.alias("rank")).filter(F.col("rank") <= per_lang).drop("rank", "salt")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    best = shares.select("*", rank.alias("rank")).filter(F.col("rank") <= per_lang)
    out = stage(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrase-best")
    for old in (pieces, counts):
        discard(old)
    return out


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
           from documents where text is not null),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
n as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
g as (select lang, unnest(list_concat(
        list_transform(range(1, len(w) + 1), lambda i: {'k': 1, 'phrase': w[i]}),
        list_transform(range(1, len(w)), lambda i: {'k': 2, 'phrase': w[i] || ' ' || w[i + 1]}),
        list_transform(range(1, len(w) - 1), lambda i: {'k': 3, 'phrase': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]})), recursive := true) from w),
f as (select lang, k, phrase, count(*) as f from g group by all having count(*) >= 10),
h as (select lang, unnest([string_split(phrase, ' ')[1] || ' ' || string_split(phrase, ' ')[2], string_split(phrase, ' ')[2] || ' ' || string_split(phrase, ' ')[3]]) as phrase, f from f where k = 3),
c as (select * from f where k >= 2 and not exists (select 1 from h where h.lang = f.lang and h.phrase = f.phrase and f.k = 2 and 100 * h.f >= 50 * f.f)),
u as (select lang, phrase, f as a, string_split(phrase, ' ') as w, unnest(range(1, k)) as cut from c),
s as (select u.lang, u.phrase, u.a, u.cut, l.f as l, r.f as r, cast((cast(1000000 as hugeint) * u.a * u.a) // (cast(l.f as hugeint) * r.f) as bigint) as score
      from u join f l on l.lang = u.lang and l.phrase = array_to_string(u.w[1:u.cut], ' ')
             join f r on r.lang = u.lang and r.phrase = array_to_string(u.w[u.cut + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
k as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
select k.lang, cast(rank as integer) as rank, phrase, a, l, r, n.n, score from k join n using (lang) where rank <= 2000
"""
