"""Operator 1: drop lines that too large a share of a host's pages carry.

Lines are counted per host as 64-bit hashes, one count per page, with map-side
partial sums, so a line on a third of all pages costs one row per task. The lines
over the ratio are folded into one array per host. A host can have at most
(mean lines per page) / ratio of them, so that array stays small however many pages
there are; pages then meet their host's array and lose the lines in it, without
being taken apart and put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.columns import table, without
from planloom.sources.scratch import discard, stage

RATIO = 0.1  # a line on more than this share of a host's pages is boilerplate ...
MIN_PAGES = 2  # ... if pages share it at all

#: What a line is compared by: the text without blanks at its ends.
BLANKS = " \t\r\x0b\x0c"


def html_lines(html: Column) -> Column:
    """Text of a page as lines: scripts, styles and comments go, every tag ends a line."""
    bare = F.regexp_replace(html, r"(?is)<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->", "")
    cut = F.split(F.regexp_replace(bare, r"<[^>]*>", "\n"), "\n", -1)
    return F.array_join(F.filter(F.transform(cut, lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != ""), "\n")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def drop_boilerplate(docs: DataFrame, host_col: str = "host", text_col: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``, plus ``n_lines`` and ``n_dropped``.

    Lines end at a line feed and are compared without blanks at their ends; blank
    lines always stay. A line counts once per row, however often a row repeats it, and
    repeated rows count as pages of their own. Null hosts form one host of their own. A
    null text stays null with 0 lines; an empty text is one blank line; a row may lose
    all its lines and then keeps an empty text. Input columns named like an output are
    replaced. An empty table gives an empty result.
    """
    kept = without(docs, ["n_lines", "n_dropped", "_host", "_lines", "_drop", "_kept"])
    host = F.concat(F.when(F.col(host_col).isNull(), "1").otherwise("0"), F.coalesce(F.col(host_col), F.lit("")))
    lines = F.split(F.col(text_col), "\n", -1)
    key = lambda x: F.xxhash64(F.btrim(x, F.lit(BLANKS)))
    pages = kept.select(host.alias("h"), F.array_distinct(F.transform(lines, key)).alias("keys"))
    totals = pages.groupBy("h").agg(F.count(F.lit(1)).alias("total"))
    counts = pages.select("h", F.explode_outer("keys").alias("k")).groupBy("h", "k").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter((F.col("n") >= min_pages) & (F.col("k") != F.xxhash64(F.lit(""))))
    frequent = stage(counts, "lines-frequent")
    totals = stage(totals, "lines-hosts")
    over = frequent.join(totals, "h").filter(F.col("n") > F.lit(ratio) * F.col("total"))
    by_host = stage(over.groupBy("h").agg(F.collect_list("k").alias("_drop")).withColumnRenamed("h", "_host"), "lines-boilerplate")
    met = kept.select(*[F.col(f"`{c}`") for c in kept.columns], host.alias("_host")).join(by_host, "_host", "left")
    split = F.split(F.col(text_col), "\n", -1)
    left = F.filter(split, lambda x: ~F.array_contains(F.col("_drop"), key(x)))
    met = met.select(*[F.col(f"`{c}`") for c in kept.columns], F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
                     F.when(F.col("_drop").isNull(), split).otherwise(left).alias("_kept"))
    out = met.select(
        *[F.array_join("_kept", "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in kept.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.col("n_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
    )
    discard(frequent)
    discard(totals)
    return out


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Pages as text lines, less what each host repeats."""
    pages = table(spark, sf_dir, "pages")
    texts = pages.select("page_id", url_host(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text"))
    return drop_boilerplate(texts)


OP1_SQL = r"""
with p as (
  select row_number() over () as rid, page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as host,
         array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(html,
           '(?is)<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->', '', 'g'), '<[^>]*>', chr(10), 'g'), chr(10)),
           lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> ''), chr(10)) as text
  from pages),
s as (select rid, host, string_split(text, chr(10)) as lines from p),
t as (select host, count(*) as total from p group by host),
u as (select distinct rid, host, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as line from (select rid, host, unnest(lines) as x from s)),
b as (select u.host, line from u join t on u.host is not distinct from t.host where line <> ''
      group by u.host, line having count(*) >= 2 and count(*) > 0.1::double * any_value(total)),
g as (select host, list(line) as gone from b group by host)
select page_id, p.host, array_to_string(k, chr(10)) as text,
       cast(case when p.text is null then 0 else len(lines) end as bigint) as n_lines,
       cast(case when p.text is null then 0 else len(lines) - len(k) end as bigint) as n_dropped
from (select s.rid, lines, case when gone is null then lines else
             list_filter(lines, lambda x: not list_contains(gone, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) end as k
      from s left join g on s.host is not distinct from g.host) q
join p on p.rid = q.rid
"""
