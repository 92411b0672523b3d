"""Column expressions over symbolic calls, facts, identifiers and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A name begins with a letter or underscore, and its bracket follows at once.
CALL = r"^\s*([A-Za-z_][A-Za-z0-9_\-]*)\((.*)\)\s*$"


def call_name(call: Column) -> Column:
    """Name of ``name(args)``; the trimmed whole text where it is no call."""
    return F.when(call.rlike(CALL), F.regexp_extract(call, CALL, 1)).otherwise(F.trim(call))


def call_args(call: Column) -> Column:
    """Arguments split at every comma and trimmed; empty where there are none. Nested calls are not parsed."""
    inner = F.trim(F.regexp_extract(call, CALL, 2))
    return F.when(call.rlike(CALL) & (inner != ""), F.transform(F.split(inner, ","), lambda a: F.trim(a))).otherwise(F.array().cast("array<string>"))


def format_call(name: Column, args: Column) -> Column:
    return F.concat(name, F.lit("("), F.array_join(args, ", "), F.lit(")"))


def inner_predicate(fact: Column) -> Column:
    """Predicate of a fact, looked up inside ``not(...)``."""
    bare = F.regexp_replace(F.trim(fact), r"^not\((.*)\)$", "$1")
    return F.trim(F.substring_index(bare, "(", 1))


def linked_predicate(fact: Column) -> Column:
    """Lower-case text before the first bracket, then before the first space."""
    return F.substring_index(F.trim(F.substring_index(F.lower(fact), "(", 1)), " ", 1)


def tokens(text: Column) -> Column:
    """ASCII word tokens of the lower-cased text; underscores stay inside."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9_]+)"), F.lit(1))


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def humanised(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(name, "_-", "  "), r"\s+", " "))


def clean_id(name: Column) -> Column:
    """Runs of anything but letters and digits become one underscore; none at the ends; ``unknown`` if nothing is left."""
    kept = F.btrim(F.regexp_replace(name, r"[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("unknown"))


def plan_step(step: Column) -> Column:
    """``a b c`` becomes ``a(b, c)``; a blank step ``noop()``."""
    parts = F.filter(F.split(F.trim(step), r"\s+"), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.lit("noop()")).otherwise(format_call(F.get(parts, 0), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def payload(text: Column) -> Column:
    """Structured part of a reply: what its first fence holds (perhaps nothing), less a ``json`` or ``python`` tag;
    without a fence, from the first ``[`` to the last ``]``; without these, all of it."""
    whole = _stripped(text)
    pieces = F.split(whole, "```")
    first, last = F.instr(whole, "["), F.length(whole) - F.instr(F.reverse(whole), "]") + 1
    return (F.when(F.size(pieces) > 2, _stripped(F.regexp_replace(F.get(pieces, 1), r"^(?i:json|python)", "")))
            .when((first > 0) & (last > first) & whole.contains("]"), F.substring(whole, first, last - first + 1)).otherwise(whole))


def is_affordance(fact: Column, prefixes: list[str]) -> Column:
    return fact.rlike(r"^(" + "|".join(prefixes) + r")\(")


def substitute_slots(action: Column, old: Column, new: Column) -> Column:
    """Replace each slot value of ``old`` that ``new`` names too, in entry order, as plain text."""
    return F.aggregate(F.map_entries(old), action, lambda acc, e: F.when(F.map_contains_key(new, e["key"]) & (e["value"] != ""), F.replace(acc, e["value"], F.element_at(new, e["key"]))).otherwise(acc))


def split_action(action: Column) -> Column:
    """``struct<name, inner>``: cut at the first bracket where the trimmed text ends in one; else all of it and null."""
    t, at = F.trim(action), F.instr(F.trim(action), "(")
    called = (at > 0) & t.endswith(")")
    return F.struct(F.when(called, F.trim(F.substring(t, F.lit(1), at - 1))).otherwise(t).alias("name"), F.when(called, F.substring(t, at + 1, F.length(t) - at - 1)).alias("inner"))
