"""Canonical JSON of typed columns: one text for equal values, whatever the order of columns, fields or keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = float(1 << 53)  # doubles below it that are whole are written as integers


def quoted(text: Column) -> Column:
    """A JSON string, escaped as ``to_json`` does."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _number(x: Column) -> Column:
    """Integers without a point; other finite numbers as Spark writes the double; null for what is no number."""
    d = x.cast("double")
    whole = (F.abs(d) < WHOLE) & (d == F.floor(d))
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), "null").when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """JSON of ``value`` of type ``kind`` without blanks, keys in code-point order at every depth; null is ``null``.

    Fields of structs and entries of maps are sorted by name, arrays keep their order. A
    number has one form, so 1, 1.0 and a decimal of 1 are the same; bytes are in base 64,
    dates and times as ``to_json`` writes them. Maps have string keys.
    """
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode())
        parts = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical_json(value.getField(f.name), f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts) if parts else F.lit(""), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(value))
        text = F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(quoted(k), F.lit(":"), canonical_json(F.element_at(value, k), kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, T.BooleanType):
        text = value.cast("string")
    elif isinstance(kind, T.IntegralType):
        text = value.cast("string")
    elif isinstance(kind, T.DecimalType):  # exact beyond what a double holds
        text = F.when(value.cast("double").cast(kind) == value, _number(value)).otherwise(F.regexp_replace(value.cast("string"), r"(\.[0-9]*?)0+$", "$1"))
    elif isinstance(kind, T.FractionalType):
        text = _number(value)
    elif isinstance(kind, T.BinaryType):
        text = quoted(F.base64(value))
    elif isinstance(kind, T.VariantType):
        raise TypeError("a VARIANT has no known fields: cast it to a type first, or use canonical_text")
    else:
        text = quoted(value) if isinstance(kind, T.StringType) else F.substring(F.to_json(F.array(value)), F.lit(2), F.length(F.to_json(F.array(value))) - 2)
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("null"))


@F.pandas_udf(T.StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    """The same of JSON texts of any shape, as Arrow batches: keys sorted at every depth; null for what is no JSON."""
    return texts.map(_sorted)


def _sorted(text: str | None) -> str | None:
    import json

    if text is None:
        return None
    number = lambda x: int(float(x)) if abs(float(x)) < WHOLE and float(x).is_integer() else float(x)
    try:
        return json.dumps(json.loads(text, parse_float=number, parse_constant=lambda _: None), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def canonical_row(schema: T.StructType) -> Column:
    """Canonical JSON of a whole row."""
    parts = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical_json(F.col(f"`{f.name}`"), f.dataType)) for f in sorted(schema.fields, key=lambda f: f.name.encode())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts) if parts else F.lit(""), F.lit("}"))
