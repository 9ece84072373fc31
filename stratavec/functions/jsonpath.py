"""Access to fields of a JSON text column, and JSON containment of a literal."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN_KEY = re.compile(r"[^'\[\]\\*?]+\Z")


def json_text(value) -> str:
    """What a value is compared as: strings as they are, all else as compact JSON."""
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _path(keys: list[str]) -> str:
    return "$" + "".join(f"['{k}']" for k in keys)


def field_text(metadata: Column, keys: list[str]) -> Column:
    """Text of a nested field, null if it is missing or JSON null; objects and arrays as JSON.

    Keys that a path can't hold are looked up in a map, level by level.
    """
    if all(_PLAIN_KEY.match(k) for k in keys):
        return F.get_json_object(metadata, _path(keys))
    for k in keys:
        metadata = F.from_json(metadata, "map<string,string>").getItem(k)
    return metadata


def dotted(field: str) -> list[str]:
    return field.split(".")


def field_variant(metadata: Column, keys: list[str]) -> Column:
    """A nested field as a variant; null if it is missing."""
    return F.try_variant_get(F.try_parse_json(metadata), _path(keys), "variant")


def valid_json(text: Column) -> Column:
    """The text if it is well-formed JSON, else null."""
    return F.when(F.try_parse_json(text).isNotNull(), text)


def field_key(metadata: Column, field: str) -> Column:
    """A top-level field as a grouping key: its text, ``null`` for JSON null, null if it is missing."""
    value = field_variant(metadata, [field])
    return F.when(F.is_variant_null(value), F.lit("null")).when(value.isNotNull(), field_text(metadata, [field]))


_NUMBER = "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"


def contains_value(v: Column, pattern) -> Column:
    """Whether a variant contains the literal: scalars by type and value (5 is 5.0, not "5"), objects by their
    keys, arrays in any order."""
    kind = F.schema_of_variant(v)
    if isinstance(pattern, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(pattern))
    if isinstance(pattern, (int, float)):
        return kind.rlike(_NUMBER) & (F.try_variant_get(v, "$", "double") == F.lit(float(pattern)))
    if isinstance(pattern, str):
        return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(pattern))
    if pattern is None:
        return F.is_variant_null(v)
    if isinstance(pattern, dict):
        parts = [F.coalesce(contains_value(F.try_variant_get(v, _path([k]), "variant"), p), F.lit(False)) for k, p in pattern.items()]
        return kind.startswith("OBJECT") & reduce(Column.__and__, parts, F.lit(True))
    return contains_elements(v, pattern)


def contains_elements(v: Column, patterns: list) -> Column:
    """Whether a variant is an array that has an element containing each literal; null if it isn't an array."""
    items = F.try_variant_get(v, "$", "array<variant>")

    def held(pattern) -> Column:
        return F.exists(items, lambda e: F.coalesce(contains_value(e, pattern), F.lit(False)))

    parts = [held(p) for p in patterns]
    return reduce(Column.__and__, parts, items.isNotNull())


_SPACE = " \t\n\r"
_DECODER = json.JSONDecoder()


def split_object(text: str) -> dict[str, str] | None:
    """Top-level keys of a JSON object and the text of their values as written; None if it is no object."""
    at = len(text) - len(text.lstrip(_SPACE))
    try:
        if not isinstance(_DECODER.decode(text), dict):
            return None
    except ValueError:
        return None
    out: dict[str, str] = {}
    at += 1
    while True:
        while text[at] in _SPACE + ",":
            at += 1
        if text[at] == "}":
            return out
        key, at = _DECODER.raw_decode(text, at)
        while text[at] in _SPACE + ":":
            at += 1
        _, end = _DECODER.raw_decode(text, at)
        out.pop(key, None)
        out[key] = text[at:end]
        at = end


def merge_objects(old: str | None, new: str | None) -> str | None:
    """Shallow merge: keys of ``new`` replace those of ``old``; numbers stay as written.

    A null side gives the other.  Where a side is no object, the new side holds.
    """
    if new is None or old is None:
        return old if new is None else new
    a, b = split_object(old), split_object(new)
    if a is None or b is None:
        return new
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{v}" for k, v in (a | b).items()) + "}"


def _merge_batch(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([merge_objects(a, b) for a, b in zip(old, new)], dtype=object)


def merge_metadata(old: str, new: str) -> Column:
    """The shallow merge of two JSON columns, over Arrow batches."""
    return F.pandas_udf(_merge_batch, "string")(old, new)


def _entries_batch(objects: pd.Series) -> pd.Series:
    def entries(text):
        found = split_object(text) if text is not None else None
        return None if found is None else [{"name": json.dumps(k, ensure_ascii=False), "value": v} for k, v in found.items()]

    return pd.Series([entries(t) for t in objects], dtype=object)


def object_entries(text: str) -> Column:
    """Top-level (name, value) of a JSON object, both as JSON text; null if it is none."""
    return F.pandas_udf(_entries_batch, "array<struct<name:string,value:string>>")(text)
