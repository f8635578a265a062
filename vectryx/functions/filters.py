"""Metadata filters: a conjunction of equalities on top-level keys of a VARIANT.

Numbers of any width compare as doubles; a string, a boolean and a number never equal one another (variant_get would cast
them into each other, so the type is asked first); objects and arrays compare as a whole. An empty filter takes every row,
also one without metadata; a filter that isn't empty takes neither such a row nor one that lacks a key.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def parsed(metadata: Column) -> Column:
    """JSON text to VARIANT; null if it can't be read."""
    return F.try_parse_json(metadata)


def field(metadata: Column, key: str) -> Column:
    """A key's value as VARIANT, null if it isn't there. A path can't hold both kinds of quotes; a map can."""
    if "'" not in key:
        return F.try_variant_get(metadata, f"$['{key}']", "variant")
    if '"' not in key:
        return F.try_variant_get(metadata, f'$["{key}"]', "variant")
    return F.try_element_at(F.try_variant_get(metadata, "$", "map<string,variant>"), F.lit(key))


def _doubles(value: Any) -> Any:
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, dict):
        return {k: _doubles(v) for k, v in value.items()}
    return [_doubles(v) for v in value]


def equals(metadata: Column, key: str, value: Any) -> Column:
    own = field(metadata, key)
    kind = F.schema_of_variant(own)
    if value is None:
        found = kind == "VOID"
    elif isinstance(value, bool):
        found = (kind == "BOOLEAN") & (F.try_variant_get(own, "$", "boolean") == value)
    elif isinstance(value, (int, float)):
        found = kind.rlike(NUMBER) & (F.try_variant_get(own, "$", "double") == F.lit(float(value)))
    elif isinstance(value, str):
        found = (kind == "STRING") & (F.try_variant_get(own, "$", "string") == value)
    else:
        text = json.dumps(_doubles(value), sort_keys=True, ensure_ascii=False)
        found = F.to_json(own) == F.to_json(F.parse_json(F.lit(text)))
    return F.coalesce(found, F.lit(False))


def matches(metadata: Column, wanted: dict[str, Any] | None) -> Column:
    """metadata is a VARIANT column."""
    out = F.lit(True)
    for key, value in (wanted or {}).items():
        out = out & equals(metadata, key, value)
    return out
