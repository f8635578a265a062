"""Request bodies: JSON to rows and to requests."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from ..schema import ITEM, Item, SearchRequest

_RAW = "id string, vector array<float>, metadata variant"


def items_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, vector, metadata) of a column of item objects; metadata stays JSON text, null if it isn't there."""
    parsed = F.try_parse_json(column)
    return lines.select(
        F.try_variant_get(parsed, "$.id", "string").alias("id"),
        F.try_variant_get(parsed, "$.vector", "array<float>").alias("vector"),
        F.when(F.schema_of_variant(F.try_variant_get(parsed, "$.metadata", "variant")) != "VOID", F.to_json(F.try_variant_get(parsed, "$.metadata", "variant"))).alias("metadata"),
    )


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of files with one JSON object a line."""
    return items_from_json(spark.read.text(path))


def item(body: Any) -> Item:
    if not isinstance(body, dict) or not isinstance(body.get("id"), str) or not body["id"]:
        raise InvalidRequest("an item needs an id")
    vector = body.get("vector")
    if not isinstance(vector, list) or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in vector):
        raise InvalidRequest("a vector is a list of numbers")
    metadata = body.get("metadata")
    if metadata is not None and not isinstance(metadata, dict):
        raise InvalidRequest("metadata is an object")
    return Item(body["id"], [float(x) for x in vector], metadata)


def search_request(body: Any) -> SearchRequest:
    if not isinstance(body, dict):
        raise InvalidRequest("a request is an object")
    known = {k: body[k] for k in ("vector", "text_query", "top_k", "filter", "include_vector", "probes") if body.get(k) is not None}
    if "filter" in known and not isinstance(known["filter"], dict):
        raise InvalidRequest("a filter is an object")
    if not isinstance(known.get("top_k", 0), int):
        raise InvalidRequest("top_k is a whole number")
    if not isinstance(known.get("probes", 1), int) or known.get("probes", 1) < 1:
        raise InvalidRequest("probes is a whole number above 0")
    return SearchRequest(**known)


def to_frame(spark: SparkSession, items: list[Item]) -> DataFrame:
    return spark.createDataFrame([(i.id, [float(x) for x in i.vector], None if i.metadata is None else json.dumps(i.metadata)) for i in items], ITEM)
