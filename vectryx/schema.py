"""Types of rows: items, the operation log, catalog entries, results."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum
from typing import Any

from pyspark.sql import types as T


class Metric(IntEnum):
    COSINE = 0
    DOT = 1
    EUCLIDEAN = 2


VECTOR = T.ArrayType(T.FloatType(), False)
ITEM = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("metadata", T.StringType())])
#: seq orders operations strictly; pos within a batch breaks its ties. metadata is JSON; null means there is none.
LOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
CATALOG = T.StructType([T.StructField("name", T.StringType()), T.StructField("dimension", T.IntegerType()), T.StructField("metric", T.IntegerType()), T.StructField("config", T.StringType())])

#: What the served index is built and searched with.
M, M0, EF_CONSTRUCTION, EF_SEARCH = 16, 32, 200, 50
DEFAULT_K = 5
RRF_K = 60


@dataclass(frozen=True)
class Item:
    """A vector with its id and, perhaps, metadata (None: none; {}: empty, which is something else)."""

    id: str
    vector: list[float]
    metadata: dict[str, Any] | None = None


@dataclass(frozen=True)
class SearchRequest:
    """By vector, by text, or both; filter is a conjunction of equalities on metadata keys.

    probes: how many cells to read where the collection lies in cells; None for an exact search.
    """

    vector: list[float] | None = None
    text_query: str | None = None
    top_k: int = 0
    filter: dict[str, Any] = field(default_factory=dict)
    include_vector: bool = False
    prefilter_text: bool = False
    probes: int | None = None

    @property
    def k(self) -> int:
        return self.top_k if self.top_k > 0 else DEFAULT_K
