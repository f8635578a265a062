"""The catalog: one small file a collection, and the tools for catalogs kept as tables."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CollectionExists, CollectionNotFound, InvalidRequest
from ..schema import CATALOG, Metric
from .files import Files


@dataclass(frozen=True)
class CollectionInfo:
    name: str
    dimension: int
    metric: int = Metric.COSINE
    config: dict[str, Any] = field(default_factory=dict)

    @property
    def text_field(self) -> str | None:
        found = self.config.get("textField")
        return found if isinstance(found, str) and found else None

    @property
    def folder(self) -> str:
        """A directory name for any collection name."""
        return "c/" + hashlib.sha256(self.name.encode()).hexdigest()[:24]


class Catalog:
    def __init__(self, files: Files):
        self.files = files

    def create(self, info: CollectionInfo) -> CollectionInfo:
        if not info.name:
            raise InvalidRequest("a collection needs a name")
        if info.dimension <= 0:
            raise InvalidRequest("the dimension must be positive")
        if info.metric not in set(Metric):
            raise InvalidRequest(f"unknown metric {info.metric}")
        if self.files.exists(f"{info.folder}/info.json"):
            raise CollectionExists(info.name)
        self.files.write(f"{info.folder}/info.json", asdict(info))
        return info

    def get(self, name: str) -> CollectionInfo:
        found = self.files.read(f"{CollectionInfo(name, 1).folder}/info.json")
        if found is None:
            raise CollectionNotFound(name)
        return CollectionInfo(**found)

    def drop(self, name: str) -> None:
        """The entry goes with the data, so the name is free again."""
        self.files.delete(self.get(name).folder)

    def list(self) -> list[CollectionInfo]:
        found = (self.files.read(f"c/{f}/info.json") for f in self.files.names("c"))
        return sorted((CollectionInfo(**x) for x in found if x), key=lambda i: i.name)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i.name, i.dimension, int(i.metric), json.dumps(i.config, sort_keys=True)) for i in self.list()], CATALOG)


def with_config(catalog: DataFrame) -> DataFrame:
    """A catalog table with config as JSON that can be read; what can't is {}."""
    parsed = F.try_parse_json("config")
    return catalog.withColumn("config", F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed)).otherwise("{}"))


def with_missing(catalog: DataFrame, items: DataFrame) -> DataFrame:
    """The catalog and an entry for each collection that only items (collection, dim) know; those already in it stay."""
    seen = items.groupBy(F.col("collection").alias("name")).agg(F.min("dim").alias("dimension"))
    new = seen.join(catalog.select("name"), "name", "left_anti").select("name", "dimension", F.lit(int(Metric.COSINE)).alias("metric"), F.lit("{}").alias("config"))
    return catalog.select("name", "dimension", "metric", "config").unionByName(new)
