"""Shards: routing by hash, scatter-gather top-k, merged health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import distance
from ..functions.hashing import fnv1a_mod
from ..schema import Metric
from .knn import DIGITS


def assigned(items: DataFrame, n: int, id_: str = "id") -> DataFrame:
    """Adds shard, from 0 to n - 1."""
    return items.withColumn("shard", fnv1a_mod(F.col(id_).cast("string"), n))


def spread(items: DataFrame, n: int) -> DataFrame:
    """assigned() items with a shard's rows together, as a partitioned write wants them."""
    return assigned(items, n).repartition(n, "shard")


def scatter_gather(items: DataFrame, query: Sequence[float], k: int, metric: Metric | int = Metric.COSINE, where: Column | None = None, norm: str | None = None) -> DataFrame:
    """(shard, id, distance): the best k of each shard (ranked within the tasks first), then the best k of those."""
    if where is not None:
        items = items.where(where)
    scored = items.select("shard", "id", F.round(distance(metric, F.col("vector"), query, F.col(norm) if norm else None), DIGITS).alias("distance"))
    local = scored.withColumn("rank", F.row_number().over(Window.partitionBy("shard").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return merge(local.drop("rank"), k, "distance")


def merge(results: DataFrame, k: int, score_type: str) -> DataFrame:
    """The best k over all shards: distances ascend, text and fusion scores descend."""
    order = F.asc("distance") if score_type == "distance" else F.desc("score")
    return results.orderBy(order, "id").limit(k)
