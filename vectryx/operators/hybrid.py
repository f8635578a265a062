"""Reciprocal rank fusion of a vector leg and a keyword leg."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import RRF_K, Metric
from .knn import knn


def ranked(leg: DataFrame, *order: Column | str) -> DataFrame:
    """(id, rank) of a leg, which is a top-k of a few dozen rows."""
    return leg.select("id", F.row_number().over(Window.orderBy(*order, "id")).alias("rank"))


def fuse(vector_leg: DataFrame, text_leg: DataFrame, k: int, constant: int = RRF_K) -> DataFrame:
    """(id, score): sum of 1 / (constant + rank) over the legs (id, distance) and (id, score) that have the id."""
    both = ranked(vector_leg, F.asc("distance")).unionByName(ranked(text_leg, F.desc("score")))
    fused = both.groupBy("id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(float(constant)) + F.col("rank"))), 9).alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(k)


def search(rows: DataFrame, vector: Sequence[float], text_leg: DataFrame, k: int, metric: Metric | int = Metric.COSINE, where: Column | None = None, norm: str | None = None) -> DataFrame:
    """(id, score): 2 k rows (id, vector) by distance that the filter takes, fused with a text leg that is filtered already."""
    return fuse(knn(rows, vector, 2 * k, metric, where, norm=norm), text_leg.select("id", "score"), k)


def post_filtered(text_leg: DataFrame, items: DataFrame, where: Column | None) -> DataFrame:
    """The rows of a finished text top-k whose item the filter takes; there may be fewer than k."""
    if where is None:
        return text_leg
    return items.where(where).select("id").join(F.broadcast(text_leg), "id")
