"""The operation log and the state that it stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_operations(log: DataFrame) -> DataFrame:
    """The last operation of each id by (seq, pos), as the columns of the log. Aggregated before the shuffle."""
    others = [c for c in log.columns if c not in ("id", "seq", "pos")]
    last = log.groupBy("id").agg(F.max_by(F.struct(*others), F.struct("seq", "pos")).alias("x"))
    return last.select("id", *(F.col(f"x.{c}").alias(c) for c in others))


def live(log: DataFrame) -> DataFrame:
    """(id, vector, metadata) after the log is applied in order: an insert replaces all of a row, a delete removes it."""
    return last_operations(log).where(F.col("op") == "insert").select("id", "vector", "metadata")


def replayed(base: DataFrame, log: DataFrame) -> DataFrame:
    """A base (id, vector, metadata) and the log after it.

    Only the log's ids are aggregated; the base's rows of ids that the log names are left out by an anti-join, which is
    a broadcast as long as the log's tail is small.
    """
    tail = last_operations(log)
    changed = tail.where(F.col("op") == "insert").select("id", "vector", "metadata")
    return base.select("id", "vector", "metadata").join(tail.select("id"), "id", "left_anti").unionByName(changed)


def conflicts(items: DataFrame, present: DataFrame) -> DataFrame:
    """The ids of items that a strict insert may not write: those present, and those twice in items."""
    twice = items.groupBy("id").count().where(F.col("count") > 1).select("id")
    return items.select("id").distinct().join(present.select("id"), "id", "left_semi").union(twice).distinct()


def last_of_batch(items: DataFrame) -> DataFrame:
    """(id, vector, metadata) of items (pos, id, vector, metadata): the last of each id."""
    return items.groupBy("id").agg(F.max_by(F.struct("vector", "metadata"), "pos").alias("x")).select("id", "x.vector", "x.metadata")
