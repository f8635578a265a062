"""Health of a collection, recall of an approximate search, and latencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lineage import cut

RATIO, LEAST_NODES = 0.20, 1000


def state_of(log: DataFrame) -> DataFrame:
    """(id, live, tombstoned): by each id's last operation; a tombstone is an id that was there and was deleted last.

    A re-inserted id is live: an upsert makes no tombstone.
    """
    last = log.groupBy("id").agg(F.max_by("op", F.struct("seq", "pos")).alias("last"), F.max((F.col("op") == "insert").cast("int")).alias("was"))
    return last.select("id", (F.col("last") == "insert").alias("live"), ((F.col("last") == "delete") & (F.col("was") == 1)).alias("tombstoned"))


def health(states: DataFrame, sharded: bool = False) -> DataFrame:
    """(total_nodes, tombstoned_nodes, rebuild_recommended, reason) of states (live, tombstoned).

    A rebuild is recommended above 20 % tombstones; unsharded, only above 1000 nodes too.
    """
    totals = states.agg(F.coalesce(F.sum((F.col("live") | F.col("tombstoned")).cast("long")), F.lit(0)).cast("long").alias("total_nodes"), F.coalesce(F.sum(F.col("tombstoned").cast("long")), F.lit(0)).cast("long").alias("tombstoned_nodes"))
    return recommended(totals, sharded)


def recommended(totals: DataFrame, sharded: bool) -> DataFrame:
    advice = (F.col("total_nodes") > 0) & (F.col("tombstoned_nodes").cast("double") / F.nullif(F.col("total_nodes").cast("double"), F.lit(0.0)) > RATIO)
    if not sharded:
        advice = advice & (F.col("total_nodes") > LEAST_NODES)
    advice = F.coalesce(advice, F.lit(False))
    return totals.select("total_nodes", "tombstoned_nodes", advice.alias("rebuild_recommended"), F.when(advice, F.lit("more than 20% of nodes are tombstoned")).alias("reason"))


def merged_health(by_shard: DataFrame) -> DataFrame:
    """The sums of shards' health rows; sharded advice has no least size."""
    return recommended(by_shard.agg(F.sum("total_nodes").alias("total_nodes"), F.sum("tombstoned_nodes").alias("tombstoned_nodes")), True)


def max_created_at(rows: DataFrame, column: str = "created_at") -> DataFrame:
    """One row; 0 if there is nothing."""
    return rows.agg(F.coalesce(F.max(column), F.lit(0)).cast("long").alias("max_created_at"))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(mean_recall, min_recall) of found (qid, id) against the true neighbours (qid, id)."""
    hits = truth.join(found.select("qid", "id").withColumn("hit", F.lit(1)), ["qid", "id"], "left").groupBy("qid").agg((F.count("hit") / F.lit(float(k))).alias("r"))
    return hits.agg(F.avg("r").alias("mean_recall"), F.min("r").alias("min_recall"))


def latencies(seconds: DataFrame, column: str = "seconds") -> DataFrame:
    """(n, p50, p99): by place in the sorted list, n // 2 and n * 99 // 100. Nothing, no row.

    Values are counted first, then sorted in ranges side by side; what comes before a range is the sum of the ranges before it.
    """
    counted = seconds.select(F.col(column).alias("s")).groupBy("s").agg(F.count("*").alias("c"))
    ranged = cut(counted.repartitionByRange("s").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.sum("c").alias("size"))
    parts = sizes.select("part", F.sum("size").over(Window.orderBy("part")).alias("upto"), "size", F.sum("size").over(Window.partitionBy()).alias("n"))  # a row a range
    within = F.sum("c").over(Window.partitionBy("part").orderBy(F.col("s").asc_nulls_first()))
    placed = ranged.join(F.broadcast(parts), "part").select("s", "c", "n", (F.col("upto") - F.col("size") + within).alias("end"))

    def at(place: Column) -> Column:
        return F.max(F.when((place < F.col("end")) & (place >= F.col("end") - F.col("c")), F.col("s")))

    return placed.groupBy("n").agg(at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(F.col("n") * 99 / 100)).alias("p99"))


def throughput(n: int, took: Sequence[float]) -> float:
    return n / sum(took) if took else 0.0
