"""Connected components of a table of links, by alternating large and small stars.

Nothing of the graph reaches the driver but a count. A hot node's links are aggregated before they are shuffled, and the
join that spreads its minimum back is one that AQE splits. Every round is cut off by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v), u > v, each once. Large: a node's larger neighbours are tied to its least; small: its smaller ones and it."""
    if large:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "n")
        tied = links.join(least, F.col("v") == F.col("n")).select("u", F.col("m").alias("v"))
        # a node's link to its own least stays, so that none is cut off
        own = links.groupBy("u").agg(F.min("v").alias("v"))
        return tied.union(own).distinct()
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
    tied = links.join(least, F.col("u") == F.col("n"))
    return tied.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each id in links (a, b), the least id that it reaches. Ids in no link have no row.

    Repeated links, links of an id to itself and either order are all one; null ids are left out; no links, no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = checkpointed(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    size, total = _measure(now)
    while True:
        now = checkpointed(_stars(_stars(now, True), False))
        measured = _measure(now)
        if measured == (size, total):
            break
        size, total = measured
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _measure(links: DataFrame) -> tuple[int, int]:
    """A round that changes anything lowers an end of some link."""
    row = links.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)"))).first()
    return row[0], (row[1], row[2])
