"""Mixing sources to target weights, in DataFrame functions alone.

Targets are found by capped water-filling: a source is clamped at its size times the largest number of epochs, and
what it can't take goes to the others in proportion to their weights, until none is above its cap. Each document then
gets its source's whole repetitions, and a seeded choice of documents one more, for the fraction.

Scale: the corpus is read once, into a narrow checkpoint (id, source, size, hash). Sums are pre-aggregated by source
and by source and hash bucket, so a hot source costs no more than any other; the one window over documents sees, of
each source, only the bucket in which its fraction ends (1/4096 of its documents). Windows over the sources themselves
see one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, if_small, keyed

BUCKETS = 4096
#: A table of so many sources is broadcast (some 100 bytes a row); more are joined by shuffle, with AQE against skew.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2)) -> DataFrame:
    """(source, weight): the sources by code point, null last, get the weights in turn."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    array = F.array(*(F.lit(float(w)) for w in weights))
    return sources.select("source", F.get(array, rank % len(weights)).alias("weight"))


def water_fill(sources: DataFrame, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Adds target to (source, source_size long, weight).

    Sweeping the sources by cap over weight, level i is what weight 1 gets when all before i are clamped; it rises
    while sources are clamped and falls after, so the water level is its maximum. Equal caps and weights tie without
    effect. No sources, no rows; sources of size 0 get 0; share is cut to max_epochs (all are then clamped).
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(min(share, max_epochs)))
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = sources.select("*", level.alias("_level"))
    water = F.max("_level").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.select("*", F.least(cap, water * F.col("weight")).alias("target")).drop("_level")


def mix(docs: DataFrame, weights: tuple[float, ...] | DataFrame = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, repeats for each row of docs (doc_id, text, source).

    weights: in turn to the sources by code point, or a table (source, weight). The seed, the id and the text fix the
    choice, so reruns agree; equal rows share their place in the order and only their number of repeats is fixed.
    A document is taken whole, 0 to ceil(max_epochs) times; a source ends at most half a document from its target.
    Null text, or one without words: size 0, taken 0. Null source: a source of its own. Null id: like any other.
    No rows give no rows; columns besides the three are not looked at.
    """
    sized, plan = _planned(docs, weights, share, max_epochs, seed)
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    apart = joined.where(F.col("_b") != F.col("_end")).withColumn("_more", (F.col("_b") < F.col("_end")).cast("long"))
    out = apart.unionByName(_ended(sized, plan))
    repeats = F.col("_whole") + F.col("_more")
    return out.select("doc_id", "source", "size", "source_size", "target", (repeats * F.col("size")).alias("taken"), repeats.cast("int").alias("repeats"))


def _digest(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))


def _bucket(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def _planned(docs: DataFrame, weights: tuple[float, ...] | DataFrame, share: float, max_epochs: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and digests; and of each source (_s) its target, whole repetitions and where its fraction ends."""
    sized = checkpointed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _digest(seed).alias("_h")).withColumn("_b", _bucket(F.col("_h"))))
    buckets = sized.groupBy("source", "_b").agg(F.sum("size").alias("_sum"))
    totals = buckets.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        weighted = totals.join(given, totals["source"].eqNullSafe(given["_s"])).drop("_s")
    else:
        weighted = totals.join(cycled_weights(totals.select("source"), weights).select(F.col("source").alias("_s"), "weight"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    targets = water_fill(weighted, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    # the bucket in which a source's fraction ends, and what comes before it
    in_order = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = buckets.select(F.col("source").alias("_s"), "_b", "_sum", F.sum("_sum").over(in_order).alias("_upto"))
    crossing = running.join(plan.select("source", "_rest"), F.col("_s").eqNullSafe(F.col("source"))).where((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_sum") < F.col("_rest")))
    ends = crossing.select("_s", F.col("_b").alias("_end"), (F.col("_upto") - F.col("_sum")).alias("_before"))
    plan = checkpointed(plan.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_s"), "source_size", "target", "_whole", "_rest", F.coalesce("_end", F.lit(-1)).alias("_end"), F.coalesce("_before", F.lit(0)).alias("_before")))
    return sized, if_small(plan, BROADCAST_SOURCES)


def _ended(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents of the buckets in which their sources' fractions end; _more tells who gets one repetition more."""
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("_s"))).where(F.col("_b") == F.col("_end"))
    earlier = Window.partitionBy("source").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("size").over(earlier), F.lit(0))
    return joined.withColumn("_more", (start + F.col("size") / 2 <= F.col("_rest")).cast("long"))


def repeated(docs: DataFrame, weights: tuple[float, ...] | DataFrame = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """The rows of docs, each as many times as mix() takes it, with all their columns. Rows without a word, of size 0, go.

    A row's digest tells its place in its source's order, so its repeats follow from its digest and its source alone: all
    but the documents next to a fraction's end are known from the source's plan, and no text is shuffled.
    """
    sized, plan = _planned(docs, weights, share, max_epochs, seed)
    ends = _ended(sized, plan).where(F.col("_more") > 0)
    ends = if_small(checkpointed(ends.groupBy("source", "_h").agg(F.count("*").alias("_rows")).select(F.col("source").alias("_es"), F.col("_h").alias("_eh"), "_rows")))
    rows = keyed(docs, _src=F.col("source"), _h=_digest(seed), _n=word_count(F.col("text"))).where(F.col("_n") > 0)
    joined = rows.withColumn("_b", _bucket(F.col("_h"))).join(plan, F.col("_src").eqNullSafe(F.col("_s")))
    apart = joined.where(F.col("_b") != F.col("_end")).select("_row", (F.col("_whole") + (F.col("_b") < F.col("_end")).cast("long")).alias("_times"))
    at_end = joined.where(F.col("_b") == F.col("_end")).join(ends, F.col("_src").eqNullSafe(F.col("_es")) & (F.col("_h") == F.col("_eh")), "left")
    nth = F.row_number().over(Window.partitionBy("_src", "_h").orderBy("_h"))  # of rows alike, as many as the mix takes
    at_end = at_end.select("_row", (F.col("_whole") + (nth <= F.coalesce("_rows", F.lit(0))).cast("long")).alias("_times"))
    times = F.when(F.col("_times") > 0, F.sequence(F.lit(1).cast("long"), F.col("_times"))).otherwise(F.array().cast("array<bigint>"))
    return apart.unionByName(at_end).select("_row", F.explode(times).alias("_nth")).select("_row.*")
