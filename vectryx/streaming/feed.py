"""Collections fed by streams: each micro-batch is one batch of operations, applied once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import VectorDB
from ..schema import LOG
from ..sources.requests import items_from_json


def operations(stream: DataFrame, id_: str, op: str, vector: str, metadata: str, deletes: tuple[str, ...] = ("delete",)) -> DataFrame:
    """Change events as operations (pos, op, id, vector, metadata); pos must come from the feed's own order."""
    gone = F.col(op).isin(*deletes)
    return stream.select("pos", F.when(gone, "delete").otherwise("insert").alias("op"), F.col(id_).cast("string").alias("id"), F.when(~gone, F.col(vector)).alias("vector"), F.when(~gone, F.col(metadata)).alias("metadata"))


def apply(db: VectorDB, name: str, stream: DataFrame, checkpoint: str, feed: str = "feed") -> StreamingQuery:
    """Starts a query that applies a stream of operations ([pos,] op, id, vector, metadata) to a collection and ends with what is there.

    Without pos, the rows of a micro-batch are taken in the order in which Spark reads them.

    A batch that is handed in again after a failure has the same key, and the store leaves it out.
    """
    store = db.store(name)

    def batch(rows: DataFrame, number: int) -> None:
        if "pos" not in rows.columns:
            rows = rows.withColumn("pos", F.monotonically_increasing_id())
        store.checked(rows.where(F.col("op") == "insert"))
        store.append(rows.select("pos", "op", "id", "vector", "metadata"), key=f"{feed}-{number}", n_shards=db.shards)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A directory of operation-log files as a stream."""
    return spark.readStream.schema(LOG).parquet(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """A directory of files with one JSON item a line as a stream of inserts, in the order of the lines of a file."""
    rows = items_from_json(spark.readStream.text(path))
    return rows.select(F.lit("insert").alias("op"), "id", "vector", "metadata")
