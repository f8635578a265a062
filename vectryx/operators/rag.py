"""Retrieval for prompts: chunks with their section, and the context of an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunked, embedded, section


def prepared(docs: DataFrame, id_column: str = "id", text_column: str = "text", size: int = 450, overlap: int = 50) -> DataFrame:
    """Items (id, vector, metadata JSON with text, section and chunk_index) of documents' chunks, ready for a batch write."""
    chunks = chunked(docs, id_column, text_column, size, overlap).withColumn("section", section(F.col("chunk")))
    named = chunks.withColumn("item", F.concat_ws("_", F.lit("chunk"), F.col(id_column).cast("string"), F.col("chunk_index").cast("string")))
    return embedded(named, "chunk").select(F.col("item").alias("id"), "vector", F.to_json(F.struct(F.col("chunk").alias("text"), "section", "chunk_index")).alias("metadata"))


def context(found: DataFrame, by: str | None = None) -> DataFrame:
    """`[section] text` blocks in rank order, parted by empty lines, of rows (rank, section, text): one row, or one for each `by`."""
    block = F.concat(F.lit("["), F.coalesce("section", F.lit("unknown")), F.lit("] "), F.coalesce("text", F.lit("")))
    joined = F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"])).alias("context")
    return found.groupBy(by).agg(joined) if by else found.agg(joined)
