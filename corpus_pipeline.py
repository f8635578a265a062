"""A training corpus from raw documents: five stages, each written as Parquet and read again for the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectryx.llm import minhash, mixing, pieces, quality, substring
from vectryx.llm.common import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document of the least id stays."""
    return minhash.keep_one(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document before has too are cut out."""
    return substring.cut(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.repeated(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 of each document."""
    found = pieces.encode(docs)
    return found.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("encoded", encoded),
]

#: SQL can't express alignment and encoding; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def _is_written(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The last stage's rows. Stages are written below `folder`, by default a new one in the folder that executors share.

    Handed the folder of a run that broke off, it goes on after the last stage that was written whole; each stage's table
    goes once the one after next is there, so that two at most are kept.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = folder or f"{shared_folder(spark, 'pipeline-')}/pipeline-{uuid.uuid4().hex}"
    paths = [f"{folder}/{i}-{name}" for i, (name, _) in enumerate(STAGES[:-1])]
    done = max((i + 1 for i, p in enumerate(paths) if _is_written(spark, p)), default=0)
    if done:
        docs = spark.read.parquet(paths[done - 1])
    for i in range(done, len(paths)):
        STAGES[i][1](spark, docs, sf_dir).write.mode("overwrite").parquet(paths[i])
        docs = spark.read.parquet(paths[i])
        if i > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(paths[i - 2])
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return STAGES[-1][1](spark, docs, sf_dir)
