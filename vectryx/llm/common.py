"""What the corpus operators share: reading tables, checkpoints, words and word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside ASCII white space; bytes.split() cuts at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENTS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """spark.checkpoint.dir. Without that setting, a folder of its own on one machine (as in tests), and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return tempfile.mkdtemp(prefix=prefix)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once into the folder that all executors share; a lost executor costs no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoint-"))
    return df.checkpoint(eager=True)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """df as a table in the folder that executors share, where it stays until the block is left."""
    spark = df.sparkSession
    path = f"{shared_folder(spark, 'table-')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.parquet(path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def keyed(docs: DataFrame, **keys: Column) -> DataFrame:
    """docs as one struct column _row beside the keys, so that no name in docs can clash; select("_row.*") gives docs back."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(k.alias(n) for n, k in keys.items()))


def if_small(df: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """df, to be broadcast if it has few rows (of bounded width); otherwise joined as Catalyst and AQE see fit."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


class _WordHashes(dict):
    """64-bit hashes of words by word, forgotten when there are too many for memory. Words beyond `longest` bytes aren't kept."""

    most, longest = 150_000, 128

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h


_hashes = _WordHashes()


class _Memory:
    """What a worker process remembers from task to task: the caches of one operator, the last that ran in it."""

    def __init__(self):
        self.owner, self.forget = "", lambda: None

    def __call__(self, owner: str, forget: Callable[[], None] = _hashes.clear) -> None:
        if owner != self.owner:
            self.forget()
            self.owner, self.forget = owner, forget
            trim()


def trim() -> None:
    """Gives memory that was freed back to the system, where the C library knows how."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


claim_memory = _Memory()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One uint64 a word, the same in every process."""
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: each bit of the result depends on all bits of h."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """uint64 hashes of all windows of n words (n up to 8); none if there are fewer words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for i in range(n):
        total += hashes[i : i + count] * _ODD[i]
    return mixed(total)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text, so that a worker's memory doesn't depend on how long the texts are."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        part = np.cumsum(sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    trim()
