"""Tokens, chunks, sections, and an embedder that needs no model."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Lower-case runs of letters and digits, without the stop words; an empty array for null."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK), lambda t: t != "")
    return F.filter(found, lambda t: ~t.isin(*stop_words)) if stop_words else found


def every_token(text: str) -> list[str]:
    """The tokens of a text, by the same rule, outside Spark."""
    out, run = [], []
    for c in [*text.lower(), " "]:
        if c.isalpha() or c.isnumeric():
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return out


def query_terms(query: str, stop_words: tuple[str, ...] = ()) -> list[str]:
    """The distinct tokens of a query."""
    return [t for t in dict.fromkeys(every_token(query)) if t not in stop_words]


#: (section, substrings) tried in order on the lower-cased text.
SECTIONS = (("education", ("education",)), ("skills", ("skills",)), ("experience", ("experience", "engineer", "intern")), ("projects", ("project",)), ("publications_certifications", ("certification", "publication")))


def section(text: Column, rules: tuple = SECTIONS, other: str = "general") -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    out = F
    for name, parts in rules:
        hit = lower.contains(parts[0])
        for p in parts[1:]:
            hit = hit | lower.contains(p)
        out = out.when(hit, name)
    return out.otherwise(other)


def split_text(text: str, size: int = 450, overlap: int = 50, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Chunks of up to size characters, cut at the coarsest separator that gives parts that fit.

    Parts are packed in order; a chunk begins with as many of the last parts of the one before as fit into overlap.
    Chunks are stripped; empty ones are dropped.
    """

    def parts(piece: str, level: int) -> list[str]:
        if len(piece) <= size:
            return [piece]
        if not separators[level]:
            step = max(1, size - overlap)
            return [piece[i : i + step] for i in range(0, len(piece), step)]
        sep, own = separators[level], piece.split(separators[level])
        whole = [x + sep for x in own[:-1]] + [own[-1]]
        return [y for x in whole for y in (parts(x, level + 1) if len(x) > size else [x]) if y]

    out, now, length = [], [], 0
    for part in parts(text, 0):
        if now and length + len(part) > size:
            out.append("".join(now))
            while now and (length > overlap or length + len(part) > size):
                length -= len(now.pop(0))
        now.append(part)
        length += len(part)
    out.append("".join(now))
    return [c for c in (x.strip() for x in out) if c]


def chunked(df: DataFrame, id_column: str = "id", text_column: str = "text", size: int = 450, overlap: int = 50) -> DataFrame:
    """(id, chunk_index, chunk) rows; null text gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, index, chunk = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, c in enumerate(split_text(t, size, overlap) if t else []):
                    ids.append(i), index.append(n), chunk.append(c)
            yield pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(index, pa.int32()), pa.array(chunk, pa.string())], names=[id_column, "chunk_index", "chunk"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, chunk_index int, chunk string")


def hashed_embedding(text: str | None, dimension: int = 64) -> np.ndarray:
    """A unit vector: each token adds 1 or -1 at a place, both from its hash; zero without tokens. Stands in for a model."""
    v = np.zeros(dimension, np.float32)
    for t in every_token(text or ""):
        h = zlib.crc32(t.encode())
        v[h % dimension] += 1 if h >> 16 & 1 else -1
    n = float(np.linalg.norm(v))
    return v / n if n else v


def embedded(df: DataFrame, text_column: str = "text", output: str = "vector", embed: Callable[[str | None], np.ndarray] = hashed_embedding) -> DataFrame:
    """df with the embedding of a text column. embed is called in the workers and may be any model's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [embed(t) for t in batch.column(text_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*batch.schema.names, output])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))]))
