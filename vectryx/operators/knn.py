"""Exact nearest neighbours, for one query or many.

One query is an expression over the scan and a bounded top-k: no shuffle but the k rows of each task. Many queries are a
matrix that goes to the tasks, in blocks of bounded size; each task keeps its best k a query before anything is shuffled,
and holds a block against its rows in tiles, so that its memory grows neither with the queries nor with the rows.
Ties go to the lower id; distances are rounded before they are compared, so that order doesn't hang on the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DimensionMismatch
from ..functions.distance import distance
from ..schema import Metric
from ..sources.lineage import cut

DIGITS = 6
#: Queries of this many bytes are sent to the tasks at a time.
BLOCK_BYTES = 16 << 20
#: A task holds rows of so many bytes at a time against so many queries; queries and rows make a tile, and so many pairs are measured at once.
CHUNK_BYTES, ASKED, TILE, PAIRS = 64 << 20, 8192, (512, 4096), 1 << 16


def knn(items: DataFrame, query: Sequence[float], k: int, metric: Metric | int = Metric.COSINE, where: Column | None = None, vector: str = "vector", id_: str = "id", norm: str | None = None) -> DataFrame:
    """(id, distance) of the k closest rows that the filter takes; the filter comes before the distance."""
    if where is not None:
        items = items.where(where)
    found = items.select(F.col(id_).alias("id"), F.round(distance(metric, F.col(vector), query, F.col(norm) if norm else None), DIGITS).alias("distance"))
    return found.orderBy("distance", "id").limit(k)


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """A column of vectors as rows, in single precision if they are stored so."""
    sizes = pc.list_value_length(column)
    least = pc.min(sizes).as_py()
    if len(column) and (sizes.null_count or least != pc.max(sizes).as_py() or (width is not None and least != width)):
        raise DimensionMismatch("vector dimension mismatch")
    kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat, kind).reshape(len(column), (least or 0) if width is None else width)


def exact(x: np.ndarray, q: np.ndarray, metric: Metric) -> np.ndarray:
    """Distances of x and q row by row, rounded."""
    x, q = x.astype(np.float64), q.astype(np.float64)
    if metric is Metric.EUCLIDEAN:  # not by |x|^2 + |q|^2 - 2xq, which loses the digits of near neighbours
        x -= q
        d = np.sqrt(np.einsum("ij,ij->i", x, x))
    else:
        d = np.einsum("ij,ij->i", x, q)
        if metric is Metric.COSINE:
            scale = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", q, q))
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.where(scale == 0, 1.0, 1 - np.clip(d / scale, -1, 1))
        else:
            d = -d
    return np.round(d, DIGITS)


def _coarse(x: np.ndarray, q: np.ndarray, metric: Metric) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x and q in single precision, their product being greater for closer rows; each query's |q|^2, and how far off its products and rounded distances may be."""
    x, q = x.astype(np.float64), q.astype(np.float64)
    off = 0.0
    if metric is Metric.EUCLIDEAN:
        middle = x.mean(0)
        x, q, off = x - middle, q - middle, float(np.abs(middle).max(initial=0.0))
    xn, qn = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    far, own, unit = float(xn.max(initial=0.0)), qn**2, (x.shape[1] + 4) * 2.0**-24
    if metric is Metric.COSINE:
        x, q = (np.divide(v, n[:, None], out=np.zeros_like(v), where=n[:, None] > 0) for v, n in ((x, xn), (q, qn)))
        room = np.full(len(q), 2 * unit + 2e-6)
    elif metric is Metric.DOT:
        room = 2 * unit * far * qn + 2e-6
    else:
        room = (2 * unit * (far + qn) + 1e-15 * off * x.shape[1] + 2e-6) * (far + qn) + 1e-11
        x, q = np.column_stack([x, -(xn**2) / 2]), np.column_stack([q, np.ones(len(q))])
    room = np.where(np.maximum(far, qn) < 1e15, room, np.inf)  # beyond what single precision holds, and for what is no number, all pairs are measured
    return x.astype(np.float32), q.astype(np.float32), own, room


def _few_alike(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows without those that have k equal ones before them: they are nobody's k closest."""
    if len(x) <= k or not x.shape[1]:
        return np.arange(min(len(x), k) if not x.shape[1] else len(x))
    whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    _, kind, counts = np.unique(whole, return_inverse=True, return_counts=True)
    if counts.max() <= k:
        return np.arange(len(x))
    nth = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(np.argsort(kind, kind="stable")[nth < k])


def best_of(d: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k least (distance, place); a place of -1 is none. Of equal distances the places ascend from left to right."""
    there = at >= 0
    order = np.argsort(d, axis=1, kind="stable") if np.isfinite(d[there]).all() else np.lexsort((d, ~there), axis=1)
    order = order[:, :k]
    return np.take_along_axis(d, order, 1), np.take_along_axis(at, order, 1)


def nearest(x: np.ndarray, q: np.ndarray, k: int, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
    """(distances, places): of each query the k closest rows, equal ones by their place; inf and -1 where there are fewer.

    Tile by tile, single precision tells which pairs can be among them, allowing for its error; those are measured in double.
    """
    distances, places = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int32)
    if not len(x) or not len(q):
        return distances, places
    kept = _few_alike(x, k)
    with np.errstate(over="ignore", invalid="ignore"):
        xs, qs, own, room = _coarse(x[kept], q, metric)
        for a in range(0, len(q), TILE[0]):
            here = slice(a, min(a + TILE[0], len(q)))
            distances[here], at = _tiles(x, kept, xs, q[here], qs[here], own[here], room[here], k, metric)
            places[here] = np.where(at >= 0, kept[at], -1)
    return distances, places


def _tiles(x: np.ndarray, kept: np.ndarray, xs: np.ndarray, q: np.ndarray, qs: np.ndarray, own: np.ndarray, room: np.ndarray, k: int, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
    d, at = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int32)
    start, width, least = 0, max(512, 4 * k), np.full(len(q), -np.inf)
    while start < len(xs):
        s = qs @ xs[start : start + width].T
        if not start and s.shape[1] > k:
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k].astype(np.float64) - room
        pairs = np.flatnonzero(~(s < least.astype(np.float32)[:, None]))
        who, row = np.divmod(pairs, s.shape[1])
        row += start
        far = np.concatenate([np.zeros(0), *(exact(x[kept[row[i : i + PAIRS]]], q[who[i : i + PAIRS]], metric) for i in range(0, len(row), PAIRS))])
        counts = np.bincount(who, minlength=len(q))
        some = np.flatnonzero(counts)
        if len(some):
            line, nth = (np.cumsum(counts > 0) - 1)[who], k + np.arange(len(who)) - (np.cumsum(counts) - counts)[who]
            both_d, both_at = np.full((len(some), k + counts.max()), np.inf), np.full((len(some), k + counts.max()), -1, np.int32)
            both_d[:, :k], both_at[:, :k] = d[some], at[some]
            both_d[line, nth], both_at[line, nth] = far, row
            d[some], at[some] = best_of(both_d, both_at, k)
        last = d[:, -1]
        least = np.where(at[:, -1] >= 0, (1 - last if metric is Metric.COSINE else -last if metric is Metric.DOT else (own - last**2) / 2) - room, -np.inf)
        start, width = start + width, TILE[1]
    return d, at


def rows_found(ids: pa.Array, d: np.ndarray, at: np.ndarray, qids: pa.Array) -> Iterator[pa.RecordBatch]:
    """(qid, id, distance) of what nearest() has found for the queries, some thousands of rows at a time."""
    step = max(1, PAIRS // d.shape[1])
    for a in range(0, len(d), step):
        own = at[a : a + step]
        there = own >= 0
        who = np.nonzero(there)[0] + a
        yield pa.record_batch([qids.take(pa.array(who)), ids.take(pa.array(own[there])), pa.array(d[a : a + step][there])], names=["qid", "id", "distance"])


def streamed(rows: DataFrame) -> Iterator[pa.Table]:
    """Rows as they come to the driver, partition by partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["packed"])

    for packed in rows.mapInArrow(pack, "packed binary").toLocalIterator(prefetchPartitions=True):
        table = pa.ipc.open_stream(packed[0]).read_all().combine_chunks()
        if table.num_rows:
            yield table


def blocks(asked: DataFrame, size: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Queries (qid, v) in blocks of so many bytes."""
    held, rows, width = [], 0, None
    for table in streamed(asked):
        vectors = matrix(table.column("v"), width)
        width = vectors.shape[1]
        most = max(1, (size or BLOCK_BYTES) // (8 * max(1, width)))
        held.append((table.column("qid").combine_chunks(), vectors))
        rows += len(vectors)
        if rows >= most:
            qids, q = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
            while len(q) >= most:
                yield pa.concat_arrays([qids.slice(0, most)]), q[:most].copy()
                qids, q = qids.slice(most), q[most:]
            held, rows = ([(qids, q)], len(q)) if len(q) else ([], 0)
    if held:
        yield pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in tables of CHUNK_BYTES, sorted by id."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().sort_by("id")
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().sort_by("id")


def spread(items: DataFrame, sent: list, many: int = 1000) -> DataFrame:
    """items in a part a core, where there are many queries for them; kept, where several blocks of queries come."""
    if len(sent) == 1 and sent[0][1] <= many:
        return items
    items = items.repartition(items.sparkSession.sparkContext.defaultParallelism)
    return cut(items) if len(sent) > 1 else items


def knn_batch(items: DataFrame, queries: DataFrame, k: int, metric: Metric | int = Metric.COSINE, vector: str = "vector", id_: str = "id", query_vector: str = "vector", query_id: str = "qid") -> DataFrame:
    """(qid, id, distance, rank): the k closest rows of each query. The stated queries are held against all rows, in blocks."""
    metric = Metric(metric)
    asked = queries.select(F.col(query_id).alias("qid"), F.col(query_vector).alias("v"))
    rows = items.select(F.col(id_).alias("id"), F.col(vector).alias("v"))
    schema = f"qid {queries.schema[query_id].dataType.simpleString()}, id {items.schema[id_].dataType.simpleString()}, distance double"
    context = items.sparkSession.sparkContext
    sent = [(context.broadcast(block), len(block[1])) for block in blocks(asked)]
    if not sent:
        return items.sparkSession.createDataFrame([], f"{schema}, rank int")
    rows = spread(rows, sent)
    parts = [_local(rows, shared, k, metric, schema) for shared, _ in sent]
    ranked = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id")))
    return ranked.where(F.col("rank") <= k)


def _local(items: DataFrame, shared: Broadcast, k: int, metric: Metric, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            qids, q = shared.value
            x, ids = matrix(table.column("v"), q.shape[1]), table.column("id").combine_chunks()
            for a in range(0, len(q), ASKED):
                yield from rows_found(ids, *nearest(x, q[a : a + ASKED], k, metric), qids.slice(a, ASKED))

    return items.mapInArrow(run, schema)


def payloads(ids: DataFrame, items: DataFrame, include_vector: bool = False) -> DataFrame:
    """(id, metadata[, vector]) of the ids (id) that items have, each once; however many there are."""
    return items.select("id", "metadata", *(["vector"] if include_vector else [])).join(ids.select("id"), "id", "left_semi")


def present(ids: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ids (id) that items have."""
    return ids.join(items.select("id"), "id", "left_semi")


def hydrated(found: DataFrame, items: DataFrame, include_vector: bool = False) -> DataFrame:
    """found (id, ...) with metadata and, if asked for, the vector. found has k rows a query, so it is the side to broadcast."""
    extra = ["id", "metadata", *(["vector"] if include_vector else [])]
    return items.select(*extra).join(F.broadcast(found), "id")
