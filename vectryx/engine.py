"""The database: collections, writes and searches over a directory. Searches are DataFrames, not yet run."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import DimensionMismatch, DuplicateId, HybridNotEnabled, InvalidRequest
from .functions.filters import matches, parsed
from .operators import ann, diagnostics, graph, hybrid, knn, shards
from .schema import Item, Metric, SearchRequest
from .sources import oplog, requests
from .sources.catalog import Catalog, CollectionInfo
from .sources.files import Files
from .sources.store import CollectionStore


class VectorDB:
    """shards > 1: rows are laid out by shard, searches gather the best of each, and health is summed over them."""

    def __init__(self, spark: SparkSession, root: str, shards: int = 1, retain_seconds: float = 3600.0):
        if shards < 1:
            raise InvalidRequest("there must be a shard")
        self.spark, self.shards, self.retain_seconds = spark, shards, retain_seconds
        self.files = Files(spark, root)
        self.catalog = Catalog(self.files)

    # collections

    def create_collection(self, name: str, dimension: int, metric: int = Metric.COSINE, config: dict[str, Any] | None = None) -> CollectionInfo:
        return self.catalog.create(CollectionInfo(name, dimension, int(metric), config or {}))

    def list_collections(self) -> list[CollectionInfo]:
        return self.catalog.list()

    def get_collection(self, name: str) -> CollectionInfo:
        return self.catalog.get(name)

    def drop_collection(self, name: str) -> None:
        self.catalog.drop(name)

    def store(self, name: str) -> CollectionStore:
        return CollectionStore(self.spark, self.files, self.catalog.get(name), self.retain_seconds)

    # writes

    def _operations(self, items: DataFrame, op: str = "insert") -> DataFrame:
        return items.select(F.monotonically_increasing_id().alias("pos"), F.lit(op).alias("op"), "id", "vector", "metadata")

    def add(self, name: str, item: Item) -> None:
        """A strict insert: an id that is there is an error."""
        self.add_all(name, [item])

    def add_all(self, name: str, items: Iterable[Item] | DataFrame) -> None:
        """Strict inserts, all or none."""
        store = self.store(name)
        rows = store.checked(self._frame(items))
        taken = oplog.conflicts(rows, store.live()).orderBy("id").limit(20)
        if ids := [r.id for r in taken.collect()]:
            raise DuplicateId(ids)
        store.append(self._operations(rows), n_shards=self.shards)

    def upsert(self, name: str, item: Item) -> None:
        """Replaces vector and metadata as a whole; no metadata removes what there was."""
        self.add_batch(name, [item])

    def add_batch(self, name: str, items: Iterable[Item] | DataFrame, key: str | None = None) -> int:
        """Inserts or replaces; of an id given twice the last counts. Nothing is written if a dimension is wrong."""
        store = self.store(name)
        rows = self._frame(items)
        count = rows.count()
        if count:
            store.append(self._operations(store.checked(rows)), key, self.shards)
        return count

    def _frame(self, items: Iterable[Item] | DataFrame) -> DataFrame:
        if isinstance(items, DataFrame):
            return items.select("id", "vector", "metadata")
        return requests.to_frame(self.spark, list(items)).coalesce(1)

    def delete(self, name: str, id_: str) -> None:
        """Deleting what isn't there succeeds."""
        gone = self.spark.createDataFrame([(id_,)], "id string").select("id", F.lit(None).alias("vector"), F.lit(None).alias("metadata"))
        self.store(name).append(self._operations(gone, "delete"), n_shards=self.shards)

    def compact(self, name: str | None = None) -> None:
        for info in [self.catalog.get(name)] if name else self.catalog.list():
            self.store(info.name).compact(self.shards)

    def rebuild_index(self, name: str, cells: int | None = None, with_graph: bool = True) -> None:
        """A new version of rows, keyword index, cells (0: none, None: as many as before) and neighbour graph.

        What is written meanwhile stays in the log after it.
        """
        self.store(name).compact(self.shards, cells, with_graph)

    # reads

    def items(self, name: str) -> DataFrame:
        """(id, vector, metadata) of all that is live."""
        return self.store(name).live().select("id", "vector", "metadata")

    def contains(self, name: str, ids: DataFrame) -> DataFrame:
        return knn.present(ids, self.items(name))

    def payloads(self, name: str, ids: Iterable[str], include_vectors: bool = False) -> DataFrame:
        """(id, metadata[, vector]) of the ids that are there."""
        wanted = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
        return knn.payloads(wanted, self.items(name), include_vectors)

    def search(self, name: str, request: SearchRequest) -> DataFrame:
        """(id, score, score_type, metadata[, vector]), best first.

        By vector, scores are distances and ascend; by text they are BM25 and descend; by both, each leg fetches 2 k rows
        and ranks are fused, descending. The filter comes before the vector leg and after the text leg, which may so
        give fewer than k rows; with prefilter_text it comes before both.
        """
        store, k = self.store(name), request.k
        if request.vector is None and not request.text_query:
            return self._hydrated(self.spark.createDataFrame([], "id string, score double"), store, request, "distance")
        if request.vector is not None and len(request.vector) != store.info.dimension:
            raise DimensionMismatch(f"vector dimension mismatch: expected {store.info.dimension}, got {len(request.vector)}")
        if request.text_query and not store.info.text_field:
            raise HybridNotEnabled(name)
        both = request.vector is not None and bool(request.text_query)
        fetch = 2 * k if both else k
        where = matches(parsed(F.col("metadata")), request.filter) if request.filter else None
        text = self._text(store, request, fetch, where) if request.text_query else None
        if both and not request.probes and self.shards == 1:
            return self._hydrated(hybrid.search(store.live(), request.vector, text, k, store.info.metric, where, "norm"), store, request, "fused")
        near = self._near(store, request, fetch, where) if request.vector is not None else None
        if both:
            return self._hydrated(hybrid.fuse(near, text, k), store, request, "fused")
        if near is not None:
            return self._hydrated(near.withColumnRenamed("distance", "score"), store, request, "distance")
        return self._hydrated(shards.merge(text, k, "text"), store, request, "text")

    def _near(self, store: CollectionStore, request: SearchRequest, k: int, where: Column | None) -> DataFrame:
        cells = store.cells() if request.probes else None
        if cells is not None:
            return self._probed(store, cells, request, k, where)
        rows = store.live(n_shards=self.shards)
        if self.shards > 1:
            return shards.scatter_gather(rows, request.vector, k, store.info.metric, where, "norm").select("id", "distance")
        return knn.knn(rows, request.vector, k, store.info.metric, where, norm="norm")

    def _probed(self, store: CollectionStore, cells: ann.Cells, request: SearchRequest, k: int, where: Column | None) -> DataFrame:
        """The k closest in the nearest cells, and among what was written after them; twice as many cells while there are too few rows."""
        order = cells.order(np.asarray([request.vector], float))[0].tolist()
        probes = request.probes
        while True:
            rows = store.live(order[:probes] if probes < len(order) else None)
            rows = rows.where(where) if where is not None else rows
            if probes >= len(order) or rows.limit(k).count() >= k:
                return knn.knn(rows, request.vector, k, store.info.metric, norm="norm")
            probes *= 2

    def queries(self, name: str, vectors: list[list[float]]) -> DataFrame:
        """(qid, vector) of vectors of the collection's dimension, numbered from 0."""
        dimension = self.catalog.get(name).dimension
        if bad := [len(v) for v in vectors if len(v) != dimension]:
            raise DimensionMismatch(f"vector dimension mismatch: expected {dimension}, got {bad[0]}")
        return self.spark.createDataFrame(list(enumerate(vectors)), "qid int, vector array<double>")

    def search_batch(self, name: str, queries: DataFrame, k: int, probes: int | None = None, filter: dict[str, Any] | None = None) -> DataFrame:
        """(qid, id, distance, rank) of queries (qid, vector), k each. Exact, or by the probes nearest cells of each where rows lie in cells.

        What was written after the cells were made is put into its cell on the way.
        """
        store = self.store(name)
        rows = store.live()
        rows = rows.where(matches(parsed(F.col("metadata")), filter)) if filter else rows
        cells = store.cells() if probes else None
        if cells is None:
            return knn.knn_batch(rows, queries, k, store.info.metric)
        return ann.search_batch(ann.assign(rows.select("id", "vector"), cells), cells, queries, k, probes)

    def walk(self, name: str, queries: DataFrame, k: int, filter: dict[str, Any] | None = None) -> DataFrame:
        """(qid, id, distance, rank) by the neighbour graph of the last rebuild, for many queries (qid, vector) at once.

        Rows deleted since are walked through and not returned; rows written since are held against the queries beside.
        """
        store = self.store(name)
        own = store.stored_graph()
        if own is None:
            return self.search_batch(name, queries, k, filter=filter)
        live = store.live()
        where = matches(parsed(F.col("metadata")), filter) if filter else None
        taken = live.where(where) if where is not None else live
        known = store.base().select("id", "vector")
        changed = store.log(store.current()["seq"]).select("id").distinct()
        found = graph.walk(own, known, queries, k, metric=store.info.metric, among=taken.join(changed, "id", "left_anti").select("id")).select("qid", "id", "distance")
        beside = knn.knn_batch(taken.join(changed, "id", "left_semi"), queries, k, store.info.metric).select("qid", "id", "distance")
        rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
        return found.unionByName(beside).withColumn("rank", rank).where(F.col("rank") <= k)

    def _text(self, store: CollectionStore, request: SearchRequest, k: int, where: Column | None) -> DataFrame:
        if request.prefilter_text and where is not None:
            found = store.search_text(request.text_query, None)
            return shards.merge(hybrid.post_filtered(found, store.live(), where), k, "text")
        return hybrid.post_filtered(store.search_text(request.text_query, k), store.live(), where)

    def _hydrated(self, found: DataFrame, store: CollectionStore, request: SearchRequest, score_type: str) -> DataFrame:
        rows = knn.hydrated(found, store.live(), request.include_vector)
        order = F.asc("score") if score_type == "distance" else F.desc("score")
        columns = ["id", F.col("score").cast("float").alias("score"), F.lit(score_type).alias("score_type"), "metadata", *(["vector"] if request.include_vector else [])]
        return rows.orderBy(order, "id").select(*columns)

    def results(self, found: DataFrame) -> list[dict[str, Any]]:
        """Rows of a search as JSON values; what is absent has no key."""
        out = []
        for r in found.collect():
            row = {"id": r.id, "score": r.score}
            if "vector" in found.columns and r.vector is not None:
                row["vector"] = list(r.vector)
            if r.metadata is not None:
                row["metadata"] = json.loads(r.metadata)
            out.append(row)
        return out

    def check_health(self, name: str) -> DataFrame:
        """(total_nodes, tombstoned_nodes, rebuild_recommended, reason)."""
        states = self.store(name).states()
        if self.shards == 1:
            return diagnostics.health(states)
        by_shard = shards.assigned(states, self.shards).groupBy("shard").agg(F.sum((F.col("live") | F.col("tombstoned")).cast("long")).alias("total_nodes"), F.sum(F.col("tombstoned").cast("long")).alias("tombstoned_nodes"))
        return diagnostics.merged_health(by_shard)

    def graph_stats(self, name: str) -> dict[str, Any]:
        """entry_point_layer and avg_degree_per_layer: as the last rebuild stored them, or of a graph of all nodes, tombstones included."""
        store = self.store(name)
        state = store.current()
        if state["graph"] and not store.batches(state["seq"]):
            return state["graph"]
        row = graph.stats(graph.build(store.nodes(), store.info.metric)).first()
        return {"entry_point_layer": row.entry_point_layer, "avg_degree_per_layer": {str(k): v for k, v in (row.avg_degree_per_layer or {}).items()}}

    def max_created_at(self, name: str) -> DataFrame:
        return diagnostics.max_created_at(self.store(name).created().select(F.unix_seconds("created_at").alias("created_at")))
