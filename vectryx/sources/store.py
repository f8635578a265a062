"""A collection on disk: immutable versions of its rows, a log of what came after, and pointers that say which is which.

    info.json                  the catalog entry
    pointer/<n>.json           the latest counts: {"version": n, "seq": the last operation in that version, "at": when,
                               "keys": batches applied, "cells": how many, "graph": its statistics}
    base/v<n>/                 id, vector, metadata, norm, created_at[, shard=/][, cell=/]
    cells/v<n>/                cell, centroid
    graph/v<n>/                id, layer, neighbours
    text/v<n>/postings, stats  the keyword index of that version, if the collection has a text field
    log/<seq>[~<key>]/         one batch of operations[, by shard]

A batch is there once Spark has committed its directory, and not before; a new version counts once its pointer is there.
Versions stay for `retain_seconds` after the next one, with the log they need, so that searches made before end well.
One writer at a time. A batch that comes with a key (a stream's) is applied once, however often it is handed in: keys of
one feed end in rising numbers, of which the last is remembered once its batch is compacted.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, InvalidRequest
from ..functions.distance import norm
from ..operators import ann, graph, keywords, shards
from ..schema import LOG
from . import oplog
from .catalog import CollectionInfo
from .files import Files

BASE = "id string, vector array<float>, metadata string, norm double, created_at timestamp"


def _feed(key: str) -> tuple[str, int | None]:
    """A key as the feed's name and its number, if it ends in one."""
    name, _, number = key.rpartition("-")
    return (name, int(number)) if number.isdigit() else (key, None)


@dataclass
class CollectionStore:
    spark: SparkSession
    files: Files
    info: CollectionInfo
    retain_seconds: float = 3600.0

    def _at(self, name: str) -> str:
        return f"{self.files.root}/{self.info.folder}/{name}"

    def current(self) -> dict:
        return self.files.latest(f"{self.info.folder}/pointer") or {"version": 0, "seq": 0, "keys": {}, "cells": 0, "graph": None, "shards": 1}

    def batches(self, after: int = 0) -> list[str]:
        folder = f"{self.info.folder}/log"
        return [n for n in self.files.names(folder) if int(n.partition("~")[0]) > after and self.files.exists(f"{folder}/{n}/_SUCCESS")]

    def log(self, after: int = 0) -> DataFrame:
        names = self.batches(after)
        return self.spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(*(self._at(f"log/{n}") for n in names)) if names else self.spark.createDataFrame([], LOG)

    def base(self, probed: Sequence[int] | None = None) -> DataFrame:
        """The rows of the current version; of its cells, only the probed ones' directories are read."""
        state = self.current()
        if not state["version"]:
            return self.spark.createDataFrame([], BASE)
        extra = ", shard long" * (state["shards"] > 1) + ", cell int" * (state["cells"] > 0)
        rows = self.spark.read.schema(BASE + extra).parquet(self._at(f"base/v{state['version']}"))
        return rows.where(F.col("cell").isin(*probed)) if probed is not None and state["cells"] else rows

    def live(self, probed: Sequence[int] | None = None, n_shards: int = 1) -> DataFrame:
        """(id, vector, metadata, norm[, shard]) of the rows that are there now. Only the log's rows need their norms and shards worked out."""
        state = self.current()
        own = state["shards"] == n_shards and n_shards > 1
        columns = ["id", "vector", "metadata", "norm"]
        rows = self.base(probed).select(*columns, *["shard"] * own)
        rows = rows if own or n_shards == 1 else shards.assigned(rows, n_shards)
        if not self.batches(state["seq"]):
            return rows
        tail = oplog.last_operations(self.log(state["seq"]))
        new = tail.where(F.col("op") == "insert").select("id", "vector", "metadata", norm(F.col("vector")).alias("norm"))
        new = shards.assigned(new, n_shards) if n_shards > 1 else new
        return rows.join(tail.select("id"), "id", "left_anti").unionByName(new) if state["version"] else new

    def nodes(self) -> DataFrame:
        """(id, vector) of all rows since the last compaction, those deleted since included, as they last were."""
        inserts = oplog.last_operations(self.log(self.current()["seq"]).where(F.col("op") == "insert"))
        return self.base().select("id", "vector").join(inserts.select("id"), "id", "left_anti").union(inserts.select("id", "vector"))

    def states(self) -> DataFrame:
        """(id, live, tombstoned) of all ids since the last compaction."""
        from ..operators.diagnostics import state_of

        start = self.base().select("id", F.lit("insert").alias("op"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("pos"))
        return state_of(start.unionByName(self.log(self.current()["seq"]).select("id", "op", "seq", "pos")))

    def created(self) -> DataFrame:
        return self.base().select("created_at").union(self.log(self.current()["seq"]).where(F.col("op") == "insert").select(F.col("ts").alias("created_at")))

    def checked(self, items: DataFrame) -> DataFrame:
        """items, once their ids and dimensions have been found right."""
        bad = items.select(F.col("id"), F.size("vector").alias("n")).where(F.col("id").isNull() | (F.col("id") == "") | F.col("n").isNull() | (F.col("n") != self.info.dimension)).first()
        if bad is not None:
            if not bad.id:
                raise InvalidRequest("an id must not be empty")
            raise DimensionMismatch(f"vector dimension mismatch: expected {self.info.dimension}, got {bad.n}")
        return items

    def applied(self, key: str) -> bool:
        name, number = _feed(key)
        last = self.current()["keys"].get(name)
        if last is not None and (number is None or number <= last):
            return True
        return any(n.partition("~")[2] == key for n in self.batches())

    def append(self, operations: DataFrame, key: str | None = None, n_shards: int = 1) -> bool:
        """Writes one batch of operations (pos, op, id, vector, metadata), each shard's rows in its directory; False if its key was applied before."""
        if key is not None and self.applied(key):
            return False
        names = self.files.names(f"{self.info.folder}/log")
        seq = max([self.current()["seq"], *(int(n.partition("~")[0]) for n in names)]) + 1
        rows = operations.select(F.lit(seq).cast("long").alias("seq"), F.col("pos").cast("long").alias("pos"), "op", "id", F.col("vector").cast("array<float>").alias("vector"), F.col("metadata").cast("string").alias("metadata"), F.current_timestamp().alias("ts"))
        to = rows.write if n_shards == 1 else shards.spread(rows, n_shards).write.partitionBy("shard")
        to.mode("overwrite").parquet(self._at(f"log/{seq:012d}" + (f"~{key}" if key else "")))
        return True

    def compact(self, n_shards: int = 1, cells: int | None = None, with_graph: bool = False) -> None:
        """Writes what is live as the next version, without tombstones and absorbed batches, and its indexes anew.

        cells: how many cells of neighbours rows are laid out by, so that a search may probe some of them; 0 for none, None
        for as many as before. with_graph: the neighbour graph is stored with its statistics.
        """
        state = self.current()
        names = self.batches(state["seq"])
        last = max([state["seq"], *(int(n.partition("~")[0]) for n in names)])
        version = state["version"] + 1
        cells = state["cells"] if cells is None else cells
        start = self.base().select("id", "vector", "metadata", "norm", F.col("created_at").alias("ts"))
        tail = oplog.last_operations(self.log(state["seq"]))
        new = tail.where(F.col("op") == "insert").select("id", "vector", "metadata", norm(F.col("vector")).alias("norm"), "ts")
        rows = start.join(tail.select("id"), "id", "left_anti").unionByName(new).withColumnRenamed("ts", "created_at")
        by = []
        if n_shards > 1:
            rows, by = shards.assigned(rows, n_shards), ["shard"]
        if cells:
            fitted = ann.fit(self.live(), cells, self.info.metric)
            cells = len(fitted.centroids)
        if cells:
            self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(fitted.centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(self._at(f"cells/v{version}"))
            rows, by = ann.assign(rows, fitted), [*by, "cell"]
        if by:
            rows = rows.hint("rebalance", *by)  # a cell or shard that holds much is more than one task's
        rows.write.mode("overwrite").partitionBy(*by).parquet(self._at(f"base/v{version}"))
        written = self.spark.read.schema(BASE).parquet(self._at(f"base/v{version}"))
        if self.info.text_field:
            docs = written.select("id", self.text(F.col("metadata")).alias("text"))
            keywords.store(docs, self._at(f"text/v{version}"))
        stats = None
        if with_graph:
            graph.build(written, self.info.metric).write.mode("overwrite").parquet(self._at(f"graph/v{version}"))
            found = graph.stats(self.spark.read.parquet(self._at(f"graph/v{version}"))).first()
            stats = {"entry_point_layer": found.entry_point_layer, "avg_degree_per_layer": {str(k): v for k, v in (found.avg_degree_per_layer or {}).items()}}
        keys = dict(state["keys"])
        for n in names:
            if key := n.partition("~")[2]:
                name, number = _feed(key)
                keys[name] = max(number or 0, keys.get(name, 0))
        self.files.write_next(f"{self.info.folder}/pointer", {"version": version, "seq": last, "at": time.time(), "keys": keys, "cells": cells, "graph": stats, "shards": n_shards})
        self._drop_old()

    def _drop_old(self) -> None:
        """Versions that were followed by another one long enough ago go, with their pointers and the log that none left needs."""
        folder = f"{self.info.folder}/pointer"
        numbers = self.files.numbered(folder)
        states = [self.files.read(f"{folder}/{n:012d}.json") for n in numbers]
        gone = [i for i in range(len(states) - 1) if states[i + 1]["at"] <= time.time() - self.retain_seconds]
        kept = [s for i, s in enumerate(states) if i not in gone]
        # before the first pointer, all was in the log
        first = time.time() if not states else states[0]["at"]
        if numbers and (numbers[0] > 1 or first <= time.time() - self.retain_seconds):
            for n in self.batches():
                if int(n.partition("~")[0]) <= kept[0]["seq"]:
                    self.files.delete(f"{self.info.folder}/log/{n}")
        for i in gone:
            for kind in ("base", "cells", "graph", "text"):
                self.files.delete(f"{self.info.folder}/{kind}/v{states[i]['version']}")
            self.files.delete(f"{folder}/{numbers[i]:012d}.json")

    def cells(self) -> ann.Cells | None:
        """The cells by which the current version is laid out."""
        state = self.current()
        if not state["cells"]:
            return None
        rows = self.spark.read.parquet(self._at(f"cells/v{state['version']}")).orderBy("cell").select("centroid").toArrow()
        return ann.Cells(np.array(rows.column("centroid").to_pylist(), np.float64), self.info.metric)

    def stored_graph(self) -> DataFrame | None:
        state = self.current()
        return self.spark.read.parquet(self._at(f"graph/v{state['version']}")) if state["graph"] else None

    def text(self, metadata):
        """The indexed text of a row: the text field, if it is a string."""
        from ..functions.filters import field, parsed

        value = field(parsed(metadata), self.info.text_field)
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))

    def search_text(self, query: str, k: int | None) -> DataFrame:
        """(id, score) by the stored index, or from the live texts if something came after it."""
        state = self.current()
        if state["version"] and not self.batches(state["seq"]):
            return keywords.search_stored(self.spark, self._at(f"text/v{state['version']}"), query, k)
        docs = self.live().select("id", self.text(F.col("metadata")).alias("text")).where(F.col("text").isNotNull())
        return keywords.bm25(docs, query, k)
