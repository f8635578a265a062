"""The database over HTTP. Python's own server: a facade for demonstrations, not what a cluster is fed through."""

from __future__ import annotations

import argparse
import json
import logging
import re
import time
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession

from .engine import VectorDB
from .errors import InvalidRequest, VectorError
from .sources import requests

log = logging.getLogger("vectryx.service")

Answer = tuple[int, Any]


class Routes:
    """Requests to answers, without a socket."""

    def __init__(self, db: VectorDB):
        self.db = db
        name, id_ = r"/collections/([^/]+)", r"/vectors/([^/]+)"
        self.table = [(m, re.compile(p + r"\Z"), f) for m, p, f in (("GET", "/", self.status), ("POST", "/collections", self.create), ("GET", "/collections", self.list), ("DELETE", name, self.drop), ("POST", name + "/insert", self.insert), ("POST", name + "/upsert", self.upsert), ("POST", name + "/batch", self.batch), ("POST", name + "/search", self.search), ("POST", name + "/hybrid-search", self.hybrid_search), ("POST", name + "/batch-search", self.batch_search), ("DELETE", name + id_, self.delete), ("GET", name + "/health", self.health), ("POST", name + "/rebuild", self.rebuild))]

    def answer(self, method: str, path: str, body: bytes = b"") -> Answer:
        began = time.perf_counter()
        try:
            status, value = self._answer(method, urlsplit(path).path, body)
        except VectorError as e:
            status, value = e.status, {"error": str(e)}
        except Exception as e:  # a request must not end the server
            log.exception("%s %s", method, path)
            status, value = 500, {"error": str(e)[:200]}
        log.info("%s %s %d %.0f ms", method, path, status, 1000 * (time.perf_counter() - began))
        return status, value

    def _answer(self, method: str, path: str, body: bytes) -> Answer:
        known = False
        for m, pattern, f in self.table:
            if found := pattern.match(path):
                known = True
                if m == method:
                    names = [unquote(x) for x in found.groups()]
                    return f(*names, self._json(body)) if method == "POST" and f != self.rebuild else f(*names)
        return (405, {"error": "method not allowed"}) if known else (404, {"error": "not found"})

    @staticmethod
    def _json(body: bytes) -> Any:
        try:
            return json.loads(body)
        except ValueError as e:
            raise InvalidRequest("the body isn't JSON") from e

    def status(self) -> Answer:
        return 200, {"status": "ok"}

    def create(self, body: Any) -> Answer:
        if not isinstance(body, dict) or not isinstance(body.get("name"), str) or not isinstance(body.get("dimension"), int):
            raise InvalidRequest("a collection needs a name and a dimension")
        made = self.db.create_collection(body["name"], body["dimension"], body.get("metric", 0), body.get("config"))
        return 201, {"name": made.name, "dimension": made.dimension, "metric": made.metric, "config": made.config}

    def list(self) -> Answer:
        return 200, [{"Name": i.name, "Dimension": i.dimension, "Metric": i.metric, "Config": i.config} for i in self.db.list_collections()]

    def drop(self, name: str) -> Answer:
        self.db.drop_collection(name)
        return 204, None

    def insert(self, name: str, body: Any) -> Answer:
        item = requests.item(body)
        self.db.add(name, item)
        return 201, {"id": item.id}

    def upsert(self, name: str, body: Any) -> Answer:
        item = requests.item(body)
        self.db.upsert(name, item)
        return 201, {"id": item.id}

    def batch(self, name: str, body: Any) -> Answer:
        items = body.get("items") if isinstance(body, dict) else None
        if not isinstance(items, list):
            raise InvalidRequest("a batch has items")
        return 201, {"inserted": self.db.add_batch(name, [requests.item(x) for x in items])}

    def search(self, name: str, body: Any) -> Answer:
        self.db.get_collection(name)
        request = requests.search_request(body)
        if request.vector is None and not request.text_query:
            raise InvalidRequest("a search needs a vector or a text_query")
        return 200, {"results": self.db.results(self.db.search(name, request))}

    def hybrid_search(self, name: str, body: Any) -> Answer:
        self.db.get_collection(name)
        request = requests.search_request(body)
        if not request.text_query:
            raise InvalidRequest("a hybrid search needs a text_query")
        return 200, {"results": self.db.results(self.db.search(name, replace(request)))}

    def batch_search(self, name: str, body: Any) -> Answer:
        """Many vectors at once: {"vectors": [...], "top_k", "filter", "probes"} to one list of results for each."""
        self.db.get_collection(name)
        vectors = body.get("vectors") if isinstance(body, dict) else None
        if not isinstance(vectors, list) or not vectors:
            raise InvalidRequest("a batch search has vectors")
        first = requests.search_request({**body, "vector": None})
        asked = self.db.queries(name, [requests.item({"id": str(i), "vector": v}).vector for i, v in enumerate(vectors)])
        out: list[list[dict]] = [[] for _ in vectors]
        for r in self.db.search_batch(name, asked, first.k, first.probes, first.filter).orderBy("qid", "rank").collect():
            out[r.qid].append({"id": r.id, "score": r.distance})
        return 200, {"results": out}

    def delete(self, name: str, id_: str) -> Answer:
        self.db.delete(name, id_)
        return 204, None

    def health(self, name: str) -> Answer:
        row = self.db.check_health(name).first().asDict()
        if row["reason"] is None:
            del row["reason"]
        if self.db.shards == 1:
            stats = self.db.graph_stats(name)
            row |= {"entry_point_layer": stats["entry_point_layer"] if stats["entry_point_layer"] is not None else -1, "avg_degree_per_layer": stats["avg_degree_per_layer"]}
        return 200, row

    def rebuild(self, name: str) -> Answer:
        self.db.rebuild_index(name)
        return 200, {"status": "success"}


def server(db: VectorDB, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    routes = Routes(db)

    class Handler(BaseHTTPRequestHandler):
        def _handle(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, value = routes.answer(self.command, self.path, body)
            data = b"" if value is None else json.dumps(value).encode()
            self.send_response(status)
            if data:
                self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = do_PUT = _handle

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="vectryx")
    serve = parser.add_subparsers(required=True).add_parser("serve")
    serve.add_argument("--port", type=int, default=8080)
    serve.add_argument("--db", default="vectryx-data")
    serve.add_argument("--shards", type=int, default=1)
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("vectryx").getOrCreate()
    running = server(VectorDB(spark, given.db, given.shards), given.port)
    try:
        running.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        running.server_close()
        spark.stop()
