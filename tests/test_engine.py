"""Collections from creation to drop, on disk."""

import json

import pytest

from vectryx.engine import VectorDB
from vectryx.errors import CollectionExists, CollectionNotFound, DimensionMismatch, DuplicateId, HybridNotEnabled, InvalidRequest
from vectryx.schema import Item, Metric, SearchRequest


@pytest.fixture
def db(spark, tmp_path):
    return VectorDB(spark, str(tmp_path / "db"))


def ids(db, name, **request):
    return [r["id"] for r in db.results(db.search(name, SearchRequest(**request)))]


def test_catalog(db):
    db.create_collection("a", 3, Metric.DOT)
    db.create_collection("b/ü", 2, config={"textField": "text"})
    assert [(i.name, i.dimension, i.metric) for i in db.list_collections()] == [("a", 3, 1), ("b/ü", 2, 0)]
    with pytest.raises(CollectionExists):
        db.create_collection("a", 3)
    for bad in (("", 3, 0), ("x", 0, 0), ("x", 3, 9)):
        with pytest.raises(InvalidRequest):
            db.create_collection(*bad)
    db.drop_collection("a")
    db.create_collection("a", 5)  # its name is free again, and nothing is left
    assert db.get_collection("a").dimension == 5 and db.items("a").count() == 0
    with pytest.raises(CollectionNotFound):
        db.drop_collection("nope")


def test_writes_deletes_and_compaction(db):
    db.create_collection("c", 3, Metric.EUCLIDEAN)
    db.add("c", Item("x", [1, 2, 3], {"status": "active"}))
    with pytest.raises(DuplicateId):
        db.add("c", Item("x", [1, 1, 1]))
    for bad in ([1, 2], [1, 2, 3, 4]):
        with pytest.raises(DimensionMismatch):
            db.add("c", Item("y", bad))
    with pytest.raises(InvalidRequest):
        db.add("c", Item("", [1, 2, 3]))
    db.upsert("c", Item("x", [4, 5, 6], {"status": "inactive"}))
    assert ids(db, "c", vector=[4, 5, 6], filter={"status": "inactive"}) == ["x"]
    assert ids(db, "c", vector=[4, 5, 6], filter={"status": "active"}) == []
    db.upsert("c", Item("x", [4, 5, 6]))
    assert db.payloads("c", ["x", "gone"]).first().metadata is None
    db.compact("c")
    assert db.add_batch("c", [Item("y", [0, 0, 0]), Item("z", [1, 0, 0]), Item("y", [9, 9, 9])]) == 3
    assert db.add_batch("c", []) == 0
    assert ids(db, "c", vector=[9, 9, 9], top_k=1) == ["y"]
    db.delete("c", "z")
    db.delete("c", "never there")
    before = {(r.id, tuple(r.vector)) for r in db.items("c").collect()}
    assert before == {("x", (4, 5, 6)), ("y", (9, 9, 9))}
    assert tuple(db.check_health("c").first())[:3] == (3, 1, False)
    db.rebuild_index("c")
    assert {(r.id, tuple(r.vector)) for r in db.items("c").collect()} == before
    assert tuple(db.check_health("c").first())[:3] == (2, 0, False)
    assert db.max_created_at("c").first()[0] > 1_700_000_000
    db.add("c", Item("z", [1, 0, 0]))
    reopened = VectorDB(db.spark, db.files.root)
    assert reopened.get_collection("c").metric == Metric.EUCLIDEAN and reopened.items("c").count() == 3


def test_separable_points_with_a_filter(db):
    db.create_collection("p", 3)
    db.add_batch("p", [Item(f"vec_{i}", [i, 10 - i, 0], {"is_even": i % 2 == 0, "index": i}) for i in range(10)])
    assert ids(db, "p", vector=[4.1, 5.9, 0])[0] == "vec_4"
    rows = db.results(db.search("p", SearchRequest(vector=[4.1, 5.9, 0], filter={"is_even": True}, include_vector=True)))
    assert len(rows) == 5 and all(r["metadata"]["is_even"] and len(r["vector"]) == 3 for r in rows)
    assert [r["score"] for r in rows] == sorted(r["score"] for r in rows)


@pytest.mark.parametrize(("metric", "want"), [(0, 1.0), (1, 0.0), (2, 2**0.5)])
def test_metrics_through_the_store(db, metric, want):
    db.create_collection("m", 2, metric)
    db.add("m", Item("a", [0, 1]))
    assert db.results(db.search("m", SearchRequest(vector=[1, 0])))[0]["score"] == pytest.approx(want, abs=1e-6)


DOCS = [("v1", [1, 1, 1], "the quick brown fox jumps over the lazy dog"), ("v2", [1, 1, 1.1], "the quick brown cat"), ("v3", [9, 9, 9], "a slow yellow fox resting by the lazy dog")]


@pytest.mark.parametrize("compacted", [False, True])
def test_hybrid(db, compacted):
    db.create_collection("h", 3, Metric.EUCLIDEAN, {"textField": "text"})
    db.add_batch("h", [Item(i, v, {"text": t, "n": len(t)}) for i, v, t in DOCS] + [Item("v4", [0, 0, 0], {"text": 5}), Item("v5", [0, 0, 1])])
    if compacted:
        db.compact("h")
    assert ids(db, "h", vector=[1, 1, 1], top_k=2) == ["v1", "v2"]
    assert set(ids(db, "h", text_query="lazy dog")) == {"v1", "v3"}
    assert ids(db, "h", text_query="lazy dog", vector=[9, 9, 9])[0] == "v3"
    first = db.results(db.search("h", SearchRequest(text_query="lazy dog", vector=[9, 9, 9], top_k=1)))[0]
    assert first["score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-8)
    assert ids(db, "h", text_query="quick", filter={"n": 19}) == ["v2"]
    best = ids(db, "h", text_query="fox", top_k=1)[0]
    other = {"n": len(next(t for i, _, t in DOCS if i != best and "fox" in t))}
    assert ids(db, "h", text_query="fox", top_k=1, filter=other) == []  # the filter comes after the top k
    assert len(ids(db, "h", text_query="fox", top_k=1, filter=other, prefilter_text=True)) == 1
    assert ids(db, "h", text_query="...") == [] and ids(db, "h") == []
    db.delete("h", "v1")
    assert ids(db, "h", text_query="jumps") == []
    db.create_collection("plain", 3)
    with pytest.raises(HybridNotEnabled):
        db.search("plain", SearchRequest(text_query="x"))
    with pytest.raises(DimensionMismatch):
        db.search("h", SearchRequest(vector=[1, 2]))


def test_isolation_and_shards(spark, tmp_path):
    one, four = VectorDB(spark, str(tmp_path / "one")), VectorDB(spark, str(tmp_path / "four"), shards=4)
    items = [Item(f"id{i}", [float((i * 7 + j * 3) % 11) for j in range(4)], {"i": i}) for i in range(40)]
    for db in (one, four):
        db.create_collection("a", 4, Metric.EUCLIDEAN)
        db.create_collection("b", 4)
        db.add_batch("a", items)
        db.add("b", Item("id0", [9, 9, 9, 9]))
        db.compact()
    for q in ([0, 0, 0, 0], [5, 1, 7, 3]):
        assert ids(one, "a", vector=q) == ids(four, "a", vector=q)
    assert tuple(four.payloads("b", ["id0"], True).first().vector) == (9, 9, 9, 9)
    for i in range(3):
        four.delete("a", f"id{i}")
        one.delete("a", f"id{i}")
    assert tuple(four.check_health("a").first())[:3] == (40, 3, False)
    for i in range(3, 12):
        four.delete("a", f"id{i}")
        one.delete("a", f"id{i}")
    assert four.check_health("a").first().rebuild_recommended and not one.check_health("a").first().rebuild_recommended


def test_json_items(spark):
    from vectryx.sources.requests import items_from_json

    lines = [json.dumps(x) for x in ({"id": "a", "vector": [1, 2.5], "metadata": {"k": 1}}, {"id": "b", "vector": [], "metadata": None}, {"vector": [1]})] + ["{broken"]
    rows = items_from_json(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in rows] == [("a", [1.0, 2.5], '{"k":1}'), ("b", [], None), (None, [1.0], None), (None, None, None)]


def test_stream_applies_each_batch_once(spark, tmp_path):
    from vectryx.streaming import feed

    db = VectorDB(spark, str(tmp_path / "db"))
    db.create_collection("s", 2)
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text('{"id":"a","vector":[1,0]}\n{"id":"b","vector":[0,1],"metadata":{"x":1}}\n{"id":"a","vector":[2,0]}\n')
    for _ in range(2):  # the second run finds nothing new
        query = feed.apply(db, "s", feed.read_items(spark, str(inbox)), str(tmp_path / "checkpoint"))
        query.awaitTermination(60)
    assert {(r.id, tuple(r.vector)) for r in db.items("s").collect()} == {("a", (2, 0)), ("b", (0, 1))}
    store = db.store("s")
    operations = db._operations(db._frame([Item("c", [1, 1])]))
    assert store.append(operations, "feed-9") and not store.append(operations, "feed-9")
    db.compact("s")
    assert not store.append(operations, "feed-9") and db.items("s").count() == 3
    # a log can be followed as a stream, and replaying it gives the same state
    other = VectorDB(spark, str(tmp_path / "other"))
    other.create_collection("s", 2)
    db.upsert("s", Item("d", [3, 3]))
    log = tmp_path / "log"
    db.store("s").log(0).write.parquet(str(log))
    feed.apply(other, "s", feed.read_log(spark, str(log)), str(tmp_path / "checkpoint2")).awaitTermination(60)
    assert {"d"} <= {r.id for r in other.items("s").collect()}


def test_http(spark, tmp_path):
    from vectryx.service import Routes

    routes = Routes(VectorDB(spark, str(tmp_path / "db")))

    def ask(method, path, body=None):
        return routes.answer(method, path, b"" if body is None else json.dumps(body).encode())

    assert ask("GET", "/")[0] == 200 and ask("GET", "/nope")[0] == 404 and ask("PUT", "/collections")[0] == 405
    assert ask("POST", "/collections", {"name": "c", "dimension": 2, "metric": 2, "config": {"textField": "text"}})[0] == 201
    for body in ({"name": "c", "dimension": 2}, {"name": "", "dimension": 2}, {"name": "d", "dimension": 0}, {"name": "d"}, [1]):
        assert ask("POST", "/collections", body)[0] == 400
    assert routes.answer("POST", "/collections", b"{")[0] == 400
    assert ask("GET", "/collections")[1] == [{"Name": "c", "Dimension": 2, "Metric": 2, "Config": {"textField": "text"}}]
    assert ask("POST", "/collections/c/insert", {"id": "a \"b\"", "vector": [1, 2], "metadata": {"text": "red fox"}}) == (201, {"id": 'a "b"'})
    assert ask("POST", "/collections/c/insert", {"id": 'a "b"', "vector": [1, 2]})[0] == 409
    assert ask("POST", "/collections/c/insert", {"id": "x", "vector": [1]})[0] == 400
    assert ask("POST", "/collections/no/insert", {"id": "x", "vector": [1, 2]})[0] == 404
    assert ask("POST", "/collections/c/upsert", {"id": "x", "vector": [5, 5], "metadata": {"text": "blue fox"}})[0] == 201
    assert ask("POST", "/collections/c/batch", {"items": [{"id": "y", "vector": [0, 0]}]}) == (201, {"inserted": 1})
    status, found = ask("POST", "/collections/c/search", {"vector": [0, 0], "top_k": 1})
    assert status == 200 and found == {"results": [{"id": "y", "score": 0.0}]}
    assert ask("POST", "/collections/c/search", {})[0] == 400 and ask("POST", "/collections/c/search", {"vector": [1]})[0] == 400
    assert ask("POST", "/collections/no/search", {"vector": [1, 2]})[0] == 404
    assert [r["id"] for r in ask("POST", "/collections/c/hybrid-search", {"text_query": "blue"})[1]["results"]] == ["x"]
    assert ask("POST", "/collections/c/hybrid-search", {"vector": [1, 2]})[0] == 400
    status, found = ask("POST", "/collections/c/batch-search", {"vectors": [[0, 0], [5, 5]], "top_k": 2})
    assert status == 200 and [[r["id"] for r in x][0] for x in found["results"]] == ["y", "x"] and len(found["results"][1]) == 2
    for body in ({}, {"vectors": []}, {"vectors": [[1]]}, {"vectors": [["a", 1]]}, {"vectors": [[0, 0]], "probes": 0}):
        assert ask("POST", "/collections/c/batch-search", body)[0] == 400
    assert ask("POST", "/collections/c/search", {"vector": [0, 0], "filter": {"both ' and \"": 1}})[1] == {"results": []}
    status, health = ask("GET", "/collections/c/health")
    assert status == 200 and health["total_nodes"] == 3 and "reason" not in health and health["entry_point_layer"] >= 0
    assert ask("POST", "/collections/c/rebuild") == (200, {"status": "success"})
    assert ask("DELETE", "/collections/c/vectors/x")[0] == 204 and ask("DELETE", "/collections/c/vectors/x")[0] == 204
    assert ask("DELETE", "/collections/c")[0] == 204 and ask("DELETE", "/collections/c")[0] == 404


class Died(Exception):
    pass


@pytest.mark.parametrize("step", ["write", "rename", "after"])
def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    from vectryx.sources.files import Files

    db = VectorDB(spark, str(tmp_path / "db"), retain_seconds=0)
    db.create_collection("c", 2)
    db.add_batch("c", [Item("a", [1, 0]), Item("b", [0, 1])])
    db.compact("c")
    db.add("c", Item("d", [1, 1]))
    db.delete("c", "a")
    before = {r.id for r in db.items("c").collect()}
    with monkeypatch.context() as m:
        if step == "write":  # rows are there, the pointer isn't
            m.setattr(Files, "write_next", lambda *_: (_ for _ in ()).throw(Died()))
        elif step == "rename":  # the pointer is beside its place
            m.setattr(Files, "_path", lambda self, name, own=Files._path: own(self, name) if not name.endswith("2.json") else (_ for _ in ()).throw(Died()))
        else:  # the pointer is there, nothing was cleared away
            m.setattr("vectryx.sources.store.CollectionStore._drop_old", lambda self: (_ for _ in ()).throw(Died()))
        with pytest.raises(Died):
            db.compact("c")
    again = VectorDB(spark, str(tmp_path / "db"), retain_seconds=0)
    assert {r.id for r in again.items("c").collect()} == before == {"b", "d"}
    again.compact("c")
    assert {r.id for r in again.items("c").collect()} == before and not again.store("c").batches()


def test_searches_outlive_compactions(db):
    db.create_collection("c", 2, config={"textField": "text"})
    db.add_batch("c", [Item("a", [1, 0], {"text": "red"}), Item("b", [0, 1], {"text": "blue"})])
    early = db.search("c", SearchRequest(vector=[1, 0]))
    db.compact("c")
    near, text = db.search("c", SearchRequest(vector=[1, 0])), db.search("c", SearchRequest(text_query="blue"))
    db.upsert("c", Item("a", [0, 1], {"text": "green"}))
    between = db.search("c", SearchRequest(vector=[1, 0], top_k=1))
    for _ in range(2):
        db.compact("c")
    assert [r["id"] for r in db.results(near)] == [r["id"] for r in db.results(early)] == ["a", "b"]
    assert [r["id"] for r in db.results(text)] == ["b"] and db.results(between)[0]["id"] == "a"
    assert len(db.files.names(db.store("c").info.folder + "/base")) == 3
    db.retain_seconds = 0
    db.compact("c")
    assert len(db.files.names(db.store("c").info.folder + "/base")) == 1 and {r.id for r in db.items("c").collect()} == {"a", "b"}


def test_the_log_of_a_long_stream_stays_small(spark, tmp_path):
    db = VectorDB(spark, str(tmp_path / "db"), retain_seconds=0)
    db.create_collection("c", 1)
    store = db.store("c")
    operations = db._operations(db._frame([Item("x", [1])])).cache()
    for n in range(30):
        assert store.append(operations, f"feed-{n}")
        if n % 10 == 9:
            store.compact()
            assert not store.batches() and len(store.files.names(store.info.folder + "/log")) == 0
    assert store.current()["keys"] == {"feed": 29}
    assert not any(store.append(operations, k) for k in ("feed-29", "feed-3")) and store.append(operations, "other-0") and store.append(operations, "feed-30")
    assert db.items("c").count() == 1


def test_cells_and_graph_of_a_collection(spark, tmp_path):
    import numpy as np
    from pyspark.sql import functions as F

    from vectryx.operators import diagnostics

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = [(f"v{i:04d}", (centres[i % 12] + 0.3 * rng.normal(size=16)).astype("f4").tolist(), json.dumps({"even": i % 2 == 0})) for i in range(900)]
    db = VectorDB(spark, str(tmp_path / "db"))
    db.create_collection("c", 16, Metric.EUCLIDEAN)
    db.add_batch("c", spark.createDataFrame(rows, "id string, vector array<float>, metadata string"))
    before = db.graph_stats("c")
    db.rebuild_index("c", cells=12)
    assert db.graph_stats("c") == before and db.store("c").stored_graph() is not None
    queries = db.items("c").where("id < 'v0040'").select(F.col("id").alias("qid"), "vector").cache()
    truth = db.search_batch("c", queries, 5).cache()
    for found in (db.search_batch("c", queries, 5, probes=3), db.walk("c", queries, 5)):
        assert diagnostics.recall(found, truth, 5).first().mean_recall >= 0.9
    q = list(queries.where("qid = 'v0007'").first().vector)
    exact = ids(db, "c", vector=q)
    assert ids(db, "c", vector=q, probes=12) == exact and len(set(ids(db, "c", vector=q, probes=2)) & set(exact)) >= 4
    assert "cell" in db.store("c").live([0])._jdf.queryExecution().executedPlan().toString()  # directories are pruned
    # what is written and deleted afterwards counts in all of them
    db.delete("c", "v0007")
    db.upsert("c", Item("new", q, {"even": True}))
    assert ids(db, "c", vector=q, top_k=1) == ids(db, "c", vector=q, top_k=1, probes=1) == ["new"]
    for found in (db.search_batch("c", queries, 5, probes=3), db.walk("c", queries, 5)):
        best = found.where("qid = 'v0007'").orderBy("rank").collect()
        assert best[0].id == "new" and all(r.id != "v0007" for r in best)
    assert ids(db, "c", vector=q, probes=1, filter={"even": True}, top_k=400) == ids(db, "c", vector=q, filter={"even": True}, top_k=400)
    assert {r.id[-1] in "02468w" for r in db.walk("c", queries, 3, filter={"even": True}).collect()} == {True}
    assert tuple(db.check_health("c").first())[:2] == (901, 1)
    db.compact("c")
    assert db.store("c").current()["cells"] == 12 and db.items("c").count() == 900


def test_shards_have_directories(spark, tmp_path):
    db = VectorDB(spark, str(tmp_path / "db"), shards=3)
    db.create_collection("c", 2, Metric.EUCLIDEAN)
    db.add_batch("c", [Item(f"i{i}", [i, 1]) for i in range(30)])
    folder = db.store("c").info.folder
    (batch,) = db.files.names(f"{folder}/log")
    assert {n for n in db.files.names(f"{folder}/log/{batch}") if n.startswith("shard=")} == {"shard=0", "shard=1", "shard=2"}
    db.rebuild_index("c", cells=2)
    assert {n for n in db.files.names(f"{folder}/base/v1") if n.startswith("shard=")} == {"shard=0", "shard=1", "shard=2"}
    db.upsert("c", Item("i31", [3.5, 1]))
    assert ids(db, "c", vector=[3.6, 1], top_k=3) == ["i31", "i4", "i3"] == ids(db, "c", vector=[3.6, 1], top_k=3, probes=2)
