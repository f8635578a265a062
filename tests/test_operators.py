import numpy as np
import pytest
from pyspark.sql import functions as F

from vectryx.operators import ann, diagnostics, graph, hybrid, knn, rag
from vectryx.schema import Metric


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(f"v{i:04d}", rng.random(16).astype("f4").tolist()) for i in range(600)] + [("w0", [0.0] * 16), ("w1", [0.0] * 16)]
    return spark.createDataFrame(rows, "id string, vector array<float>").cache()


@pytest.mark.parametrize("metric", list(Metric))
def test_batch_equals_single(spark, vectors, metric):
    queries = vectors.where("id < 'v0005'").withColumnRenamed("id", "qid")
    found = {}
    for r in knn.knn_batch(vectors, queries, 7, metric).collect():
        found.setdefault(r.qid, {})[r["rank"]] = (r.id, r.distance)
    for q in queries.collect():
        single = [(r.id, r.distance) for r in knn.knn(vectors, q.vector, 7, metric).collect()]
        assert [found[q.qid][i][0] for i in range(1, 8)] == [s[0] for s in single]
        assert [found[q.qid][i][1] for i in range(1, 8)] == pytest.approx([s[1] for s in single], abs=2e-6)


def test_batch_edges(spark, vectors):
    none = vectors.where("false").withColumnRenamed("id", "qid")
    assert knn.knn_batch(vectors, none, 3).count() == 0
    assert knn.knn_batch(vectors.where("false"), vectors.limit(2).withColumnRenamed("id", "qid"), 3).count() == 0
    with pytest.raises(Exception, match="dimension mismatch"):
        knn.knn_batch(vectors, spark.createDataFrame([("q", [1.0])], "qid string, vector array<float>"), 3).count()


def test_cells(spark, vectors):
    cells = ann.fit(vectors, 8, Metric.EUCLIDEAN)
    assigned = ann.assign(vectors, cells).cache()
    truth = knn.knn_batch(vectors, vectors.withColumnRenamed("id", "qid"), 10, Metric.EUCLIDEAN)
    found = ann.search_batch(assigned, cells, vectors.withColumnRenamed("id", "qid"), 10, probes=6)
    assert diagnostics.recall(found, truth, 10).first().mean_recall >= 0.9
    q = vectors.first().vector
    exact = [r.id for r in knn.knn(vectors, q, 5, Metric.EUCLIDEAN).collect()]
    assert [r.id for r in ann.search(assigned, cells, q, 5, probes=8).collect()] == exact
    rare = ann.search(assigned, cells, q, 5, probes=1, where=F.col("id").isin("w0", "w1"))
    assert {r.id for r in rare.collect()} == {"w0", "w1"}


def test_many_queries_meet_rows_by_cell(spark, vectors, monkeypatch):
    cells = ann.fit(vectors, 5, Metric.EUCLIDEAN)
    assigned, queries = ann.assign(vectors, cells).cache(), vectors.selectExpr("id AS qid", "vector")
    few = ann.search_batch(assigned, cells, queries, 6, probes=3)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    many = ann.search_batch(assigned, cells, queries, 6, probes=3, most_sent=10)
    assert "CoGroup" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_graph(spark, vectors):
    built = graph.build(vectors, Metric.EUCLIDEAN, m=4).cache()
    assert built.where("layer = 0").count() == vectors.count()
    assert all(len(r.neighbours) <= (8 if r.layer == 0 else 4) and r.id not in r.neighbours for r in built.collect())
    row = graph.stats(built).first()
    assert row.entry_point_layer == max(row.avg_degree_per_layer) and 4 <= row.avg_degree_per_layer[0] <= 8


def test_graph_beyond_exact_rows(spark):
    rows = [(f"v{i:04d}", x.tolist()) for i, x in enumerate(np.random.default_rng(4).normal(size=(900, 64)).astype("f4"))]
    items = spark.createDataFrame(rows, "id string, vector array<float>").cache()
    exact, near = ({(r.id, r.neighbour) for r in graph.neighbours(items, 8, Metric.COSINE, exact_rows=most).collect()} for most in (900, 500))
    assert len(exact & near) >= 0.85 * len(exact)


def test_walk(spark, vectors):
    built = graph.build(vectors, Metric.EUCLIDEAN, m=8).cache()
    queries = vectors.where("id < 'v0020'").withColumnRenamed("id", "qid")
    truth = knn.knn_batch(vectors, queries, 10, Metric.EUCLIDEAN)
    found = graph.walk(built, vectors, queries, 10, metric=Metric.EUCLIDEAN).cache()
    assert diagnostics.recall(found, truth, 10).first().mean_recall >= 0.9
    assert all(r.id == r.qid and r.distance == 0 for r in found.where("rank = 1").collect())
    some = graph.walk(built, vectors, queries, 3, metric=Metric.EUCLIDEAN, where=F.col("id") >= "v0300").collect()
    assert some and all(r.id >= "v0300" for r in some)
    assert graph.walk(built.where("false"), vectors, queries, 3).count() == 0


def test_fusion_scores(spark):
    near = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.2)], "id string, distance double")
    text = spark.createDataFrame([("c", 9.0), ("d", 1.0)], "id string, score double")
    rows = {r.id: r.score for r in hybrid.fuse(near, text, 10).collect()}
    assert rows == pytest.approx({"a": 1 / 61, "b": 1 / 62, "c": 1 / 63 + 1 / 61, "d": 1 / 62}, abs=1e-8)
    assert [r.id for r in hybrid.fuse(near, text, 2).collect()] == ["c", "a"]


def test_health_thresholds(spark):
    def states(live, dead):
        return spark.range(live + dead).selectExpr("id", f"id < {live} AS live", f"id >= {live} AS tombstoned")

    for live, dead, single, sharded in ((800, 200, False, False), (700, 300, False, True), (801, 201, True, True), (900, 200, False, False), (0, 0, False, False)):
        assert diagnostics.health(states(live, dead)).first().rebuild_recommended == single
        assert diagnostics.health(states(live, dead), sharded=True).first().rebuild_recommended == sharded


def test_context(spark):
    rows = spark.createDataFrame([(2, "b", "two"), (1, None, "one"), (3, "c", None)], "rank int, section string, text string")
    assert rag.context(rows).first().context == "[unknown] one\n\n[b] two\n\n[c] "


def test_chunks_to_items(spark):
    docs = spark.createDataFrame([("d", "Education at school. " * 60), ("n", None)], "id string, text string")
    rows = rag.prepared(docs).collect()
    assert len(rows) > 2 and all(r.id.startswith("chunk_d_") and len(r.vector) == 64 and '"section":"education"' in r.metadata for r in rows)


def test_latencies_by_place(spark):
    import random

    for n in (1, 2, 7, 100, 999):
        rng = random.Random(n)
        own = sorted(rng.choice([0.5, 1.0, rng.random()]) for _ in range(n))
        rows = spark.createDataFrame([(x,) for x in own], "seconds double").repartition(3)
        assert tuple(diagnostics.latencies(rows).first()) == (n, own[n // 2], own[n * 99 // 100])
    found = diagnostics.latencies(rows)
    assert "SinglePartition" not in found.select("p50")._jdf.queryExecution().executedPlan().toString().split("Window")[0]


def test_walk_in_tasks_equals_walk_by_joins(spark, vectors, monkeypatch):
    metric = Metric.EUCLIDEAN
    some = vectors.where("id < 'v0150'").cache()
    built = graph.build(some, metric, m=4).cache()
    queries = some.where("id < 'v0015'").withColumnRenamed("id", "qid")
    fewer = some.where("id <> 'v0123'")  # the graph still has it
    cases = ((fewer, {"among": fewer.where("id < 'v0130'").select("id"), "where": F.col("id") >= "v0020"}),)
    own = [sorted(map(tuple, graph.walk(built, rows, queries, 6, width=12, metric=metric, **more).collect())) for rows, more in cases]
    assert "MapInArrow" in graph.walk(built, vectors, queries, 6)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(graph, "SENT_BYTES", 0)
    by_joins = [sorted(map(tuple, graph.walk(built, rows, queries, 6, width=12, metric=metric, **more).collect())) for rows, more in cases]
    assert own == by_joins and all(own)


def test_graph_searches_once(spark, vectors):
    plan = graph.neighbours(vectors, 4, Metric.COSINE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_postings_are_counted_in_their_row(spark, tmp_path):
    from vectryx.operators import keywords

    docs = spark.createDataFrame([("a", "The cat. the CAT the"), ("b", ""), ("c", None), ("d", "... !"), ("e", "x")], "id string, text string").coalesce(1)
    found = keywords.postings(docs)
    assert sorted((r.id, r.term, r.tf, r.dl) for r in found.collect()) == [("a", "cat", 2, 5), ("a", "the", 3, 5), ("e", "x", 1, 1)]
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    keywords.store(docs, str(tmp_path / "index"))
    assert tuple(spark.read.parquet(str(tmp_path / "index/stats")).first()) == (2, 3.0)
    keywords.store(docs.where("id = 'c'"), str(tmp_path / "none"))
    assert tuple(spark.read.parquet(str(tmp_path / "none/stats")).first()) == (0, None)
