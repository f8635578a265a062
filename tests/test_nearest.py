"""The step that all batches of queries share: the closest rows of each query, tile by tile."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectryx.errors import DimensionMismatch
from vectryx.operators import knn
from vectryx.schema import Metric


def brute(x, q, k, metric):
    for v in q:
        d = knn.exact(x, np.broadcast_to(v, x.shape), metric)
        yield np.lexsort((np.arange(len(x)), d))[:k].tolist()


@pytest.mark.parametrize("metric", list(Metric))
def test_nearest_equals_brute_force(metric):
    rng = np.random.default_rng(5)
    plain = rng.normal(size=(5000, 20))
    far = plain + 1000
    copies = plain[rng.integers(0, 40, 5000)]
    odd = np.vstack([plain[:300].astype("f4"), np.zeros((3, 20)), np.full((1, 20), np.nan), plain[:2] * 1e20])
    for x, k in ((plain.astype("f4"), 10), (far, 33), (copies, 7), (np.ones((3000, 20)), 5), (odd, 12), (odd[:4], 9)):
        q = x[::97]
        places = knn.nearest(x, q, k, metric)[1]
        for own, true in zip(places, brute(x, q, k, metric)):
            assert own.tolist() == true + [-1] * (k - len(true))


@pytest.mark.parametrize("metric", list(Metric))
def test_memory_is_that_of_a_tile(metric):
    x = np.random.default_rng(6).normal(size=(20_000, 8)).astype("f4")
    tracemalloc.start()
    knn.nearest(x, x[:4096], 10, metric)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all pairs in double: 655 MB


def test_blocks_of_queries_and_several_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(f"v{i:04d}", x.tolist()) for i, x in enumerate(np.random.default_rng(7).normal(size=(700, 6)))], "id string, vector array<double>")
    queries = rows.select(F.col("id").alias("qid"), "vector")
    one = sorted(map(tuple, knn.knn_batch(rows, queries, 4).collect()))
    monkeypatch.setattr(knn, "BLOCK_BYTES", 8 * 6 * 99)
    assert [len(q) for _, q in knn.blocks(queries.withColumnRenamed("vector", "v"))] == [99] * 7 + [7]
    assert sorted(map(tuple, knn.knn_batch(rows, queries, 4).collect())) == one and len(one) == 2800


def test_lengths_are_each_row_s_own():
    import pyarrow as pa

    with pytest.raises(DimensionMismatch):  # six numbers for three rows of two
        knn.matrix(pa.array([[1.0], [1.0, 2.0], [1.0, 2.0, 3.0]]), 2)


def test_truth_is_worked_out_once(spark):
    from sqlcheck import SMALL

    from vectryx.plans import registry

    assert "MapInArrow" not in registry.recall_of_half(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
