"""Every registered query against its SQL on the smallest tables."""

import pytest
from sqlcheck import SMALL, compare

from vectryx.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    ours, theirs = compare(spark, name)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"graph_walk", "recall_at_k"}))  # those have tests of their own
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= registry.K and set(rows[0].asDict()) == {"id", "score"}


def test_filter_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from vectryx.operators import knn

    rows = registry.items(spark, SMALL)
    plan = knn.knn(rows, [0.0] * 64, 3, 0, F.col("label") == 3)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan and "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_approximate_search_recall(spark):
    row = registry.recall_at_k(spark, SMALL).first()
    assert row.mean_recall >= 0.9


def test_walk_recall(spark):
    from pyspark.sql import functions as F

    from vectryx.operators import diagnostics, knn

    rows = registry.items(spark, SMALL).select(F.col("id").cast("string").alias("id"), "vector", "label")
    truth = knn.knn_batch(rows, rows.where("label = 0").select(F.col("id").alias("qid"), "vector"), registry.K)
    assert diagnostics.recall(registry.graph_walk(spark, SMALL), truth, registry.K).first().mean_recall >= 0.9


def test_stored_index_is_written_once(spark):
    first = registry.stored_index(spark, SMALL)
    before = registry.Files(spark, first).names("postings")
    assert registry.stored_index(spark, SMALL) == first and registry.Files(spark, first).names("postings") == before
    plan = registry.bm25_postings(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
