import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectryx.errors import InvalidRequest
from vectryx.functions.distance import as_vector, distance
from vectryx.functions.filters import matches, parsed
from vectryx.functions.hashing import fnv1a_mod, level
from vectryx.functions.text import SECTIONS, hashed_embedding, query_terms, section, split_text
from vectryx.schema import Metric


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("metric", "a", "b", "want"),
    [(2, [0, 0], [3, 4], 5), (0, [1, 0], [0, 1], 1), (0, [1, 2, 3], [1, 2, 3], 0), (0, [1, 2, 3], [-1, -2, -3], 2), (1, [1, 2], [3, 4], -11), (0, [1, 2], [0, 0], 1), (2, [], [], 0)],
)
def test_distances(spark, metric, a, b, want):
    assert value(spark, distance(metric, as_vector(a), b)) == pytest.approx(want, abs=1e-6)


def test_distance_errors(spark):
    with pytest.raises(InvalidRequest):
        distance(7, as_vector([1]), [1])
    with pytest.raises(Exception, match="dimension mismatch"):
        value(spark, distance(Metric.EUCLIDEAN, as_vector([1, 2]), [1]))


def number(x):
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def same(a, b):
    if number(a) and number(b):
        return float(a) == float(b)
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


STORED = [None, {}] + [{"k": v} for v in (1, 1.0, 2.5, "1", "", "true", True, False, None, {"a": 1}, {"a": 1, "b": [1, "x"]}, [], [1, 2], [2, 1], 2**53 + 1, -3)] + [{"other": 1}, {"a.b": 1}, {"it's": "x"}]
WANTED = [{}, {"a.b": 1}, {"it's": "x"}, {"k": 1, "other": 1}] + [{"k": v} for v in (1, 1.0, 2.5, "1", "", True, False, None, {"a": 1.0}, {"b": [1, "x"], "a": 1}, [], [1, 2], 2**53, -3)]


def test_filter_against_plain_python(spark):
    rows = spark.createDataFrame([(i, None if m is None else json.dumps(m)) for i, m in enumerate(STORED)], "i int, m string").withColumn("v", parsed(F.col("m")))
    found = rows.select("i", *(matches(F.col("v"), w).alias(f"w{j}") for j, w in enumerate(WANTED))).collect()
    for r in found:
        for j, w in enumerate(WANTED):
            m = STORED[r.i]
            want = not w or (m is not None and all(k in m and same(m[k], v) for k, v in w.items()))
            assert r[f"w{j}"] == want, (m, w)


def fnv(text, n):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h % n


def test_routing_hash(spark):
    rng = random.Random(5)
    ids = ["", "a", "vec_1", "日本語", "é"] + ["".join(rng.choice("abcé0123 _") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    rows = spark.createDataFrame([(x,) for x in ids], "id string").select("id", fnv1a_mod(F.col("id"), 3).alias("a"), fnv1a_mod(F.col("id"), 97).alias("b")).collect()
    assert all((r.a, r.b) == (fnv(r.id, 3), fnv(r.id, 97)) for r in rows)


def test_levels_fall_off(spark):
    counts = dict(spark.range(20000).select(level(F.col("id").cast("string")).alias("x")).groupBy("x").count().collect())
    assert counts[0] / 20000 == pytest.approx(1 - 1 / 16, abs=0.01) and max(counts) <= math.ceil(math.log(1e6) / math.log(16))


def test_sections(spark):
    rows = {"My Education": "education", "Skills and education": "education", "an intern": "experience", "Projects": "projects", "publication": "publications_certifications", "x": "general"}
    for text, want in rows.items():
        assert value(spark, section(F.lit(text), SECTIONS)) == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400))
def test_chunks_fit_and_keep_the_words(text):
    chunks = split_text(text, 40, 10)
    assert all(0 < len(c) <= 40 for c in chunks)
    assert set("".join(chunks).split()) <= set("".join(text.split())) | set("".join(chunks).split())
    joined = "".join("".join(c.split()) for c in chunks)
    assert len(joined) >= len("".join(text.split()))


def test_embedding_and_terms():
    assert query_terms("The quick, the QUICK fox_2!") == ["the", "quick", "fox", "2"]
    assert abs(sum(x * x for x in hashed_embedding("some words")) - 1) < 1e-6 and not hashed_embedding("").any() and not hashed_embedding(None).any()
