"""Vector distances as Catalyst expressions; for all three, lower is closer.

Sums run in double. A row whose length differs from the query's raises; two empty vectors are at distance 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from ..schema import Metric


def as_vector(q: Sequence[float] | Column) -> Column:
    """A column, or a literal array of doubles (as one expression to parse: a call a number would take longer than the search)."""
    if isinstance(q, Column):
        return q
    values = [float(x) for x in q]
    if not all(map(math.isfinite, values)):
        raise InvalidRequest("a vector's numbers must be finite")
    return F.expr(f"cast(array({', '.join(f'{x!r}D' for x in values)}) as array<double>)")


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def dot_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def negative_dot(a: Column, b: Column) -> Column:
    return -dot_product(a, b)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - similarity, the similarity kept within [-1, 1]; exactly 1 if either is the zero vector. Known norms save passes."""
    na, nb = norm_a if norm_a is not None else norm(a), norm_b if norm_b is not None else norm(b)
    similarity = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot_product(a, b) / F.nullif(na * nb, F.lit(0.0))))
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(F.lit(1.0) - similarity)


def distance(metric: Metric | int, a: Column, b: Sequence[float] | Column, norm_a: Column | None = None) -> Column:
    try:
        metric = Metric(metric)
    except ValueError as e:
        raise InvalidRequest(f"unknown metric {metric}") from e
    b = as_vector(b)
    value = euclidean(a, b) if metric is Metric.EUCLIDEAN else negative_dot(a, b) if metric is Metric.DOT else cosine(a, b, norm_a)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vector dimension mismatch")).cast("double")).when(F.size(a) == 0, F.lit(0.0)).otherwise(value)
