"""Vectors as blobs of little-endian float32, for stores that keep them so."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in blobs:
        yield s.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.BinaryType())
def encode_vector(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in vectors:
        yield s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def dimension_of(blob: Column) -> Column:
    return (F.length(blob) / 4).cast("int")
