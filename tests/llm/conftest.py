import pytest
from pyspark.sql import types as T

#: Names that operators use inside, as extra columns of their input.
CLASHES = ("id", "d", "r", "h", "g", "n", "v", "size", "target", "kept", "component", "sketch", "set_hash", "_row", "_h", "_s", "_n", "_times", "lo", "x")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASHES)])


def words(n, start=0):
    return " ".join(f"w{start + i}x" for i in range(n))


@pytest.fixture(scope="session")
def make(spark):
    def documents(rows):
        """rows of (doc_id, text[, lang[, source]])"""
        full = []
        for row in rows:
            doc, text, lang, source = (*row, *("en", "s0")[len(row) - 2 :]) if len(row) < 4 else row
            full.append((doc, text, lang, source, None if text is None else len(text), *("clash" for _ in CLASHES)))
        return spark.createDataFrame(full, SCHEMA)

    return documents


LONG = " ".join(f"long{i % 997}y{i}" for i in range(30_000))
MESSY = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "two words"), (6, words(80)), (7, words(80)), (7, words(80)), (8, words(60, 500) + "\n" + words(60, 500)),
    (9, LONG), (None, words(90, 2000)), (None, None), (10, "¿Qué? ÀÉ ﬁ ① 中文   \x00 \x1c x", None, None), (11, "THE AND OF! " * 40, "xx", None), (12, words(70, 3000), None, "s1"), (13, "###$$$ %% && <> | *", "en", "é"),
]


@pytest.fixture(scope="session")
def messy(make):
    return make(MESSY).cache()
