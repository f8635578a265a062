"""Keyword search: BM25 over tokens, by a stored index or straight from the texts.

score = sum over the query's distinct terms of ln(1 + (N - df + .5) / (df + .5)) * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl))
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_terms, tokens

K1, B = 1.2, 0.75
DIGITS = 6
#: Postings are written in so many directories by their term's hash, so that a query reads only its terms' directories.
BUCKETS = 64


def _term_score(tf: Column, df: Column, dl: Column, n: Column, average: Column) -> Column:
    idf = F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))
    return idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / average))


def _occurrences(term: str) -> Column:
    return F.size(F.filter("t", lambda t: t == term)).cast("double")


def _spread(docs: DataFrame) -> DataFrame:
    """docs, in as many parts as there are cores if they come in less than half as many: a file that isn't split leaves the others idle."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if 2 * docs.rdd.getNumPartitions() <= cores else docs


def bm25(docs: DataFrame, query: str, k: int | None = None, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, score) of the documents with a term of the query, best first, k of them if given.

    A text is read once, by two regular expressions: one counts its tokens, one finds the query's terms. What comes of it is
    one narrow row a document, shuffled so that the statistics and the scores share it instead of reading the texts twice.
    """
    terms = query_terms(query)
    if not terms:
        return docs.select(F.col(id_).alias("id"), F.lit(0.0).alias("score")).limit(0)
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.regexp_extract_all(lower, F.lit(rf"(?<![\p{{L}}\p{{N}}])({'|'.join(terms)})(?![\p{{L}}\p{{N}}])"), F.lit(1))
    own = _spread(docs.select(id_, text)).select(F.col(id_).alias("id"), F.regexp_count(lower, F.lit(r"[\p{L}\p{N}]+")).cast("double").alias("dl"), found.alias("t")).where(F.col("dl") > 0)
    counts = own.select("id", "dl", *(_occurrences(w).alias(f"tf{i}") for i, w in enumerate(terms))).repartition("id")
    stats = counts.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("average"), *(F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + F.when(F.col(f"tf{i}") > 0, _term_score(F.col(f"tf{i}"), F.col(f"df{i}"), F.col("dl"), F.col("n"), F.col("average"))).otherwise(0.0)
    hit = F.lit(False)
    for i in range(len(terms)):
        hit = hit | (F.col(f"tf{i}") > 0)
    found = counts.where(hit).join(F.broadcast(stats)).select("id", F.round(score, DIGITS).alias("score"))
    return found.orderBy(F.desc("score"), "id").limit(k) if k is not None else found


def postings(docs: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(bucket, term, id, tf, dl): the index of the documents that have a text. A text's tokens are sorted and counted in its own row: nothing is shuffled."""
    own = _spread(docs.where(F.col(text).isNotNull()).select(id_, text)).select(F.col(id_).alias("id"), F.array_sort(tokens(F.col(text))).alias("t"))
    first = F.filter(F.transform("t", lambda term, i: F.when((i == 0) | (F.get("t", i - 1) != term), F.struct(term.alias("term"), i.alias("at")))), lambda x: x.isNotNull())
    runs = own.select("id", F.size("t").alias("dl"), first.alias("runs"))
    counted = F.transform("runs", lambda x, i: F.struct(x["term"].alias("term"), (F.coalesce(F.get("runs", i + 1)["at"], F.col("dl")) - x["at"]).alias("tf")))
    each = runs.select("id", "dl", F.explode(counted).alias("x")).select("id", "dl", "x.term", "x.tf")
    return each.select(F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(BUCKETS)).cast("int").alias("bucket"), "term", "id", "tf", "dl")


def lengths(docs: DataFrame, index: DataFrame, text: str = "text") -> DataFrame:
    """(n, average): one row of statistics that goes with postings(), the index. Of a text only the first token is looked for."""
    n = docs.where(F.col(text).isNotNull() & F.lower(F.col(text)).rlike(r"[\p{L}\p{N}]")).agg(F.count("*").alias("n"))
    total = index.agg(F.sum(F.col("tf").cast("long")).alias("total"))
    return n.join(F.broadcast(total)).select("n", (F.col("total").cast("double") / F.nullif(F.col("n"), F.lit(0))).alias("average"))


def store(docs: DataFrame, folder: str) -> None:
    """Writes the index of docs (id, text) into a folder: postings by bucket, and statistics."""
    postings(docs).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    index = docs.sparkSession.read.schema("term string, tf int, bucket int").parquet(f"{folder}/postings")
    lengths(docs, index).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")


def search_stored(spark: SparkSession, folder: str, query: str, k: int | None = None) -> DataFrame:
    """bm25() by what store() has written; of the postings, only the directories of the query's terms are read."""
    return search_postings(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/stats"), query, k)


def search_postings(index: DataFrame, stats: DataFrame, query: str, k: int | None = None) -> DataFrame:
    """bm25() over stored postings: reads the buckets of the query's terms, and needs one shuffle on the documents hit."""
    import zlib

    terms = query_terms(query)
    if not terms:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
    hits = index.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms))
    dfs = hits.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    each = hits.join(F.broadcast(dfs), "term").join(F.broadcast(stats))
    score = _term_score(F.col("tf").cast("double"), F.col("df"), F.col("dl").cast("double"), F.col("n").cast("double"), F.col("average"))
    found = each.groupBy("id").agg(F.round(F.sum(score), DIGITS).alias("score"))
    return found.orderBy(F.desc("score"), "id").limit(k) if k is not None else found
