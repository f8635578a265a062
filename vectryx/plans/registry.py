"""Registered queries of the search engine, each over whole tables, with the SQL it is compared with.

The tables stand in for collections: embeddings (vec_id, embedding, label) for vectors, documents for texts, events for an
operation log (the user is the id, `error` deletes, anything else inserts).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import as_vector, cosine, euclidean, negative_dot, norm
from ..functions.filters import matches, parsed
from ..functions.text import query_terms, section, tokens
from ..operators import ann, diagnostics, graph, hybrid, keywords, knn, rag, shards
from ..schema import Metric, M
from ..sources import catalog, codec, oplog, requests
from ..sources.files import Files
from ..sources.lineage import cut, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TEXT_QUERY = "The thing from that"
K = 10


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_rrf(spark, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """That of the least id."""
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0])


Q = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1)"


def _nearest(spark: SparkSession, sf_dir: str, metric: Metric) -> DataFrame:
    return knn.knn(items(spark, sf_dir), query_vector(spark, sf_dir), K, metric)


@registered(f"WITH {Q} SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], v), 6) AS distance FROM embeddings, q ORDER BY distance, id LIMIT {K}")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, Metric.COSINE)


@registered(f"WITH {Q} SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], v), 6) AS distance FROM embeddings, q ORDER BY distance, id LIMIT {K}")
def knn_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, Metric.EUCLIDEAN)


@registered(f"WITH {Q} SELECT vec_id AS id, round(-list_inner_product(embedding::DOUBLE[], v), 6) AS distance FROM embeddings, q ORDER BY distance, id LIMIT {K}")
def knn_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, Metric.DOT)


@registered(f"WITH {Q} SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], v), 6) AS distance FROM embeddings, q WHERE label = 3 ORDER BY distance, id LIMIT {K}")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.knn(items(spark, sf_dir), query_vector(spark, sf_dir), K, Metric.COSINE, F.col("label") == 3)


@registered(f"WITH {Q} SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], v), 6) AS distance FROM embeddings, q WHERE label = 3 ORDER BY distance, id LIMIT {K}")
def knn_json_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through metadata in JSON: 3.0 equals 3."""
    rows = items(spark, sf_dir).withColumn("metadata", F.to_json(F.struct("label")))
    return knn.knn(rows, query_vector(spark, sf_dir), K, Metric.COSINE, matches(parsed(F.col("metadata")), {"label": 3.0}))


def _batch_sql(distance: str, where: str = "") -> str:
    return f"""
SELECT qid, id, distance FROM (
  SELECT b.vec_id AS qid, e.vec_id AS id, round({distance}, 6) AS distance FROM embeddings e, embeddings b {where})
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, id) <= {K}"""


@registered(_batch_sql("1 - list_cosine_similarity(e.embedding::DOUBLE[], b.embedding::DOUBLE[])", "WHERE b.label = 0"))
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries (all vectors of label 0) against all rows."""
    rows = items(spark, sf_dir)
    asked = rows.where(F.col("label") == 0).select(F.col("id").alias("qid"), "vector")
    return knn.knn_batch(rows, asked, K).select("qid", "id", "distance")


@registered(_batch_sql("list_distance(e.embedding::DOUBLE[], b.embedding::DOUBLE[])", "WHERE b.label = 1"))
def knn_batch_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    asked = rows.where(F.col("label") == 1).select(F.col("id").alias("qid"), "vector")
    return knn.knn_batch(rows, asked, K, Metric.EUCLIDEAN).select("qid", "id", "distance")


@registered(f"""
WITH {Q}, t AS (SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], v), 6) AS distance FROM embeddings, q ORDER BY distance, id LIMIT {K})
SELECT t.id, distance, '{{"label":' || label || '}}' AS metadata, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(embedding::DOUBLE[]), 6) AS total
FROM t JOIN embeddings e ON t.id = e.vec_id""")
def knn_include_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("metadata", F.to_json(F.struct("label")))
    found = knn.hydrated(_nearest(spark, sf_dir, Metric.COSINE), rows, include_vector=True)
    total = F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 6)
    return found.select("id", "distance", "metadata", F.size("vector").alias("n"), total.alias("total"))


@registered("SELECT * FROM (VALUES (5.0::DOUBLE, -11.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE)) t(euclid, dot, orthogonal, same, opposite, zero)")
def distance_goldens(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = as_vector
    return spark.range(1).select(
        euclidean(v([0, 0]), v([3, 4])).alias("euclid"), negative_dot(v([1, 2]), v([3, 4])).alias("dot"), F.round(cosine(v([1, 0]), v([0, 1])), 6).alias("orthogonal"),
        F.abs(F.round(cosine(v([1, 2, 3]), v([1, 2, 3])), 6)).alias("same"), F.round(cosine(v([1, 2, 3]), v([-1, -2, -3])), 6).alias("opposite"), cosine(v([1, 2]), v([0, 0])).alias("zero"),
    )


@registered("SELECT vec_id AS id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", F.round(norm(F.col("vector")), 6).alias("norm"))


@registered("SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = items(spark, sf_dir).select("id", codec.encode_vector("vector").alias("blob"))
    back = blobs.select("id", codec.dimension_of(F.col("blob")).alias("dim"), codec.decode_vector("blob").alias("vector"))
    return back.select("id", "dim", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


_STORED = [("int", '{"k":1}'), ("float", '{"k":1.0}'), ("text", '{"k":"1"}'), ("true", '{"k":true}'), ("null", '{"k":null}'), ("missing", "{}"), ("object", '{"k":{"b":[1,2],"a":"x"}}'), ("array", '{"k":[1,"a"]}'), ("none", None)]
_WANTED = [("is_1", 1), ("is_1_0", 1.0), ("is_text_1", "1"), ("is_true", True), ("is_null", None), ("is_object", {"a": "x", "b": [1.0, 2]}), ("is_array", [1, "a"])]


@registered("""
SELECT * FROM (VALUES ('int',true,true,false,false,false,false,false,true), ('float',true,true,false,false,false,false,false,true),
  ('text',false,false,true,false,false,false,false,true), ('true',false,false,false,true,false,false,false,true),
  ('null',false,false,false,false,true,false,false,true), ('missing',false,false,false,false,false,false,false,true),
  ('object',false,false,false,false,false,true,false,true), ('array',false,false,false,false,false,false,true,true),
  ('none',false,false,false,false,false,false,false,true)) t(stored, is_1, is_1_0, is_text_1, is_true, is_null, is_object, is_array, is_empty)""")
def filter_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_STORED, "stored string, metadata string").withColumn("m", parsed(F.col("metadata")))
    return rows.select("stored", *(matches(F.col("m"), {"k": v}).alias(n) for n, v in _WANTED), matches(F.col("m"), {}).alias("is_empty"))


@registered("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) = 42 AND event_type = 'view' AS hit FROM events")
def filter_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys at once, over every event's properties with its type put in."""
    meta = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("type")))
    return table(spark, sf_dir, "events").select("event_id", matches(F.parse_json(meta), {"k": 42, "type": "view"}).alias("hit"))


TOKENS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@registered(f"SELECT doc_id AS id, CAST(len({TOKENS}) AS INTEGER) AS n, CAST(len(list_distinct({TOKENS})) AS INTEGER) AS n_distinct FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tokens(F.col("text")).alias("t"))
    return own.select("id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("n_distinct"))


def _bm25_cte() -> str:
    terms = ", ".join(f"('{t}')" for t in query_terms(TEXT_QUERY))
    return f"""
tok AS (SELECT doc_id AS id, lang, {TOKENS} AS t FROM documents),
dl AS (SELECT id, lang, t, CAST(len(t) AS DOUBLE) AS dl FROM tok WHERE len(t) > 0),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS average FROM dl),
terms(term) AS (VALUES {terms}),
tf AS (SELECT id, dl, term, CAST(len(list_filter(t, lambda x: x = term)) AS DOUBLE) AS tf FROM dl, terms),
hits AS (SELECT * FROM tf WHERE tf > 0),
df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM hits GROUP BY term),
bm AS (SELECT id, round(sum(ln(1::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / average))), 6) AS score
  FROM hits JOIN df USING (term), st GROUP BY id)"""


def stored_index(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the keyword index of all documents, written when it is first asked for; other files have another folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    summary = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    name = hashlib.sha256(f"{summary.getPath()} {summary.getModificationTime()} {summary.getLen()}".encode()).hexdigest()[:24]
    folder = f"{shared_folder(spark)}/keywords-{name}"
    if not Files(spark, folder).exists("stats/_SUCCESS"):
        keywords.store(texts(spark, sf_dir), folder)
    return folder


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")


@registered(f"WITH {_bm25_cte()} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT {K}")
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.bm25(texts(spark, sf_dir), TEXT_QUERY, K)


@registered(f"WITH {_bm25_cte()} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT {K}")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the stored keyword index."""
    return keywords.search_stored(spark, stored_index(spark, sf_dir), TEXT_QUERY, K)


@registered(f"WITH {_bm25_cte()}, top AS (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT {K}) SELECT top.id, score FROM top JOIN documents d ON top.id = d.doc_id WHERE d.lang = 'en'")
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter comes after the top k, so there are fewer."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.to_json(F.struct("lang", "source")).alias("metadata"))
    where = matches(parsed(F.col("metadata")), {"lang": "en"})
    return hybrid.post_filtered(keywords.bm25(docs, TEXT_QUERY, K), docs, where).select("id", "score")


def _hybrid_sql(where: str, post: str) -> str:
    return f"""
WITH {Q}, {_bm25_cte()},
near AS (SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], v), 6) AS distance FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id, q {where} ORDER BY distance, id LIMIT {2 * K}),
both_ids AS (SELECT d.doc_id AS id FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id),
txt0 AS (SELECT bm.id, score FROM bm ORDER BY score DESC, id LIMIT {2 * K}),
txt AS (SELECT txt0.* FROM txt0 {post}),
legs AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS r FROM near UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM txt)
SELECT id, round(sum(1::DOUBLE / (60::DOUBLE + r)), 9) AS score FROM legs GROUP BY id ORDER BY score DESC, id LIMIT {K}"""


def _hybrid(spark: SparkSession, sf_dir: str, lang: str | None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    rows = items(spark, sf_dir).join(docs.select("id", "lang"), "id")
    where = F.col("lang") == lang if lang else None
    text = hybrid.post_filtered(keywords.search_stored(spark, stored_index(spark, sf_dir), TEXT_QUERY, 2 * K), docs, where)
    return hybrid.search(rows, query_vector(spark, sf_dir), text, K, Metric.COSINE, where)


@registered(_hybrid_sql("", ""))
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, None)


@registered(_hybrid_sql("WHERE d.lang = 'en'", "JOIN documents d ON txt0.id = d.doc_id WHERE d.lang = 'en'"))
def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, "en")


# the operation log


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.lit(0).cast("long").alias("pos"), F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("op"), F.col("user_id").cast("string").alias("id"),
        F.array(F.col("value").cast("float")).alias("vector"), F.when(F.col("event_type") != "view", F.col("props")).alias("metadata"), "ts",
    )


LOG_SQL = "log AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'insert' END AS op, CAST(user_id AS VARCHAR) AS id, CAST(value AS FLOAT) AS value, CASE WHEN event_type <> 'view' THEN props END AS metadata, ts FROM events)"
LAST_SQL = "last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"


def _row(df: DataFrame) -> DataFrame:
    return df.select("id", F.round(F.get("vector", F.lit(0)).cast("double"), 4).alias("value"), "metadata")


@registered(f"WITH {LOG_SQL}, {LAST_SQL} SELECT id, round(CAST(value AS DOUBLE), 4) AS value, metadata FROM last WHERE op = 'insert'")
def oplog_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(oplog.live(log(spark, sf_dir)))


@registered(f"WITH {LOG_SQL}, {LAST_SQL} SELECT id, round(CAST(value AS DOUBLE), 4) AS value, metadata FROM last WHERE op = 'insert'")
def upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base of the first half of the log and a replay of the rest end at the same rows."""
    own = log(spark, sf_dir)
    middle = own.agg((F.max("seq") / 2).cast("long")).first()[0] or 0
    return _row(oplog.replayed(oplog.live(own.where(F.col("seq") <= middle)), own.where(F.col("seq") > middle)))


@registered("SELECT CAST(user_id AS VARCHAR) AS id, round(CAST(CAST(arg_max(value, event_id) AS FLOAT) AS DOUBLE), 4) AS value, arg_max(props, event_id) AS metadata FROM events GROUP BY user_id")
def batch_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("id"), F.array(F.col("value").cast("float")).alias("vector"), F.col("props").alias("metadata"))
    return _row(oplog.last_of_batch(e))


@registered(f"WITH {LOG_SQL}, {LAST_SQL} SELECT id, op = 'insert' AS live, op = 'delete' AND id IN (SELECT id FROM log WHERE op = 'insert') AS tombstoned FROM last")
def delete_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.state_of(log(spark, sf_dir))


@registered("SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE doc_id IN (SELECT vec_id FROM embeddings) OR doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1)")
def strict_insert_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return oplog.conflicts(new, items(spark, sf_dir).select(F.col("id").cast("string").alias("id")))


@registered("SELECT e.vec_id AS id, l.quality, CAST(len(e.embedding) AS INTEGER) AS n FROM embeddings e LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON e.vec_id = l.doc_id WHERE e.vec_id IN (SELECT doc_id FROM documents)")
def payload_multiget(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("metadata"))
    found = knn.payloads(ids, items(spark, sf_dir).join(labels, "id", "left"), include_vector=True)
    return found.select("id", F.col("metadata").alias("quality"), F.size("vector").alias("n"))


@registered("SELECT vec_id AS id FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)")
def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.present(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), items(spark, sf_dir))


@registered("SELECT CAST(coalesce(epoch(max(ts))::BIGINT, 0) AS BIGINT) AS max_created_at FROM (SELECT date_trunc('second', ts) AS ts FROM events)")
def max_created_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.max_created_at(table(spark, sf_dir, "events").select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("created_at")))


# catalog

_CATALOG = [("articles", 64, 0, '{"textField": "text"}'), ("broken", 8, 2, "{not json"), ("src1", 4, 1, "{}"), ("listed", 3, 0, "[1]")]


@registered("SELECT * FROM (VALUES ('articles', 64, 0, '{\"textField\":\"text\"}'), ('broken', 8, 2, '{}'), ('src1', 4, 1, '{}'), ('listed', 3, 0, '{}')) t(name, dimension, metric, config)")
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can't be read as an object is {}."""
    return catalog.with_config(spark.createDataFrame(_CATALOG, "name string, dimension int, metric int, config string"))


@registered("""
SELECT name, dimension, metric FROM (VALUES ('articles', 64, 0), ('broken', 8, 2), ('src1', 4, 1), ('listed', 3, 0)) t(name, dimension, metric)
UNION ALL SELECT source, CAST(min(length(source)) AS INTEGER), 0 FROM documents WHERE source <> 'src1' GROUP BY source""")
def catalog_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections that only their rows tell of are put in; those that are there stay."""
    known = spark.createDataFrame(_CATALOG, "name string, dimension int, metric int, config string")
    rows = table(spark, sf_dir, "documents").where(F.col("source").isNotNull()).select(F.col("source").alias("collection"), F.length("source").alias("dim"))
    return catalog.with_missing(known, rows).select("name", "dimension", "metric")


# shards and health

FNV_SQL = "CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) % 4 AS BIGINT)"


@registered(f"SELECT vec_id AS id, {FNV_SQL.format('CAST(vec_id AS VARCHAR)')} AS shard FROM embeddings")
def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assigned(items(spark, sf_dir), 4).select("id", "shard")


@registered(f"WITH {Q} SELECT {FNV_SQL.format('CAST(vec_id AS VARCHAR)')} AS shard, vec_id AS id, round(list_distance(embedding::DOUBLE[], v), 6) AS distance FROM embeddings, q ORDER BY distance, id LIMIT {K}")
def scatter_gather_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.scatter_gather(shards.assigned(items(spark, sf_dir), 4), query_vector(spark, sf_dir), K, Metric.EUCLIDEAN)


STATE_SQL = f"WITH {LOG_SQL}, {LAST_SQL}, s AS (SELECT id, op = 'insert' AS live, op = 'delete' AND id IN (SELECT id FROM log WHERE op = 'insert') AS tombstoned FROM last), t AS (SELECT CAST(count(*) FILTER (WHERE live OR tombstoned) AS BIGINT) AS total_nodes, CAST(count(*) FILTER (WHERE tombstoned) AS BIGINT) AS tombstoned_nodes FROM s)"
ADVICE_SQL = "SELECT total_nodes, tombstoned_nodes, {0} AS rebuild_recommended, CASE WHEN {0} THEN 'more than 20% of nodes are tombstoned' END AS reason FROM t"


@registered(f"{STATE_SQL} {ADVICE_SQL.format('(total_nodes > 1000 AND tombstoned_nodes / total_nodes > 0.2)')}")
def health_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.health(diagnostics.state_of(log(spark, sf_dir)))


@registered(f"{STATE_SQL} {ADVICE_SQL.format('(total_nodes > 0 AND tombstoned_nodes / total_nodes > 0.2)')}")
def health_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = shards.assigned(diagnostics.state_of(log(spark, sf_dir)), 4)
    by_shard = states.groupBy("shard").agg(F.sum((F.col("live") | F.col("tombstoned")).cast("long")).alias("total_nodes"), F.sum(F.col("tombstoned").cast("long")).alias("tombstoned_nodes"))
    return diagnostics.merged_health(by_shard)


@registered(f"""
WITH lv AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding::DOUBLE[] AS v, CAST(floor(-ln(greatest(1e-6::DOUBLE, CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496::DOUBLE)) * {1 / math.log(M)!r}::DOUBLE) AS INTEGER) AS top FROM embeddings),
layers AS (SELECT CAST(unnest(generate_series(0, (SELECT max(top) FROM lv))) AS INTEGER) AS layer),
d AS (SELECT layer, a.id, b.id AS n, round(1 - list_cosine_similarity(b.v, a.v), 6) AS distance FROM layers, lv a, lv b WHERE a.top >= layer AND b.top >= layer AND a.id <> b.id),
one AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY layer, id ORDER BY distance, n) <= CASE WHEN layer = 0 THEN {2 * M} ELSE {M} END),
mutual AS (SELECT layer, id, n, distance FROM one UNION SELECT layer, n, id, distance FROM one),
kept AS (SELECT layer, id, n FROM mutual QUALIFY row_number() OVER (PARTITION BY layer, id ORDER BY distance, n) <= CASE WHEN layer = 0 THEN {2 * M} ELSE {M} END),
degrees AS (SELECT layer, lv.id, count(kept.n) AS degree FROM layers JOIN lv ON top >= layer LEFT JOIN kept USING (layer, id) GROUP BY layer, lv.id)
SELECT (SELECT max(top) FROM lv) AS entry_point_layer, layer, round(avg(degree), 9) AS degree FROM degrees GROUP BY layer""")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of the layered neighbour graph."""
    rows = items(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "vector")
    found = graph.stats(graph.build(rows)).select("entry_point_layer", F.explode("avg_degree_per_layer").alias("layer", "degree"))
    return found.withColumn("degree", F.round("degree", 9))


@registered(f"""
WITH d AS (SELECT a.vec_id AS id, b.vec_id AS n, round(1 - list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
one AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, n) <= 4),
mutual AS (SELECT id, n, distance FROM one UNION SELECT n, id, distance FROM one),
kept AS (SELECT id, n FROM mutual QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, n) <= 4)
SELECT id, CAST(count(*) AS BIGINT) AS degree FROM kept GROUP BY id""")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One layer of the graph: the four nearest, made mutual, cut to four again."""
    return graph.neighbours(items(spark, sf_dir).select("id", "vector"), 4, Metric.COSINE).groupBy("id").agg(F.count("*").alias("degree"))


@registered()
def graph_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries (all vectors of label 0) by walking the layered graph of all rows."""
    rows = items(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "vector", "label")
    return graph.walk(cut(graph.build(rows)), rows, rows.where("label = 0").select(F.col("id").alias("qid"), "vector"), K)


@registered()
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the inverted file with three quarters of its cells probed (the vectors fill space evenly, the worst case for cells), for all rows as queries."""
    rows = items(spark, sf_dir).select("id", "vector")
    asked = rows.select(F.col("id").alias("qid"), "vector")
    cells = ann.fit(rows, 16)
    found = ann.search_batch(ann.assign(rows, cells), cells, asked, K, probes=12)
    return diagnostics.recall(found, knn.knn_batch(rows, asked, K), K)


@registered(f"""
WITH t AS (SELECT b.vec_id AS qid, e.vec_id AS id, row_number() OVER (PARTITION BY b.vec_id ORDER BY round(1 - list_cosine_similarity(e.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6), e.vec_id) AS r FROM embeddings e, embeddings b WHERE b.label = 0),
hits AS (SELECT truth.qid, count(found.id) / {K}.0::DOUBLE AS recall FROM t truth LEFT JOIN (SELECT * FROM t WHERE r <= {K // 2}) found USING (qid, id) WHERE truth.r <= {K} GROUP BY truth.qid)
SELECT avg(recall) AS mean_recall, min(recall) AS min_recall FROM hits""")
def recall_of_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measure itself: a search that returns the first half of the true neighbours has recall one half."""
    rows = items(spark, sf_dir)
    truth = cut(knn.knn_batch(rows, rows.where(F.col("label") == 0).select(F.col("id").alias("qid"), "vector"), K))  # read twice
    return diagnostics.recall(truth.where(F.col("rank") <= K // 2), truth, K)


@registered("SELECT count(*) AS n, max(value) FILTER (WHERE place = n_all // 2) AS p50, max(value) FILTER (WHERE place = n_all * 99 // 100) AS p99 FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS place, count(*) OVER () AS n_all FROM events)")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.latencies(table(spark, sf_dir, "events"), "value")


# requests and retrieval


@registered("SELECT CAST(event_id AS VARCHAR) AS id, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 4) AS value, props IS NOT NULL AS has_metadata FROM events")
def json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item objects as a request body has them, parsed."""
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit('{"id":"'), F.col("event_id").cast("string"), F.lit('","vector":['), F.col("value").cast("string"), F.lit('],"metadata":'), F.coalesce("props", F.lit("null")), F.lit("}"))
    found = requests.items_from_json(e.select(body.alias("value")))
    return found.select("id", F.round(F.get("vector", F.lit(0)).cast("double"), 4).alias("value"), F.col("metadata").isNotNull().alias("has_metadata"))


_SECTION_SQL = "CASE WHEN contains(lower({0}), 'education') THEN 'education' WHEN contains(lower({0}), 'skills') THEN 'skills' WHEN contains(lower({0}), 'experience') OR contains(lower({0}), 'engineer') OR contains(lower({0}), 'intern') THEN 'experience' WHEN contains(lower({0}), 'project') THEN 'projects' WHEN contains(lower({0}), 'certification') OR contains(lower({0}), 'publication') THEN 'publications_certifications' ELSE 'general' END"


@registered(f"SELECT page_id AS id, {_SECTION_SQL.format('html')} AS section FROM pages")
def section_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), section(F.col("html")).alias("section"))


@registered("SELECT conv_id, string_agg('[' || coalesce(role, 'unknown') || '] ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("rank"), F.col("role").alias("section"), "text")
    return rag.context(rows, "conv_id")


@registered()
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document with section and a hashed embedding."""
    return rag.prepared(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", F.size("vector").alias("dimension"), "metadata")
