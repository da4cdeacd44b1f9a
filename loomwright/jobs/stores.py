"""Queries of search from texts alone, of term tables and stores that are updated, and of streams that go on after a stop."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.embedding import DIM, HashingModel, encoder, hashed
from ..operators import embedding
from ..operators.store import Store, complete
from ..operators.tables import folder
from ..operators.terms import TermStore
from ..streaming import percentiles, sinks
from .queries import _bm25_sql
from .registry import query, t


def _vectors_sql(name: str, key: str, table: str, text: str = "text") -> str:
    return rf"""{name}_c AS (SELECT {key} AS id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {2 * DIM} AS c FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')) AS term FROM {table})),
{name}_s AS (SELECT id, c // 2 AS place, sum(2 * (c % 2) - 1) AS s FROM {name}_c GROUP BY 1, 2), {name} AS (SELECT id, place, s / sqrt(sum(s * s) OVER (PARTITION BY id)) AS v FROM {name}_s WHERE s <> 0)"""


def _nearest_sql(name: str, k: int, among: str = "true") -> str:
    return f"""{name}_d AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.v * d.v) AS score FROM qv q JOIN dv d USING (place) WHERE {among} GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {name}_d) WHERE rank <= {k})"""


def _asked(spark, sf_dir):
    return t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_vectors_sql('dv', 'doc_id', 'documents')} SELECT id AS doc_id, CAST(place AS INTEGER) AS place, round(v, 6) AS v FROM dv")
def embedded_documents(spark, sf_dir):
    """The vector of each text, by place; places of 0 are left out."""
    x = embedding.embedded(t(spark, sf_dir, "documents"), hashed)
    return x.select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("place", "v")).where("v <> 0").select("doc_id", "place", F.round("v", 6).alias("v"))


_TEXTS = f"{_vectors_sql('dv', 'doc_id', 'documents')}, {_vectors_sql('qv', 'item_id', 'benchmark')}"


@query(f"WITH {_TEXTS}, {_nearest_sql('h', 10)} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM h")
def embedded_search(spark, sf_dir):
    x = embedding.search(embedding.embedded(t(spark, sf_dir, "documents"), hashed), _asked(spark, sf_dir), hashed)
    return x.select("query_id", F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_TEXTS}, {_nearest_sql('a', 50)}, {_bm25_sql('okapi', 50, 'b')},
u AS (SELECT query_id, doc_id, rank, 0 AS route FROM a UNION ALL SELECT query_id, doc_id, rank, 1 FROM b), f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score, min(route * 1000 + rank) AS first FROM u GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS rank FROM f) WHERE rank <= 10""")
def hybrid_from_texts(spark, sf_dir):
    x = embedding.hybrid_texts(t(spark, sf_dir, "documents"), _asked(spark, sf_dir), hashed)
    return x.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


_ROUTES = "(SELECT item_id * 2 AS id, text FROM benchmark UNION ALL SELECT item_id * 2 + 1, split_part(text, '.', 1) FROM benchmark)"


@query(f"""WITH {_vectors_sql('dv', 'doc_id', 'documents')}, {_vectors_sql('qv', 'id', _ROUTES)}, ok AS (SELECT doc_id FROM documents WHERE lang <> 'de'), {_nearest_sql('h', 25, 'd.id IN (SELECT doc_id FROM ok)')},
r AS (SELECT query_id // 2 AS query_id, doc_id, arg_min(score, query_id % 2) AS score FROM h GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r) WHERE rank <= 10""")
def routed_search(spark, sf_dir):
    """Each benchmark text and its first sentence as two routes, encoded by a model that workers load, within documents of some languages."""
    model = encoder(HashingModel, "hashing")
    encode = lambda df: df.withColumn("embedding", model("text"))
    asked, docs = _asked(spark, sf_dir), t(spark, sf_dir, "documents")
    routes = asked.select("query_id", F.lit(0).alias("route"), "text").unionByName(asked.select("query_id", F.lit(1).alias("route"), F.substring_index("text", ".", 1).alias("text")))
    x = embedding.search_routes(embedding.embedded(docs, encode), routes, encode, 10, 50, docs.where("lang <> 'de'").select(F.col("doc_id").alias("vec_id")))
    return x.select("query_id", F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


#: What an update does: some texts change, some come, some go.
_UPDATED = "(SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN text || ' ' || source || ' ' || source ELSE text END AS text FROM documents WHERE doc_id % 11 <> 4)"


def _updated(docs):
    """(first, new, removed): documents before the update, those that it brings or changes, ids that it removes."""
    i = F.col("doc_id")
    first = docs.where(i % 5 != 0)
    text = F.when(i % 7 == 3, F.concat_ws(" ", "text", "source", "source")).otherwise(F.col("text"))
    new = docs.where(((i % 5 == 0) | (i % 7 == 3)) & (i % 11 != 4)).withColumn("text", text)
    return first, new, docs.where(i % 11 == 4).select("doc_id")


@query(f"WITH {_bm25_sql('okapi', 10, documents=_UPDATED)} SELECT query_id, doc_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM hits")
def bm25_updated(spark, sf_dir):
    """Search in a term table after an update, which read only what it brought and took away."""
    first, new, removed = _updated(t(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    store = TermStore(spark, f"{folder(spark)}/terms-{uuid.uuid4().hex}")
    store.update(first)
    store.update(new, removed)
    return store.search(_asked(spark, sf_dir)).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


def _store(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("tenant"), F.when(F.col("doc_id") % 2 == 0, "fixed").otherwise("recursive").alias("strategy"), "text", "source")
    first, new, _ = _updated(docs)
    store = Store(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}")
    store.publish(first, complete(first, "doc_id"))
    store.reindex(new, docs.where(F.col("doc_id") % 11 == 4).select("tenant", "strategy", "doc_id"))
    return store


_STORED = "doc_id, coalesce(lang, '') AS tenant, CASE WHEN doc_id % 2 = 0 THEN 'fixed' ELSE 'recursive' END AS strategy"


@query(f"SELECT {_STORED}, md5(CASE WHEN doc_id % 7 = 3 THEN text || ' ' || source || ' ' || source ELSE text END) AS digest FROM documents WHERE doc_id % 11 <> 4")
def reindexed_store(spark, sf_dir):
    return _store(spark, sf_dir).read().select("doc_id", "tenant", "strategy", F.md5("text").alias("digest"))


@query(f"SELECT {_STORED}, md5(text) AS digest FROM documents WHERE doc_id % 5 <> 0")
def rolled_back_store(spark, sf_dir):
    store = _store(spark, sf_dir)
    return store.read(store.rollback(1)).select("doc_id", "tenant", "strategy", F.md5("text").alias("digest"))


def _arriving(spark, sf_dir, columns, take):
    """The events in four parts by time, each written to a folder and taken by a stream of it before the next comes: take(stream, path for its own use)."""
    at = f"{folder(spark)}/events-{uuid.uuid4().hex}"
    events = t(spark, sf_dir, "events").select(*columns)
    least, most = events.agg(F.min("event_id"), F.max("event_id")).first()
    part = F.floor((F.col("event_id") - least) * 4 / (most - least + 1))
    for k in range(4):
        events.where(part == k).write.mode("append").parquet(f"{at}/in")
        take(spark.readStream.schema(events.schema).parquet(f"{at}/in"), at)
    return at


@query("""WITH e AS (SELECT *, list(value) FILTER (value IS NOT NULL) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS v FROM events)
SELECT event_id, event_type, CAST(len(v) AS BIGINT) AS samples, s[CAST(floor(0.5 * (len(v) - 1)) AS INTEGER) + 1] AS p50, s[CAST(floor(0.95 * (len(v) - 1)) AS INTEGER) + 1] AS p95, s[CAST(floor(0.99 * (len(v) - 1)) AS INTEGER) + 1] AS p99 FROM (SELECT *, list_sort(v) AS s FROM e)""")
def streamed_percentiles(spark, sf_dir):
    """Percentiles of the last thousand samples of each kind at each event, by a stream that stops and goes on three times."""
    key, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(key, percentiles.STATE_STORE)
    try:
        run = lambda s, at: sinks.replayed(percentiles.percentiles(s, "event_type", "value", ["ts", "event_id"]), f"{at}/out", f"{at}/progress")
        at = _arriving(spark, sf_dir, ["event_id", "ts", "event_type", "value"], run)
    finally:
        spark.conf.set(key, was) if was else spark.conf.unset(key)
    return spark.read.parquet(f"{at}/out").select("event_id", "event_type", "samples", "p50", "p95", "p99")


@query("""SELECT event_id, 'default' AS tenant_id, CAST(user_id AS VARCHAR) AS actor_user_id, event_type AS action, left(repeat(props, 40), 256) AS resource, 'success' AS result, '' AS ip, left(repeat(props, 200), 1024) AS detail
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS n FROM events) WHERE n = 1""")
def streamed_audit(spark, sf_dir):
    """Audit rows from a stream that stops and goes on, each kind of request once."""
    rows = lambda s: sinks.audit_rows(s.withColumns({"tenant_id": F.lit(None).cast("string"), "actor_user_id": F.col("user_id").cast("string"), "action": F.col("event_type"), "resource": F.repeat("props", 40), "result": F.lit(""), "ip": F.lit(None).cast("string"), "detail": F.repeat("props", 200)}))
    keys = ["actor_user_id", "action", "detail"]
    names = ["tenant_id", "actor_user_id", "action", "resource", "result", "ip", "detail"]
    sink = lambda s, at: sinks.insert_ignore(s, f"{at}/out", keys, ["event_id"], f"{at}/progress", made=rows, columns=["event_id", *names])
    at = _arriving(spark, sf_dir, ["event_id", "user_id", "event_type", "props"], sink)
    return sinks.table(spark, f"{at}/out", T.StructType([T.StructField("event_id", T.LongType()), *[T.StructField(n, T.StringType()) for n in names]]))
