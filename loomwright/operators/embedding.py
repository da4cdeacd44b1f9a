"""Search that starts from texts: queries of all routes are encoded at once, each text once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import bm25, dense, first_of_routes, rrf
from .tables import broadcast_if_small, handed, spread, written

#: What adds `embedding` to a frame that has `text`.
Encode = Callable[[DataFrame], DataFrame]


def embedded(docs: DataFrame, encode: Encode, key: str = "doc_id") -> DataFrame:
    """(vec_id, embedding) of every row of docs(key, text), written once; texts without a vector have null."""
    with handed(docs.sparkSession):
        return written(encode(spread(docs.select(F.col(key).alias("vec_id"), "text"))).select("vec_id", "embedding"), "embedded")


def embedded_routes(queries: DataFrame, encode: Encode) -> tuple[DataFrame, DataFrame]:
    """(query_id, embedding) of the different texts of queries(.., text), and queries with the query_id of their text as `text_id`.

    Routes of one query, and queries of many users, share texts: each is encoded once.
    """
    texts = written(queries.select("text").where("text is not null").distinct().withColumn("text_id", F.monotonically_increasing_id()), "texts")
    with handed(queries.sparkSession):
        vectors = written(encode(texts).select(F.col("text_id").alias("query_id"), "embedding"), "asked")
    return vectors.where("embedding is not null"), queries.join(broadcast_if_small(texts), "text")


def search(vectors: DataFrame, queries: DataFrame, encode: Encode, k: int = 10, among: DataFrame | None = None) -> DataFrame:
    """(query_id[, route], vec_id, score, rank): the k vectors nearest to each text of queries(query_id[, route], text), by inner product.

    `among` are the vec_ids that may be hit, looked at before the k are chosen. Texts without a vector have no hits.
    """
    keys = [c for c in ("query_id", "route") if c in queries.columns]
    asked, named = embedded_routes(queries.select(*keys, "text"), encode)
    hits = dense(vectors, asked, k, among).withColumnRenamed("query_id", "text_id")
    return named.join(hits, "text_id").select(*keys, "vec_id", "score", "rank")


def search_routes(vectors: DataFrame, queries: DataFrame, encode: Encode, k: int = 10, pool: int = 50, among: DataFrame | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the routes of each query searched together, max(pool / routes, 1) hits each, and merged: each vector once, as the first route has it."""
    routes = [r.route for r in queries.select("route").distinct().orderBy("route").collect()]  # a handful: the ways a query is put
    hits = written(search(vectors, queries, encode, max(pool // max(1, len(routes)), 1), among), "routes")
    return first_of_routes([hits.where(F.col("route") == r) for r in routes], k, "vec_id")


def hybrid_texts(docs: DataFrame, queries: DataFrame, encode: Encode, k: int = 10, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): dense and sparse hits of docs(doc_id, text) for queries(query_id, text), fused; both from texts alone."""
    pool = max(5 * k, 20)
    vectors = embedded(docs, encode) if vectors is None else vectors
    return rrf([search(vectors, queries, encode, pool).withColumnRenamed("vec_id", "doc_id"), bm25(docs, queries, pool)], k)
