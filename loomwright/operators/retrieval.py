"""Sparse and dense search over many queries at once, and fusion of their hits."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import terms
from . import catalog, files
from .tables import broadcast_if_small, folder, handed, spread, written
from .terms import Among, best, counted, idf, postings, query_terms, scored


def top(scored: DataFrame, k: int, key: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best rows of each query with a rank from 1; ties, to nine places, by key."""
    order = W.partitionBy("query_id").orderBy(F.round(score, 9).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


COUNTS = "doc_id long, dl int, counts array<struct<term:string,tf:int>>"


def term_table(docs: DataFrame, version: str | None = None) -> DataFrame:
    """(doc_id, dl, term, tf), written once: the terms of each text and its length in terms. A text without terms has one row, with a null term; a null text has none."""
    return postings(count_table(docs, version))


def count_table(docs: DataFrame, version: str | None = None) -> DataFrame:
    """(doc_id, dl, counts) of `terms.counted`, written once: a row for each text, with its terms and how often each stands there.

    With a version, such as `files.version` gives of the index, the table is kept under it in the shared folder, and found
    there by later searches of that version, whoever wrote it. A half-written one is never found: it is moved there whole.
    """
    if version is None:
        return written(counted(docs), "terms")
    spark = docs.sparkSession
    at = f"{folder(spark)}/counts-of-{version}"
    if not files.exists(spark, f"{at}/_SUCCESS"):
        own = f"{at}-{uuid.uuid4().hex}"
        counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).write.option("compression", "zstd").parquet(own)
        if not files.move(spark, own, at):
            files.remove(spark, own)
    return spark.read.schema(COUNTS).parquet(at)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, variant: str = "okapi", among: Among = None, table: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): Okapi (idf floored at a quarter of the mean) or Lucene weighting.

    Weights come from the count table of all documents, which several searches may share. Scores are summed within a
    document's row, and each task keeps k documents of each query, unless the queries' terms are too many to send to all tasks: then only
    terms of queries are joined and shuffled, so that a common term is no hot key.
    `among` restricts hits, not the statistics: doc_ids for all queries, (query_id, doc_id) for each, or a function that
    keeps the rows of (query_id, doc_id, score) that may be seen, before the cut. Repeated query
    terms count each; hits at or under 0 go after the cut. `terms.TermStore` keeps the table between searches.
    """
    table = count_table(docs) if table is None else table
    n = docs.count()
    told, total = table.agg(F.count(F.lit(1)), F.sum("dl")).first()
    known = postings(table).where("term is not null")
    every = written(known.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    mean = (every.agg(F.avg(idf(F.col("df"), n, variant))).first()[0] or 0.0) if variant == "okapi" else 0.0
    q = written(query_terms(queries), "query-terms")
    some = broadcast_if_small(q.select("term").distinct())
    df, avgdl = every.join(some, "term", "left_semi"), float(total) / told if total else 1.0
    if among is None or isinstance(among, DataFrame) and "query_id" not in among.columns:
        whole = table if among is None else table.join(among.select("doc_id").distinct(), "doc_id", "left_semi")
        if (found := best(whole, q, df, n, avgdl, float(mean), variant, k)) is not None:
            return top(found, k)
    return top(scored(q, known.join(some, "term", "left_semi"), df, n, avgdl, float(mean), variant, among), k).where("score > 0")


_SCORED = "query_id long, vec_id long, score double"


def _met(blocks: DataFrame, score: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], k: int) -> DataFrame:
    """The k hits of each query from blocks of queries and vectors, written once: workers are handed a block or a few at a time."""
    with handed(blocks.sparkSession):
        return written(top(blocks.select("qs", "vs").mapInArrow(score, _SCORED), k, "vec_id"), "hits")


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix, without an object for each."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _block_tops(k: int):
    """Rows of queries `qs` and vectors `vs` to the k best vectors of each query of the row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(x.num_rows):
                qs, vs = x["qs"][i].values, x["vs"][i].values
                s = _matrix(qs.field("q")) @ _matrix(vs.field("v")).T
                ids = vs.field("vec_id").to_numpy()
                out = [np.lexsort((ids, -r))[:k] for r in s]
                m = [len(o) for o in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qs.field("query_id").to_numpy(), m)), pa.array(ids[np.concatenate(out)]), pa.array(np.concatenate([r[o] for r, o in zip(s, out, strict=True)]))], names=["query_id", "vec_id", "score"])

    return score


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, among: DataFrame | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): exact inner products of a stated query set against all rows of the same length, in blocks.

    About 256 queries and 4096 vectors meet at a time; each such block keeps k vectors of each query, so few rows leave a task.
    """
    base = vectors if among is None else vectors.join(among.select("vec_id").distinct(), "vec_id", "left_semi")
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")).where("q is not null")
    n = q.count()
    numbered = q.select("*", F.size("q").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(max(1, n // 256))).cast("int").alias("block"))
    packed = numbered.groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))
    rows = base.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
    part = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rows.count() // 4096))).cast("int")
    parts = rows.groupBy(F.size("v").alias("dim"), part.alias("part")).agg(F.collect_list(F.struct("vec_id", "v")).alias("vs"))  # about 4096 vectors each
    met = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(1, n // 256) - 1)))).join(broadcast_if_small(written(packed, "queries")), ["dim", "block"])
    return _met(met, _block_tops(k), k)


def _seen_tops(k: int):
    """Rows of queries `qs` and vectors `vs` of one tenant to the k best vectors that each query's user may see."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(x.num_rows):
                qs, vs = x["qs"][i].values, x["vs"][i].values
                ids, user = vs.field("vec_id").to_numpy(), qs.field("user_id").to_numpy(zero_copy_only=False)
                owner = vs.field("owner").to_numpy(zero_copy_only=False)
                ok = (user[:, None] == owner) | vs.field("owner").is_null().to_numpy(zero_copy_only=False) | qs.field("superadmin").to_numpy(zero_copy_only=False)[:, None]
                for asked, granted in (("roles", "to_roles"), ("own", "to_users")):
                    have = vs.field(granted).to_pylist()
                    for j, some in enumerate(qs.field(asked).to_pylist()):
                        wanted = set(some or ())
                        if wanted:
                            ok[j] |= np.fromiter((bool(g) and not wanted.isdisjoint(g) for g in have), bool, len(have))
                for j, scope in enumerate(qs.field("scope").to_pylist()):
                    if scope is not None:
                        ok[j] &= np.isin(ids, scope)
                s = _matrix(qs.field("q")) @ _matrix(vs.field("v")).T
                out = []
                for row, seen in zip(s, ok, strict=True):
                    at = np.flatnonzero(seen)
                    out.append(at[np.lexsort((ids[at], -row[at]))[:k]])
                m = [len(o) for o in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qs.field("query_id").to_numpy(), m)), pa.array(ids[np.concatenate(out).astype(np.int64)]), pa.array(np.concatenate([r[o] for r, o in zip(s, out, strict=True)]))], names=["query_id", "vec_id", "score"])

    return score


def dense_seen(vectors: DataFrame, queries: DataFrame, requests: DataFrame, docs: DataFrame, users: DataFrame, grants: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, score, rank): exact inner products of each query(query_id, embedding) with the vectors that its request's user may see.

    requests, docs, users and grants are those of `catalog.seen`; vec_ids are doc_ids. Rights travel with the vectors and
    are tested where blocks of a tenant's vectors meet blocks of its queries: no table of what who may see is made, and a
    tenant of most vectors fills many blocks. Of a document's grants to users only those to users who ask are carried.
    """
    asked = requests.select("query_id", "tenant", "user_id", "scope").join(catalog.who(requests, users), ["tenant", "user_id"])
    q = asked.join(queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")), "query_id").where("q is not null")
    n = q.count()
    blocks = max(1, n // 256)
    q = q.select("tenant", F.size("q").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.struct("query_id", "user_id", "superadmin", "roles", F.array("user_id").alias("own"), "scope", "q").alias("s"))
    packed = q.groupBy("tenant", "dim", "block").agg(F.collect_list("s").alias("qs"))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
    rows = rows.join(catalog.granted(docs, grants, requests).withColumnRenamed("doc_id", "vec_id"), "vec_id")
    part = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, vectors.count() // 4096))).cast("int")
    parts = rows.groupBy("tenant", F.size("v").alias("dim"), part.alias("part")).agg(F.collect_list(F.struct("vec_id", "owner", "to_roles", "to_users", "v")).alias("vs"))
    met = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(broadcast_if_small(written(packed, "queries")), ["tenant", "dim", "block"])
    return _met(met, _seen_tops(k), k)


#: Vectors that the lists' centres are fitted on, those of the lowest hashes; every vector is listed.
FITTED = 50_000


def _nearest(rows: DataFrame, key: str, value: str, centres: np.ndarray, n: int) -> DataFrame:
    """(key, value, list): each row once for each of the n centres nearest to it."""
    half = (centres**2).sum(1) / 2

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                far = half - _matrix(x[value]) @ centres.T
                near = np.argsort(far, axis=1, kind="stable")[:, :n]
                take = pa.array(np.repeat(np.arange(x.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([x[key].take(take), x[value].take(take), pa.array(near.ravel().astype(np.int32))], names=[key, value, "list"])

    return rows.mapInArrow(assign, f"{key} long, {value} array<double>, list int")


def inverted_lists(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int = 64, probes: int = 32) -> DataFrame:
    """(query_id, vec_id, score, rank): the k greatest inner products among the `probes` lists nearest to each query.

    k-means centres are fitted on at most FITTED vectors; with fewer vectors than lists there are as many lists as
    vectors. A list of any size is met in parts of about 4096 vectors, by blocks of about 256 queries. Approximate: a
    test holds the recall against `dense`.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FITTED).select(array_to_vector("v").alias("features"))
    model = KMeans(k=max(2, min(lists, some.count())), seed=42, maxIter=10).fit(some)
    centres = np.array(model.clusterCenters())
    listed = _nearest(rows, "vec_id", "v", centres, 1)
    sizes = listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / 4096).alias("parts"))  # a row a list
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    packed = listed.join(broadcast_if_small(sizes), "list").groupBy("list", part.alias("part")).agg(F.collect_list(F.struct("vec_id", "v")).alias("vs"))
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")).where("q is not null")
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, q.count() // 256)))
    asked = _nearest(q, "query_id", "q", centres, probes).groupBy("list", block.alias("block")).agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))
    return _met(packed.join(asked, "list"), _block_tops(k), k)


def hybrid(vectors: DataFrame, query_vectors: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): dense and sparse hits of a wider pool, fused; vec_id and doc_id name the same documents."""
    pool = max(5 * k, 20)
    return rrf([dense(vectors, query_vectors, pool).withColumnRenamed("vec_id", "doc_id"), bm25(docs, queries, pool)], k)


def rrf(routes: list[DataFrame], k: int = 10, c: int = 60, key: str = "doc_id") -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (c + rank) over routes; ties by the first route and rank that had it."""
    every = None
    for i, r in enumerate(routes):
        one = r.select("query_id", key, "rank", F.lit(i).alias("route"))
        every = one if every is None else every.unionByName(one)
    fused = every.groupBy("query_id", key).agg(F.sum(1.0 / (c + F.col("rank"))).alias("score"), F.min(F.struct("route", "rank")).alias("first"))
    order = W.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.col("first.route"), F.col("first.rank"))
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("first")


def first_of_routes(routes: list[DataFrame], k: int = 10, key: str = "doc_id") -> DataFrame:
    """(query_id, key, score, rank): hits of several routes, each key once as the first route has it, ranked by raw score."""
    every = None
    for i, r in enumerate(routes):
        one = r.select("query_id", key, "score", "rank", F.lit(i).alias("route"))
        every = one if every is None else every.unionByName(one)
    once = every.groupBy("query_id", key).agg(F.min_by("score", F.struct("route", "rank")).alias("score"))
    return top(once, k, key)


def reranked(hits: DataFrame, score: Column, k: int = 10, key: str = "doc_id") -> DataFrame:
    """The k hits of each query with the greatest `score`, a column over their texts; a model may stand behind it as a Pandas UDF."""
    return top(hits.drop("rank").withColumn("rerank_score", score), k, key, "rerank_score")


def term_statistics(docs: DataFrame) -> DataFrame:
    """(term, df, tf): documents that have a term, and times it stands in them."""
    tf = spread(docs.select("doc_id", "text")).select("doc_id", F.explode_outer(terms(F.col("text"))).alias("term")).where("term is not null").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
