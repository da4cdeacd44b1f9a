"""Queries of grants, versions, stores, audit and cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import cache_key
from ..operators import catalog, chunking, evaluation
from .registry import query, t

_ACL = """u AS (SELECT c_custkey AS user_id, c_nationkey AS role FROM customer), d AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS owner FROM orders),
g AS (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey AS principal_id, CASE WHEN l_linenumber % 2 = 0 THEN 'user' ELSE 'role' END AS principal_type, CASE WHEN l_linenumber % 3 = 0 THEN 'write' ELSE 'read' END AS permission FROM lineitem)"""


def _acl(spark, sf_dir):
    users = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("role"))
    docs = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("owner"))
    kind = F.when(F.col("l_linenumber") % 2 == 0, "user").otherwise("role").alias("principal_type")
    right = F.when(F.col("l_linenumber") % 3 == 0, "write").otherwise("read").alias("permission")
    return users, docs, t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("principal_id"), kind, right).distinct()


@query(f"""WITH {_ACL}, a AS (SELECT DISTINCT l_suppkey AS user_id, l_orderkey + l_linenumber % 2 AS doc_id, CASE WHEN l_linenumber % 2 = 0 THEN 'read' ELSE 'write' END AS permission FROM lineitem)
SELECT a.*, CASE WHEN d.doc_id IS NULL THEN false WHEN owner = a.user_id THEN true WHEN owner IS NULL THEN permission = 'read' ELSE
EXISTS (SELECT 1 FROM g WHERE g.doc_id = a.doc_id AND g.permission = a.permission AND principal_type = 'user' AND principal_id = a.user_id) OR
EXISTS (SELECT 1 FROM g JOIN u ON principal_id = role WHERE g.doc_id = a.doc_id AND g.permission = a.permission AND principal_type = 'role' AND u.user_id = a.user_id) END AS allowed FROM a LEFT JOIN d ON d.doc_id = a.doc_id""")
def permission_checks(spark, sf_dir):
    users, docs, grants = _acl(spark, sf_dir)
    asked = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("user_id"), (F.col("l_orderkey") + F.col("l_linenumber") % 2).alias("doc_id"), F.when(F.col("l_linenumber") % 2 == 0, "read").otherwise("write").alias("permission"))
    return catalog.may(asked, docs, users, grants)


@query(f"WITH {_ACL} SELECT g.* FROM g JOIN d USING (doc_id) WHERE NOT (principal_type = 'role' AND permission = 'write' AND principal_id % 2 = 0)")
def revoked_grants(spark, sf_dir):
    _, docs, grants = _acl(spark, sf_dir)
    revoked = grants.where("principal_type = 'role' and permission = 'write' and principal_id % 2 = 0")
    return catalog.without(grants.join(docs.select("doc_id"), "doc_id", "left_semi"), revoked, ["doc_id", "principal_id", "principal_type", "permission"]).select("doc_id", "principal_id", "principal_type", "permission")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascaded_delete(spark, sf_dir):
    gone = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return catalog.without(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), gone, ["l_orderkey"])


@query("""WITH a AS (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1), x AS (SELECT l_orderkey, l_orderkey % 4 AS target FROM a WHERE l_orderkey % 4 >= 1 AND l_orderkey % 4 < m AND EXISTS (SELECT 1 FROM lineitem i WHERE i.l_orderkey = a.l_orderkey AND i.l_linenumber = a.l_orderkey % 4))
SELECT l_orderkey, l_linenumber FROM lineitem LEFT JOIN x USING (l_orderkey) WHERE target IS NULL OR l_linenumber <= target""")
def rolled_back_versions(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    targets = x.select("l_orderkey", (F.col("l_orderkey") % 4).cast("int").alias("target")).distinct()
    return catalog.rolled_back(x, targets, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS active FROM lineitem")
def version_list(spark, sf_dir):
    return catalog.listed_versions(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("""WITH a AS (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, coalesce(m + 1, 1) AS bumped, coalesce(m, 1) AS kept FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""")
def resolved_versions(spark, sf_dir):
    ledger = t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    x = catalog.resolved(t(spark, sf_dir, "orders").select("o_orderkey"), ledger, "o_orderkey", "l_linenumber", True)
    return catalog.resolved(x.withColumnRenamed("version", "bumped"), ledger, "o_orderkey", "l_linenumber", False).select("o_orderkey", "bumped", F.col("version").alias("kept"))


@query("SELECT doc_id || '_v' || (doc_id % 3 + 1) || '_chunk_0' AS chunk_id, CAST('0x' || substr(sha256(doc_id || '_v' || (doc_id % 3 + 1) || '_chunk_0'), 1, 15) AS BIGINT) AS vector_id FROM documents")
def versioned_chunks(spark, sf_dir):
    x = t(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3 + 1).alias("version"), F.lit(0).alias("chunk_index"))
    return chunking.named(x).select("chunk_id", "vector_id")


@query("SELECT event_type, CAST(sum(n) AS BIGINT) AS version FROM (SELECT event_type, 10 AS n FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'click') UNION ALL SELECT event_type, count(*) FROM events GROUP BY 1) GROUP BY 1")
def index_versions(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return catalog.counted(e.where("event_type <> 'click'").select("event_type").distinct().withColumn("version", F.lit(10)), e, ["event_type"])


@query("""SELECT 'labels' AS store, count(*) AS missing, count(*) = 0 AS complete FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'embeddings', count(*), count(*) = 0 FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def missing_ids(spark, sf_dir):
    stores = {"labels": t(spark, sf_dir, "labels"), "embeddings": t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))}
    return catalog.missing(t(spark, sf_dir, "documents"), stores, "doc_id")


@query("SELECT c_custkey AS user_id, 1 + CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END AS token_version FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def bumped_tokens(spark, sf_dir):
    role = t(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(1).alias("held"))
    x = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(role), "c_nationkey", "left")  # at most 25 rows at any scale
    return x.select(F.col("c_custkey").alias("user_id"), (1 + F.coalesce("held", F.lit(0))).alias("token_version"))


@query("""SELECT user_id, event_type AS action, count(*) AS n, max(left(props, 1024)) AS detail FROM events WHERE event_type IN ('error', 'signup') AND value > 10 GROUP BY 1, 2""")
def audit_counts(spark, sf_dir):
    x = t(spark, sf_dir, "events").where("event_type in ('error', 'signup') and value > 10")
    return x.groupBy("user_id", F.col("event_type").alias("action")).agg(F.count(F.lit(1)).alias("n"), F.max(F.left("props", F.lit(1024))).alias("detail"))


@query("""SELECT event_id, sha256(concat_ws('|', 'v2', 'default', 'u' || user_id, CASE WHEN event_id % 2 = 0 THEN 'chat,doc' ELSE 'none' END, CASE event_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'none' ELSE sha256('a,b') END,
'fixed', event_type, CASE WHEN value > 50 THEN 'True' ELSE 'False' END, 'missing', props)) AS cache_key FROM events""")
def cache_keys(spark, sf_dir):
    id_, strings = F.col("event_id"), "array<string>"
    may = F.when(id_ % 2 == 0, F.array(F.lit("doc"), F.lit("chat"), F.lit("doc"))).otherwise(F.array().cast(strings))
    docs = F.when(id_ % 3 == 1, F.array().cast(strings)).when(id_ % 3 == 2, F.array(F.lit("b"), F.lit("a")))
    key = cache_key(F.lit(""), F.concat(F.lit("u"), F.col("user_id").cast("string")), may, docs, F.lit("fixed"), F.col("event_type"), F.col("value") > 50, F.lit(None).cast("string"), F.concat(F.lit(" "), F.col("props"), F.lit("\n")))
    return t(spark, sf_dir, "events").select("event_id", key.alias("cache_key"))


@query("""SELECT event_type, user_id, last FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY last DESC, user_id) AS n FROM (SELECT event_type, user_id, max(ts) AS last FROM events GROUP BY 1, 2)) WHERE n <= 50""")
def cache_survivors(spark, sf_dir):
    return catalog.survivors(t(spark, sf_dir, "events"), "event_type", "user_id", "ts", 50)


@query("SELECT source, count(*) AS n, bit_xor(CAST('0x' || substr(sha256(concat_ws('|', doc_id, text)), 1, 15) AS BIGINT)) AS digest, CAST(sum(CAST('0x' || substr(sha256(concat_ws('|', doc_id, text)), 1, 15) AS BIGINT)) AS VARCHAR) AS total FROM documents GROUP BY 1")
def corpus_digests(spark, sf_dir):
    return catalog.fingerprint(t(spark, sf_dir, "documents"), "source", ["doc_id", "text"])


@query("""WITH b AS (SELECT lang AS metric, avg(length(text)) AS was FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), c AS (SELECT lang AS metric, avg(length(text)) AS now FROM documents WHERE doc_id % 2 = 1 AND lang <> 'es' GROUP BY 1),
n AS (SELECT count(*) FILTER (now IS NOT NULL AND round(now - was, 4) < -50) AS failed, count(*) FILTER (now IS NULL) AS gone FROM b LEFT JOIN c USING (metric)) SELECT failed, gone, failed = 0 AND gone = 0 AS passed FROM n""")
def release_gate(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    half = lambda k: d.where(F.col("doc_id") % 2 == k).groupBy(F.col("lang").alias("metric")).agg(F.avg(F.length("text")).alias("value"))
    b, c = half(0), half(1).where("metric <> 'es'")
    return evaluation.gate(evaluation.regression(b, c, b.select("metric", F.lit(50.0).alias("limit"))), b, c)
