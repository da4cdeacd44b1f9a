"""Queries of what users may see, of searches within it, of ledgers and caches, and of prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import json_object, real_claim
from ..operators import catalog, chunking, context, evaluation, retrieval
from .queries import _bm25_sql
from .registry import SQL, query, t

_GRANTED = """u AS (SELECT c_custkey AS user_id, c_custkey % 3 AS tenant, c_nationkey AS role, c_custkey % 50 = 0 AS superadmin FROM customer),
d AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 AS tenant, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS owner FROM orders),
g AS (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey AS principal_id, CASE WHEN l_linenumber % 2 = 0 THEN 'user' ELSE 'role' END AS principal_type, CASE WHEN l_linenumber % 3 = 0 THEN 'write' ELSE 'read' END AS permission FROM lineitem)"""


@query(f"""WITH {_GRANTED} SELECT DISTINCT u.tenant, u.user_id, d.doc_id FROM d JOIN u ON d.tenant = u.tenant AND NOT superadmin AND owner = user_id
UNION SELECT u.tenant, u.user_id, d.doc_id FROM g JOIN d USING (doc_id) JOIN u ON d.tenant = u.tenant AND NOT superadmin AND permission = 'read' AND (principal_type = 'user' AND principal_id = user_id OR principal_type = 'role' AND principal_id = role)
UNION SELECT tenant, NULL, doc_id FROM d WHERE owner IS NULL UNION SELECT tenant, user_id, NULL FROM u WHERE superadmin""")
def readable_documents(spark, sf_dir):
    users = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 3).alias("tenant"), F.col("c_nationkey").cast("long").alias("role"), (F.col("c_custkey") % 50 == 0).alias("superadmin"))
    docs = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 3).alias("tenant"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("owner"))
    kind = F.when(F.col("l_linenumber") % 2 == 0, "user").otherwise("role").alias("principal_type")
    right = F.when(F.col("l_linenumber") % 3 == 0, "write").otherwise("read").alias("permission")
    grants = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("principal_id"), kind, right)
    return catalog.readable(docs, users, grants)


_SEEN = """d AS (SELECT doc_id, doc_id % 2 AS tenant, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 20 END AS owner, lang, text FROM documents), g AS (SELECT doc_id, quality * 3 AS principal_id FROM labels WHERE toxic = 0),
q AS (SELECT item_id AS query_id, item_id % 2 AS tenant, item_id % 20 AS user_id, item_id % 20 = 19 AS superadmin, item_id % 4 AS role, item_id % 3 AS scoped FROM benchmark),
eff AS (SELECT DISTINCT query_id, d.doc_id FROM q JOIN d ON d.tenant = q.tenant WHERE (superadmin OR owner IS NULL OR owner = user_id OR EXISTS (SELECT 1 FROM g WHERE g.doc_id = d.doc_id AND g.principal_id = q.role)) AND (scoped = 0 OR scoped = 1 AND d.doc_id % 2 = d.tenant AND d.doc_id < 500))"""


def _rights(spark, sf_dir):
    """(requests, docs, users, grants): searches by benchmark texts, for 20 users of two tenants; one in three is in no scope, one in documents under 500, one in none."""
    id_ = F.col("doc_id")
    docs = t(spark, sf_dir, "documents").select("doc_id", (id_ % 2).alias("tenant"), F.when(id_ % 7 != 0, id_ % 20).alias("owner"))
    item = F.col("item_id")
    asks = t(spark, sf_dir, "benchmark").select(item.alias("query_id"), (item % 2).alias("tenant"), (item % 20).alias("user_id"), (item % 20 == 19).alias("superadmin"), (item % 4).alias("role"), (item % 3).alias("scoped"))
    users = asks.select("user_id", "tenant", "role", "superadmin").distinct()
    grants = t(spark, sf_dir, "labels").where("toxic = 0").select("doc_id", F.lit("role").alias("principal_type"), (F.col("quality") * 3).cast("long").alias("principal_id"), F.lit("read").alias("permission"))
    some = F.when(F.col("scoped") == 1, F.sequence(F.lit(0).cast("long"), F.lit(499).cast("long"))).when(F.col("scoped") == 2, F.array().cast("array<bigint>"))
    return asks.withColumn("scope", some), docs, users, grants


@query(f"WITH {_SEEN} SELECT query_id, doc_id FROM eff")
def visible_documents(spark, sf_dir):
    asks, docs, users, grants = _rights(spark, sf_dir)
    return catalog.visible(asks, catalog.readable(docs, users, grants), docs)


@query(f"WITH {_SEEN}, {_bm25_sql('okapi', 10, 'hits', '(query_id, hits_tf.doc_id) IN (SELECT (query_id, doc_id) FROM eff)')} SELECT query_id, doc_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM hits")
def bm25_visible(spark, sf_dir):
    q = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    x = retrieval.bm25(t(spark, sf_dir, "documents"), q, among=catalog.seen(*_rights(spark, sf_dir)))
    return x.select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query(f"""WITH {_SEEN}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT query_id, v.vec_id, list_inner_product(x.e, v.e) AS score FROM eff JOIN v ON v.vec_id = doc_id JOIN v x ON x.vec_id = query_id)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def dense_visible(spark, sf_dir):
    v = t(spark, sf_dir, "embeddings")
    queries = v.select(F.col("vec_id").alias("query_id"), "embedding")
    x = retrieval.dense_seen(v, queries, *_rights(spark, sf_dir))
    return x.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("""WITH u AS (SELECT c_custkey AS user_id, c_nationkey AS role, c_custkey % 50 = 0 AS superadmin FROM customer), d AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS owner FROM orders),
g AS (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey AS principal_id, CASE WHEN l_linenumber % 2 = 0 THEN 'user' ELSE 'role' END AS principal_type FROM lineitem WHERE l_linenumber % 3 = 0),
a AS (SELECT DISTINCT l_suppkey AS user_id, l_orderkey + l_linenumber % 2 AS doc_id FROM lineitem UNION SELECT o_custkey, o_orderkey FROM orders)
SELECT a.*, s.user_id IS NOT NULL OR coalesce(owner = a.user_id, false) OR owner IS NOT NULL AND (EXISTS (SELECT 1 FROM g WHERE g.doc_id = a.doc_id AND principal_type = 'user' AND principal_id = a.user_id) OR EXISTS (SELECT 1 FROM g JOIN u ON principal_id = role WHERE g.doc_id = a.doc_id AND principal_type = 'role' AND u.user_id = a.user_id)) AS may_delete,
s.user_id IS NOT NULL OR coalesce(owner = a.user_id, false) AS may_manage FROM a LEFT JOIN d ON d.doc_id = a.doc_id LEFT JOIN (SELECT user_id FROM u WHERE superadmin) s ON s.user_id = a.user_id""")
def manageable_documents(spark, sf_dir):
    users = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("role"), (F.col("c_custkey") % 50 == 0).alias("superadmin"))
    docs = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("owner"))
    lines = t(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "user").otherwise("role").alias("principal_type")
    right = F.when(F.col("l_linenumber") % 3 == 0, "delete").otherwise("read").alias("permission")
    grants = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("principal_id"), kind, right)
    asked = lines.select(F.col("l_suppkey").alias("user_id"), (F.col("l_orderkey") + F.col("l_linenumber") % 2).alias("doc_id"))
    own = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("doc_id"))
    return catalog.manageable(asked.unionByName(own), docs, users, grants)


@query("SELECT event_id, coalesce(CASE WHEN event_id % 4 > 0 THEN event_id % 3 END <> c_nationkey % 3 OR event_id % 4 = 0 OR c_custkey IS NULL, true) AS stale FROM events LEFT JOIN customer ON c_custkey = user_id")
def stale_tokens(spark, sf_dir):
    users = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") % 3).alias("token_version"))
    tokens = t(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 3).alias("uv"))
    return catalog.stale_tokens(tokens, users).select("event_id", "stale")


@query("""SELECT doc_id, 'add' AS action FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION SELECT doc_id, 'drop' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def store_repairs(spark, sf_dir):
    return catalog.repairs(t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels"), "doc_id")


@query(f"SELECT doc_id, count(DISTINCT vector_id) AS chunk_count FROM ({SQL['fixed_chunks']}) GROUP BY 1")
def recorded_versions(spark, sf_dir):
    return catalog.recorded(chunking.fixed_chunks(t(spark, sf_dir, "documents")), ["doc_id"])


@query(f"""WITH k AS ({SQL['fixed_chunks']}), n AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (vector_id % 10 <> 0) AS n_vectors FROM k GROUP BY 1)
SELECT doc_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_vectors, 0) AS n_vectors, CASE WHEN n_chunks IS NULL THEN 'missing' WHEN n_vectors < n_chunks THEN 'partial' ELSE 'ready' END AS status FROM documents LEFT JOIN n USING (doc_id)""")
def index_status(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    chunks = chunking.fixed_chunks(d).select("doc_id", "vector_id")
    return catalog.index_status(d, chunks, chunks.where("vector_id % 10 <> 0").select("vector_id"), "doc_id", "vector_id")


@query("""WITH c AS (SELECT vec_id AS id, sha256(CAST(vec_id AS VARCHAR)) AS hash, CASE WHEN vec_id % 3 = 0 THEN 'other' ELSE 'small' END AS model, vec_id % 5 > 0 AS normalise, embedding FROM embeddings)
SELECT d.doc_id AS id, c.id IS NOT NULL AS cached FROM documents d LEFT JOIN c ON c.id = doc_id AND hash = sha256(CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE CAST(doc_id AS VARCHAR) END) AND model = 'small' AND normalise AND len(embedding) = 64""")
def cached_embeddings(spark, sf_dir):
    sha = lambda c: F.sha2(c.cast("string").cast("binary"), 256)
    cache = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sha(F.col("vec_id")).alias("hash"), F.when(F.col("vec_id") % 3 == 0, "other").otherwise("small").alias("model"), (F.col("vec_id") % 5 > 0).alias("normalise"), "embedding")
    corpus = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, sha(F.lit("new"))).otherwise(sha(F.col("doc_id"))).alias("hash"))
    return catalog.reusable(corpus, cache, "small", True, 64).select("id", F.col("embedding").isNotNull().alias("cached"))


@query("""SELECT vec_id, CASE WHEN e IS NULL THEN 'missing' WHEN len(e) <> 64 THEN 'dimension' WHEN len(list_filter(e, lambda x: x IS NULL OR isnan(x))) > 0 THEN 'not a number' END AS error
FROM (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN embedding[1:32] WHEN vec_id % 5 = 0 THEN list_append(embedding[1:63], CAST('nan' AS FLOAT)) ELSE embedding END AS e FROM embeddings)""")
def checked_vectors(spark, sf_dir):
    e, i = F.col("embedding"), F.col("vec_id")
    odd = F.when(i % 7 == 0, F.slice(e, 1, 32)).when(i % 5 == 0, F.concat(F.slice(e, 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(e)
    x = t(spark, sf_dir, "embeddings").select("vec_id", F.when(i % 11 != 0, odd).alias("embedding"))
    return catalog.vector_errors(x, 64).select("vec_id", "error")


@query(f"""WITH last AS (SELECT conv_id, arg_max(text, turn) AS question, max(turn) AS at FROM conversations WHERE role = 'user' GROUP BY 1), before AS (SELECT c.* FROM conversations c JOIN last USING (conv_id) WHERE c.turn < last.at),
h AS ({SQL['chat_history'].replace('FROM conversations)', 'FROM before)')}), s AS (SELECT conv_id, list({{'role': role, 'content': text}} ORDER BY turn) AS ms FROM h GROUP BY 1),
m AS (SELECT conv_id, list_concat([{{'role': 'system', 'content': 'Answer from the context alone.'}}], coalesce(ms, []), [{{'role': 'user', 'content': '上下文：' || chr(10) || '[1] ' || b.text || chr(10) || chr(10) || '问题：' || question}}]) AS ms FROM last JOIN benchmark b ON item_id = conv_id % (SELECT count(*) FROM benchmark) LEFT JOIN s USING (conv_id)),
x AS (SELECT conv_id, unnest(ms) AS m, unnest(range(len(ms))) AS place FROM m) SELECT conv_id, CAST(place AS INTEGER) AS place, m.role AS role, m.content AS content FROM x""")
def prompt_messages(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    last = c.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"), F.max("turn").alias("at"))
    given = t(spark, sf_dir, "benchmark")
    n = given.count()
    given = given.select(F.col("item_id").alias("k"), F.concat(F.lit("[1] "), F.col("text")).alias("context"))
    asked = last.withColumn("k", F.col("conv_id") % n).join(given, "k").select("conv_id", "context", "question")
    before = c.join(last.select("conv_id", "at"), "conv_id").where("turn < at").select("conv_id", "turn", "role", "text")
    x = context.messages("Answer from the context alone.", before, asked)
    return x.select("conv_id", F.posexplode("messages").alias("place", "m")).select("conv_id", "place", "m.role", "m.content")


@query(r"""WITH c AS (SELECT source, trim(regexp_extract(text, '^[^.]*')) AS claim, CASE WHEN quality = 1 THEN 'supported' WHEN toxic = 0 THEN 'partial' ELSE 'unsupported' END AS v FROM documents d JOIN labels l ON d.doc_id = l.doc_id), k AS (SELECT * FROM c WHERE length(regexp_replace(claim, '^\s+|\s+$', '', 'g')) > 2)
SELECT source, count(*) AS total_claims, count(*) FILTER (v = 'supported') AS supported_claims, round((count(*) FILTER (v = 'supported') + 0.5 * count(*) FILTER (v = 'partial')) / count(*), 4) AS score FROM k GROUP BY 1""")
def claim_scores(spark, sf_dir):
    """The first sentence of each text as a claim, judged in a reply that is one object amid other words; claims of two signs or fewer are none."""
    verdict = F.when(F.col("quality") == 1, "supported").when(F.col("toxic") == 0, "partial")
    claim = F.trim(F.regexp_extract("text", r"(?s)^[^.]*", 0))
    reply = F.concat(F.lit("The judgement: "), F.to_json(F.struct(claim.alias("claim"), verdict.alias("verdict"))), F.lit(" so far."))
    x = t(spark, sf_dir, "documents").select("doc_id", "source", "text").join(t(spark, sf_dir, "labels"), "doc_id").select("source", json_object(reply, "claim string, verdict string").alias("c"))
    x = x.select("source", real_claim(F.col("c.claim")).alias("claim"), "c.verdict").where("claim is not null")
    return evaluation.faithfulness(x, "source")


@query("""SELECT vec_id, CAST(coalesce(CASE WHEN vec_id % 3 = 0 THEN vec_id / 10 END, CASE WHEN vec_id % 3 = 1 THEN label END, 0) AS DOUBLE) AS score FROM embeddings""")
def final_scores(spark, sf_dir):
    i = F.col("vec_id")
    return t(spark, sf_dir, "embeddings").select("vec_id", context.final_score(F.when(i % 3 == 0, i / 10), F.when(i % 3 == 1, F.col("label"))).alias("score"))
