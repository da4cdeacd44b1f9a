"""Queries of evaluation data, document names, reports, hybrid and approximate search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, chunking, evaluation, retrieval
from .queries import _DENSE, _DOCS, _bm25_sql
from .registry import query, t


@query(f"""WITH {_DOCS}, x AS (SELECT doc_id, content, length(content) AS n, [substr(content, 1, 20), substr(content, length(content) // 3 + 1, 20), substr(content, 2 * length(content) // 3 + 1, 20), '#none#'] AS titles FROM d),
s AS (SELECT doc_id, n, title, instr(content, title) - 1 AS start FROM (SELECT *, unnest(titles) AS title FROM x) WHERE instr(content, title) > 0),
e AS (SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start, title), n) AS "end" FROM s)
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end" FROM e WHERE "end" > start""")
def section_spans(spark, sf_dir):
    docs = chunking.cleaned(t(spark, sf_dir, "documents"))
    third = lambda k: F.substring(F.col("content"), F.floor(k * F.length("content") / 3).cast("int") + 1, F.lit(20))
    return evaluation.sections(docs, docs.select("doc_id", F.explode(F.array(third(0), third(1), third(2), F.lit("#none#"))).alias("title")))


@query("""WITH f AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, 'data/' || source || '/f' || doc_id || '.txt' AS file_name, source FROM documents)
SELECT CASE doc_id % 5 WHEN 0 THEN id WHEN 1 THEN id || '.pdf' WHEN 2 THEN 'f' || id || '.txt' WHEN 3 THEN source || '/f' || id || '.txt' ELSE 'g' || id END AS name, CASE WHEN doc_id % 5 < 4 THEN id END AS doc_id FROM f""")
def named_documents(spark, sf_dir):
    d, id_ = t(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    file = F.concat(F.lit("f"), id_, F.lit(".txt"))
    docs = d.select(id_.alias("doc_id"), F.concat(F.lit("data/"), "source", F.lit("/"), file).alias("file_name"))
    kind = F.col("doc_id") % 5
    name = F.when(kind == 0, id_).when(kind == 1, F.concat(id_, F.lit(".pdf"))).when(kind == 2, file).when(kind == 3, F.concat("source", F.lit("/"), file)).otherwise(F.concat(F.lit("g"), id_))
    return catalog.named_documents(d.select(name.alias("name")), docs)


@query("SELECT l_orderkey AS request_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS pos, p_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey")
def ordered_lookup(spark, sf_dir):
    ids = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    asked = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("request_id")).agg(ids.alias("ids"))
    return catalog.in_order(asked, t(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").select("request_id", "pos", "p_partkey", "p_name")


@query("""WITH r AS (SELECT 'u' || user_id AS actor, '10.0.0.' || user_id AS ip, '/docs/' || user_id % 10 AS path, CASE event_type WHEN 'error' THEN 403 WHEN 'signup' THEN 401 ELSE 200 END AS status FROM events)
SELECT 'authz.denied' AS action, 'denied' AS result, actor, path AS resource, ip, 'HTTP ' || status || ': GET ' || path AS detail FROM r WHERE status IN (401, 403) AND path <> '/docs/3'""")
def denied_requests(spark, sf_dir):
    user = F.col("user_id").cast("string")
    status = F.when(F.col("event_type") == "error", 403).when(F.col("event_type") == "signup", 401).otherwise(200)
    x = t(spark, sf_dir, "events").select(F.concat(F.lit("u"), user).alias("actor"), F.concat(F.lit("10.0.0."), user).alias("ip"), F.lit("GET").alias("method"), F.concat(F.lit("/docs/"), (F.col("user_id") % 10).cast("string")).alias("path"), status.alias("status"))
    return catalog.denied(x, ("/docs/3",))


@query("""WITH h AS (SELECT l_suppkey AS query_id, l_partkey AS doc_id, l_extendedprice AS score, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem),
f AS (SELECT query_id, doc_id, min(rank) AS r, arg_min(score, rank) AS score FROM h GROUP BY 1, 2)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INTEGER) AS rank FROM f""")
def document_hits(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem")
    rank = F.row_number().over(retrieval.W.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey"))
    return evaluation.of_documents(x.select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), F.col("l_extendedprice").alias("score"), rank.alias("rank")))


@query("""WITH g AS (SELECT o_custkey, string_agg('{"document_id":"' || o_orderkey || '","relevance":1,"spans":[]}', ',' ORDER BY o_orderkey) AS docs FROM orders GROUP BY 1)
SELECT c_custkey AS id, '{"id":"' || c_custkey || '","task":"retrieval","query":"' || c_name || '","history":[],"gold":{"documents":[' || coalesce(docs, '') || '],"chunks":[],"answers":[],"values":[],"behavior":"answer"},"metadata":{"source_dataset":"orders"}}' AS sample FROM customer LEFT JOIN g ON o_custkey = c_custkey""")
def retrieval_samples(spark, sf_dir):
    q = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("text"))
    return evaluation.samples(q, t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id")), "orders")


@query("""WITH m AS (SELECT lang AS metric, avg(length(text)) FILTER (doc_id % 2 = 0) AS was, avg(length(text)) FILTER (doc_id % 2 = 1 AND lang <> 'es') AS now FROM documents GROUP BY 1)
SELECT metric, was, now, round(now - was, 6) AS delta, CASE WHEN now IS NULL THEN 'missing' WHEN abs(round(now - was, 6)) > 50 THEN 'differs' ELSE 'same' END AS status FROM m WHERE was IS NOT NULL""")
def figures_agree(spark, sf_dir):
    half = lambda k: t(spark, sf_dir, "documents").where(F.col("doc_id") % 2 == k).groupBy(F.col("lang").alias("metric")).agg(F.avg(F.length("text")).alias("value"))
    return evaluation.agreement(half(0), half(1).where("metric <> 'es'"), 50)


@query("SELECT event_type, user_id, count(value) AS samples, round(sum(value), 4) AS total, round(avg(value), 9) AS mean FROM events GROUP BY 1, 2")
def stage_figures(spark, sf_dir):
    return evaluation.snapshot(t(spark, sf_dir, "events"), ["event_type", "user_id"], "value", 9)


@query("SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text FROM conversations WHERE role = 'assistant'")
def answer_report(spark, sf_dir):
    return evaluation.report(t(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text"), "text")


@query(f"""WITH {_DENSE.split(", s AS")[0]}, s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q, v WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 50), {_bm25_sql('okapi', 50, 'a')},
u AS (SELECT query_id, vec_id AS doc_id, rank, 0 AS route FROM b UNION ALL SELECT query_id, doc_id, rank, 1 FROM a),
f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score, min(route * 1000 + rank) AS first FROM u GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS rank FROM f) WHERE rank <= 10""")
def hybrid_search(spark, sf_dir):
    v, asked = t(spark, sf_dir, "embeddings"), t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    own = v.join(asked.select(F.col("query_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.hybrid(v, own, t(spark, sf_dir, "documents"), asked).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query()
def inverted_lists(spark, sf_dir):
    v = t(spark, sf_dir, "embeddings")
    return retrieval.inverted_lists(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))
