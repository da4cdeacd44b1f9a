"""The corpus operators as registered queries, and the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import interaction, mixing, packing, pii, quality, resampling, secrets, sharding, simhash, spans, tokens, vectors, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spans.dedup_spans(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "text", "n_removed")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(table(spark, sf_dir, "documents"))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


_ALL = (op1_simhash, op2_packing, op3_sharding, op4_quality, op5_spans, op6_token_files, op7_vectors, op8_mixing, op9_secrets, op10_pii, op11_resampling, op12_warc, op13_filter_audit)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_OP4 = r"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1),
p AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM r) GROUP BY 1),
l AS (SELECT rid, count(*) AS lines, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
f AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
coalesce(l.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, coalesce(l.lines, 0) AS n_lines FROM w LEFT JOIN l USING (rid) LEFT JOIN p USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, [count(*) FILTER (n_words < 50), count(*) FILTER (100 * n_repeat_words > 50 * n_words), count(*) FILTER (10 * n_symbols > word_chars), count(*) FILTER (3 * n_dup_lines > n_lines)] AS ks FROM b GROUP BY 1),
e AS (SELECT source, n, unnest([1, 2, 3, 4]) AS rule, unnest(ks) AS k FROM h),
m AS (SELECT rule, least(greatest(avg(k / n), 1e-3), 1 - 1e-3) AS mean, var_pop(k / n) AS v, avg(1 / n) AS inv FROM e GROUP BY 1),
s AS (SELECT rule, mean, least(greatest(mean * (1 - mean) / greatest(v - mean * (1 - mean) * inv, 1e-4 * mean * (1 - mean)) - 1, 1), 1000) AS strength FROM m),
q AS (SELECT source, mean, n + strength AS t, (k + mean * strength) / (n + strength) AS rate FROM e JOIN s USING (rule)),
bad AS (SELECT DISTINCT source FROM q WHERE rate - 2 * sqrt(rate * (1 - rate) / (t + 1)) >= greatest(0.5, mean))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM b.source) AS kept, n_lines FROM b"""

#: All pairs by brute force. The operator finds nearly all of them (995,660 of 995,754 where it missed any), and all while one cell holds the vectors.
_OP7 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT *, sqrt(list_inner_product(e, e)) AS long FROM (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0)),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.long * b.long) >= 0.98),
r AS (SELECT vec_id, vec_id AS reached FROM v UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.reached = p.a),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

#: A CRC-32 is a fold over a word's bytes with what each byte does to it, itself a fold over eight bits.
_OP11 = r"""WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
w AS (SELECT is_doc, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
FROM (SELECT true AS is_doc, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark)),
f AS (SELECT is_doc, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
h AS (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM f)),
c AS (SELECT f, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, steps[1 + (xor(c, x) & 255)])) AS c FROM h, steps),
b AS (SELECT is_doc, rid, xor(c, 4294967295) % 10000 AS b FROM f JOIN c USING (f)),
n AS (SELECT b, count(*) FILTER (is_doc) AS s, count(*) FILTER (NOT is_doc) AS t FROM b GROUP BY 1),
m AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
g AS (SELECT b, floor(1000 * ln((n.t + 1.0::DOUBLE) * (m.s + 10000)::DOUBLE / ((n.s + 1.0::DOUBLE) * (m.t + 10000)::DOUBLE))) AS g FROM n, m),
d AS (SELECT rid, count(*) AS n_features, floor(sum(g) / count(*)) AS weight FROM b JOIN g USING (b) WHERE is_doc GROUP BY 1),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN d USING (rid) WHERE w.is_doc),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_features >= 39) OVER () AS able FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 39 AND r <= 25 * able // 100 THEN r END AS rank FROM z"""

_OP12 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r"""

_OP13 = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS again FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
+ 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(again AS INT) AS mask FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
o AS (SELECT '' AS o, 0 AS before, 0 AS own, 0 AS step UNION ALL SELECT o || substr('ABCDE', i + 1, 1), before + own, CAST(1 << i AS INT), step + 1 FROM o, range(5) r(i) WHERE (before + own) & (1 << i) = 0 AND step < 5),
s AS (SELECT f.o AS filter_order, o.step, o.own, o.before FROM o JOIN o f ON f.step = 5 AND o.step > 0 AND starts_with(f.o, o.o))
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (mask & (before | own) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
CAST(coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
CAST(coalesce(sum(n) FILTER (good AND mask & own > 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (toxic AND mask & own > 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost,
CAST(coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & own > 0), 0) AS BIGINT) AS shapley FROM c, s GROUP BY 1, 2, 3, own, before"""

SQL: dict[str, str] = {"op4_quality": _OP4, "op7_vectors": _OP7, "op11_resampling": _OP11, "op12_warc": _OP12, "op13_filter_audit": _OP13}
