"""Operators on small made-up cases, and the stream against the batch."""

import pytest
from pyspark.sql import functions as F

from loomwright.functions.text import citations, clean, query_variants, stable_id
from loomwright.operators import catalog, chunking, context, evaluation, retrieval
from loomwright.sources.html import read_html
from loomwright.streaming.latency import windowed


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, clean(F.lit("  a\r\nb\rc \t d\n\n\n\ne \x1f"))) == "a\nb\nc d\n\ne"
    assert one(spark, citations(F.lit("as said [1], [2，3] and 【1、4】 [x]"))) == [1, 2, 3, 4]
    assert one(spark, query_variants(F.lit("q"), F.lit('1. "a"\n- b\n\nq\n2、c'), 3)) == ["q", "a", "b"]
    import hashlib

    assert one(spark, stable_id(F.lit("d_chunk_1"))) == int(hashlib.sha256(b"d_chunk_1").hexdigest()[:15], 16)


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, "  \n "), (3, None)], "doc_id long, text string")
    got = chunking.fixed_chunks(docs, 4, 1).orderBy("chunk_index").collect()
    assert [(r.content, r.start_offset, r.end_offset) for r in got] == [("abcd", 0, 4), ("defg", 3, 7), ("ghij", 6, 10), ("j", 9, 13)]
    text = "第一句。第二句话长一点！third line\n\nfourth，fifth"
    parts = chunking.split_text(text, 8, 2)
    assert all(text[a:b] == s for a, b, s in parts)
    assert chunking.split_text("abcdefghijk", 4, 0) == [(0, 4, "abcd"), (4, 8, "efgh"), (8, 12, "ijk")]  # the last end isn't clamped
    assert chunking.split_text("aa\nbb\ncc", 6, 2) == [(0, 6, "aa\nbb\n"), (4, 8, "b\ncc")]
    assert chunking.split_text("aa\nbbbbbb", 6, 2) == [(0, 3, "aa\n"), (1, 9, "a\nbbbbbb")]  # an overlap may go beyond the size
    covered = {i for a, b, _ in parts for i in range(a, b)}
    assert all(i in covered or text[i].isspace() for i in range(len(text)))


def test_html():
    assert read_html("<title> A &amp; B </title><script>no</script><p>x<b>y</b><style>z</style>") == ("A & B", " A & B \nx\ny")


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple apple fig"), (3, "plum"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "Fig"), (8, "plum"), (9, "none")], "query_id long, text string")
    assert {(r.query_id, r.doc_id) for r in retrieval.bm25(docs, q).collect()} == {(7, 2), (8, 3)}
    among = docs.where("doc_id = 3")
    all_, some = retrieval.bm25(docs, q), retrieval.bm25(docs, q, among=among)
    assert [r.score for r in some.collect()] == [r.score for r in all_.where("doc_id = 3").collect()]
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 6, 1), (1, 7, 2)], "query_id long, doc_id long, rank int")
    got = retrieval.rrf([a, b]).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [6, 5, 7] and abs(got[0].score - (1 / 61 + 1 / 62)) < 1e-12


def test_context(spark):
    schema = "query_id long, chunk_id string, doc_id long, chunk_index int, start_offset int, end_offset int, content string, score double"
    rows = [
        (1, "a", 1, 0, 0, 10, "abcdefghij", 0.9), (1, "b", 1, 1, 4, 14, "efghijklmn", 0.8), (1, "c", 2, 5, 0, 10, "abcdefghij", 0.7),
        (1, "d", 1, 2, 12, 22, "qrstuvwxyz", 0.6), (1, "e", 1, 1, 10, 20, "0123456789", 0.5), (1, "f", 1, 9, 90, 99, "!!!!!!!!!", 0.1),
    ]
    hits = spark.createDataFrame(rows, schema)
    kept = context.without_duplicates(hits)
    assert {r.chunk_id for r in kept.collect()} == {"a", "d", "f"}  # b and e overlap, c has the text of a
    merged = {tuple(r.chunk_ids): (r.start_offset, r.end_offset, r.score) for r in context.merged_neighbours(hits.where("chunk_id in ('a', 'd', 'e', 'f')")).collect()}
    assert merged == {("a", "e"): (0, 20, 0.9), ("d",): (12, 22, 0.6), ("f",): (90, 99, 0.1)}  # d is two from the head
    caps = context.token_shares(hits, 100).collect()
    assert sum(r.cap for r in caps) <= 100 and max(caps, key=lambda r: r.cap).chunk_id == "a"
    ranked = spark.createDataFrame([(1, i) for i in range(1, 6)], "query_id long, rank int")
    assert [r.rank for r in context.interleaved(ranked).orderBy("place").collect()] == [1, 3, 5, 4, 2]


def test_catalog(spark):
    rows = spark.createDataFrame([("d", 1), ("d", 2), (None, 1), ("x", 3)], "doc string, version int")
    active = catalog.active_versions(spark.createDataFrame([("d", 2)], "doc string, version int"), "doc", "version")
    assert sorted(map(str, catalog.only_active(rows, active, "doc", "version").collect())) == sorted(map(str, rows.where("doc is null or version > 1").collect()))
    new, old = spark.createDataFrame([(1, "n"), (1, "m"), (2, "n")], "k int, v string"), spark.createDataFrame([(2, "o")], "k int, v string")
    assert [tuple(r) for r in catalog.insert_ignore(new, old, ["k"], ["v"]).collect()] == [(1, "m")]
    assert sorted(tuple(r) for r in catalog.upsert(new.where("k = 2"), old, ["k"]).collect()) == [(2, "n")]


def test_relevance_by_class_is_that_of_the_pairs(spark):
    label = lambda i: None if i % 11 == 0 else 99 if i == 7 else i % 4  # noqa: E731  7 is alone in its class
    items = spark.createDataFrame([(i, label(i)) for i in range(60)], "key long, class int")
    queries = spark.createDataFrame([(i, label(i)) for i in (0, 3, 7, 12, 40, 41)] + [(100, 2)], "query_id long, class int")
    hits = spark.createDataFrame([(q, (q * 7 + r * 3) % 64 if r else q, r + 1) for q in (0, 3, 7, 12, 41, 100) for r in range(12)], "query_id long, key long, rank int")
    pairs = queries.join(items, "class").where("query_id <> key").select("query_id", "key")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    by_class = evaluation.marked_by_class(hits, queries, items)
    assert rows(evaluation.ranking_of(*by_class)) == rows(evaluation.ranking(hits, pairs)) != []
    assert rows(evaluation.recall_of(*by_class, (2, 12))) == rows(evaluation.recall_at_pools(hits, pairs, (2, 12)))
    many = spark.range(50000).selectExpr("id AS key", "0 AS class")  # of 50,000,000 pairs
    found, n = evaluation.marked_by_class(hits, many.where("key % 50 = 0").selectExpr("key AS query_id", "class"), many)
    assert n.where("n_relevant = 49999").count() == 1000 and found.count() == hits.count()


def test_metrics(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "z", 1)], "query_id int, key string, rank int")
    rels = spark.createDataFrame([(1, "b"), (1, "c"), (2, "y")], "query_id int, key string")
    got = {r.query_id: r for r in evaluation.ranking(hits, rels, 2).collect()}
    assert (got[1].recall, got[1].mrr, got[1].precision, got[2].recall, got[2].ndcg) == (0.5, 0.5, 0.5, 0, 0)
    b = spark.createDataFrame([("recall", 0.9), ("mrr", 0.9), ("gone", 1.0)], "metric string, value double")
    c = spark.createDataFrame([("recall", 0.85), ("mrr", 0.7)], "metric string, value double")
    limits = spark.createDataFrame([("recall", 0.1), ("mrr", 0.1)], "metric string, limit double")
    assert {r.metric: r.passed for r in evaluation.regression(b, c, limits).collect()} == {"recall": True, "mrr": False}
    got = evaluation.gate(evaluation.regression(b, c, limits), b, c).first()
    assert (got.failed, got.gone, got.passed) == (1, 1, False)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in")
    q = windowed(stream).writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windowed(events).collect()))


def test_replies(spark):
    from loomwright.functions.text import compressed, entity, json_items, needs_many

    s = "struct<claim:string,verdict:string>"
    for reply, n in (('[{"claim":"a"},{"claim":"b"}]', 2), ('```json\n[{"claim":"a"}]\n```', 1), ('so: [{"claim":"a"}] it is', 1), ("no", 0), ("[", 0), ("", 0)):
        assert one(spark, F.size(json_items(F.lit(reply), s))) == n, reply
    assert [one(spark, needs_many(F.lit(x))) for x in ("不需要", "需要", "?")] == [False, True, False]
    assert [one(spark, entity(F.lit(x))) for x in (" None ", "无。", "x。", "")] == [None, None, "x", None]
    for text, cap, want in (("ab. cd. ef", 20, "ab. cd. ef"), ("ab. cd. ef", 8, "ab. cd."), ("abcdef. g", 3, "abc"), ("ab. cdefghi. j", 5, "ab."), ("abc", 0, "")):
        assert one(spark, compressed(F.lit(text), F.lit(cap))) == want


def test_spans(spark):
    hits = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 50, 60), (1, 3, 100, 110), (2, 1, 0, 5)], "query_id int, rank int, start_offset int, end_offset int")
    gold = spark.createDataFrame([(1, 5, 15), (1, 105, 115), (2, 5, 9)], "query_id int, start int, end int")
    got = {r.query_id: tuple(r)[1:] for r in evaluation.spans(hits, gold, 3).collect()}
    assert got == {1: (2, 1.0, 0.666667, 1.0, 0.919721), 2: (1, 0.0, 0.0, 0.0, 0.0)}


def test_built_context(spark):
    schema = "query_id long, chunk_id string, doc_id long, chunk_index int, start_offset int, end_offset int, content string, score double"
    hits = spark.createDataFrame([(1, "a", 1, 0, 0, 4, "abcd", 0.9), (1, "b", 1, 1, 4, 8, "efgh", 0.5), (1, "c", 2, 0, 0, 3, "xyz", 0.2)], schema)
    q = spark.createDataFrame([(1, "q")], "query_id long, text string")
    r = context.build(hits, q, 200, 100).first()
    assert (r.context, r.used, r.skipped, r.n_input, r.n_merged, r.n_final) == ("[1] abcdefgh\n\n[2] xyz", 11, 0, 3, 2, 2)
    x = spark.createDataFrame([(1, i, "x" * n, 60) for i, n in enumerate((30, 50, 10, 25))], "query_id int, rank int, content string, budget int")
    r = context.fitted(x).first()
    assert ([len(p) for p in r.parts], r.used, r.skipped) == ([30, 10], 40, 2)


def test_grants(spark):
    docs = spark.createDataFrame([(1, 7), (2, None)], "doc_id int, owner int")
    users = spark.createDataFrame([(7, 1), (8, 1), (8, 2), (9, None)], "user_id int, role int")
    grants = spark.createDataFrame([(1, "role", 2, "read"), (1, "user", 9, "write")], "doc_id int, principal_type string, principal_id int, permission string")
    asked = spark.createDataFrame([(7, 1, "write"), (8, 1, "read"), (8, 1, "write"), (9, 1, "write"), (9, 2, "read"), (9, 2, "write"), (9, 3, "read")], "user_id int, doc_id int, permission string")
    got = {tuple(r)[:3]: r.allowed for r in catalog.may(asked, docs, users, grants).collect()}
    assert [got[tuple(r)] for r in asked.collect()] == [True, True, False, True, True, False, False]


def test_readable_and_visible(spark):
    docs = spark.createDataFrame([(1, "a", 7), (2, "a", None), (3, "b", 7), (4, "a", 9), (5, "b", None)], "doc_id long, tenant string, owner long")
    users = spark.createDataFrame([(7, "a", 1, False), (8, "a", 2, False), (1, "a", 1, True)], "user_id long, tenant string, role long, superadmin boolean")
    grants = spark.createDataFrame([(4, "role", 2, "read"), (4, "user", 7, "write"), (1, "user", 8, "manage"), (3, "user", 8, "read")], "doc_id long, principal_type string, principal_id long, permission string")
    may = catalog.readable(docs, users, grants)
    # another tenant's documents, and grants to write or manage, give nothing to read; ownerless ones are all users' of their tenant
    assert {tuple(r) for r in may.collect()} == {("a", 7, 1), ("a", 8, 4), ("a", None, 2), ("b", None, 5), ("a", 1, None)}
    rows = [(1, "a", 7, None), (2, "a", 7, [2, 4, 5]), (3, "a", 7, []), (4, "a", 1, None), (5, "a", 8, [4]), (6, "a", 99, None)]
    asks = spark.createDataFrame(rows, "query_id long, tenant string, user_id long, scope array<long>")
    got = {tuple(r) for r in catalog.visible(asks, may, docs).collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (4, 1), (4, 2), (4, 4), (5, 4), (6, 2)}
    texts = spark.createDataFrame([(i, "apple") for i in range(1, 6)], "doc_id long, text string").unionByName(spark.createDataFrame([(9, "pear pear plum"), (10, "fig")] + [(i, "kiwi") for i in range(20, 30)], "doc_id long, text string"))
    hits = retrieval.bm25(texts, asks.select("query_id", F.lit("apple").alias("text")), among=catalog.visible(asks, may, docs)).collect()
    assert {(r.query_id, r.doc_id) for r in hits} == got


@pytest.mark.parametrize("cell", [2, 512])
def test_readable_is_that_of_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(catalog, "CELL", cell, raising=False)
    monkeypatch.setattr(catalog, "LISTED", 8, raising=False)
    docs = [(i, "ab"[i % 2], None if i % 5 == 0 else i % 7) for i in range(30)] + [(3, "b", 3), (3, "a", 3), (40, None, 2), (None, "a", 2), (41, "a", None), (41, "a", 1)]
    users = [(u, "ab"[u % 2], r, u == 6) for u in range(12) for r in range(u % 4)] + [(1, "b", 1, False), (1, "b", 1, False), (2, "b", None, False), (None, "a", 2, False), (8, "a", 0, True), (9, None, 1, False), (5, "a", 1, None)]
    grants = [(i, "role" if i % 3 else "user", (i * 7) % 4, "read" if i % 4 else "write") for i in range(30)] * 2 + [(i, "role", i % 3, "read") for i in range(35)] + [(3, "user", 3, "read"), (4, "user", None, "read"), (None, "role", 1, "read"), (41, "role", 2, "read"), (7, "role", None, "read")]
    plain, same = [u for u in users if u[3] is False], lambda a, b: a is not None and a == b
    want = {(t, u[0], d) for d, t, o in docs for u in plain if same(t, u[1]) and same(o, u[0])}
    given = lambda g, u: g[1] == "user" and same(g[2], u[0]) or g[1] == "role" and same(g[2], u[2])
    want |= {(t, u[0], d) for d, t, o in docs for g in grants if same(g[0], d) and g[3] == "read" for u in plain if same(t, u[1]) and given(g, u)}
    want |= {(t, None, d) for d, t, o in docs if o is None} | {(u[1], u[0], None) for u in users if u[3]}
    frames = (docs, "doc_id long, tenant string, owner long"), (users, "user_id long, tenant string, role long, superadmin boolean"), (grants, "doc_id long, principal_type string, principal_id long, permission string")
    got = [tuple(r) for r in catalog.readable(*(spark.createDataFrame(*f) for f in frames)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_what_a_role_reads_is_listed_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(catalog, "CELL", 32, raising=False)
    monkeypatch.setattr(catalog, "LISTED", 2000, raising=False)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(1).alias("tenant"), F.lit(-1).cast("long").alias("owner"))
    users = spark.range(1000).select(F.col("id").alias("user_id"), F.lit(1).alias("tenant"), F.lit(3).cast("long").alias("role"), F.lit(False).alias("superadmin"))
    grants = docs.select("doc_id", F.lit("role").alias("principal_type"), F.lit(3).cast("long").alias("principal_id"), F.lit("read").alias("permission"))
    n = [r["count"] for r in catalog.readable(docs, users, grants).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(n) == 60_000 and max(n) < 7500, max(n)  # 8 partitions of a shuffle would hold no fewer


def test_cited(spark):
    schema = "query_id long, number int, chunk_id string, doc_id string, start_offset int, end_offset int, content string"
    chunks = spark.createDataFrame([(1, 1, "c0", "d", 0, 48, "x" * 60), (1, 2, "c1", "d", 48, 90, "y")], schema)
    for answer, want in (("so [2], and [1\uff0c2] \u30101\u30012\u3011", ["c1", "c0"]), ("[9] and [1]", ["c0"]), ("[x] none", []), ("", []), ("[99999999999999999999]", [])):
        got = context.cited(spark.createDataFrame([(1, answer)], "query_id long, answer string"), chunks).orderBy("place").collect()
        assert [r.chunk_id for r in got] == want and all(len(r.preview) <= 50 for r in got)


def test_messages_and_objects(spark):
    from loomwright.functions.text import json_object, real_claim

    turns = spark.createDataFrame([(1, 0, "user", " hi "), (1, 1, "tool", "no"), (1, 2, "assistant", "yes")], "conv_id long, turn int, role string, text string")
    asked = spark.createDataFrame([(1, "[1] c", "q"), (2, "", "r")], "conv_id long, context string, question string")
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in context.messages("S", turns, asked).collect()}
    last = lambda c, q: ("user", f"\u4e0a\u4e0b\u6587\uff1a\n{c}\n\n\u95ee\u9898\uff1a{q}")
    assert got == {1: [("system", "S"), ("user", "hi"), ("assistant", "yes"), last("[1] c", "q")], 2: [("system", "S"), last("", "r")]}
    for reply, want in (('{"score": 0.5}', 0.5), ('```json\n{"score": 1}\n```', 1.0), ('well: {"score": 0.25} so', 0.25), ("none", None)):
        assert one(spark, json_object(F.lit(reply), "score double")["score"]) == want
    assert [one(spark, real_claim(F.lit(x))) for x in (" abc ", " ab ", "")] == ["abc", None, None]


def test_upsert_takes_the_last(spark):
    new, old = spark.createDataFrame([(1, "n", 1), (1, "m", 2), (2, "z", 1)], "k int, v string, at int"), spark.createDataFrame([(1, "o", 0), (3, "p", 0)], "k int, v string, at int")
    assert sorted(tuple(r) for r in catalog.upsert(new, old, ["k"], ["at"]).collect()) == [(1, "m", 2), (2, "z", 1), (3, "p", 0)]


def test_best_of_tasks_are_those_of_all_pairs(spark, monkeypatch):
    from loomwright.operators import terms

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 13}" for j in range(1, i % 9 + 2)) if i % 17 else "") for i in range(400)] + [(1000 + i, "w1 w2 w2") for i in range(60)] + [(2000, None)], "doc_id long, text string").repartition(7)
    q = spark.createDataFrame([(i, " ".join(f"w{(i + j) % 15}" for j in range(i % 5))) for i in range(40)], "query_id long, text string")
    few = docs.where("doc_id % 3 = 0")
    rows = lambda x: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in x.collect())
    monkeypatch.setattr(terms, "HELD", 1000)  # slices of a few documents
    for variant in ("okapi", "lucene"):
        one, two = (rows(retrieval.bm25(docs, q, 7, variant, a)) for a in (None, few))
        with monkeypatch.context() as m:
            m.setattr(retrieval, "best", lambda *a: None)
            assert one == rows(retrieval.bm25(docs, q, 7, variant)) and two == rows(retrieval.bm25(docs, q, 7, variant, few)) and one != two != []
