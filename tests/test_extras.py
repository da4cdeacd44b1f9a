"""Streamed answers, digests, pages, ids, removal and rights on small made-up cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import catalog, digest, evaluation, logs, retrieval
from loomwright.sources.benchmark import inverted, read_benchmark


def delta(text):
    import json

    return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]})


def test_answers(spark):
    rows = [(1, 1, delta("Hel")), (1, 2, ""), (1, 4, delta("lo")), (1, 3, "data: {broken"), (1, 5, "data: [DONE]"), (1, 6, delta("late")), (1, 7, "data:[DONE]"), (2, 1, 'data: {"choices": []}'), (2, 2, 'data: {"choices": [{"delta": {}}]}'), (2, 3, delta("x\n\"y\"")), (2, 4, delta("")), (3, 1, ": ping"), (3, 2, None), (4, 1, "data: [DONE]")]
    lines = spark.createDataFrame(rows, "request_id int, seq int, line string").repartition(3)
    assert sorted(map(tuple, logs.answers(lines).collect())) == [(1, "Hello", 2, True), (2, 'x\n"y"', 1, False), (3, "", 0, False), (4, "", 0, True)]
    assert logs.answers(lines.where("false")).count() == 0


@pytest.mark.parametrize("kinds, fault", [
    ("meta done", None), ("error", None), ("meta error", None), ("meta citations done", None), ("meta delta delta citations done", None), ("meta delta error", None), ("meta citations error", None),
    ("", None), ("done", 0), ("meta", 1), ("meta delta", 2), ("meta delta done", 2), ("meta meta", 1), ("meta done done", 2), ("meta delta citations delta", 3), ("meta delta citations", 3), ("error meta", 1), ("meta odd", 1), ("delta", 0),
])
def test_event_faults(spark, kinds, fault):
    rows = [(7, i, k) for i, k in enumerate(kinds.split())]
    got = logs.event_faults(spark.createDataFrame(rows, "request_id int, seq int, type string").repartition(2)).collect()
    assert [tuple(r) for r in got] == ([(7, len(rows), fault)] if rows else [])


def test_ordered_digest(spark):
    rows = [(g, i, f"text {i * 7 % 50}" if i % 9 else None) for g in ("a", "b", None) for i in range(60 if g else 3)]
    df = spark.createDataFrame(rows, "g string, i int, text string")
    want = {}
    for g, i, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want[g] = digest.joined(want.get(g, (0, 0)), (digest.row_value(f"{i}|{x or ''}"), 1))
    told = lambda d: {r.g: (r.digest, r.rows) for r in digest.ordered_digest(d, "g", ["i", "text"], ["i"]).collect()}
    assert told(df.repartition(1)) == want == told(df.repartition(7, "text")) == told(df.orderBy(F.desc("i")))
    swapped = df.withColumn("text", F.when((F.col("g") == "a") & F.col("i").isin(1, 2), F.concat(F.lit("text "), ((3 - F.col("i")) * 7 % 50).cast("string"))).otherwise(F.col("text")))
    assert told(swapped)["a"] != want["a"] and told(swapped)["b"] == want["b"]
    a, b, c = (5, 1), (6, 2), (7, 3)
    assert digest.joined(digest.joined(a, b), c) == digest.joined(a, digest.joined(b, c)) and digest.joined((0, 0), a) == a == digest.joined(a, (0, 0))
    assert told(df.where("false")) == {}


def test_pages(spark, tmp_path):
    rows = spark.createDataFrame([(int(i), f"v{i}") for i in np.random.default_rng(0).permutation(1000) * 3], "k long, v string").repartition(4)
    laid = catalog.laid_out(rows, "k", f"{tmp_path}/laid", 8)
    after, seen = None, []
    while page := catalog.keyset_page(laid, "k", after, 130).collect():
        seen.append([r.k for r in page])
        after = page[-1].k
    assert sum(seen, []) == list(range(0, 3000, 3)) and len(seen) == 8
    plan = catalog.keyset_page(laid, "k", 1500, 130)._jdf.queryExecution().toString()
    assert "GreaterThan(k,1500)" in plan and "TakeOrderedAndProject" in plan
    got = {r.k: r.page for r in catalog.keyset_pages(rows, "k", 130).collect()}
    assert got == {k: i for i, page in enumerate(seen) for k in page}
    assert catalog.keyset_pages(rows.where("false"), "k", 10).count() == 0


def test_continued_ids(spark):
    new = spark.createDataFrame([(f"c{i:03}",) for i in range(250)], "chunk string").repartition(5)
    old = spark.createDataFrame([(4,), (41,), (7,)], "vector_id long")
    got = sorted((r.chunk, r.vector_id) for r in catalog.continued_ids(new, old, ["chunk"]).collect())
    assert got == [(f"c{i:03}", 42 + i) for i in range(250)]
    assert sorted(r.vector_id for r in catalog.continued_ids(new, old.where("false"), ["chunk"]).collect()) == list(range(250))
    assert catalog.continued_ids(new.where("false"), old, ["chunk"]).count() == 0


def test_verified_removal(spark, tmp_path):
    rows = spark.createDataFrame([(i // 2, f"v{i}") for i in range(20)], "k long, v string")
    gone = spark.createDataFrame([(1,), (1,), (3,), (77,)], "k long")
    assert catalog.removed_verified(rows, gone, ["k"], f"{tmp_path}/a") == {"kept": 16, "removed": 4, "absent": 1, "residue": 0}
    assert {r.k for r in spark.read.parquet(f"{tmp_path}/a").collect()} == {0, 2, 4, 5, 6, 7, 8, 9}
    # the place must be new: nothing is written over
    with pytest.raises(Exception, match="already exists"):
        catalog.removed_verified(rows, gone, ["k"], f"{tmp_path}/a")


def rights(spark):
    docs = spark.createDataFrame([(1, 0, 10), (2, 0, None), (3, 0, 11), (4, 1, None), (5, 0, 12), (6, 0, 12)], "doc_id long, tenant long, owner long")
    users = spark.createDataFrame([(10, 0, 5, False), (10, 0, 6, False), (11, 0, 6, False), (12, 0, 9, True), (13, 1, 5, False)], "user_id long, tenant long, role long, superadmin boolean")
    grants = spark.createDataFrame([(3, "user", 10, "read"), (5, "role", 6, "read"), (5, "user", 99, "read"), (6, "role", 5, "write"), (1, "role", 77, "read")], "doc_id long, principal_type string, principal_id long, permission string")
    asks = [(1, 0, 10, None), (2, 0, 11, None), (3, 0, 12, None), (4, 1, 13, None), (5, 0, 99, None), (6, 0, 10, [1, 4, 5]), (7, 0, 10, []), (8, 1, 10, None), (9, 0, 12, [2])]
    seen = {1: {1, 2, 3, 5}, 2: {2, 3, 5}, 3: {1, 2, 3, 5, 6}, 4: {4}, 5: {2, 5}, 6: {1, 5}, 7: set(), 8: {4}, 9: {2}}
    return spark.createDataFrame(asks, "query_id long, tenant long, user_id long, scope array<long>"), docs, users, grants, seen


def test_search_within_rights(spark):
    requests, docs, users, grants, want = rights(spark)
    keep = catalog.seen(requests, docs, users, grants)
    pairs = requests.select("query_id").crossJoin(docs.select("doc_id")).withColumn("score", F.lit(1.0))
    got = {q: set() for q in want}
    for r in keep(pairs).collect():
        got[r.query_id].add(r.doc_id)
    assert got == want
    listed = {q: set() for q in want}
    for r in catalog.visible(requests, catalog.readable(docs, users, grants), docs).collect():
        listed[r.query_id].add(r.doc_id)
    assert {q: s for q, s in listed.items() if q not in (5,)} == {q: s for q, s in want.items() if q not in (5,)}  # that relation knows users alone
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.col("doc_id").cast("double"), F.lit(1.0)).alias("embedding"))
    queries = requests.select("query_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    for k in (1, 10):
        top = {q: [] for q in want}
        for r in sorted(retrieval.dense_seen(vectors, queries, requests, docs, users, grants, k).collect(), key=lambda r: r.rank):
            top[r.query_id].append(r.vec_id)
        assert top == {q: sorted(s, reverse=True)[:k] for q, s in want.items()}
    texts = docs.select("doc_id", F.concat(F.lit("same word"), F.col("doc_id").cast("string")).alias("text"))
    asked = requests.select("query_id", F.lit("same word1 word2 word3 word4 word5 word6").alias("text"))
    found = {q: set() for q in want}
    for r in retrieval.bm25(texts, asked, 10, "lucene", keep).collect():
        found[r.query_id].add(r.doc_id)
    assert found == want
    # a table of rights that is missing lets nobody see anything
    for lost in range(3):
        tables = [None if i == lost else x for i, x in enumerate((docs, users, grants))]
        assert catalog.seen(requests, *tables)(pairs).count() == 0
    # rights that are empty let nobody see more
    assert {(r.query_id, r.doc_id) for r in catalog.seen(requests, docs, users.where("false"), grants.where("false"))(pairs).collect()} <= {(q, d) for q in want for d in (1, 2, 3, 4)} | {(3, 5), (3, 6)}  # owners see theirs


def test_may_by_tenant(spark):
    _, docs, users, grants, _ = rights(spark)
    asked = spark.createDataFrame([(10, 1, "write"), (10, 2, "read"), (10, 2, "write"), (10, 3, "read"), (10, 4, "read"), (12, 4, "delete"), (12, 99, "read"), (13, 5, "read"), (11, 5, "read"), (99, 2, "read")], "user_id long, doc_id long, permission string")
    got = {(r.user_id, r.doc_id, r.permission) for r in catalog.may(asked, docs, users, grants).collect() if r.allowed}
    assert got == {(10, 1, "write"), (10, 2, "read"), (10, 3, "read"), (12, 4, "delete"), (12, 99, "read"), (11, 5, "read")}


def test_manageable_by_tenant(spark):
    _, docs, users, grants, _ = rights(spark)
    docs = docs.unionByName(spark.createDataFrame([(7, 1, 10)], docs.schema))
    grants = grants.unionByName(spark.createDataFrame([(3, "role", 5, "delete"), (7, "role", 5, "delete")], grants.schema))
    asked = spark.createDataFrame([(10, 1), (10, 3), (10, 7), (13, 3), (12, 99), (10, 2), (10, 99)], "user_id long, doc_id long")
    told = lambda d: {(r.user_id, r.doc_id): (r.may_delete, r.may_manage) for r in catalog.manageable(asked, d, users, grants).collect()}
    want = {(10, 1): (True, True), (10, 3): (True, False), (10, 7): (False, False), (13, 3): (False, False), (12, 99): (True, True), (10, 2): (False, False), (10, 99): (False, False)}
    assert told(docs) == want
    assert told(docs.drop("tenant")) == want | {(10, 7): (True, True), (13, 3): (True, False)}


def test_checked_grants(spark):
    keys = "doc_id long, principal_type string, principal_id long, permission string"
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    have = spark.createDataFrame([(1, "user", 5, "read")], keys)
    new = spark.createDataFrame([(1, "user", 5, "read"), (1, "user", 6, "read"), (1, "user", 6, "read"), (3, "role", 1, "read"), (2, "team", 1, "read"), (2, "role", 1, "own"), (2, None, 1, "read")], keys)
    got = sorted((str(r.doc_id), str(r.principal_type), str(r.error)) for r in catalog.checked_grants(new, docs, have).collect())
    assert got == sorted([("1", "user", "exists"), ("1", "user", "None"), ("1", "user", "exists"), ("3", "role", "document"), ("2", "team", "principal"), ("2", "role", "permission"), ("2", "None", "principal")])


def test_judged(spark):
    rows = [(1, " ", '["a claim"]', "[]"), (2, "x", "none", "[]"), (3, "x", '["one claim", "ab", "two claim"]', "no list"), (4, "x", '```json\n["one claim", "two claim"]\n```', '[{"claim": "one claim", "verdict": "supported"}, {"claim": "two claim", "verdict": "partial"}]'), (5, None, None, None), (6, "x", '["one claim"]', '[{"claim": "one claim"}]')]
    df = spark.createDataFrame(rows, "id int, answer string, claims_reply string, verdict_reply string")
    got = sorted(map(tuple, evaluation.judged(df, "id").collect()))
    assert got == [(1, 0, 0, 0.0), (2, 0, 0, 1.0), (3, 2, 0, 0.0), (4, 2, 1, 0.75), (5, 0, 0, 0.0), (6, 1, 0, 0.0)]


def test_answer_scores_of_odd_texts(spark, tmp_path):
    import duckdb

    from loomwright.jobs.extras import answer_scores
    from loomwright.jobs.registry import SQL

    odd = [None, "", " ", "\n", "\xa0", "...", "ab.", "abc.", "\xa0a\xa0.cde.\u3000\u3000\u3000", "a\x0b\x0b.b\x1c\x1d.cde", "a \u2028.\u2003b\x85", "a\t\n\x0c\r .abc ", "['a\"\\].{}\x00\x01.```.[]```", "abc." * 10_000, "abc." * 80, "abc" + " " * 100_000 + "de."]
    rows = [(6 * i + k, x) for i, x in enumerate(odd) for k in range(6)] + [(-3, "abc."), (None, "a\xa0\xa0."), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in answer_scores(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got, key=repr) == sorted(con.execute(SQL["answer_scores"]).fetchall(), key=repr)


def test_scores_of_many_claims_and_of_long_ones(spark):
    claims = spark.range(10_000).select(F.lit(1).alias("id"), F.col("id").cast("string").alias("claim"), F.when(F.col("id") == 0, "supported").when(F.col("id") == 1, "partial").alias("verdict"))
    assert tuple(evaluation.faithfulness(claims, "id").first()) == (1, 10_000, 1, 0.0001)
    long = F.concat(F.lit('["'), F.repeat(F.lit("a"), F.lit(21_000_000)), F.lit('"]'))
    one = spark.range(1).select("id", F.lit("x").alias("answer"), long.alias("claims_reply"), F.lit('[{"verdict": "partial"}]').alias("verdict_reply"))
    assert tuple(evaluation.judged(one, "id").first()) == (0, 1, 0, 0.5)


def test_benchmark_tables(spark, tmp_path):
    spark.createDataFrame([(1, "t", 9)], "id long, text string, more int").write.parquet(f"{tmp_path}/corpus.parquet")
    spark.createDataFrame([(7, "q")], "id long, text string").write.parquet(f"{tmp_path}/asked.parquet")
    spark.createDataFrame([("7", "1", 1), ("7", "1", 2), ("8", "1", 1), ("7", "2", 0)], "qid string, pid string, score int").write.parquet(f"{tmp_path}/qrels.parquet")
    got = read_benchmark(spark, str(tmp_path), {"queries": "asked.parquet"})
    assert got["corpus"].dtypes == [("id", "string"), ("text", "string")] and got["queries"].first().id == "7"
    assert [tuple(r) for r in inverted(got["qrels"], "pid").collect()] == [("1", ["7", "8"], 2)]
    assert sorted(tuple(r) for r in inverted(got["qrels"], "qid", -1).collect()) == [("7", ["1", "2"], 2), ("8", ["1"], 1)]
    with pytest.raises(ValueError, match="queries has no id, text"):
        read_benchmark(spark, str(tmp_path), {"queries": "qrels.parquet"})


def test_sentences_and_what_fits_are_those_of_a_plain_fold(spark):
    import random
    import re

    from loomwright.functions.text import clean, compressed, sentences, strip

    random.seed(5)
    marks, blank = "。！？；\n.!?", [chr(i) for i in range(0x11000) if re.match(r"\s", chr(i))]
    texts = ["", " ", "\n \n", "a", " \n \n ", "\n\nFoo. \n  \nBar", "Ab.   \nA.b.c", ".\n\n x", "x \n. y", "。。a", *blank, "a" + "".join(blank), "".join(blank) + "a"]
    texts += ["".join(random.choice(["a", "é", "中", "😀", " ", "  ", "\n", "\n", ".", "!", "。", "　", "\t", "\x1c", "\r\n", "\xa0"]) for _ in range(random.randint(1, 40))) for _ in range(3000)]

    def plain(t):
        return [s for s in re.findall(rf"[^{marks}]*[{marks}]+|[^{marks}]+$", t) if s.strip()] or [t]

    def fits(t, cap):
        if len(t) <= cap:
            return t
        parts, out = plain(t), ""
        for s in parts:
            if len(out) + len(s) > cap:
                break
            out += s
        return parts[0][: max(cap, 0)] if len(parts[0]) > cap else out

    def tidy(t):
        for a, b in (("\xa0", " "), ("\r\n?", "\n"), ("[ \t]+", " "), ("\n{3,}", "\n\n")):
            t = re.sub(a, b, t)
        return t.strip()

    df = spark.createDataFrame([(i, t, i % 17 - 1) for i, t in enumerate(texts)], "i int, t string, cap int").repartition(8)
    got = df.select("t", "cap", sentences(F.col("t")).alias("s"), compressed(F.col("t"), F.col("cap")).alias("c"), strip(F.col("t")).alias("x"), clean(F.col("t")).alias("k")).collect()
    bad = [(r.t, r.cap, r.s, r.c) for r in got if (r.s, r.c, r.x, r.k) != (plain(r.t), fits(r.t, r.cap), r.t.strip(), tidy(r.t))]
    assert len(got) == len(texts) and not bad, (len(bad), bad[:5])


def test_long_texts_are_compressed_by_their_heads(spark):
    import time

    from loomwright.functions.text import compressed, sentences

    df = spark.createDataFrame([("A b. " * 40_000 + " " * 60_000 + "\n",)] * 8, "t string").repartition(8)
    began = time.time()
    assert {r.c for r in df.select(compressed(F.col("t"), F.lit(300)).alias("c")).collect()} == {("A b. " * 60)[:-1]}
    assert {r.n for r in df.select(F.size(sentences(F.col("t"))).alias("n")).collect()} == {40_000}
    assert time.time() - began < 30
