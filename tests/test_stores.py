"""Term tables, stores and streams over updates, failures and restarts; vectors of texts against their definition."""

import math
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import embedding as vectors
from loomwright.operators import embedding, evaluation, retrieval, tables
from loomwright.operators.store import Store, complete
from loomwright.operators.terms import TermStore
from loomwright.streaming import percentiles, sinks

TEXTS = [(1, "One two two ÜBER"), (2, ""), (3, None), (4, "日本 x9 9x — two"), (5, "..."), (6, "word " * 500)]


def defined(text, dim):
    v = np.zeros(dim)
    for w in text.lower().replace("日本", " 日 本 ").replace("—", " ").replace(".", " ").split():
        c = int(md5(w.encode()).hexdigest()[:8], 16) % (2 * dim)
        v[c // 2] += 2 * (c % 2) - 1
    long = np.linalg.norm(v)
    return v / long if long else None


def test_vectors_of_texts(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for dim in (8, 256):
        a = {r.doc_id: r.embedding for r in vectors.hashed(df, dim=dim).collect()}
        model = vectors.encoder(lambda dim=dim: vectors.HashingModel(dim), f"hashing-{dim}", dim, at_once=2)
        b = {r.doc_id: r.embedding for r in df.select("doc_id", model("text").alias("embedding")).collect()}
        for i, t in TEXTS:
            want = None if t is None else defined(t, dim)
            for got in (a[i], b[i]):
                assert (got is None) == (want is None) and (want is None or np.allclose(got, want))
    # a filter on the vectors must not be worked out beneath them
    assert vectors.hashed(df).where("embedding is not null").count() == 3


def test_models_are_loaded_once_a_worker_and_checked(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return lambda texts: np.ones((len(texts), 3))

    df = spark.range(40).repartition(4).select(F.col("id").cast("string").alias("text"))
    got = df.select(vectors.encoder(load, "ones", 3, 4)("text").alias("v")).collect()
    assert all(np.allclose(r.v, 1 / math.sqrt(3)) for r in got)
    loads = len(list(tmp_path.iterdir()))
    assert 1 <= loads <= spark.sparkContext.defaultParallelism
    for bad in (lambda t: np.ones((len(t), 2)), lambda t: np.full((len(t), 3), np.nan)):
        with pytest.raises(Exception, match="were due"):
            df.select(vectors.encoder(lambda bad=bad: bad, f"bad-{id(bad)}", 3)("text").alias("v")).collect()


def test_routes_are_encoded_once_and_merged(spark):
    docs = spark.createDataFrame([(1, "red green"), (2, "green blue"), (3, "blue"), (4, "grey"), (5, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(7, 0, "red green"), (7, 1, "blue"), (8, 0, "blue"), (8, 1, "blue"), (9, 0, ""), (9, 1, None)], "query_id long, route int, text string")
    seen = spark.sparkContext.accumulator(0)
    v = embedding.embedded(docs, vectors.hashed)

    def encode(df):
        seen.add(df.count())
        return vectors.hashed(df)

    got = embedding.search_routes(v, queries, encode, k=3, pool=4).collect()
    assert seen.value == 3  # different texts but for the null one
    best = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (7, 8, 9)}
    assert best[7][:2] in ([1, 3], [3, 1]) and best[8][0] == 3 and best[9] == []
    only = embedding.search(v, queries, vectors.hashed, 2, docs.where("doc_id > 2").select(F.col("doc_id").alias("vec_id"))).collect()
    assert {r.vec_id for r in only} <= {3, 4}


def test_vectors_of_another_length_are_not_met(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0, 1.0, 1.0]), (4, None)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (3, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    assert {(r.query_id, r.vec_id) for r in retrieval.dense(v, q, 5).collect()} == {(1, 1), (1, 2), (3, 3)}


def test_workers_are_handed_few_texts_and_blocks_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "HANDED", 100_000, raising=False)
    folder, name = str(tmp_path), "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)

    def said(kind, n):
        import uuid

        open(f"{folder}/{kind}-{n}-{uuid.uuid4().hex}", "w").close()

    def model(texts):
        said("texts", len(texts))
        return np.ones((len(texts), 2))

    encode = lambda df: df.withColumn("embedding", vectors.encoder(lambda: model, "counts", 2, 1000)("text"))
    docs = spark.range(800).select(F.col("id").alias("doc_id"), F.repeat(F.lit("words "), 4000).alias("text"))
    assert embedding.embedded(docs, encode).where("embedding is not null").count() == 800
    tops = retrieval._block_tops

    def spied(k):
        inner = tops(k)

        def score(batches):
            for x in batches:
                said("blocks", x.num_rows)
                yield from inner(iter([x]))

        return score

    monkeypatch.setattr(retrieval, "_block_tops", spied)
    v = spark.range(13_000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "query_id long, embedding array<double>")
    hits = {(r.query_id, r.rank): r.vec_id for r in retrieval.dense(v, q, 2).collect()}
    assert hits == {(1, 1): 12_999, (1, 2): 12_998, (2, 1): 0, (2, 2): 1}
    most = lambda kind: max(int(p.name.split("-")[1]) for p in tmp_path.glob(f"{kind}-*"))
    assert most("texts") <= 6 and most("blocks") == 1
    assert spark.conf.get(name) == was


@pytest.mark.parametrize("variant", ["okapi", "lucene"])
def test_terms_after_updates_are_those_from_nothing(spark, tmp_path, variant, monkeypatch):
    docs = {i: f"alpha {'beta ' * (i % 4)} term{i % 5} gamma{i} {'delta' if i % 3 else ''}" for i in range(40)}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "doc_id long, text string")
    queries = spark.createDataFrame([(1, "beta delta term3"), (2, "alpha gamma7 gamma7"), (3, "nothing here"), (4, "new words")], "query_id long, text string")
    rows = lambda df: sorted((r.query_id, r.doc_id, round(r.score, 9), r.rank) for r in df.collect())
    store = TermStore(spark, f"file://{tmp_path}/t", buckets=4)
    steps = [(docs, []), ({3: "new words beta", 50: "term3 new", 7: None}, [1, 2, 999]), ({3: "beta beta", 1: "alpha again"}, [50])]
    live = {}
    for n, (new, gone) in enumerate(steps):
        known = [i for i in gone if i in live]
        for i in gone:
            live.pop(i, None)
        live |= new
        assert store.update(frame(new), spark.createDataFrame([(i,) for i in gone], "doc_id long") if gone else None) == n + 1
        assert known or not n
        whole = frame({i: t or "" for i, t in live.items()})
        assert rows(store.search(queries, 5, variant)) == rows(retrieval.bm25(whole, queries, 5, variant))
        if n == 1:
            second = rows(store.search(queries, 5, variant))
            # an update that is lost before its figures leaves the version as it is, and can be run again
            monkeypatch.setattr("loomwright.operators.files.create", lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                store.update(frame({9: "lost"}))
            monkeypatch.undo()
            assert store.version() == 2 and rows(store.search(queries, 5, variant)) == second
    assert rows(store.search(queries, 5, variant, version=2)) == second


def test_an_update_reads_only_what_it_touches(spark, tmp_path):
    store = TermStore(spark, f"file://{tmp_path}/t", buckets=8)
    store.update(spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("common w"), F.col("id").cast("string")).alias("text")))
    store.update(spark.createDataFrame([(3, "common changed")], "doc_id long, text string"))
    second = spark.read.parquet(f"file://{tmp_path}/t/postings/version=2")
    assert second.count() == 2
    hits = store.search(spark.createDataFrame([(1, "w5")], "query_id long, text string"))
    assert [r.doc_id for r in hits.collect()] == [5]


def stored(store, version=None):
    return sorted((r.doc_id, r.tenant, r.strategy, r.text) for r in store.read(version).collect())


def test_store(spark, tmp_path):
    schema = "doc_id long, tenant string, strategy string, text string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    store = Store(spark, f"file://{tmp_path}/s", buckets=4)
    first = [(i, "a" if i % 3 else None, "fixed" if i % 2 else "recursive", f"t{i}") for i in range(30)]
    assert store.publish(frame(first)) == 1
    assert stored(store) == sorted(first, key=lambda r: (r[0], r[1] or "")) or {*stored(store)} == {*first}
    # refused by its check, or lost amid its write: the version before stays readable
    with pytest.raises(ValueError, match="missing"):
        store.publish(frame(first[:3]), complete(frame(first), "doc_id"))
    broken = frame(first).withColumn("text", F.when(F.col("doc_id") == 29, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        store.publish(broken)
    assert store.versions() == [1] and {*stored(store)} == {*first}
    # one tenant's publish leaves the others
    assert store.publish(frame([(99, "a", "fixed", "only")])) == 2
    second = {r for r in first if (r[1], r[2]) != ("a", "fixed")} | {(99, "a", "fixed", "only")}
    assert {*stored(store)} == second
    # documents replaced, new and removed: equal to a rebuild, and untouched folders keep their snapshot
    new, gone = [(6, None, "recursive", "changed"), (40, "b", "fixed", "new"), (40, "b", "fixed", "twice")], frame([(12, None, "recursive", None), (5, "zz", "fixed", None), (99, "a", "fixed", None)]).drop("text")
    before = {tuple(r) for r in store._pointers(2).collect()}
    assert store.reindex(frame(new), gone) == 3
    third = {r for r in second if r[0] not in (6, 12, 99)} | {*new}
    assert {*stored(store)} == third and len(stored(store)) == len(third)
    assert {tuple(r) for r in store._pointers(3).collect()} & before
    # versions before it stay, and one of them becomes the latest again
    assert {*stored(store, 1)} == {*first}
    assert store.rollback(1) == 4 and {*stored(store)} == {*first}
    assert [(r.version, r.action, r.parent) for r in store.history().collect()] == [(1, "publish", 0), (2, "publish", 1), (3, "reindex", 2), (4, "rollback", 1)]
    assert len(store.vacuum(keep=1)) >= 3 and {*stored(store)} == {*first}
    # of two writers that began at one version, one wins
    other = Store(spark, f"file://{tmp_path}/s", buckets=4)
    real = Store._snapshot

    def late(self, rows, check):
        got = real(self, rows, check)
        if self is store:
            other.publish(frame([(1, "c", "fixed", "x")]))
        return got

    with pytest.MonkeyPatch.context() as m:
        m.setattr(Store, "_snapshot", late)
        with pytest.raises(RuntimeError, match="meanwhile"):
            store.publish(frame([(2, "d", "fixed", "y")]))
    assert {r[1] for r in stored(store)} == {"a", None, "c"}
    removed = frame([(i, t, s, None) for i, t, s, _ in first] + [(1, "c", "fixed", None)]).drop("text")
    store.reindex(frame([]), removed)
    assert stored(store) == []


def test_streamed_percentiles_after_restart(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", percentiles.STATE_STORE)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("value"))
    run = lambda s: sinks.replayed(percentiles.percentiles(s, "event_type", "value", ["ts", "event_id"], 50), f"{tmp_path}/out", f"{tmp_path}/progress")
    try:
        for k in range(3):
            events.where(f"floor(event_id * 3 / 1000) = {k}").write.mode("append").parquet(f"{tmp_path}/in")
            run(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.event_id: (r.samples, r.p50, r.p95) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    for q, at in ((0.5, 1), (0.95, 2)):
        want = evaluation.rolling_percentile(events, "event_type", "value", ["ts", "event_id"], q, 50)
        bad = [r for r in want.collect() if r.p is not None and got[r.event_id][at] != r.p]
        # a null takes a place in the batch window's rows and none here
        assert not [r for r in bad if r.samples == got[r.event_id][0]]
    assert len(got) == events.count()


def test_insert_ignore_stream_killed_amid_a_batch(spark, tmp_path, monkeypatch):
    schema = "id long, k string, v long"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    at = str(tmp_path)
    run = lambda: sinks.insert_ignore(spark.readStream.schema(schema).parquet(f"{at}/in"), f"{at}/out", ["k"], ["id"], f"{at}/progress", buckets=2)
    rows = lambda: sorted((r.id, r.k, r.v) for r in sinks.table(spark, f"{at}/out", frame([]).schema).collect())
    frame([(2, "a", 1), (1, "a", 2), (3, None, 3), (4, None, 4)]).write.parquet(f"{at}/in")
    run()
    assert rows() == [(1, "a", 2), (3, None, 3)]
    frame([(0, "a", 9), (6, "b", 5), (5, "b", 6), (7, None, 1)]).write.mode("append").parquet(f"{at}/in")
    real = sinks.written
    monkeypatch.setattr(sinks, "written", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="division"):
        run()
    monkeypatch.setattr(sinks, "written", real)
    run()
    run()
    assert rows() == [(1, "a", 2), (3, None, 3), (5, "b", 6)]
    # a batch whose rows are there but which is not in the stream's log is written again, not twice
    last = max((tmp_path / "progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    crc = last.with_name(f".{last.name}.crc")
    last.unlink()
    if crc.exists():
        crc.unlink()
    run()
    assert rows() == [(1, "a", 2), (3, None, 3), (5, "b", 6)]


def test_insert_ignore_broadcasts_no_rows_of_the_table(spark, tmp_path):
    at, wide = str(tmp_path), F.repeat(F.col("p"), 1000)
    put = lambda ids: ids.select("id", F.concat(F.lit("p"), F.col("id") % 7).alias("p"), (F.col("id") % 3000).alias("u")).write.mode("append").parquet(f"{at}/in")
    make = lambda df: df.withColumn("detail", wide)
    run = lambda: sinks.insert_ignore(spark.readStream.schema("id long, p string, u long").parquet(f"{at}/in"), f"{at}/out", ["u", "detail"], ["id"], f"{at}/progress", buckets=2, made=make, columns=["id", "u", "detail"])
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4m")  # the files are small, the rows are not
    try:
        put(spark.range(4000))
        run()
        put(spark.range(4000, 30000))
        run()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    got = sinks.table(spark, f"{at}/out", spark.createDataFrame([], "id long, u long, detail string").schema).collect()
    assert {(r.id, r.u, r.detail) for r in got} == {(i, i % 3000, f"p{i % 7}" * 1000) for i in range(21000)} and len(got) == 21000


def test_terms_are_kept_by_version(spark, tmp_path):
    from loomwright.operators import files

    rows = [(1, "one two"), (2, "two"), (3, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    read = lambda: spark.read.parquet(f"{tmp_path}/docs")
    v = files.version(read())
    told = lambda t: [tuple(r) for r in t.collect()]
    first = retrieval.term_table(read(), v)
    assert len(told(first)) == 4 and (3, 0, None, None) in [tuple(r) for r in first.collect()]
    assert retrieval.term_table(read(), files.version(read())).inputFiles() == first.inputFiles()  # found, not written
    spark.createDataFrame([(5, "three")], "doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/docs")
    assert files.version(read()) != v and len(told(retrieval.term_table(read(), files.version(read())))) == 5
    assert files.version(spark.range(1)) != files.version(spark.range(1))  # no files, no version
