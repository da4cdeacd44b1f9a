"""Importance resampling, web archives and the filter audit against brute force, and on damage, repeats and restarts."""

import hashlib
import io
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwright.llm import interaction, resampling, warc

from .conftest import plain


def slow_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [zlib.crc32(f.encode()) % 10000 for f in w + [a + " " + b for a, b in zip(w, w[1:])]]


def slow_resample(rows, target):
    own = [(d, slow_features(t)) for d, t in rows]
    s, t = Counter(f for _, fs in own for f in fs), Counter(f for x in target for f in slow_features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * (big_s + 10000) / (float(s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for d, fs in own:
        weight = sum(gain[f] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= 39), key=lambda x: (-x[3], x[0] is None, x[0]))
    for i, x in enumerate(able[: 25 * len(able) // 100]):
        x[4] = i + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_resample(name, request, spark, sf_dir):
    df, b = request.getfixturevalue(name), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    df = df.unionByName(df.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    got = Counter(map(tuple, resampling.resample(df, b).collect()))
    assert got == slow_resample(plain(df), [r.text or "" for r in b.collect()])


def test_resample_repeats_and_empty(spark, docs, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    same = spark.createDataFrame([(7, "word " * 30)] * 41 + [(8, "other " * 30)] * 3, "doc_id long, text string")
    got = resampling.resample(same.repartition(4), b).collect()  # the cut falls among equal rows
    assert len(got) == 44 and sorted(r.rank for r in got if r.rank) == list(range(1, 12))
    assert resampling.resample(docs.where("false"), b).count() == 0
    assert resampling.resample(same, b.where("false")).count() == 44


@pytest.mark.parametrize("at_once", [1, 7, 50, 4 << 20])
def test_features_are_cut_between_words(at_once, monkeypatch):
    monkeypatch.setattr(resampling, "AT_ONCE", at_once)
    texts = ["One two  three", None, "", "x" * 200 + " y ü日本z9", "...", "same same same", "a" * 70]
    arrow = pa.array(["dropped first", *texts]).slice(1)
    found = [[] for _ in texts]
    for row, f in resampling.features(arrow):
        for r, x in zip(row.tolist(), f.tolist()):
            found[r].append(x)
    assert [sorted(x) for x in found] == [sorted(slow_features(t or "")) for t in texts]


@pytest.mark.parametrize("accuracy", [4, 100, 10_000])
def test_cutoff_widens_its_bracket(spark, accuracy):
    rows = [(int(1000 * math.sin(i)) if i % 3 else 5, i % 50 if i % 7 else None, i) for i in range(900)]
    df = spark.createDataFrame(rows, "score long, doc_id long, row long").repartition(5)
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    for k in (1, 2, 300, 455, 899, 900):
        assert resampling.cutoff(df, k, accuracy) == order[k - 1]


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>é" * 400, "<p>other" * 300
    rows = [(1, "http://a/ b\r\nX: y", big, 1), (2, None, big, 1), (3, "u", "short", 1), (4, "u", "short", 1), (5, "u", None, 1), (6, "u", "", 1), (None, "n", big, 1), (7, "u", "z" * 999, 1), (8, "u", "z" * 999, 1), (9, "u", other, 1), (9, "u", other, 1), (0, "u", other, 1), (11, "u", "x" * 3_000_000, 1), (None, "n", "q" * 2000, 1), (None, "n", "q" * 2000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, size int")
    clash = ("digest", "of", "of_size", "last", "refers_to", "n", "file", "place", "error", "record_type")
    return df.select("*", *[F.lit("clash").alias(c) for c in clash]).repartition(4)


def slow_pages(rows):
    last = {}
    for p, h in rows:
        if len(h) >= 1000 and p is not None:
            last[h] = max(last.get(h, p), p)
    out = [(p, len(h), hashlib.sha1(h).hexdigest(), last.get(h) if last.get(h) != p else None) for p, h in rows]
    return Counter((p, n, d, "response" if r is None else "revisit", r) for p, n, d, r in out)


def test_archived(spark, pages, sf_dir):
    for df in (pages, spark.read.parquet(f"{sf_dir}/pages.parquet")):
        rows = [(r.page_id, (r.html or "").encode()) for r in df.select("page_id", "html").collect()]
        assert Counter(map(tuple, warc.archived(df).collect())) == slow_pages(rows)
    assert warc.archived(pages.where("false")).count() == 0


def test_archives_roll_and_keep_payloads(spark, pages, tmp_path):
    archives = warc.write_archives(pages, f"file://{tmp_path}/w", file_bytes=500).collect()
    assert len(archives) > 4 and sum(a.records for a in archives) == 15
    got = warc.read_archives(spark.createDataFrame(archives), keep=True)
    assert warc.faults(got).count() == 0
    own = Counter((r.page_id, r.html or "") for r in pages.collect())
    assert not Counter((r.page_id, bytes(r.payload).decode()) for r in got.collect() if r.record_type == "response") - own
    assert {r.url for r in got.where("page_id = 1").collect()} == {"http://a/%20b%0D%0AX:%20y"}
    lost = got.where("not (record_type = 'response' and page_id = 9)")
    assert [r.error for r in warc.faults(lost).collect()] == ["no such response"]
    # what a lost task left is listed nowhere
    (tmp_path / "w" / "left.warc.gz").write_bytes(b"half")
    assert warc.read_archives(spark.createDataFrame(archives)).count() == 15


def test_every_record_is_a_gzip_member():
    one = warc.record(5, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None)
    text = zlib.decompress(one, 31)
    head, _, block = text.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and block.endswith(b"hello\r\n\r\n")
    assert f"Content-Length: {len(block) - 4}".encode() in head


class Drip(io.BytesIO):
    """A file that gives few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 11))


@pytest.mark.parametrize("kind", [io.BytesIO, Drip])
def test_damaged_archives(kind, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 13)
    rec = lambda i, p: warc.record(i, "u", p, hashlib.sha1(p).hexdigest(), None)
    packed = lambda t: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(t) + z.flush()
    good, plain_ = rec(1, b"one"), zlib.decompress(rec(2, b"payload two"), 31)
    read = lambda b: [(r["page_id"], r["error"]) for r in warc.read_archive(kind(b))]
    assert read(b"") == [] and read(good + rec(2, b"")) == [(1, None), (2, None)]
    assert read(good + packed(plain_.replace(b"payload two", b"payload 2wo")) + good) == [(1, None), (2, "block digest"), (1, None)]
    wrong = warc.record(3, "u", b"abc", hashlib.sha1(b"xyz").hexdigest(), None)
    assert read(wrong + good) == [(3, "payload digest"), (1, None)]
    assert read(packed(plain_ + b"more") + good) == [(None, "length"), (1, None)]
    assert read(packed(plain_[:-9]) + good) == [(None, "length"), (1, None)]
    assert read(packed(b"no header" * 9000) + good) == [(None, "header"), (1, None)]
    assert read(good + good[:-20]) == [(1, None), (None, "truncated")]
    assert read(good + b"not gzip at all" + good) == [(1, None), (None, "not gzip")]


def slow_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, t in labels if t == 1} - {None}
    ids = {}
    for d, t, _ in rows:
        if d is not None:
            ids[t] = min(ids.get(t, d), d)
    cases = []
    for d, t, part in rows:
        w = t.encode().split()
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": t in ids and (d is None or d > ids[t])}
        cases.append((part, frozenset(f for f in fails if fails[f]), d in good, d in toxic))
    cases = Counter(cases)
    out, shapley = {}, Counter()
    for part in {c[0] for c in cases}:
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before, sums = set(order[:k]), [0] * 6
                for (p, fails, g, x), n in cases.items():
                    if p == part:
                        hit, early = f in fails, bool(fails & before)
                        for i, c in enumerate([not hit and not early, hit and not early, hit and early, fails == {f}, hit and not early and g, hit and not early and x]):
                            sums[i] += n * c
                out[part, "".join(order), k + 1] = sums
                shapley[part, f] += sums[1]
    return {(p, o, k, *s, shapley[p, o[k - 1]]) for (p, o, k), s in out.items()}


def audited(df):
    return {tuple(r) for r in df.collect()}


def stored(df, path, files):
    df.repartition(files).write.mode("append").parquet(path)
    return [(r.doc_id, r.text or "", r.lang or "") for r in df.select("doc_id", "text", "lang").collect()]


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_audit(name, request, spark, sf_dir, tmp_path):
    df = request.getfixturevalue(name)
    df = df.unionByName(df.where("doc_id % 7 = 1").withColumn("doc_id", F.when(F.rand(3) < 0.3, F.lit(None)).otherwise(-F.col("doc_id"))))
    df = df.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("lang")))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").union(spark.createDataFrame([(1, None, 1), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int"))
    path = f"{tmp_path}/documents.parquet"
    df = df.cache()
    rows = stored(df, path, 9)
    want = slow_audit(rows, [tuple(r) for r in labels.collect()])
    for rounds in (1, 4):
        assert audited(interaction.audit(spark, path, labels, rounds=rounds)) == want
    df.unpersist()


def test_audit_goes_on_with_new_files_and_after_loss(spark, tmp_path, monkeypatch):
    text = " ".join(f"w{i}" for i in range(120))
    schema = "doc_id long, text string, lang string, n long"
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    path, at = f"{tmp_path}/documents", f"file://{tmp_path}/state"
    flags = [tuple(r) for r in labels.collect()]
    rows = stored(spark.createDataFrame([(9, text, "en", 0), (8, text, "de", 0), (4, "short", "en", 0)], schema), path, 1)
    assert audited(interaction.audit(spark, path, labels, at)) == slow_audit(rows, flags)
    rows += stored(spark.createDataFrame([(5, text, "fr", 0), (5, text, "en", 0), (3, "short", "en", 0)], schema), path, 2)
    whole, calls = interaction.fold, []

    def breaks(df, batch, folder):
        whole(df, batch, folder)
        calls.append(batch)
        if len(calls) == 1:
            raise RuntimeError("lost after its writes")

    monkeypatch.setattr(interaction, "fold", breaks)
    with pytest.raises(Exception, match="lost after"):
        interaction.audit(spark, path, labels, at)
    assert audited(interaction.audit(spark, path, labels, at)) == slow_audit(rows, flags)
    assert calls[0] == calls[1] == 1  # that batch ran twice and counts once
    rows += stored(spark.createDataFrame([(1, text, "de", 0), (7, text, "de", 0), (5, text, "en", 0)], schema), path, 1)
    assert audited(interaction.audit(spark, path, labels, at)) == slow_audit(rows, flags)


def test_audit_of_one_file_and_of_none(spark, docs, sf_dir, tmp_path):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = interaction.audit(spark, f"{sf_dir}/documents.parquet", labels.where("false"))
    assert got.where("good_lost + toxic_lost > 0").count() == 0 and got.count() % 600 == 0
    docs.where("false").write.parquet(f"{tmp_path}/none")
    assert interaction.audit(spark, f"{tmp_path}/none", labels).count() == 0
