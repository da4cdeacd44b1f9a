"""Files and reports, and search by inverted lists against exact search."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from loomwright.operators import catalog, evaluation, retrieval
from loomwright.sources import datasets, files

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_NS}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(text: str) -> str:
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_BYTES", 4000)
    (tmp_path / "huge.txt").write_text("x" * 5000)
    (tmp_path / "in").mkdir()
    (tmp_path / "a.txt").write_text("première\nligne")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "in" / "b.HTML").write_text("<title> T </title><p>x</p><script>y</script>")
    (tmp_path / "c.docx").write_bytes(docx(p(" one ") + p(" ") + f"<w:tbl><w:tr><w:tc>{p('k')}</w:tc><w:tc>{p('')}</w:tc><w:tc>{p('v')}</w:tc></w:tr></w:tbl>" + p("two")))
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "odd.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "x.csv").write_text("1,2")
    got = {r.file_name: r for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert got["huge.txt"].content is None and got["huge.txt"].error == "too large: 5000 bytes" and got["huge.txt"].document_id == "huge"
    assert set(got) - {"huge.txt"} == {"a.txt", "b.HTML", "c.docx", "broken.docx", "odd.txt"}
    assert got["a.txt"].content == "première\nligne" and got["a.txt"].document_id == "a"
    assert got["b.HTML"].title == "T" and "y" not in got["b.HTML"].content and got["b.HTML"].file_type == "html"
    assert got["c.docx"].content == "one\n\ntwo\n\nk\tv" and (got["c.docx"].n_parts, got["c.docx"].n_tables) == (2, 1)
    assert got["broken.docx"].content is None and got["broken.docx"].error and "Unicode" in got["odd.txt"].error
    with pytest.raises(ValueError):
        files.read_folder(spark, str(tmp_path), ("pdf",))


def test_one_file(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("one")
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.csv").write_text("1")
    assert files.read_file(spark, str(tmp_path / "a.TXT")).first().content == "one"
    with pytest.raises(ValueError, match="is none of"):
        files.read_file(spark, str(tmp_path / "c.csv"))
    with pytest.raises(ValueError, match="zip"):
        files.read_file(spark, str(tmp_path / "b.docx"))


def test_folder_as_a_source(spark, tmp_path):
    """Batch and stream give what read_folder gives; a stream takes each file once, and goes on after a stop."""
    from loomwright.sources.folder import FolderSource
    from loomwright.streaming.sinks import replayed

    spark.dataSource.register(FolderSource)
    at = tmp_path / "in"
    (at / "deep").mkdir(parents=True)
    for i in range(7):
        (at / ("deep" if i % 2 else "") / f"f{i}.txt").write_text(f"text {i} " * 40)
    (at / "h.html").write_text("<title> T </title><p>x</p>")
    (at / "broken.docx").write_bytes(b"no zip")
    (at / "empty.txt").write_text("")
    (at / "x.csv").write_text("1,2")
    rows = lambda df: sorted(map(str, df.collect()))
    whole = spark.read.format("files").option("taskBytes", "500").load(str(at))
    assert rows(whole) == rows(files.read_folder(spark, str(at))) and whole.rdd.getNumPartitions() > 3
    assert rows(spark.read.format("files").option("kinds", "html").load(str(at))) == rows(files.read_folder(spark, str(at), ("html",)))
    with pytest.raises(Exception, match="no pdf file"):
        spark.read.format("files").option("kinds", "pdf").load(str(at)).collect()
    run = lambda: replayed(spark.readStream.format("files").load(str(at)), f"{tmp_path}/out", f"{tmp_path}/progress")
    run()
    out = lambda: spark.read.schema(whole.schema).parquet(f"{tmp_path}/out").select(*whole.columns)
    assert rows(out()) == rows(whole)
    (at / "late.txt").write_text("late")
    run()
    run()
    assert rows(out()) == rows(files.read_folder(spark, str(at))) and out().count() == 10


def test_trend(spark, tmp_path):
    for commit, values in (("a1", [("recall", 0.5), ("mrr", 0.25)]), ("b2", [("recall", 0.75), ("ndcg", None)])):
        files.append_trend(spark.createDataFrame(values, "metric string, value double"), f"{tmp_path}/trend", commit)
    got = {(r.commit, r.metric, r.value) for r in files.read_trend(spark, f"{tmp_path}/trend").collect()}
    assert got == {("a1", "recall", 0.5), ("a1", "mrr", 0.25), ("b2", "recall", 0.75), ("b2", "ndcg", None)}


def test_evaluation_data(spark, tmp_path):
    lines = ['{"id": "a", "query": "q", "gold": {"documents": [{"document_id": "d", "spans": [{"start": 1, "end": 5}]}, {"document_id": "e", "relevance": 2}], "answers": ["x"]}, "metadata": {"k": "v"}, "more": 1}', '{"id": "b", "history": [{"role": "user", "content": "h"}]}']
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    (tmp_path / "s.json").write_text("[" + ",\n".join(lines) + "]")
    got = datasets.read_samples(spark, str(tmp_path / "s.jsonl"))
    assert got.collect() == datasets.read_samples(spark, str(tmp_path / "s.json"), lines=False).collect()
    gold = [tuple(r) for r in datasets.gold_documents(got).collect()]
    assert [(g[0], g[1], g[2], [tuple(s) for s in g[3]]) for g in gold] == [("a", "d", 1.0, [(1, 5)]), ("a", "e", 2.0, [])]
    (tmp_path / "q.json").write_text('{"q1": {"d": 1, "e": 0.5}, "q2": ["f", "g"], "q3": {}}')
    assert sorted(map(tuple, datasets.read_qrels(spark, str(tmp_path / "q.json")).collect())) == [("q1", "d", 1.0), ("q1", "e", 0.5), ("q2", "f", 1.0), ("q2", "g", 1.0)]
    (tmp_path / "m.json").write_text('{"name": "n", "size": 3, "files": {"a": 1}}')
    assert {(r.key, r.value) for r in datasets.read_manifest(spark, str(tmp_path / "m.json")).collect()} == {("name", "n"), ("size", "3"), ("files", '{"a":1}')}
    spans = '[{"query": "q", "relevant_spans": [{"start": 0, "end": 9}]}]'
    (tmp_path / "spans.json").write_text(spans)
    assert datasets.read_samples(spark, str(tmp_path / "spans.json"), False, datasets.SPANS).first().relevant_spans[0].end == 9


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "a",\nb'), (2, "x" * 205), (3, None)], "id long, answer string")
    files.write_report(evaluation.report(rows, "answer"), str(tmp_path / "r"))
    back = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(str(tmp_path / "r"))
    assert {r.id: r.answer for r in back.collect()} == {"1": 'say "a",\nb', "2": "x" * 200 + "...", "3": None}
    figures = spark.createDataFrame([("recall", 0.5)], "metric string, value double")
    for _ in range(2):
        files.append_figures(figures, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 2
    for name, said in (("a", '{"metrics": {"recall": 0.5, "note": "x"}, "k": 5}'), ("b", '{"recall": 1, "who": "y", "deep": {"z": 1}}')):
        (tmp_path / name).write_text(said)
    assert [tuple(r) for r in files.read_figures(spark, str(tmp_path / "a")).collect()] == [("recall", 0.5)]
    assert [tuple(r) for r in files.read_figures(spark, str(tmp_path / "b")).collect()] == [("recall", 1.0)]


def test_names(spark):
    docs = spark.createDataFrame([("a", "in/x.txt"), ("b", "c:\\in\\y.txt"), ("x", None), ("c", "noext")], "doc_id string, file_name string")
    asked = spark.createDataFrame([(n,) for n in ("a", "in/a.txt", "x.txt", "in/y.txt", "y.txt", "noext.md", "no", None)], "name string")
    got = {r.name: r.doc_id for r in catalog.named_documents(asked, docs).collect()}
    assert got == {"a": "a", "in/a.txt": "a", "x.txt": "x", "in/y.txt": "b", "y.txt": "b", "noext.md": "c", "no": None, None: None}


def test_sections(spark):
    docs = spark.createDataFrame([(1, "A one B two B"), (2, None), (3, "")], "doc_id long, content string")
    titles = spark.createDataFrame([(1, "B"), (1, "A"), (1, "Z"), (2, "A"), (3, "A")], "doc_id long, title string")
    assert sorted(tuple(r) for r in evaluation.sections(docs, titles).collect()) == [(1, 0, 6), (1, 6, 13)]


def test_inverted_lists(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in retrieval.dense(v, q).collect()}
    found = {(r.query_id, r.vec_id) for r in retrieval.inverted_lists(v, q).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    every = {(r.query_id, r.vec_id) for r in retrieval.inverted_lists(v, q, lists=8, probes=8).collect()}
    assert every == exact
