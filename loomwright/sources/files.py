"""Folders of text, HTML, DOCX and PDF files to documents; reports and figures as files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html import read_html

try:
    import pypdf
except ImportError:  # then PDF files have an error in place of content
    pypdf = None

#: Larger files are not read.
MOST_BYTES = 50 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SCHEMA = "document_id string, file_name string, file_path string, file_type string, title string, n_parts int, n_tables int, content string, error string"


def _runs(p: ElementTree.Element) -> str:
    """The text of a paragraph; tabs and breaks are characters of it."""
    marks = {_W + "tab": "\t", _W + "br": "\n", _W + "cr": "\n"}
    return "".join(e.text or "" if e.tag == _W + "t" else marks.get(e.tag, "") for e in p.iter())


def read_docx(raw: bytes) -> tuple[str, int, int]:
    """(text, paragraphs, tables): paragraphs with text, then rows of tables with their cells parted by tabs, all parted by empty lines."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
    texts = [s for p in body.findall(_W + "p") if (s := _runs(p).strip())]
    tables = body.findall(_W + "tbl")
    rows = []
    for tr in (r for table in tables for r in table.findall(_W + "tr")):
        cells = ["\n".join(map(_runs, c.findall(_W + "p"))).strip() for c in tr.findall(_W + "tc")]
        rows.append("\t".join(c for c in cells if c))
    return "\n\n".join(texts + [r for r in rows if r]), len(texts), len(tables)


def read_pdf(raw: bytes) -> tuple[str, int]:
    """(text, pages): the pages that have text, parted by empty lines."""
    if pypdf is None:
        raise ValueError("no PDF reader is installed")
    pages = pypdf.PdfReader(io.BytesIO(raw)).pages
    texts = []
    for p in pages:
        try:
            texts.append((p.extract_text() or "").strip())
        except Exception:  # noqa: BLE001: a page that can't be read is passed over
            continue
    return "\n\n".join(t for t in texts if t), len(pages)


#: The suffixes of the files that can be read.
KINDS = ("txt", "html", "docx", "pdf")


def _document(kind: str, raw: bytes) -> tuple[str | None, int, int, str]:
    """(title, parts, tables, content) of a file of this kind."""
    if kind == "txt":
        return None, 1, 0, raw.decode("utf-8")
    if kind == "html":
        title, text = read_html(raw.decode("utf-8"))
        return title, 1, 0, text
    if kind == "docx":
        text, parts, tables = read_docx(raw)
        return None, parts, tables, text
    text, pages = read_pdf(raw)
    return None, pages, 0, text


def read_folder(spark: SparkSession, folder: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """A row for each file of these kinds in the folder and those below it.

    The kind is the suffix, in either case. A file that can't be read, or has over MOST_BYTES, has no content and tells
    why in `error`, so that one broken file doesn't end a large job. Spark passes over files without a byte. A folder without any such file raises ValueError.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", "[^/]*$", 0)
    every = files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("kind"), "length", "content").where(F.col("kind").isin(*kinds))
    if every.select("path").isEmpty():
        raise ValueError(f"no {', '.join(kinds)} file in {folder}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = []
            for path, file, kind, raw in zip(*(x[c].to_pylist() for c in ("path", "name", "kind", "content")), strict=True):
                own = {"document_id": file.rpartition(".")[0], "file_name": file, "file_path": path, "file_type": kind}
                try:
                    own["title"], own["n_parts"], own["n_tables"], own["content"] = _document(kind, raw)
                except (ValueError, KeyError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    own["error"] = f"{type(e).__name__}: {e}"
                rows.append(own)
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    found = every.where(F.col("length") <= MOST_BYTES).select("path", "name", "kind", "content").mapInArrow(read, _SCHEMA)
    large = every.where(F.col("length") > MOST_BYTES)
    own = {"document_id": F.regexp_replace("name", r"\.[^.]*$", ""), "file_name": F.col("name"), "file_path": F.col("path"), "file_type": F.col("kind"), "error": F.concat(F.lit("too large: "), F.col("length").cast("string"), F.lit(" bytes"))}
    return found.unionByName(large.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in found.schema.fields]))


def read_file(spark: SparkSession, path: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The row of one file, as `read_folder` has it. A suffix that isn't among the kinds raises ValueError, and so does a file that can't be read."""
    suffix = path.rpartition("/")[2].rpartition(".")[2].lower()
    if suffix not in kinds:
        raise ValueError(f"{path} is none of {', '.join(kinds)}")
    row = read_folder(spark, path, kinds)
    if why := row.select("error").first().error:
        raise ValueError(f"{path}: {why}")
    return row


_ARROW = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in _SCHEMA.split(", ")])


def write_report(rows: DataFrame, path: str) -> None:
    """rows as CSV with a header in each file; quotes inside are doubled and line feeds stay in their fields."""
    rows.write.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(path)


def append_figures(figures: DataFrame, path: str) -> None:
    """Adds the rows (metric, value) of a run to those of earlier runs."""
    figures.select("metric", F.col("value").cast("double"), F.current_timestamp().alias("at")).write.mode("append").json(path)


def append_trend(figures: DataFrame, path: str, commit: str) -> None:
    """Adds a row to the CSV of runs: when, which commit, and each of figures(metric, value) as a column by name. A run's file has its own header, as metrics come and go."""
    row = figures.groupBy().pivot("metric").agg(F.first(F.col("value").cast("double")))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    row.select(stamp.alias("timestamp"), F.lit(commit).alias("commit"), *sorted(row.columns)).coalesce(1).write.mode("append").option("header", "true").csv(path)


def read_trend(spark: SparkSession, path: str) -> DataFrame:
    """(timestamp, commit, metric, value) of all runs, whichever columns each has."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    head = lines.where("value like 'timestamp,%'").select("file", F.split("value", ",").alias("names"))
    said = lines.where("value not like 'timestamp,%'").select("file", F.split("value", ",").alias("v"))
    x = said.join(head, "file").select(F.col("v")[0].alias("timestamp"), F.col("v")[1].alias("commit"), F.explode(F.arrays_zip(F.slice("names", 3, 1000).alias("metric"), F.slice("v", 3, 1000).alias("said"))).alias("p"))
    return x.select("timestamp", "commit", "p.metric", F.expr("try_cast(p.said AS double)").alias("value"))


def read_figures(spark: SparkSession, path: str, under: str = "metrics") -> DataFrame:
    """(metric, value) of JSON documents, from the object `under` or, where there is none, from the top; only numbers count."""
    whole = spark.read.text(path, wholetext=True)
    top = F.from_json("value", "map<string,string>")
    inner = F.from_json(F.get_json_object("value", f"$.{under}"), "map<string,string>")
    pairs = whole.select(F.explode(F.coalesce(inner, top)).alias("metric", "said"))
    return pairs.select("metric", F.expr("try_cast(said AS double)").alias("value")).where("value is not null")
