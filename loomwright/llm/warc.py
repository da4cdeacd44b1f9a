"""Web archives: one gzip member a record, written by tasks and read back as streams."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, materialise, text_or_empty, work_dir

#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 1000
#: An archive is closed once it has so many bytes; the next record opens another. Archives are read a task each.
FILE_BYTES = 128 << 20
#: Bytes that are read or inflated at once, and the most that the header of a record may have.
CHUNK, HEADER_BYTES = 1 << 20, 64 << 10
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "file string, records long, bytes long"
RECORDS = "file string, place long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


class Damaged(ValueError):
    """An archive that does not go on as its format has it."""


def _label(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _record_id(page_id: int | None) -> str:
    return "<urn:x-page:{}>".format("none" if page_id is None else page_id)


def _page_id(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit of the page `refers_to` without one."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}" if m[0] != "%" else "%", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: {_label(digest)}", f"WARC-Block-Digest: {_label(hashlib.sha1(block).hexdigest())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _members(f: BinaryIO) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(place in the file, its inflated bytes in pieces) of each gzip member; a member must be read to its end before the next."""
    held, place = f.read(CHUNK), 0

    def pieces() -> Iterator[bytes]:
        nonlocal held, place
        z = zlib.decompressobj(31)
        while not z.eof:
            if not held and not (held := f.read(CHUNK)):
                raise Damaged("truncated")
            try:
                out = z.decompress(held, CHUNK)
            except zlib.error as e:
                raise Damaged("not gzip") from e
            left = z.unused_data if z.eof else z.unconsumed_tail
            place += len(held) - len(left)
            held = left
            if out:
                yield out
        held = held or f.read(CHUNK)

    while held:
        yield place, pieces()


def _record(pieces: Iterator[bytes], keep: bool) -> dict:
    """The fields of one record. Its block is hashed as it comes; only a payload to be kept is held whole."""
    seen = b""
    while (end := seen.find(b"\r\n\r\n")) < 0:
        if len(seen) > HEADER_BYTES or not (more := next(pieces, b"")):
            raise Damaged("header")
        seen += more
    first, *lines = seen[:end].decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not first.startswith("WARC/") or not fields.get("content-length", "").isdigit():
        raise Damaged("header")
    left, rest = int(fields["content-length"]), seen[end + 4 :]
    block, payload, http, kept, size = hashlib.sha1(), hashlib.sha1(), b"", [], 0
    in_http = fields.get("content-type", "").startswith("application/http")
    while left:
        if not rest and not (rest := next(pieces, b"")):
            raise Damaged("length")
        now, rest = rest[:left], rest[left:]
        left -= len(now)
        block.update(now)
        if in_http:
            http += now
            if (cut := http.find(b"\r\n\r\n")) < 0:
                if len(http) > HEADER_BYTES:
                    raise Damaged("header")
                continue
            now, http, in_http = http[cut + 4 :], http[:cut], False
        payload.update(now)
        size += len(now)
        if keep:
            kept.append(now)
    while len(rest) <= 4 and (more := next(pieces, b"")):
        rest += more
    if rest != b"\r\n\r\n":
        for _ in pieces:  # to the member's end, so that the next can be read
            pass
        raise Damaged("length")
    kind, said = fields.get("warc-type"), fields.get("warc-payload-digest", "")
    out = {"page_id": _page_id(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _page_id(fields.get("warc-refers-to")), "payload_bytes": size, "payload_digest": payload.hexdigest(), "payload": b"".join(kept) if keep else None, "error": None}
    if kind == "revisit":  # the payload is elsewhere: what is said of it
        told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        named = re.fullmatch("sha1:([A-Z2-7]{32})", said)
        out |= {"payload_bytes": int(told[1]) if told else None, "payload_digest": base64.b32decode(named[1]).hex() if named else None, "payload": None}
    elif said and said != _label(payload.hexdigest()):
        out["error"] = "payload digest"
    if fields.get("warc-block-digest") not in (None, _label(block.hexdigest())):
        out["error"] = "block digest"
    return out


def read_archive(f: BinaryIO, keep: bool = False) -> Iterator[dict]:
    """Fields of each record of an archive, in order, with its `place` in the file.

    Digests are verified over what is read: `error` names the one that fails. A member that isn't one whole record is a
    row with an error; where the file ends amid a member or isn't gzip, reading stops after such a row.
    """
    empty = dict.fromkeys(["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
    for place, pieces in _members(f):
        try:
            out = _record(pieces, keep)
        except Damaged as e:
            yield empty | {"place": place, "error": str(e)}
            if str(e) in ("truncated", "not gzip"):
                return
            try:
                for _ in pieces:
                    pass
            except Damaged:
                return
        else:
            yield out | {"place": place}


def shared_uri(spark: SparkSession, name: str) -> str:
    """A folder of that name in the shared one, with its scheme, as tasks open it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/{name}")
    at = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", at)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html) into archives in the folder, an URI that pyarrow opens; (file, records, bytes) of each.

    Of rows of equal payload of at least `least` bytes (equal SHA-1 and length), those of the largest page_id are
    responses and the others revisit that; one row of each such payload goes to the join, so copies are no hot key. A
    task's files have names of their own and are listed once they are closed: what a lost task leaves is listed nowhere.
    """
    t = text_or_empty("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), t.alias("html"), F.sha1(t.cast("binary")).alias("digest"))
    sized = rows.select("page_id", "digest", F.octet_length("html").alias("size")).where(F.col("size") >= least)
    same = sized.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last")).where("n > 1 and last is not null")
    same = materialise(same.select(F.col("digest").alias("of"), F.col("size").alias("of_size"), "last"), "same")
    told = rows.join(broadcast_if_small(same), (F.col("digest") == F.col("of")) & (F.octet_length("html") == F.col("of_size")), "left")
    todo = told.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, records, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records]), pa.array([size])], names=["file", "records", "bytes"])

        try:
            for x in batches:
                for i in range(x.num_rows):
                    if out is None:
                        name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    page_id, url, html, digest, refers_to = (c[i] for c in x.columns)
                    out.write(r := record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), digest.as_py(), refers_to.as_py()))
                    records, size = records + 1, size + len(r)
                    if size >= file_bytes:
                        yield closed()
                        out = None
            if out is not None:
                yield closed()
                out = None
        finally:
            if out is not None:
                out.close()

    return materialise(todo.mapInArrow(write, MANIFEST), "archives")


def read_archives(archives: DataFrame, keep: bool = False) -> DataFrame:
    """The records of all archives(file, ..), each read by one task from its start to its end; with `keep`, their payloads.

    Rows have the file and the place of their member in it, and an error where a record is damaged. A revisit has the
    size and digest that are told of its payload.
    """
    kinds = T._parse_datatype_string(RECORDS)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for file in x["file"].to_pylist():
                fs, path = FileSystem.from_uri(file)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as f:
                    for r in read_archive(f, keep):
                        rows.append(r | {"file": file})
                        held += 200 + len(r["payload"] or b"")
                        if held > CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = archives.select("file")
    return files.repartition(max(1, files.count())).mapInArrow(read, RECORDS)


def faults(records: DataFrame) -> DataFrame:
    """(file, place, page_id, error): damaged records, and revisits (one of each kind) of a page that is no response of their digest."""
    said = records.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest", "payload_bytes").agg(F.min(F.struct("file", "place", "page_id")).alias("r"))
    there = records.where("record_type = 'response' and error is null").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    lost = said.join(there, ["refers_to", "payload_digest", "payload_bytes"], "left_anti").select("r.*", F.lit("no such response").alias("error"))
    return records.where("error is not null").select("file", "place", "page_id", "error").unionByName(lost)


def archived(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row, from archives written into the shared folder and read back.

    Null pages are empty payloads. Rows of null page_id are responses if no page_id has their payload, else revisits;
    their page_id is null again. Rows that repeat the largest page_id of a payload are all responses. A long page is one
    record, deflated and inflated in parts. Other columns are left out, whatever their names. An empty table gives an
    empty one. Any damage found in reading is an error.
    """
    spark = pages.sparkSession
    archives = write_archives(pages, shared_uri(spark, f"warc-{uuid.uuid4().hex}"))
    records = materialise(read_archives(archives).drop("payload"), "records")
    if bad := faults(records).first():
        raise Damaged(f"{bad.file} at {bad.place}: {bad.error}")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
