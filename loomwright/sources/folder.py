"""Folders of files as a data source of Spark's: spark.read.format("files") and readStream give what `files.read_folder` gives."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .files import _ARROW, _SCHEMA, KINDS, MOST_BYTES, _document

#: Bytes of files that a task reads; a larger file has a task to itself.
TASK_BYTES = 32 << 20


class Files(InputPartition):
    """Files (path, bytes) for one task."""

    def __init__(self, files: list[tuple[str, int]]) -> None:
        super().__init__(0)
        self.files = files


class _Folder:
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"] if "://" in options["path"] else f"file://{options['path']}"
        self.kinds = tuple(options.get("kinds", ",".join(KINDS)).split(","))
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))

    def listed(self) -> list[tuple[int, str, int]]:
        """(time of change, path, bytes) of the files of these kinds in the folder and below it that have a byte, by time and path."""
        fs, base = FileSystem.from_uri(self.root)
        found = fs.get_file_info(FileSelector(base, recursive=True))
        return sorted((f.mtime_ns, f.path, f.size) for f in found if f.type == FileType.File and f.size and f.extension.lower() in self.kinds)

    def planned(self, found: list[tuple[int, str, int]]) -> list[Files]:
        """The files in parts of about task_bytes."""
        parts, held = [[]], 0
        for _, path, size in found:
            if parts[-1] and held + size > self.task_bytes:
                parts.append([])
                held = 0
            parts[-1].append((path, size))
            held += size
        return [Files(p) for p in parts if p]

    def rows(self, files: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
        fs, _ = FileSystem.from_uri(self.root)
        for path, size in files:
            name = path.rpartition("/")[2]
            kind = name.rpartition(".")[2].lower()
            own = {"document_id": name.rpartition(".")[0], "file_name": name, "file_path": f"file:{path}" if self.root.startswith("file:") else path, "file_type": kind}
            if size > MOST_BYTES:
                own["error"] = f"too large: {size} bytes"
            else:
                try:
                    with fs.open_input_stream(path, compression=None) as f:
                        own["title"], own["n_parts"], own["n_tables"], own["content"] = _document(kind, f.read())
                except (ValueError, KeyError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    own["error"] = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_pylist([own], schema=_ARROW)


class FolderReader(DataSourceReader, _Folder):
    def partitions(self) -> list[Files]:
        found = self.listed()
        if not found:
            raise ValueError(f"no {', '.join(self.kinds)} file in {self.root}")
        return self.planned(found)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.rows(partition.files)


class FolderStream(DataSourceStreamReader, _Folder):
    """A stream of the files as they come: an offset is the time and path of the last one taken. Files that change are taken again."""

    def initialOffset(self) -> dict:
        return {"after": json.dumps([0, ""])}

    def latestOffset(self) -> dict:
        found = self.listed()
        return {"after": json.dumps(list(found[-1][:2]))} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        a, b = (tuple(json.loads(x["after"])) for x in (start, end))
        return self.planned([f for f in self.listed() if a < f[:2] <= b]) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.rows(partition.files)


class FolderSource(DataSource):
    """Register it once with spark.dataSource.register(FolderSource). Options: path, kinds (by commas), taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(self.options)
