"""Small files of any file system that Spark reaches: listed, read, and created once."""

from __future__ import annotations

import re
import uuid
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none if it isn't there. Names that begin with a dot or an underscore are passed over."""
    p, fs = _at(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in found if not n.startswith((".", "_")))


def text(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    f = fs.open(p)
    try:
        return bytes(f.readAllBytes()).decode()
    finally:
        f.close()


def create(spark: SparkSession, path: str, content: str) -> bool:
    """Writes a file that isn't there yet; False, and nothing written, if it is: of two writers one wins.

    The content is written beside it and moved, so that nobody reads half of it; the move refuses to replace a file, on file systems that move in one step.
    """
    p, fs = _at(spark, path)
    if fs.exists(p):
        return False
    beside = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(content.encode()))
    out.close()
    if fs.rename(beside, p):
        return True
    fs.delete(beside, False)
    return False


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Moves a folder to a place that isn't taken; False if it is."""
    p, fs = _at(spark, path)
    return not exists(spark, to) and fs.rename(p, _at(spark, to)[0])


def version(df: DataFrame) -> str:
    """A key of the files that df reads: it changes when one of them comes, goes or is written again. A folder is listed at once. A frame that reads no files has another key each time."""
    spark = df.sparkSession
    mine = set(df.inputFiles())
    told = []
    for parent in sorted({f.rpartition("/")[0] for f in mine}):
        p, fs = _at(spark, parent)
        told += [f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}" for s in fs.listStatus(p)]
    plain = lambda f: re.sub("^file:/+", "file:///", f)
    names = {plain(f) for f in mine}
    found = sorted(x for x in told if plain(x.rpartition("|")[0].rpartition("|")[0]) in names)
    if not mine or len(found) != len(mine):  # what can't be told has no version twice
        return uuid.uuid4().hex[:24]
    return sha256("\n".join(found).encode()).hexdigest()[:24]


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)
