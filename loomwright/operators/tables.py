"""Tables that several steps read: written once to the shared folder, spread over tasks, broadcast by size."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a side that may be broadcast once they are summed.
BROADCAST_BYTES = 16 << 20
#: Bytes of rows that a Python worker is handed at a time; a larger row comes alone.
HANDED = 8 << 20


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where that is unset, one of its own on one machine, elsewhere an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-loomwright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: lineage ends here."""
    path = f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def handed(spark: SparkSession) -> Iterator[None]:
    """Within it, queries hand Python workers HANDED bytes at a time rather than 64 MB, so that few texts or blocks of vectors are held at once; those that are lazy must be written there."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name, "64m")
    spark.conf.set(name, str(HANDED))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def spread(df: DataFrame) -> DataFrame:
    """df in as many tasks as there are cores at least: a few large row groups leave most of them idle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def is_small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the bytes of its values are few. df should be a small or a written table, as it is read for this."""

    def width(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return 2 * F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        return F.lit(16)

    return (df.agg(F.sum(reduce(Column.__add__, map(width, df.schema.fields)).cast("long"))).first()[0] or 0) <= most


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df for broadcast if the bytes of its values are few; beyond that Spark joins by shuffle. df is read twice, so it should be a small or a written table."""
    return F.broadcast(df) if is_small(df, most) else df
