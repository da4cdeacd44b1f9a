"""What the corpus operators share: durable intermediate tables, running sums, components, sorted groups."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What parts words: the space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a side that may be broadcast once they are summed; the table that a join makes of them takes some three times that.
BROADCAST_BYTES = 8 << 20


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is unset, an own one on one machine; elsewhere an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="spark-loomwright-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends here and lost executors cost nothing."""
    path = f"{work_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the written table that df reads, once nothing that may still run reads it."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(parent)
        at.getFileSystem(conf).delete(at, True)


def _width(f: T.StructField) -> Column:
    """About how many bytes a value takes, an upper bound for texts and numbers."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return 2 * F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(16)


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Sums the bytes of df's values and marks it for broadcast if they are at most that many; beyond that Spark joins by shuffle.

    df is read twice: callers give a written table, or a narrow projection of one.
    """
    size = df.agg(F.sum(reduce(Column.__add__, [_width(f) for f in df.schema.fields]).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def slots(df: DataFrame, group: list[str], order: list[str], rows: int, value: str | None = None, per: int = 1000) -> DataFrame:
    """Adds `slot` (the row's number from 0 in its group) and, for a value column, `before` (the sum of value over the rows of lower slot).

    A group may hold any share of all rows: it is dealt into buckets of about `per` rows by a hash of `order`, buckets are
    summed on their own, and each row adds what precedes its bucket. Rows is about how many rows df has. Ties of
    `order` take any order; nulls come first.
    """
    n = max(1, rows // per)
    x = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    v = F.coalesce(F.col(value), F.lit(0)).cast("long") if value else F.lit(0).cast("long")
    sums = x.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_v"))
    above = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_v").over(above), F.lit(0)).alias("_v0"))
    inner = W.partitionBy(*group, "_bucket").orderBy(*order)
    x = x.withColumn("_r", F.row_number().over(inner).cast("long") - 1)
    if value:
        x = x.withColumn("_s", F.coalesce(F.sum(v).over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    same = F.col("_bucket") == F.col("_b")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    base = materialise(base, "buckets") if n > 1000 else base
    out = x.join(broadcast_if_small(base), same).withColumn("slot", F.col("_r") + F.col("_n0"))
    if value:
        out = out.withColumn("before", F.col("_s") + F.col("_v0"))
    return out.drop("_bucket", "_r", "_s", "_b", "_n0", "_v0", *[f"_g_{g}" for g in group])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the edges; component is the smallest node that it reaches.

    Alternating large-star and small-star rounds, each written to the shared folder, until the edges no longer change.
    Minima are taken by partial aggregation and joined back, so one node may hold most of the edges. Edges with a null
    end and loops are dropped.
    """
    u, v = F.col("u"), F.col("v")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    e = materialise(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    was = mark(e)
    while was[0]:
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        old, e = e, materialise(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old)
        now = mark(e)
        if now == was:
            break
        was = now
    return e.groupBy("u").agg(F.min("v").alias("component")).unionByName(e.select(v.alias("u"), v.alias("component")).distinct()).withColumnRenamed("u", "node")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n items' component under the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != (up := label[label])).any():
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by keys, of about `least` rows or one group."""
    kept: list[pa.RecordBatch] = []
    rows = 0

    def cut(t: pa.Table) -> int:
        same = np.ones(max(0, t.num_rows - 1), bool)
        for k in keys:
            c = t[k].to_numpy()
            same &= c[1:] == c[:-1]
        at = np.flatnonzero(~same)
        return int(at[-1]) + 1 if len(at) else 0

    for x in batches:
        kept.append(x)
        rows += x.num_rows
        if rows >= least:
            t = pa.Table.from_batches(kept).combine_chunks()
            if at := cut(t):
                yield t.slice(0, at)
                t = t.slice(at)
            kept, rows = t.to_batches(), t.num_rows
            least = max(least, 2 * rows)
    if rows:
        yield pa.Table.from_batches(kept).combine_chunks()


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups start in a table sorted by keys, and its length."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = t[k].to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def by_text(f: Callable[[str], tuple], fields: pa.StructType) -> Callable[[pa.Array], pa.Array]:
    """An Arrow UDF body that gives a struct of f(text) for each text; a null counts as empty."""

    def body(texts: pa.Array) -> pa.Array:
        rows = [f(x.as_py() or "") for x in texts]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], fields.field(i).type) for i in range(fields.num_fields)], fields=list(fields))

    body.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return body
