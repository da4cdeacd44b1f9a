"""Sinks that write each row of a stream once, however often a batch runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import files
from ..operators.tables import broadcast_if_small, written

#: Folders that a table of unique keys is dealt into.
BUCKETS = 16


def replayed(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Runs a stream over what is there now, and stops; rows go to path/batch=n, where n is the micro-batch's number.

    The batch's number is the ledger: one that runs again, after its writes or amid them, writes the same folder again.
    """

    def put(batch: DataFrame, n: int) -> None:
        out = change(batch, n) if change else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={n}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def insert_ignore(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str, buckets: int = BUCKETS, made: Callable[[DataFrame], DataFrame] | None = None, columns: list[str] | None = None) -> None:
    """Appends the rows of a stream whose keys (nulls equal) the table at path lacks: the first by `order` of a batch, and earlier batches before later ones.

    Rows lie by micro-batch and a bucket of their keys, and a batch meets only those of lower numbers, by bucket and key:
    as it is replayed it sees what it saw before, and its own folder is written again. `made` adds the table's `columns`
    to the stream's rows, one by one, and leaves other columns be: wide columns are then made when rows are written, and what is
    grouped, joined and dealt out are the stream's rows and the SHA-256 of text keys. Rows of the table are never
    broadcast: their files tell little of their size, as repeated text is small there.
    """
    made = made or (lambda df: df)
    columns = columns or made(stream).columns
    own = lambda df: F.pmod(F.xxhash64(*[df[k] for k in keys]), F.lit(buckets)).cast("int").alias("bucket")
    schema = T.StructType([*made(stream).select(*columns).schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])
    text = {k for k in keys if isinstance(schema[k].dataType, T.StringType)}
    lean = [(F.unhex(F.sha2(F.col(k), 256)) if k in text else F.col(k)).alias(f"_key_{k}") for k in keys]
    leans = [f"_key_{k}" for k in keys]

    def put(batch: DataFrame, n: int) -> None:
        x = made(batch.withColumn("_was", F.struct(*batch.columns)))
        x = x.select(*lean, own(x), "_was", F.struct(*order).alias("_at"))
        new = x.groupBy(*leans, "bucket").agg(F.min_by("_was", "_at").alias("_was"))
        if n and files.names(batch.sparkSession, path):
            new = written(new, "new")
            have = batch.sparkSession.read.schema(schema).parquet(path).where(F.col("batch") < n)
            at = broadcast_if_small(new.select("bucket").distinct())
            have = have.join(at, "bucket", "left_semi").select(*lean, "bucket").hint("merge")
            new = new.join(have, _same(new, have, ["bucket", *leans]), "left_anti")
        out = made(new.select("bucket", "_was").repartition("bucket").select("_was.*", "bucket")).select(*columns, "bucket")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={n}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    same = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        same = same & a[k].eqNullSafe(b[k])
    return same


def table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What such a sink has written so far, without the columns that tell its folders."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def audit_rows(events: DataFrame) -> DataFrame:
    """Audit rows of events(tenant_id, actor_user_id, action, resource, result, ip, detail): blanks filled, fields cut to their columns."""
    fill = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other)).alias(c)
    cut = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n).alias(c)
    named = {"tenant_id": fill("tenant_id", "default"), "actor_user_id": fill("actor_user_id", ""), "resource": cut("resource", 256), "result": fill("result", "success"), "ip": cut("ip", 64), "detail": cut("detail", 1024)}
    return events.select(*[named.get(c, F.col(c)) for c in events.columns])
