"""How text filters interact: every order of five of them, counted from a stream of files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, work_dir

FILTERS = "ABCDE"
#: Micro-batches that the files of a first run are dealt into.
ROUNDS = 6
COPY = 1 << FILTERS.index("E")
SIGNS = b"#$%&*|"

_KEYS = ["part", "mask", "good", "toxic"]
_HOLDERS = "text_key binary, doc_id long, part string, mask int, good boolean, toxic boolean, n long"
_CHANGES = "part string, mask int, good boolean, toxic boolean, n long"
_NO_ID = (1 << 63) - 1
_NOT_CAPITAL = bytes(set(range(256)) - set(range(65, 91)))
_NOT_SIGN = bytes(set(range(256)) - set(SIGNS))
_FOLLOWS = bytes(range(128, 192))  # bytes that don't begin a code point


def own_mask(text: str) -> int:
    """Bit i is set if the text alone fails filter i: A too short, B too few different words, C too many capitals, D a sign."""
    b = text.encode()
    words = b.split()  # by the six ASCII blanks
    short, same = len(words) < 100, 100 * len(set(words)) < 80 * len(words)
    loud = 100 * len(b.translate(None, _NOT_CAPITAL)) > 10 * len(b.translate(None, _FOLLOWS))
    return short + 2 * same + 4 * loud + 8 * bool(b.translate(None, _NOT_SIGN))


def masked(docs: DataFrame) -> DataFrame:
    """(text_key, doc_id, part, mask) of every row: a digest of the text, the lang, and what the text alone fails. A null doc_id is beyond all others."""

    def own(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in texts:
            yield pa.array([own_mask(t.as_py()) for t in x], pa.int32())

    mask = F.arrow_udf(own, "int")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.unhex(F.sha2(text, 256)).alias("text_key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), mask(text).alias("mask"))


def _moved(holders: DataFrame, sign: int) -> DataFrame:
    """Counts of holders taken from those that fail as copies to those that don't (sign 1), or back (-1)."""
    both = F.array(F.struct(F.col("mask").alias("m"), (sign * F.col("n")).alias("d")), F.struct(F.col("mask").bitwiseOR(COPY).alias("m"), (-sign * F.col("n")).alias("d")))
    return holders.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", F.col("x.m").alias("mask"), "good", "toxic", F.col("x.d").alias("n"))


def fold(rows: DataFrame, batch: int, at: str) -> None:
    """Takes the masked rows of a micro-batch, written once, into the state and counters in folder `at`.

    The state has, by text, the rows of the smallest doc_id so far: a batch adds those of texts that are new, or come with
    a smaller id or the same. Counters take each row first as a copy (it fails E); the holder of a text's smallest id is
    then moved to those that don't, and, where a smaller id comes, an earlier holder is moved back. Both are written under
    the batch's number, and only lower numbers are read, so a batch that runs again leaves the same.

    Rows of a text are brought down to its smallest id by partial aggregation, and its holders are met by text and id,
    so a text of a third of all rows is no hot key.
    """
    spark = rows.sparkSession
    low = materialise(rows.groupBy("text_key").agg(F.min("doc_id").alias("doc_id")), "low")
    held = rows.join(low, ["text_key", "doc_id"], "left_semi").groupBy("text_key", "doc_id", *_KEYS).agg(F.count(F.lit(1)).alias("n"))
    copies = rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n")).withColumn("mask", F.col("mask").bitwiseOR(COPY))
    changes = copies.select(*_KEYS, "n")
    if batch:
        state = spark.read.schema(_HOLDERS + ", batch long").parquet(f"{at}/holders").where(F.col("batch") < batch).drop("batch")
        known = materialise(state.join(low.select("text_key"), "text_key", "left_semi"), "known")
        was = materialise(known.groupBy("text_key").agg(F.min("doc_id").alias("was")), "was")
        held = held.join(was, "text_key", "left").where("was is null or doc_id <= was").drop("was")
        beaten = low.withColumnRenamed("doc_id", "now").join(was, "text_key").where("now < was").select("text_key", F.col("was").alias("doc_id"))
        changes = changes.unionByName(_moved(known.join(beaten, ["text_key", "doc_id"], "left_semi"), -1))
    held.write.mode("overwrite").parquet(f"{at}/holders/batch={batch}")
    held = spark.read.schema(_HOLDERS).parquet(f"{at}/holders/batch={batch}")
    changes = changes.unionByName(_moved(held, 1)).groupBy(*_KEYS).agg(F.sum("n").alias("n"))
    changes.write.mode("overwrite").parquet(f"{at}/changes/batch={batch}")


def _folder(spark: SparkSession, path: str) -> str:
    """The path for a stream of files, which takes folders and patterns: one file becomes a pattern that it alone meets."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{path[:-1]}[{path[-1]}]" if fs.exists(at) and fs.getFileStatus(at).isFile() else path


def follow(spark: SparkSession, path: str, labels: DataFrame, at: str, files: int) -> DataFrame:
    """(part, mask, good, toxic, n) of all rows of the Parquet files at path: a stream takes those not yet seen, `files` at a time, and stops.

    The folder `at` has the stream's progress, the state by text and the counters' changes; run again, it takes new files
    only, and goes on where a lost run ended. labels(doc_id, quality, toxic) are those of the time of a row's batch; of
    labels that share a doc_id, any that is 1 counts.
    """
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    flags = materialise(flags.where("label_id is not null and (good or toxic)"), "flags")

    def take(batch: DataFrame, number: int) -> None:
        own = materialise(masked(batch), "masked")
        flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
        rows = own.join(broadcast_if_small(flags), F.col("doc_id") == F.col("label_id"), "left").select("text_key", "doc_id", "part", "mask", flag("good"), flag("toxic"))
        fold(materialise(rows, "flagged"), number, at)

    schema = spark.read.parquet(path).select("doc_id", "text", "lang").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(_folder(spark, path))
    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema(_CHANGES + ", batch long").parquet(f"{at}/changes")
    return changes.groupBy(*_KEYS).agg(F.sum("n").alias("n")).where("n <> 0")


def _sum(n: Column, where: Column, name: str) -> Column:
    return F.sum(F.when(where, n).otherwise(F.lit(0))).cast("long").alias(name)


def every_order(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, ..) of counts(part, mask, good, toxic, n): what each filter does at each place of each order.

    What a filter does depends on which filters stood before it and not on their order: it is summed for the 80 pairs of
    a filter and a set before it, and then told for the 600 steps.
    """
    bits = [1 << i for i in range(len(FILTERS))]
    pairs = F.array(*[F.struct(F.lit(f).alias("own"), F.lit(b).alias("before")) for f in bits for b in range(1 << len(bits)) if not b & f])
    x = counts.select("*", F.explode(pairs).alias("p")).select("*", "p.own", "p.before")
    fails, early = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    n = F.col("n")
    every = factorial(len(FILTERS))
    sums = x.groupBy("part", "own", "before").agg(
        _sum(n, ~fails & ~early, "kept"),
        _sum(n, fails & ~early, "removed"),
        _sum(n, fails & early, "redundant"),
        _sum(n, F.col("mask") == F.col("own"), "unique_fails"),
        _sum(n, fails & ~early & F.col("good"), "good_lost"),
        _sum(n, fails & ~early & F.col("toxic"), "toxic_lost"),
        # it is the first of the filters that a document fails in an equal share of all orders
        _sum((n * every / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long"), fails, "shapley"),
    )
    steps = [("".join(o), k + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(b) for b in o[:k])) for o in permutations(FILTERS) for k, f in enumerate(o)]
    told = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, own int, before int")  # 600 rows
    return sums.join(F.broadcast(told), ["own", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(spark: SparkSession, path: str, labels: DataFrame, at: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of the Parquet files at path.

    Files are taken as a stream of micro-batches, about `rounds` of them on a first run; `at` keeps progress, state and
    counters in a folder of its own if none is given.

    Null texts are empty, null langs the empty part. Rows without a doc_id come after all others: they fail E if any row
    with an id has their text. Rows that repeat a text's smallest doc_id all stay. A text of any length is one row. Columns
    besides doc_id, text and lang aren't read, whatever their names. Files without rows, or labels without rows, give
    no rows, or zeros; rows in no label count as neither good nor toxic.
    """
    files = len(spark.read.parquet(path).inputFiles())
    counts = follow(spark, path, labels, at or f"{work_dir(spark)}/audit-{uuid.uuid4().hex}", max(1, -(-files // rounds)))
    return every_order(materialise(counts, "counts"))
