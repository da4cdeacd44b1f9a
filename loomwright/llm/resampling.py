"""Importance resampling towards a target distribution of hashed word features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise

BUCKETS = 10_000
#: Documents with fewer words are never drawn; how many of a hundred others are; what the noise of a document is hashed with.
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Accuracy of the sketch of scores: it tells the row of a quantile but for one in so many rows.
ACCURACY = 10_000
#: Bytes of texts whose words are found at once; words over so many bytes are hashed one by one.
AT_ONCE, LONG_WORD = 4 << 20, 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _crc_steps() -> np.ndarray:
    """What each byte does to a CRC-32 (reflected, polynomial 0xEDB88320)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_STEPS = _crc_steps()


def _fed(state: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC registers after each has been fed its own run of the text, all runs a byte at a time."""
    order = np.argsort(-length, kind="stable")
    s, at, n = state[order], start[order], length[order]
    far = int(np.searchsorted(-n, -LONG_WORD, "left"))  # runs longer than LONG_WORD come first
    for k in range(far):
        s[k] = ~np.uint32(zlib.crc32(text[at[k] : at[k] + n[k]], int(~s[k])))
    s2, at, n = s[far:], at[far:], n[far:]
    for p in range(int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(-n, -p, "left"))  # those with a byte at p
        s2[:m] = _STEPS[(s2[:m] ^ text[at[:m] + p]) & 0xFF] ^ (s2[:m] >> 8)
    out = np.empty_like(s)
    out[order] = s
    return out


def features(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, buckets of their features), a few megabytes of text at a time; a row may come in several parts.

    Words are runs of digits, letters a-z after lowering A-Z, and all beyond ASCII; features are words and pairs of
    consecutive ones. A text longer than AT_ONCE is cut between words, and its last word is met again for the pair.
    """
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    edge = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
    data = np.frombuffer(t.buffers()[2], np.uint8) if t.buffers()[2] else np.zeros(0, np.uint8)
    b, at, end, again = int(edge[0]), int(edge[0]), int(edge[-1]), False
    while at < end:
        q = min(at + AT_ONCE, end)
        while q < end:  # not inside a word
            x = data[q : min(q + 4096, end)]
            stop = np.flatnonzero(~_IN_WORD[_LOWER[x]])
            to = q + int(stop[0] if len(stop) else len(x))
            next_text = int(edge[np.searchsorted(edge, q)])
            q = min(to, next_text)
            if len(stop) or next_text <= to:
                break
        text = _LOWER[data[b:q]]
        inside = _IN_WORD[text]
        cuts = edge[np.searchsorted(edge, b, "right") : np.searchsorted(edge, q)] - b
        before = np.concatenate([[False], inside[:-1]])
        before[cuts] = False
        after = np.concatenate([inside[1:], [False]])
        after[cuts - 1] = False
        start, length = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        length -= start
        if len(start):
            row = np.searchsorted(edge, start + b, "right") - 1
            state = _fed(np.full(len(start), 0xFFFFFFFF, np.uint32), text, start, length)
            pair = row[1:] == row[:-1]
            joined = state[:-1][pair]
            joined = _STEPS[(joined ^ np.uint32(0x20)) & 0xFF] ^ (joined >> 8)
            joined = _fed(joined, text, start[1:][pair], length[1:][pair])
            own = slice(1, None) if again else slice(None)
            yield np.concatenate([row[own], row[1:][pair]]), (~np.concatenate([state[own], joined])).astype(np.int64) % buckets
            b, again = b + int(start[-1]), True
        elif not again:
            b = q
        at = q


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all rows fall into each bucket that has any. A task gives one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for x in batches:
            for _, f in features(x["text"], buckets):
                n += np.bincount(f, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths: the logarithm of its share in the target over that in docs, both with one feature more a bucket."""
    s = bucket_counts(docs, buckets).withColumnRenamed("n", "s")
    t = bucket_counts(target, buckets).withColumnRenamed("n", "t")
    both = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("s", "t")])
    both = materialise(both, "buckets")  # a row a bucket
    big_s, big_t = both.agg(F.sum("s"), F.sum("t")).first()
    d = lambda c: F.col(c).cast("double") + 1
    gain = F.floor(1000 * F.log(d("t") * F.lit(float(big_s + buckets)) / (d("s") * F.lit(float(big_t + buckets)))))
    return np.array([r.gain for r in both.select("bucket", gain.alias("gain")).orderBy("bucket").collect()], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight) of every row: the mean gain of its features, rounded down; 0 without features."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n, total = np.zeros(x.num_rows, np.int64), np.zeros(x.num_rows, np.int64)
            for row, f in features(x["text"], len(gain)):
                n += np.bincount(row, minlength=x.num_rows)
                total += np.bincount(row, weights=gain[f], minlength=x.num_rows).astype(np.int64)  # whole numbers far under 2^53
            yield pa.RecordBatch.from_arrays([x["doc_id"], pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the id: the same in each run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def numbered(rows: DataFrame) -> DataFrame:
    """rows(.., score, doc_id, row) with `number`, from 0, by falling score, then doc_id (nulls last), then row.

    Dealt by range of all three, so that many rows of one score or id fill many tasks; each row is counted within its
    part, and parts are summed on their own.
    """
    names = rows.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for x in batches:
            own = [pa.array(np.full(x.num_rows, part, np.int32)), pa.array(np.arange(n, n + x.num_rows))]
            yield pa.RecordBatch.from_arrays([*x.columns, *own], names=[*names, "part", "in_part"])
            n += x.num_rows

    keys = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    got = materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(count, f"{kinds}, part int, in_part long"), "numbered")
    above = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a part
    base = got.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("base"))
    return got.join(broadcast_if_small(materialise(base, "parts")), F.col("part") == F.col("of")).select(*names, (F.col("base") + F.col("in_part")).alias("number"))


def cutoff(scored: DataFrame, k: int, accuracy: int = ACCURACY) -> tuple[int, int | None, int]:
    """(score, doc_id, row) of the k-th row by falling score; scored has at least k rows, and k is at least 1.

    A quantile sketch brackets the score. Rows above the bracket and in it are counted exactly; while the k-th is not in
    it, it is widened four times, up to all rows. Only rows in the bracket are sorted.
    """
    n = scored.count()
    at = 1 - k / n
    steps, wide = [], 2 / accuracy
    while wide < 1:
        steps.append(wide)
        wide *= 4
    asked = [max(0.0, at - w) for w in steps] + [min(1.0, at + w) for w in steps]
    low_high, least, most = scored.agg(F.percentile_approx("score", asked, accuracy), F.min("score"), F.max("score")).first()
    brackets = [*zip(low_high[: len(steps)], low_high[len(steps) :], strict=True), (least, most)]
    for low, high in brackets:
        above, inside = scored.agg(F.count(F.when(F.col("score") > high, 1)), F.count(F.when(F.col("score").between(low, high), 1))).first()
        if above < k <= above + inside:
            break
    found = numbered(scored.where(F.col("score").between(low, high)).select("score", "doc_id", "row")).where(F.col("number") == k - 1 - above).first()
    return found.score, found.doc_id, found.row


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank is null for those not drawn.

    Texts are read twice: to count features in buckets, and to weigh each document by an array of the buckets' gains
    towards the target's texts. Of the rows with least_words words or more, `percent` in a hundred are drawn, those of
    the highest score (weight and a hashed Gumbel noise); ranks go by falling score, then doc_id.

    Null and empty texts have no features, weigh 0 and are never drawn. Null doc_ids share one noise and come after
    others of their score. Rows that repeat a doc_id have ranks of their own, in any order where all else is equal. A
    very long text is cut between words where it is hashed. Columns besides doc_id and text are left out, whatever their
    names. Empty docs give no rows; an empty target leaves gains by rarity alone.
    """
    x = weighted(docs, gains(docs, target))
    scored = x.select("*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), F.monotonically_increasing_id().alias("row"))
    scored = materialise(scored, "scored")
    names = ["doc_id", "n_features", "weight", "score"]
    able = F.col("n_features") >= 2 * least_words - 1
    k = percent * scored.where(able).count() // 100
    if not k:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    score, doc_id, row = cutoff(scored.where(able), k)
    last = F.col("row") <= row
    if doc_id is None:
        ahead = F.col("doc_id").isNotNull() | last
    else:
        ahead = F.coalesce((F.col("doc_id") < doc_id) | ((F.col("doc_id") == doc_id) & last), F.lit(False))
    drawn = able & ((F.col("score") > score) | ((F.col("score") == score) & ahead))
    ranked = numbered(scored.where(drawn)).select(*names, (F.col("number") + 1).alias("rank"))
    return ranked.unionByName(scored.where(~drawn).select(*names, F.lit(None).cast("long").alias("rank")))
