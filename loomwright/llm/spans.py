"""Substring near-exact dedup by sliding spans of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: A run is so many consecutive sentences with so many words at least; fewer words are common phrases.
SENTENCES, WORDS = 3, 10
#: A sentence ends after its stops before a blank, after Chinese and Japanese stops, and at a line feed.
_EDGE = re.compile(r"[.!?]+[\"'”’)\]]*(?=\s)\s*|[。！？；]+[\"'”’)\]]*\s*|\n\s*")
#: A sentence of more than LONG words is cut before words whose hash with the word before is 0 modulo EVERY: what stands
#: around a passage does not move the cuts inside it, so that passages of few or no stops make sentences of their own.
LONG, EVERY = 16, 5
#: Chinese and Japanese signs are words each, as these are written without blanks.
_SIGNS = "぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_SIGN, _PLAIN, _MIXED = re.compile(f"[{_SIGNS}]"), re.compile(r"\S+"), re.compile(rf"[{_SIGNS}]|[^\s{_SIGNS}]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def sentences(text: str) -> tuple[list[int], list[int], list[int]]:
    """(where sentences and the pieces of long ones start, and the text's length; their hashes; their words).

    A sentence is hashed by its words in lower case, whatever blanks part them.
    """
    cuts, hashes, words = [0], [], []
    parts = _MIXED if not text.isascii() and _SIGN.search(text) else _PLAIN
    h64, h32 = xxhash.xxh3_64_intdigest, xxhash.xxh32_intdigest
    edges = [m.end() for m in _EDGE.finditer(text)]
    if text and (not edges or edges[-1] < len(text)):
        edges.append(len(text))
    at = 0
    for to in edges:
        piece = text[at:to].lower()
        w = piece.split() if parts is _PLAIN else parts.findall(piece)
        if len(w) > LONG:
            inner = [k for k in range(1, len(w)) if h32(w[k - 1] + " " + w[k]) % EVERY == 0]
            starts = [m.start() for m in parts.finditer(text, at, to)] if inner else []
            if len(starts) == len(w):  # lower case may part a word of odd letters in other ways
                for a, b in zip([0, *inner], [*inner, len(w)], strict=True):
                    hashes.append(h64(" ".join(w[a:b])))
                    words.append(b - a)
                cuts.extend(starts[k] for k in inner)
                cuts.append(to)
                at = to
                continue
        hashes.append(h64(" ".join(w)))
        words.append(len(w))
        cuts.append(to)
        at = to
    return cuts, hashes, words


def runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of its first sentence, whether it stood before in the text) of every run of SENTENCES sentences with WORDS words."""
    _, hashes, words = sentences(text)
    n = len(hashes) - SENTENCES + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    h, w = np.array(hashes, np.uint64), np.array(words)
    run, many = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(SENTENCES):
        run = (run ^ h[k : n + k]) * _M1
        run ^= run >> np.uint64(29)
        run *= _M2
        many += w[k : n + k]
    at = np.flatnonzero(many >= WORDS)
    run = run[at].view(np.int64)
    again = np.ones(len(run), bool)
    again[np.unique(run, return_index=True)[1]] = False
    return run, at.astype(np.int32), again


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        for at in range(0, x.num_rows, 500):
            some = x.slice(at, 500)
            got = [runs(t or "") for t in some["text"].to_pylist()]
            row = pa.array(np.repeat(np.arange(len(got)), [len(g[0]) for g in got]))
            h, i, again = (np.concatenate(c) for c in zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays([some["place"].take(row), pa.array(h), pa.array(i), pa.array(again)], names=["place", "h", "i", "again"])


def _place() -> Column:
    """A text's place in the order of doc_id, nulls last, and then of a hash of the text, as one number: doc_id * 2**60 and 60 bits of the hash."""
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    return (id_.cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)") + F.xxhash64("text").bitwiseAND(F.lit((1 << 60) - 1)).cast("decimal(19,0)")).cast("decimal(38,0)")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(place, i): each run of sentences that stood earlier, in the same text or in one of a lower place.

    Runs are written once; repeats in a text are told where it is read, so only the first of each goes through the
    shuffle, where the least place is taken before and after.
    """
    every = materialise(docs.select(_place().alias("place"), F.col("text")).mapInArrow(_runs, "place decimal(38,0), h long, i int, again boolean"), "runs")
    once = every.where("not again").select("place", "h", "i")
    first = once.groupBy("h").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("of"), "first")
    later = once.join(first, F.col("h") == F.col("of")).where("place > first")
    return later.select("place", "i").unionByName(every.where("again").select("place", "i"))


def _without(text: str, removed: list[int]) -> tuple[int, str]:
    """(removed sentences, what is left) when runs start at the sentences `removed`."""
    cuts, _, words = sentences(text)
    n = len(words)
    gone = np.zeros(n, bool)
    for i in removed:
        gone[i : i + SENTENCES] = True
    return int(gone.sum()), "".join(text[cuts[k] : cuts[k + 1]] for k in range(n) if not gone[k])


def dedup_spans(docs: DataFrame) -> DataFrame:
    """docs' columns with `text` less its repeated sentences, and `n_removed`; pieces of long sentences count as sentences.

    Every run of SENTENCES consecutive sentences is hashed and joined with all others; a sentence goes when a run that
    covers it stood earlier, in the order of doc_id (nulls last), then of the text's hash, then of sentences. The first
    place of a passage stays. Rows that share a doc_id but not the text are texts of their own; rows that repeat both
    are one place, so all of them stay or change alike. Null texts stay null, with nothing removed. An input column
    n_removed is replaced; all others stay, whatever their names. A text is cut whole in one task, however long. An
    empty table gives an empty one.
    """
    hits = repeated_runs(docs).groupBy("place").agg(F.collect_set("i").alias("runs")).withColumnRenamed("place", "hit")
    rows = docs.drop("n_removed").select(F.struct("*").alias("row"), _place().alias("place"))
    x = rows.join(hits, F.col("place") == F.col("hit"), "left").select("row", "runs")

    @F.arrow_udf("struct<removed:int,text:string>")
    def cut(texts: pa.Array, starts: pa.Array) -> pa.Array:
        got = [_without(t.as_py(), s.as_py()) if t.is_valid else (0, None) for t, s in zip(texts, starts, strict=True)]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string())], names=["removed", "text"])

    hit = F.col("runs").isNotNull()
    x = x.select("row", hit.alias("hit"), cut.asNondeterministic()(F.when(hit, F.col("row.text")), "runs").alias("cut"))  # texts without a hit don't go to Python
    row = F.col("row").withField("text", F.when(F.col("hit"), F.col("cut.text")).otherwise(F.col("row.text")))
    return x.select(row.alias("row"), F.col("cut.removed").alias("removed")).select("row.*", F.col("removed").alias("n_removed"))
