"""Token ids of whole texts, and token files in Parquet."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, work_dir

TOKENIZER = "word_bpe_49k.json"
#: Bytes of words and their ids that a Python worker keeps; beyond that it starts again with the words in hand. Longer words aren't kept.
KEPT_BYTES, KEPT_WORD = 16 << 20, 40
#: Bytes of texts that are encoded at once (a longer text is taken whole).
AT_ONCE = 2 << 20
#: Words of letters (ASCII, and U+00C0 to U+00FF but for the two signs there) with ASCII signs other than the apostrophe
#: after them: the tokenizer encodes both parts apart. Words of letters alone are encoded in lines of so many.
_PLAIN = r"^(?P<letters>[a-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"
_LINE = 512


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one run after the other."""
    end = np.cumsum(length)
    total = int(end[-1]) if len(end) else 0
    kind = np.int32 if max(total, int(start.max(initial=0))) < 1 << 30 else np.int64
    at = np.repeat((start - (end - length)).astype(kind), length)
    at += np.arange(total, dtype=kind)
    return at


class _Words:
    """A tokenizer, and the ids of the parts of words met so far: parts[k] has ids[edge[k]:edge[k + 1]]."""

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.parts, self.ids, self.edge = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)

    def _fresh(self, plain: pa.Array, rest: pa.Array) -> None:
        """Encodes parts not met before and keeps them. Parts of letters alone are one word to the tokenizer too, so a line of them is encoded at once and cut by word."""
        words = plain.to_pylist()
        lines = [words[i : i + _LINE] for i in range(0, len(words), _LINE)]
        ids, n = [self.ids], [np.zeros(0, np.int64)]
        for line, e in zip(lines, self._encode([" ".join(x) for x in lines]), strict=True):
            ids.append(np.array(e.ids, np.uint32))
            n.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(line)))
        for e in self._encode(rest.to_pylist()):
            ids.append(np.array(e.ids, np.uint32))
            n.append(np.array([len(e.ids)]))
        self.parts, self.ids = pa.concat_arrays([self.parts, plain, rest]), np.concatenate(ids)
        self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(np.concatenate(n))])

    def _place(self, parts: pa.Array) -> np.ndarray:
        """Where different parts are among those kept, with new ones encoded and kept."""
        at = pc.fill_null(pc.index_in(parts, value_set=self.parts), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = parts.take(pa.array(new))
            letters = pc.match_substring_regex(fresh, "^[a-zÀ-ÖØ-öø-ÿ]+$").to_numpy(zero_copy_only=False)
            order = np.concatenate([new[letters], new[~letters]])
            at[order] = len(self.parts) + np.arange(len(new))
            self._fresh(parts.take(pa.array(new[letters])), parts.take(pa.array(new[~letters])))
        return at

    def known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, ids): the ids of each of these different words are ids[start : start + length]."""
        split = pc.extract_regex(words, _PLAIN)
        first, second = pc.coalesce(pc.struct_field(split, "letters"), words), pc.struct_field(split, "signs")
        both = pa.concat_arrays([first, pc.if_else(pc.equal(second, ""), None, second)]).dictionary_encode()
        at = self._place(both.dictionary)[pc.fill_null(both.indices, 0).to_numpy()]
        at[pc.is_null(both.indices).to_numpy(zero_copy_only=False)] = -1
        at = at.reshape(2, -1).T
        # the second part of a word without one is the empty run at 0
        start = np.where(at < 0, 0, self.edge[at])
        n = np.where(at < 0, 0, self.edge[at + 1] - self.edge[at])
        ids, length = self.ids[_ragged(start.ravel(), n.ravel())], n.sum(1)
        keep = pc.binary_length(self.parts).to_numpy() <= KEPT_WORD
        if self.parts.nbytes + self.ids.nbytes + self.edge.nbytes > KEPT_BYTES:
            keep &= np.isin(np.arange(len(keep)), at)
        if not keep.all():
            kept = np.flatnonzero(keep)
            n = self.edge[kept + 1] - self.edge[kept]
            self.ids = self.ids[_ragged(self.edge[kept], n)]
            self.parts, self.edge = self.parts.take(pa.array(kept)), np.concatenate([[0], np.cumsum(n)])
        return np.cumsum(length) - length, length, ids


_LOADED: dict[str, _Words] = {}


def loaded(name: str) -> _Words:
    if name not in _LOADED:
        _LOADED[name] = _Words(name)
    return _LOADED[name]


def encode(texts: pa.Array, name: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """(ids, edge): text k has ids[edge[k]:edge[k + 1]]; a null text has none.

    This tokenizer lowers case, drops white space and looks across it in no step, so a text's ids are those of its parts
    between spaces and line feeds, with A-Z lowered; each different part is encoded once. Texts that may hold the name of
    a special token keep their case.
    """
    t = pc.fill_null(texts.cast(pa.string()), "")
    special = pc.match_substring(t, "<|")
    t = pc.if_else(special, t, pc.ascii_lower(t)) if pc.any(special).as_py() else pc.ascii_lower(t)
    parts = pc.split_pattern(pc.replace_substring(t, "\n", " "), " ")
    words = parts.flatten().dictionary_encode()
    start, length, ids = loaded(name).known(words.dictionary)
    of = words.indices.to_numpy()
    n = length[of]
    edge = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])]
    return ids[_ragged(start[of], n)], edge


def encoded(texts: pa.Array, end_id: int, name: str = TOKENIZER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the first, ids, edge) of slices of the texts, each text with the end id after its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), AT_ONCE, "right")) + at)
        ids, edge = encode(texts.slice(at, to - at), name)
        yield at, np.insert(ids, edge[1:], np.uint32(end_id)), edge + np.arange(len(edge))
        at = to
    pa.default_memory_pool().release_unused()  # the worker goes on to other stages


def pieces(docs: DataFrame, size: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row: its ids and the end id, cut after each `size` ids.

    Null texts are empty and give the end id alone. Every row is encoded on its own, whatever its doc_id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at, ids, edge in encoded(x["text"], end_id):
                n = -(-np.diff(edge) // size)
                row = np.repeat(np.arange(len(n)), n)
                piece = _ragged(np.zeros(len(n), np.int64), n).astype(np.int64)
                begin = edge[row] + piece * size
                end = np.minimum(begin + size, edge[row + 1])
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                cols = [x["doc_id"].take(pa.array(at + row)), pa.array(piece.astype(np.int32)), pa.array(piece * size), pa.array(end - begin), pa.array(crc, pa.int64())]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


#: Tokens repeat from a vocabulary that fits a dictionary page; sorted ids and running starts are delta-coded. Row groups
#: and pages are small, and each page has its least and greatest doc_id in the page index.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_part": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"


def write_tokens(docs: DataFrame, path: str, end_id: int = 2) -> None:
    """Token files of all rows in ascending doc_id order, nulls first, in path/ids: file by file and, in a file, row by row.

    Texts rather than ids are dealt by range, since they are the smaller; rows that share a doc_id, or have none, are
    dealt on by their text's hash, so that many of them fill many files. A row has its file's number and how many ids
    stand before it in the file; path/parts has what stands before each file, so that a selective read needs no other.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for x in batches:
            for at, ids, edge in encoded(x["text"], end_id):
                k = len(edge) - 1
                yield pa.RecordBatch.from_arrays([x["doc_id"].slice(at, k), pa.array(np.full(k, part, np.int32)), pa.array(before + edge[:-1]), pa.array(np.diff(edge).astype(np.int32)), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
                before += int(edge[-1])

    keys = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("h")).repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    ordered.mapInArrow(rows, SCHEMA).write.options(**LAYOUT).parquet(f"{path}/ids")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a file
    totals = docs.sparkSession.read.schema(SCHEMA).parquet(f"{path}/ids").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base")).coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The token files with `start`, the ids of all documents before a row. Filters on doc_id reach the page index; columns that aren't asked for aren't read."""
    files = spark.read.schema(SCHEMA).parquet(f"{path}/ids")
    base = spark.read.schema("part int, base long").parquet(f"{path}/parts").withColumnRenamed("part", "_part")
    return files.join(broadcast_if_small(base), files.part == F.col("_part")).select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) with the last two taken from the ids themselves."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids = x["ids"]
            raw, edge = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B"), ids.offsets.to_numpy().astype(np.int64) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x["doc_id"], x["start"], pa.array(np.diff(edge) // 4), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame) -> DataFrame:
    """Writes docs' tokens into the shared folder and returns what its files give back.

    Null texts give the end id alone; repeated rows are rows of their own, in any order among themselves; columns
    besides doc_id and text are left out, whatever their names. A text is encoded whole in one task, however long. An
    empty table gives an empty one.
    """
    path = f"{work_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path)
    return digest(read_tokens(docs.sparkSession, path))
