"""Documents to chunks with offsets in code points."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE, clean, stable_id
from .tables import spread

SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，")


def cleaned(docs: DataFrame) -> DataFrame:
    """(doc_id, content) without documents that are empty once clean: told by their text, as a condition on the content would clean it twice."""
    return spread(docs.select("doc_id", "text")).where(F.col("text").rlike("(?U)[^\\s\\x1c-\\x1f]")).select("doc_id", clean(F.col("text")).alias("content"))


def fixed_chunks(docs: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """Windows of `size` every size - overlap code points. Blank ones go but keep their number; ends aren't clamped."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to size - 1")
    step = size - overlap
    at = F.posexplode_outer(F.sequence(F.lit(0), F.length("content") - 1, F.lit(step))).alias("chunk_index", "start_offset")  # outer: else Spark infers a filter that cleans each text once more
    raw = F.substring(F.col("content"), F.col("start_offset") + 1, F.lit(size))
    x = cleaned(docs).select("doc_id", "content", at).select("doc_id", "chunk_index", "start_offset", (F.col("start_offset") + size).alias("end_offset"), raw.alias("raw")).where(F.col("raw").rlike("(?U)\\S"))
    x = x.select("doc_id", "chunk_index", "start_offset", "end_offset", F.trim("raw", F.lit(WHITE)).alias("content"))
    return named(x)


def pieces(text: str, size: int) -> list[tuple[int, int]]:
    """(start, end) of pieces: cut after each of the coarsest separator that parts a piece over `size`, and so on; where none does, every `size`, the last end not clamped."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0)]
    while todo:
        start, end, level = todo.pop()
        if end - start <= size:
            out.append((start, end))
        elif level == len(SEPARATORS):
            out += [(i, i + size) for i in range(start, end, size)]
        else:
            cuts = [start]
            while (at := text.find(SEPARATORS[level], cuts[-1], end)) >= 0:
                cuts.append(at + len(SEPARATORS[level]))
            cuts += [end] * (cuts[-1] < end)
            todo += [(x, y, level + 1) for x, y in reversed(list(zip(cuts, cuts[1:])))]
    return out


def split_text(text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, chunk): pieces put together while they stay within `size`; each further chunk starts with the last `overlap` of the one before, whatever its size then."""
    out: list[tuple[int, int, str]] = []
    first = last = None
    for start, end in pieces(text, size):
        stop = min(end, len(text))
        if first is None:
            first = start
        elif stop - first > size:
            out.append((first, last, text[first:start]))
            first = max(first, start - overlap)
        last = end
    if first is not None:
        out.append((first, last, text[first:]))
    return out


def recursive_chunks(docs: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """(chunk_id, doc_id, chunk_index, start_offset, end_offset, content, vector_id) by `split_text` over clean texts; packing is sequential, so Python does it, by Arrow batches."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = [(i, n, *g) for i, text in enumerate(x["content"].to_pylist()) for n, g in enumerate(split_text(text, size, overlap))]
            row, *columns = zip(*got, strict=True) if got else ((),) * 5
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([x["doc_id"].take(pa.array(row, pa.int64())), *map(pa.array, columns, kinds)], names=["doc_id", "chunk_index", "start_offset", "end_offset", "content"])

    x = cleaned(docs).mapInArrow(cut, "doc_id long, chunk_index int, start_offset int, end_offset int, content string")
    return named(x)


def named(chunks: DataFrame) -> DataFrame:
    """chunks with chunk_id and vector_id; a `version` column makes part of the name."""
    version = F.concat(F.lit("_v"), F.col("version").cast("string")) if "version" in chunks.columns else F.lit("")
    name = F.concat(F.col("doc_id").cast("string"), version, F.lit("_chunk_"), F.col("chunk_index").cast("string"))
    return chunks.select(name.alias("chunk_id"), "*", stable_id(name).alias("vector_id"))
