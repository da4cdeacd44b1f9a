"""Texts to vectors: signed feature hashing in column functions, and as a model that workers load."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import terms

DIM = 256
#: Texts that a model takes at once.
AT_ONCE = 256

#: What encodes: a list of texts to a row of floats each.
Model = Callable[[list[str]], np.ndarray]


def hashed(df: DataFrame, text: str = "text", out: str = "embedding", dim: int = DIM) -> DataFrame:
    """df with `out`: its text's terms, each hashed to one of dim places and a sign, summed and made one long. Null without terms.

    A place is the top bits of a term's MD5, the sign its next. Codes are sorted within the row, together with one of each
    code there is, so that the ends of their runs are the counts by code: nothing leaves the row, and nothing is searched.
    Each step is a column of its own, as lambdas would work out an inner expression again; the sums come through an explode
    of one row, which no filter on the vectors is pushed beneath.
    """
    code = lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % (2 * dim)).cast("int")
    x = df.withColumn("_terms", terms(F.col(text)))
    x = x.withColumn("_codes", F.when(F.size("_terms") > 0, F.sort_array(F.concat(F.transform("_terms", code), F.sequence(F.lit(0), F.lit(2 * dim - 1))))))
    n, at = F.size("_codes"), lambda i: F.element_at("_codes", i.cast("int"))
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (at(i) != at(F.least(i + 1, n))))
    x = x.withColumn("_ends", F.when(F.col("_codes").isNotNull(), F.concat(F.array(F.lit(0)), ends)))
    end = lambda i: F.element_at("_ends", i.cast("int"))  # noqa: E731  of the runs before, for i from 1
    sums = F.when(F.col("_ends").isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: (end(2 * b + 3) - 2 * end(2 * b + 2) + end(2 * b + 1)).cast("double")))
    x = x.select("*", F.explode(F.array(F.struct(sums.alias("s")))).alias("_x")).withColumn("_sums", F.col("_x.s"))
    long = F.sqrt(F.aggregate("_sums", F.lit(0.0), lambda s, v: s + v * v))
    x = x.withColumn("_long", F.nullif(long, F.lit(0.0)))
    return x.withColumn(out, F.when(F.col("_long").isNotNull(), F.transform("_sums", lambda v: v / F.col("_long")))).drop("_terms", "_codes", "_ends", "_x", "_sums", "_long")


class HashingModel:
    """The same vectors as `hashed` gives, by text; stands in where a trained model would be loaded."""

    _TERM = regex.compile(r"(?V1)[一-鿿]|[[\p{L}\p{N}]--[一-鿿]]++")

    def __init__(self, dim: int = DIM) -> None:
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for v, t in zip(out, texts, strict=True):
            codes = [int(md5(w.encode()).hexdigest()[:8], 16) % (2 * self.dim) for w in self._TERM.findall(t.lower())]
            np.add.at(v, [c // 2 for c in codes], [2 * (c % 2) - 1 for c in codes])
        return out


_LOADED: dict[str, Model] = {}


def encoder(load: Callable[[], Model], name: str, dim: int = DIM, at_once: int = AT_ONCE):
    """A column function that encodes texts by the model of that name, vectors made one long.

    A worker loads a model once, when it first meets it, and gives it `at_once` texts at a time. Null texts and vectors
    of length 0 give null. A model that gives other than dim numbers a text, or any that isn't finite, is an error.
    """

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if name not in _LOADED:
            _LOADED[name] = load()
        for texts in batches:
            some = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            vectors = np.zeros((len(texts), dim))
            for i in range(0, len(some), at_once):
                at = some[i : i + at_once]
                got = np.asarray(_LOADED[name](texts.take(pa.array(at)).to_pylist()), np.float64)
                if got.shape != (len(at), dim) or not np.isfinite(got).all():
                    raise ValueError(f"{name} gave {got.shape} for {len(at)} texts, or numbers that aren't finite; {dim} a text were due")
                vectors[at] = got
            long = np.linalg.norm(vectors, axis=1)
            with np.errstate(invalid="ignore"):
                vectors /= long[:, None]
            edge = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim)
            yield pa.ListArray.from_arrays(edge, pa.array(vectors.ravel()), mask=pa.array(long == 0))

    return F.arrow_udf(encode, "array<double>")
