"""Near-duplicate embeddings by an inverted multi-index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, components, forest, group_starts, materialise, whole_groups

COSINE = 0.98
#: Rows of a cell on average, and rows of the sample for each codeword at least; the sample on which the two codebooks are
#: fitted has SAMPLE rows, or more for more codewords, up to MOST_SAMPLE. On how many of them the recall is measured, and
#: the recall to reach.
IN_CELL, PER_CODE, SAMPLE, MOST_SAMPLE, PROBED, RECALL = 512, 8, 4000, 65_536, 1000, 0.995
#: Rows of one cell that meet in one task.
BLOCK = 2048


def codebook(x: np.ndarray, k: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """k codewords by Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    if len(x) == 0:
        return np.zeros((1, 0))
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(1)
        for j in range(len(c)):
            if (own := near == j).any():
                c[j] = x[own].mean(0)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def multi_sequence(d1: np.ndarray, d2: np.ndarray, cells: int) -> np.ndarray:
    """The `cells` nearest cells of the product grid for each row, nearest first, as numbers i * codes + j.

    A cell is as far as its two codewords together. In order of the two sorted lists, the cell at ranks (a, b) has
    (a + 1)(b + 1) - 1 cells that are no farther, so only cells with (a + 1)(b + 1) <= cells can be among the nearest.
    """
    k1, k2 = d1.shape[1], d2.shape[1]
    cells = min(cells, k1 * k2)
    o1, o2 = d1.argsort(1, kind="stable")[:, :cells], d2.argsort(1, kind="stable")[:, :cells]
    ranks = [(a, b) for a in range(min(cells, k1)) for b in range(min(cells // (a + 1), k2))]
    a, b = np.array(ranks).T
    s = np.take_along_axis(d1, o1, 1)[:, a] + np.take_along_axis(d2, o2, 1)[:, b]
    number = o1[:, a] * k2 + o2[:, b]
    first = np.lexsort((number, s), axis=1)[:, :cells]
    return np.take_along_axis(number, first, 1)


def rank(d1: np.ndarray, d2: np.ndarray, home: np.ndarray) -> np.ndarray:
    """How many cells are nearer to each row than cell `home`."""
    k2 = d2.shape[1]
    own = np.take_along_axis(d1, home[:, None] // k2, 1) + np.take_along_axis(d2, home[:, None] % k2, 1)
    lists = np.sort(d2, 1)
    return np.array([np.searchsorted(y, s - x, "left").sum() for x, y, s in zip(d1, lists, own[:, 0], strict=True)])


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of large components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Grid:
    """Two codebooks for vectors of one length, and how many cells to visit so that links are found at the target recall."""

    def __init__(self, x: np.ndarray, codes: int, cosine: float, seed: int = 7) -> None:
        """x: unit vectors of the sample. They are moved by as much as a link allows, in random directions; a link is found when either end's cell is among those that the other visits."""
        rng = np.random.default_rng(seed)
        self.half = x.shape[1] // 2
        k = max(1, min(codes, len(x) // PER_CODE))
        self.c1, self.c2 = codebook(x[:, : self.half], k, seed), codebook(x[:, self.half :], k, seed + 1)
        y = x[rng.permutation(len(x))[:PROBED]]
        side = rng.normal(size=y.shape)
        side -= (side * y).sum(1)[:, None] * y
        side /= np.maximum(np.sqrt((side * side).sum(1)), 1e-12)[:, None]
        moved = cosine * y + np.sqrt(1 - cosine * cosine) * side
        ends = [self.to(v) for v in (y, moved)]
        homes = [multi_sequence(*d, 1)[:, 0] for d in ends]
        need = np.minimum(rank(*ends[0], homes[1]), rank(*ends[1], homes[0]))
        self.cells = int(np.quantile(need, RECALL, method="higher")) + 1

    def to(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.c1), distances(x[:, self.half :], self.c2)

    def visits(self, x: np.ndarray) -> np.ndarray:
        """The cells of each unit vector, its own first."""
        return np.concatenate([multi_sequence(*self.to(x[i : i + 4096]), self.cells) for i in range(0, len(x), 4096)])


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vec_id.

    Vectors of equal, non-null label and equal length link at a cosine of at least `cosine`, in double precision. Equal
    vectors of a label are one, with their number, before any comparison, so many copies cost nothing. Two codebooks,
    one for each half, are fitted on a sample, with more codewords for more vectors, so that cells stay as small; every
    vector is put in its cell of the product grid, and visits the cells nearest to it, as many as the target recall
    takes; what it meets there is verified. A pair is found when either visits the other's cell, and counted once on
    both sides. Large cells are cut into blocks, and tasks give counts and a spanning forest, not pairs.

    Null or zero vectors, vectors with null or non-finite components, and null labels or ids link with nothing. Rows
    that repeat a vec_id are one vector, that of the least (label, embedding) among those with a label and a vector.
    Other columns are left out, whatever their names. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()
    e = F.col("embedding")
    good = F.col("label").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding", F.coalesce(good, F.lit(False)).alias("good"))
    k1, k2 = F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(7), "embedding").alias("k2")
    base = base.select("vec_id", "label", "good", F.size("embedding").alias("n"), k1, k2, "embedding")
    one = base.groupBy("vec_id").agg(F.min(F.struct(~F.col("good"), "label", "embedding", "good", "n", "k1", "k2")).alias("v"))
    rows = materialise(one.select("vec_id", "v.label", "v.embedding", "v.good", "v.n", "v.k1", "v.k2"), "vectors")
    able = rows.where("good and vec_id is not null")
    same = ["label", "n", "k1", "k2"]
    copies = materialise(able.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")), "copies")
    reps = able.join(copies.select(F.col("rep").alias("vec_id"), "m"), "vec_id").select("vec_id", "m", "label", "n", "embedding")
    count = copies.count()
    codes = math.ceil(math.sqrt(count / IN_CELL))
    sample = reps.orderBy(F.xxhash64("vec_id")).limit(min(MOST_SAMPLE, max(SAMPLE, 2 * PER_CODE * codes))).select("n", "embedding").toArrow()
    lengths = sample["n"].to_numpy()
    drawn = {int(n): unit(matrix(sample["embedding"].combine_chunks().filter(pa.array(lengths == n)))) for n in np.unique(lengths)}
    grid = spark.sparkContext.broadcast({n: Grid(x, codes, cosine) for n, x in drawn.items()})

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            length = x["n"].to_numpy()
            for n in np.unique(length):
                some = x.filter(pa.array(length == n))
                known = grid.value.get(int(n))  # a length that the sample lacks has one cell
                seen = known.visits(unit(matrix(some["embedding"]))) if known else np.zeros((some.num_rows, 1), int)
                visits = pa.ListArray.from_arrays(pa.array(np.arange(len(seen) + 1) * seen.shape[1], pa.int32()), pa.array(seen.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(some[c] for c in ("vec_id", "m", "label", "n")), pa.array(seen[:, 0].astype(np.int32)), visits, some["embedding"]], names=["vec_id", "m", "label", "n", "home", "visits", "v"])

    placed = materialise(reps.mapInArrow(cells, f"vec_id long, m long, label string, n int, home int, visits array<int>, v {kind}"), "cells")
    cell = F.xxhash64("label", "n", "home").alias("cell")
    sizes = materialise(placed.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "cell-sizes")
    sizes = broadcast_if_small(sizes)
    # residents go to their block of their cell; visitors go to all blocks of a cell, dealt into parts
    visitors = placed.select("*", F.explode("visits").alias("to")).withColumn("cell", F.xxhash64("label", "n", "to"))
    visitors = visitors.join(sizes, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int")
    none = F.lit(None).cast("array<int>").alias("visits")  # only residents' visits are asked for
    visitors = visitors.select("cell", part.alias("q"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("r"), "vec_id", "m", "home", none, "v")
    residents = placed.withColumn("cell", cell).join(sizes, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("blocks")).cast("int")
    residents = residents.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q"), block.alias("r"), "vec_id", "m", "home", "visits", "v")
    keys = ["cell", "q", "r"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            starts = group_starts(t, keys)
            ids, home, m = (t[c].to_numpy() for c in ("vec_id", "home", "m"))
            visits, vecs = t["visits"].combine_chunks(), t["v"].combine_chunks()
            lives = visits.is_valid().to_numpy(zero_copy_only=False)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for g, to in zip(starts[:-1], starts[1:], strict=True):
                r, q = g + np.flatnonzero(lives[g:to]), g + np.flatnonzero(~lives[g:to])
                if not len(r) or not len(q):
                    continue
                x = matrix(vecs.slice(g, to - g))
                x = x / np.abs(x).max(1, keepdims=True)
                long = np.sqrt((x * x).sum(1))
                u = x / long[:, None]
                w = visits.slice(g, to - g).filter(pa.array(lives[g:to])).flatten().to_numpy().reshape(len(r), -1)
                for at in range(0, len(q), 512):
                    some = q[at : at + 512]
                    i, j = np.nonzero(u[some - g] @ u[r - g].T >= cosine - 1e-9)
                    near = w[j]
                    i, j = some[i], r[j]
                    exact = np.einsum("ij,ij->i", x[i - g], x[j - g]) / (long[i - g] * long[j - g]) >= cosine
                    exact &= ids[i] != ids[j]
                    found.append((i[exact], j[exact], (near == home[i][:, None]).any(1)[exact]))  # then the resident finds the visitor itself
            zero = np.zeros(0, np.int64)
            i, j, both = (np.concatenate([zero, *c]).astype(np.int64) for c in zip(*found, strict=True)) if found else (zero,) * 3
            named, at_ = np.unique(np.concatenate([ids[i], ids[j]]), return_inverse=True)
            a, b = at_[: len(i)], at_[len(i) :]
            links = np.bincount(a, m[j], len(named)) + np.bincount(b, m[i] * (both == 0), len(named))
            label = forest(len(named), a, b)
            own = np.flatnonzero(label != np.arange(len(named)))
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([named[some], named[own]])), pa.array(np.concatenate([links[some], np.zeros(len(own))]).astype(np.int64)), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(named[label[own]])])], names=["vec_id", "links", "to"])

    met = visitors.unionByName(residents).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "vec_id long, links long, to long")
    met = materialise(met, "links")
    links = met.where("to is null").groupBy(F.col("vec_id").alias("of")).agg(F.sum("links").alias("others"))
    found = components(met.where("to is not null").select(F.col("vec_id").alias("a"), F.col("to").alias("b")))
    told = copies.join(links, F.col("rep") == F.col("of"), "left").join(found, F.col("rep") == F.col("node"), "left")
    told = told.select(*[F.col(c).alias(f"the_{c}") for c in same], (F.col("m") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component"))
    told = broadcast_if_small(materialise(told, "classes"))
    match = F.col("good") & reduce(Column.__and__, [F.col(c) == F.col(f"the_{c}") for c in same])
    own = F.coalesce("component", "vec_id")
    out = rows.select("vec_id", "good", *same).join(told, match & F.col("vec_id").isNotNull(), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
