"""Shards of near equal bytes by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, slots, text_or_empty

SHARDS = 24


class FreeTree:
    """(free, bin) pairs in a treap, a search tree that hashed priorities keep balanced."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    def _split(self, t: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        if t is None:
            return None, None
        if t[0] < key:
            t[3], right = self._split(t[3], key)
            return t, right
        left, t[2] = self._split(t[2], key)
        return left, t

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, free: int, bin_: int) -> None:
        left, right = self._split(self.root, (free, bin_))
        self.root = self._merge(self._merge(left, [(free, bin_), hash((free, bin_, 7)) & 0xFFFFFFFF, None, None]), right)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the pair of least free space that is at least size."""
        t, best = self.root, None
        while t is not None:
            if t[0] >= (size, -1):
                best, t = t[0], t[2]
            else:
                t = t[3]
        if best is not None:
            left, right = self._split(self.root, best)
            _, right = self._split(right, (best[0], best[1] + 1))
            self.root = self._merge(left, right)
        return best


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """For each (size, count), sizes falling: (bin, how many of them) in the order of placing, each into the tightest bin that takes it.

    Groups of one size are alike, and the tightest bin stays so while it takes more of them, so a step places as many as
    fit there. None when more than `most` bins are needed.
    """
    tree, bins, out = FreeTree(), 0, []
    for s, left in sizes:
        own = []
        while left:
            if (got := tree.tightest(s)) is None:
                if bins == most or s > capacity:
                    return None
                got, bins = (capacity, bins), bins + 1
            n = min(left, got[0] // s)
            own.append((got[1], n))
            tree.add(got[0] - n * s, got[1])
            left -= n
        out.append(own)
    return out


def place(sizes: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """(shard, how many) for each (size, count), sizes falling: the least capacity found at which best-fit-decreasing needs at most that many shards.

    A group at or above the mean of what is left has a shard to itself, so that the rest stays even.
    """
    out: list[list[tuple[int, int]]] = []
    todo, left, rest = list(sizes), shards, sum(s * n for s, n in sizes)
    alone: list[list[tuple[int, int]]] = []
    while todo and left > 1 and todo[0][0] * left >= rest:
        s, n = todo[0]
        own = []
        while n and left > 1 and s * left >= rest:
            left, n, rest = left - 1, n - 1, rest - s
            own.append((left, 1))
        alone.append(own)
        if n:
            todo[0] = (s, n)
            break
        todo.pop(0)
    low = max([-(-rest // left), *(s for s, _ in todo[:1])])
    best = best_fit_decreasing(todo, low, left)
    if best is None:
        high = low + max(1, low // 64)
        while (best := best_fit_decreasing(todo, high, left)) is None:
            high *= 2
        for _ in range(8):
            if low + 1 >= high:
                break
            if (got := best_fit_decreasing(todo, mid := (low + high) // 2, left)) is None:
                low = mid
            else:
                high, best = mid, got
    if len(alone) + len(best) > len(sizes):  # a size of which some stand alone and some do not
        out, best = [*alone[:-1], alone[-1] + best[0]], best[1:]
    else:
        out = alone
    return out + best


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, by law `bytes`: shards near equal in bytes.

    Rows of equal text stay together and are one group, placed by the bytes of all its rows. What one task places is
    how many groups there are of each size: different sizes add up to the total at least, so there are at most
    sqrt(2 * total bytes) of them, however many groups. A group's number among those of its size tells its shard.

    A text whose copies hold a shard's share or more has a shard to itself, and the others share the rest evenly. Null
    texts are sized as empty (8 bytes) and stay with empty ones. Repeated rows and ids are rows each. Other columns are
    left out, whatever their names. An empty table gives an empty one.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    t = text_or_empty()
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.md5(t).alias("text_md5")), "sized")
    groups = materialise(rows.groupBy("text_md5").agg(F.sum("size").alias("bytes")), "groups")
    classes = materialise(groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")), "sizes")

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = pd.concat([pd.DataFrame({"bytes": [], "n": []}), *parts]).astype("int64").sort_values("bytes", ascending=False)
        if x.empty:
            return
        found = place(list(zip(x["bytes"].tolist(), x["n"].tolist(), strict=True)), shards)
        yield pd.DataFrame({"bytes": x["bytes"], "to": [[s for s, _ in own] for own in found], "upto": [list(accumulate(n for _, n in own)) for own in found]})

    plan = materialise(classes.coalesce(1).mapInPandas(placed, "bytes long, to array<int>, upto array<long>"), "placed")
    n = rows.count()
    numbered = slots(groups, ["bytes"], ["text_md5"], n)
    at = F.size(F.filter("upto", lambda u: u <= F.col("slot"))) + 1
    where = materialise(numbered.join(broadcast_if_small(plan), "bytes").select(F.col("text_md5").alias("md5"), F.element_at("to", at).alias("shard")), "shards")
    known = rows.join(broadcast_if_small(where), F.col("text_md5") == F.col("md5")).select("doc_id", "size", "text_crc32", "shard")
    got = slots(known, ["shard"], ["doc_id", "text_crc32"], n // shards)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
