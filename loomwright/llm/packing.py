"""Best-fit packing by swap-based local search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise
from .tokens import pieces

SIZE = 4096
#: Pieces that are packed together.
GROUP = 8192


def best_fit(lengths: list[int], cap: int) -> list[list[int]]:
    """Bins of item numbers, longest item first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}
    mask = 0  # bit r: there is a bin with r free
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[i]
        if fit := mask >> n:
            r = n + (fit & -fit).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask ^= 1 << r
            bins[b].append(i)
        else:
            r, b = cap, len(bins)
            bins.append([i])
        if left := r - n:
            free.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins


def least_bins(lengths: np.ndarray, cap: int) -> int:
    """Bins that any packing needs: for the total, for items of which at most k share a bin, and for the room that items over half leave beside them."""
    n = np.sort(lengths)
    sums = np.concatenate([[0], np.cumsum(n)])
    least = -(-int(sums[-1]) // cap)
    for k in range(1, 9):
        over = len(n) - int(np.searchsorted(n, cap // (k + 1), "right"))  # k + 1 of these are over the size
        least = max(least, -(-over // k))
    half = int(np.searchsorted(n, cap // 2, "right"))
    for small in np.unique(n[:half]):  # those over cap - small have no room for what is as long as small or longer
        low, high = int(np.searchsorted(n, small)), int(np.searchsorted(n, cap - small, "right"))
        room = (high - half) * cap - int(sums[high] - sums[half])
        least = max(least, len(n) - half + max(0, -(-(int(sums[half] - sums[low]) - room) // cap)))
    return least


def local_search(bins: list[list[int]], lengths: list[int], cap: int, slack: int = 0) -> list[list[int]]:
    """Moves an item from one underfull bin to another, or one or two for one of the other's, from the emptiest bins on.

    Of all exchanges that a bin can make, that by which the sum of squared fills grows most is made, so fills drift apart
    until bins are empty and go. Every item is a slot that takes an incoming length between its own and that and its bin's
    room; a bin meets all slots at once, and again only those of bins that changed since, unless it changed itself. Ends
    when there are at most `slack` bins more than `least_bins`, or when no bin can give.
    """
    size = np.array(lengths, np.int64)
    n, bins = len(size), [list(b) for b in bins]
    fill = np.array([size[b].sum() for b in bins], np.int64)
    own = np.concatenate([size, np.zeros(len(bins), np.int64)])  # the last slot of each bin takes an item for nothing
    of = np.concatenate([np.zeros(n, np.int64), np.arange(len(bins))])
    for b, members in enumerate(bins):
        of[members] = b
    room = cap - fill[of]
    when = np.zeros(len(own), np.int64)  # when a slot's bin last changed
    changed, tried = np.zeros(len(bins), np.int64), np.full(len(bins), -1)
    now, left, least, moved = 0, len(bins), least_bins(size, cap) + slack, True

    def best(a: int, among: np.ndarray) -> tuple[tuple[int, ...], int] | None:
        """(items that go, slot that takes them) of the greatest gain."""
        y, r = own[among], room[among]
        f = cap - r - fill[a]
        items = bins[a]
        pairs = np.triu_indices(len(items), 1)
        for go in ([(i,) for i in range(len(items))], list(zip(*(p.tolist() for p in pairs), strict=True))):
            x = np.array([sum(size[items[i]] for i in g) for g in go], np.int64)
            x, first = np.unique(x, return_index=True)
            step = max(1, (1 << 20) // len(y))
            top, found = 0, None
            for i in range(0, len(x), step):
                gain = x[i : i + step, None] - y
                worth = np.where((gain > 0) & (gain <= r) & (f + gain > 0), gain * (f + gain), 0)
                k = int(worth.argmax())
                if worth.flat[k] > top:
                    top, found = worth.flat[k], (tuple(items[j] for j in go[first[i + k // len(y)]]), int(among[k % len(y)]))
            if found:
                return found
        return None

    while moved and left > least:
        moved = False
        for a in np.argsort(fill, kind="stable").tolist():
            while bins[a] and fill[a] < cap and left > least:
                open_ = (room > 0) & (of != a)
                if changed[a] <= tried[a]:
                    open_ &= when > tried[a]
                among = np.flatnonzero(open_)
                tried[a] = now
                if not len(among) or (got := best(a, among)) is None:
                    break
                go, slot = got
                b, now, moved = int(of[slot]), now + 1, True
                back = (slot,) if slot < n else ()
                bins[a] = [i for i in bins[a] if i not in go] + list(back)
                bins[b] = [i for i in bins[b] if i not in back] + list(go)
                gain = int(sum(size[i] for i in go) - own[slot])
                fill[a], fill[b] = fill[a] - gain, fill[b] + gain
                for k in (a, b):
                    slots = [*bins[k], n + k]
                    of[slots], room[slots], when[slots], changed[k] = k, (cap - fill[k]) if bins[k] else 0, now, now
                left -= not bins[a]
            if left <= least:
                break
    return [b for b in bins if b]


def pack(items: DataFrame, size: int = SIZE, length: str = "length", key: tuple[str, ...] = ("doc_id", "piece"), group: int = GROUP) -> DataFrame:
    """items with sequence_id and offset: as few sequences of at most `size` as it can, gapless from offset 0.

    Items are dealt by a hash of their key into groups of about `group`, each packed in one task. Sequences left under
    97 % full are then taken apart and packed again in fewer groups, up to three times; while that is to come, a group may
    keep one sequence more than it needs at least. What the last round leaves stays as it is.
    Lengths must be between 1 and size; null lengths raise an error. Repeated items, and those whose keys are null, are
    items of their own; equal items take any order. Input columns _group, _fill, sequence_id and offset are not kept.
    """
    items = items.drop("_group", "_fill", "sequence_id", "offset")
    out = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("_fill", T.LongType())])
    columns = items.columns

    def packed(level: int, last: bool):
        def one(k: tuple[pa.Scalar, ...], x: pa.Table) -> pa.Table:
            x = x.take(pc.sort_indices(x, [(c, "ascending") for c in (*key, length)], null_placement="at_start")).select(columns)
            lengths = x[length].to_pylist()
            if min(lengths) < 1 or max(lengths) > size:
                raise ValueError(f"lengths must be from 1 to {size}")
            bins = local_search(best_fit(lengths, size), lengths, size, 0 if last else 1)
            no, at, full = (np.zeros(len(lengths), np.int64) for _ in range(3))
            for b, members in enumerate(bins):
                n = np.array([lengths[i] for i in members])
                no[members], at[members], full[members] = b, np.cumsum(n) - n, n.sum()
            for name, c in (("sequence_id", (level << 60) + (k[0].as_py() << 24) + no), ("offset", at), ("_fill", full)):
                x = x.append_column(name, pa.array(c))
            return x

        return one

    done, left = None, items
    n = items.count()
    groups = max(1, -(-n // group))
    for level in range(4):
        hashed = F.pmod(F.xxhash64(*key, length, F.lit(level)), F.lit(groups)).cast("int")
        last = groups == 1 or level == 3
        got = left.withColumn("_group", hashed).groupBy("_group").applyInArrow(packed(level, last), out)
        if last:
            done = got if done is None else done.unionByName(got)
            break
        got = materialise(got, "packed")
        full = got.where(F.col("_fill") >= int(size * 0.97))
        done = full if done is None else done.unionByName(full)
        left = got.where(F.col("_fill") < int(size * 0.97)).select(*columns)
        rest = left.count()
        if not rest:
            break
        groups = max(1, min(groups - 1, -(-rest // group)))
    return done.drop("_fill")


def pack_documents(docs: DataFrame, size: int = SIZE, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of all pieces of all rows.

    Null texts are packed as empty ones, one end id each. Repeated rows are packed each. Columns besides doc_id and text
    are left out, whatever their names. A text is encoded whole in one task, however long. An empty table gives an
    empty one.
    """
    return pack(materialise(pieces(docs, size, end_id, keep_ids), "pieces"), size)
