"""SimHash near-duplicates by bit-sliced comparison."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, components, forest, group_starts, materialise, whole_groups

SEED = 42
RADIUS = 3
#: The 64 bits are cut into this many bands; two fingerprints that differ in RADIUS bits agree on at least BANDS - RADIUS of them.
BANDS = 5
#: Near-duplicates that `keep_first` looks for: their shingles' similarity, the chance that a pair of just that similarity is
#: in no common bucket, in how many of 64 bits it may differ, and of 128, and how many of a fingerprint's links in a bucket are looked at in the first round.
SIMILARITY, MISSED, WIDE, WIDER, NEAREST = 0.8, 0.05, 16, 30, 2
#: Larger buckets are cut into blocks of about this many fingerprints, and pairs of blocks are compared. Families of texts come with their shingles, in smaller blocks.
BLOCK, FAMILY = 4096, 1024


def majority(text: str, words: int, digest: Callable[[bytes, int], bytes], width: int = 64) -> np.ndarray:
    """The bits, as 64-bit words, that are set in over half the digests of all word shingles, repeats included; none without a word."""
    w = text.encode().lower().split()  # bytes: only A-Z are lowered and only ASCII blanks part words
    grams = [b" ".join(s) for s in zip(*(w[i:] for i in range(words)))] if len(w) >= words else [b" ".join(w)] if w else []
    bits = np.zeros(width, np.int64)
    for i in range(0, len(grams), 1 << 16):  # a very long text takes little memory
        part = np.frombuffer(b"".join(digest(g, SEED) for g in grams[i : i + (1 << 16)]), np.uint8).reshape(-1, width // 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(bits * 2 > len(grams), bitorder="little").view("<u8")


def _xxh64(gram: bytes, seed: int) -> bytes:
    return xxhash.xxh64_digest(gram, seed)[::-1]  # least byte first


def fingerprint(text: str, words: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles."""
    return int(majority(text, words, _xxh64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            fp = np.fromiter((fingerprint(t.as_py() or "") for t in x["text"]), np.uint64, x.num_rows)
            yield pa.RecordBatch.from_arrays([x["doc_id"], pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(rows, "doc_id long, fp long")


def wide_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, h, fp, more) of every row: 128 majority bits in two longs, and a hash of the text that tells rows of one doc_id apart."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            both = np.array([majority(t.as_py() or "", words, xxhash.xxh3_128_digest, 128) for t in x["text"]], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([x["doc_id"], x["h"], pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["doc_id", "h", "fp", "more"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("h")).mapInArrow(rows, "doc_id long, h long, fp long, more long")


def masks(radius: int = RADIUS, bands: int = BANDS) -> list[int]:
    """The bits of each choice of bands that two fingerprints within the radius may agree on; they agree on one choice at least."""
    edges = [64 * i // bands for i in range(bands + 1)]
    band = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(bands)]
    return [sum(c) for c in combinations(band, bands - radius)]


def sliced_links(fp: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same group that differ in at most `radius` bits, as two arrays (first below second).

    Each group fills lanes of 64-bit words; plane p of a word has bit p of its 64 lanes. A row is held against a word by
    XOR with each plane in turn, and counted in all lanes at once by carry-save counters that stick once they pass the
    radius. Words whose lanes have all passed it are given up after every eight planes.
    """
    size = np.diff(starts)
    words = -(-size // 64)
    base = np.concatenate([[0], np.cumsum(words)])
    group = np.repeat(np.arange(len(size)), size)
    lane = np.arange(len(fp)) - starts[group] + base[group] * 64
    total = int(base[-1])
    spread = np.zeros(total * 64, np.uint64)
    spread[lane] = fp
    row = np.full(total * 64, -1)
    row[lane] = np.arange(len(fp))
    bits = np.unpackbits(spread.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)
    valid = np.packbits(row >= 0, bitorder="little").view(np.uint64)
    del bits, spread
    own = lane // 64
    todo = base[group + 1] - own  # a row meets its own word and those after it
    counters = max(1, int(radius).bit_length())
    found_a, found_b = [], []
    ends = np.cumsum(todo)
    at = 0
    while at < len(fp):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 32_768, "right")))
        q = np.repeat(np.arange(at, to), todo[at:to])
        first = np.repeat(ends[at:to] - todo[at:to], todo[at:to])
        w = own[q] + np.arange(len(q)) + (ends[at - 1] if at else 0) - first
        at = to
        mask = valid[w].copy()
        mine = w == own[q]
        low = (lane[q[mine]] % 64).astype(np.uint64)
        mask[mine] &= ~((np.uint64(2) << low) - np.uint64(1))  # only lanes above the row itself
        live = mask != 0
        q, w, mask = q[live], w[live], mask[live]
        over = np.zeros(len(q), np.uint64)
        count = [np.zeros(len(q), np.uint64) for _ in range(counters)]
        mine_fp = fp[q]
        for p in range(64):
            carry = planes[p][w] ^ (np.uint64(0) - ((mine_fp >> np.uint64(p)) & np.uint64(1)))
            for k in range(counters):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if p % 8 == 7:
                if radius + 1 < 1 << counters:
                    passed = _above(count, radius)
                    gone = over | passed
                else:
                    gone = over
                live = (mask & ~gone) != 0
                if not live.all():
                    q, w, mask, over, mine_fp = q[live], w[live], mask[live], over[live], mine_fp[live]
                    count = [c[live] for c in count]
                if not len(q):
                    break
        if len(q):
            hit = mask & ~(over | _above(count, radius))
            some = hit != 0
            at_bits = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.nonzero(at_bits)
            found_a.append(q[some][i])
            found_b.append(row[w[some][i] * 64 + j])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found_a]), np.concatenate([empty, *found_b])


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    above, equal = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            equal &= count[k]
        else:
            above |= equal & count[k]
            equal &= ~count[k]
    return above


def sampled_masks(rows: int, similarity: float = SIMILARITY, missed: float = MISSED, seed: int = SEED) -> list[int]:
    """Bits drawn for each table so that few unlike fingerprints share a bucket, however many rows there are, in so many
    tables that a pair of that similarity shares none with a chance of `missed`, over the bits in which such pairs differ.
    """
    apart = angle(similarity)
    bits = max(10, math.ceil(math.log2(max(1, rows) / 512)))
    differ = [math.comb(64, d) * apart**d * (1 - apart) ** (64 - d) for d in range(65)]
    share = [math.comb(64 - d, bits) / math.comb(64, bits) for d in range(65)]
    tables = 1
    while sum(p * (1 - s) ** tables for p, s in zip(differ, share, strict=True)) > missed:
        tables += 1
    rng = np.random.default_rng(seed)
    return [sum(1 << int(b) for b in rng.permutation(64)[:bits]) for _ in range(tables)]


def angle(similarity: float) -> float:
    """The share of bits that differ, on average, between fingerprints of texts of that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _links(radius: int, wider: int | None, nearest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links in sorted buckets: a spanning forest of them or, with `nearest`, those of each fingerprint to so many others, the nearest by 128 bits.

    With `wider`, links of more bits than that of all 128 don't count. A fingerprint that has more links than are given is
    also linked to itself, as a mark. A link is left out only where both its ends have that mark.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["bucket", "i", "j"]
        for t in whole_groups(batches, keys):
            starts = group_starts(t, keys)
            big = np.diff(starts) > 1
            size = np.diff(starts)[big]
            if not len(size):
                continue
            take = np.repeat(big, np.diff(starts))
            fp = t["fp"].to_numpy()[take].view(np.uint64)
            a, b = sliced_links(fp, np.concatenate([[0], np.cumsum(size)]), radius)
            if wider is not None:
                more = t["more"].to_numpy()[take].view(np.uint64)
                apart = np.bitwise_count(fp[a] ^ fp[b]) + np.bitwise_count(more[a] ^ more[b])
                near = apart <= wider
                a, b, apart = a[near], b[near], apart[near]
            if not nearest:
                label = forest(len(fp), a, b)
                a = np.flatnonzero(label != np.arange(len(fp)))
                b = label[a]
            else:
                a, b, apart = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(apart, 2)
                order = np.lexsort((b, apart, a))
                a, b = a[order], b[order]
                first = np.arange(len(a)) - np.searchsorted(a, a) < nearest
                more_left = np.unique(a[~first])
                a, b = np.concatenate([a[first], more_left]), np.concatenate([b[first], more_left])
            yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["a", "b"])

    return links


def compared(fps: DataFrame, tables: list[int], radius: int, wider: int | None = None, nearest: int = 0) -> DataFrame:
    """(a, b): links between different values of fp (written once) that agree on all bits of one of the tables' masks and differ in at most `radius`.

    With `wider`, fps has `more`, another 64 bits, and links that differ in more than that of all 128 bits fall out where
    they are found. A bucket gives a spanning forest of its links or, with `nearest`, so many for each fingerprint, and a
    link to itself where it has others besides. Large buckets are cut into blocks, and pairs of blocks are compared, so that no task gets a whole one.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in tables]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    own = [c for c in ("fp", "more") if c in fps.columns]
    blocks = in_blocks(fps.select(*own, F.explode(keys).alias("bucket")), own, BLOCK)
    return blocks.mapInArrow(_links(radius, wider, nearest), "a long, b long")


def in_blocks(buckets: DataFrame, own: list[str], size: int) -> DataFrame:
    """(bucket, i, j, own..) sorted within tasks: buckets(bucket, fp, ..) of over `size` rows are cut into blocks by fp, and each two blocks i and j are put together."""
    hot = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).select("bucket", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1), lambda k: F.struct(F.least(k, mine).alias("i"), F.greatest(k, mine).alias("j")))
    )
    blocks = buckets.join(broadcast_if_small(materialise(hot, "hot")), "bucket", "left").select("bucket", *own, F.explode(pairs).alias("p")).select("bucket", "p.i", "p.j", *own)
    return blocks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs.

    Fingerprints that differ in at most RADIUS bits are linked; component_id is the smallest doc_id reachable. Equal
    fingerprints are one before any comparison, so exact copies cost nothing. Each distinct fingerprint goes to one
    bucket for each choice of BANDS - RADIUS bands, which no link escapes; buckets are compared bit-sliced, give a
    spanning forest rather than all their links, and are compared by pairs of blocks when they are large.

    Null texts count as empty (fingerprint 0). Rows with a null doc_id are linked like any other and get the component of
    their fingerprint, null if no row of the component has an id. Repeated rows and ids stay as they are. Other columns
    are left out, whatever their names. A very long text is hashed in one task, in parts. An empty table gives an empty one.
    """
    fps = materialise(fingerprints(docs), "fp")
    reps = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    found = components(compared(reps, masks(), RADIUS))
    linked = materialise(reps.join(found, reps.fp == found.node).select("node", "component", "rep"), "linked")
    low = linked.groupBy("component").agg(F.min("rep").alias("low"))
    named = materialise(linked.join(low, "component").select("node", "low"), "named")
    by_fp = reps.join(broadcast_if_small(named), reps.fp == named.node, "left").select(F.col("fp").alias("own_fp"), F.when(F.col("node").isNull(), F.col("rep")).otherwise(F.col("low")).alias("component_id"))
    return fps.join(by_fp, F.col("fp") == F.col("own_fp")).select("doc_id", "fp", "component_id")


def _shingles(text: str, words: int) -> np.ndarray:
    """The different word shingles as sorted 32-bit hashes."""
    w = text.encode().lower().split()
    h = xxhash.xxh32_intdigest
    grams = [b" ".join(s) for s in zip(*(w[i:] for i in range(words)))] if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter((h(g) for g in grams), np.uint32, len(grams)))


def _alike(u: np.ndarray, v: np.ndarray, similarity: float) -> bool:
    if min(len(u), len(v)) < similarity * max(len(u), len(v)):
        return False
    both = len(np.intersect1d(u, v, assume_unique=True))
    return both >= similarity * (len(u) + len(v) - both)


def shingle_sets(wanted: DataFrame, docs: DataFrame, fps: DataFrame, words: int) -> DataFrame:
    """(fp, s) of wanted(fp): the shingles, as sorted 32-bit hashes, of one text that has the fingerprint."""
    texts = fps.join(wanted, "fp").groupBy("fp").agg(F.min(F.struct("doc_id", "h")).alias("t")).select("fp", F.col("t.doc_id").alias("one_id"), F.col("t.h").alias("one_h"))
    texts = broadcast_if_small(materialise(texts, "texts"))

    @F.arrow_udf("binary")
    def sets(x: pa.Array) -> pa.Array:
        return pa.array([_shingles(t.as_py() or "", words).tobytes() for t in x], pa.binary())

    own = F.col("doc_id").cast("long").eqNullSafe(F.col("one_id")) & (F.xxhash64("text") == F.col("one_h"))
    have = docs.select("doc_id", "text").join(texts, own).groupBy("fp").agg(F.first("text").alias("text")).select("fp", sets("text").alias("s"))
    return materialise(have, "shingles")


def similar(pairs: DataFrame, docs: DataFrame, fps: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of fingerprints whose texts have at least that Jaccard similarity of word shingles; one text stands for a fingerprint."""

    @F.arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([_alike(np.frombuffer(p.as_py(), np.uint32), np.frombuffer(q.as_py(), np.uint32), similarity) for p, q in zip(x, y, strict=True)])

    have = shingle_sets(pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct(), docs, fps, words)
    x = pairs.join(have.select(F.col("fp").alias("a"), F.col("s").alias("s_a")), "a").join(have.select(F.col("fp").alias("b"), F.col("s").alias("s_b")), "b")
    return x.where(alike("s_a", "s_b")).select("a", "b")


def _verified(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A spanning forest of the links between texts of a family: all near pairs that aren't joined yet are compared by their shingles, nearest first, where they stand."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["bucket", "i", "j"], FAMILY):
            starts = group_starts(t, ["bucket", "i", "j"])
            fp, more = (t[c].to_numpy().view(np.uint64) for c in ("fp", "more"))
            sets, comp = t["s"], t["comp"].to_numpy()
            a, b = sliced_links(fp, starts, WIDE)
            apart = np.bitwise_count(fp[a] ^ fp[b]) + np.bitwise_count(more[a] ^ more[b])
            near = apart <= WIDER
            a, b, apart = a[near], b[near], apart[near]
            _, label = np.unique(comp, return_inverse=True)
            up = list(range(int(label.max(initial=0)) + 1))

            def root(x: int, up: list[int] = up) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            known: dict[int, np.ndarray] = {}
            of = lambda i: known[i] if i in known else known.setdefault(i, np.frombuffer(sets[i].as_py(), np.uint32))  # noqa: B023, E731
            out = []
            for i in np.argsort(apart, kind="stable").tolist():
                x, y = int(a[i]), int(b[i])
                u, v = root(int(label[x])), root(int(label[y]))
                if u != v and _alike(of(x), of(y), similarity):
                    up[u] = v
                    out.append((x, y))
            x, y = np.array(out, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)), pa.array(fp[y].view(np.int64))], names=["a", "b"])

    return links


def near_components(kinds: DataFrame, docs: DataFrame, fps: DataFrame, tables: list[int], words: int, similarity: float) -> DataFrame:
    """(node, component) of the fingerprints whose texts are linked, by exact similarity of all that share a bucket and are near.

    Each fingerprint first gives its NEAREST in each bucket, and their texts are compared. Those that had more are put into
    families, by a spanning forest of all near ones; members of a family meet in blocks, with their shingles, and those
    near ones that are not joined yet are compared there. So every near pair is looked at, and only few links leave a task, however large a family.
    """
    found = compared(kinds, tables, WIDE, WIDER, NEAREST)
    found = materialise(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = materialise(similar(found.where("a <> b"), docs, fps, words, similarity), "links")
    named = materialise(components(links), "components")
    more = materialise(found.where("a = b").select(F.col("a").alias("fp")), "more")
    if not more.count():
        return named
    todo = materialise(kinds.join(broadcast_if_small(more), "fp", "left_semi"), "todo")
    families = materialise(components(compared(todo, tables, WIDE, WIDER)), "families").select(F.col("node").alias("fp"), F.col("component").alias("bucket"))
    own = named.select(F.col("node").alias("fp"), F.col("component").alias("comp"))
    members = todo.join(broadcast_if_small(families), "fp").join(broadcast_if_small(own), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    members = materialise(members.join(shingle_sets(more, docs, fps, words), "fp").select("bucket", "fp", "more", "comp", "s"), "members")
    good = in_blocks(members, ["fp", "more", "comp", "s"], FAMILY).mapInArrow(_verified(similarity), "a long, b long")
    return materialise(components(materialise(links.unionByName(good), "links")), "components")


def keep_first(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The first row of each group of near-duplicates, by doc_id (nulls last) and a hash of the text.

    Texts are near-duplicates when the Jaccard similarity of their word shingles is at least `similarity`. Candidates
    come from SimHash fingerprints of those shingles: tables of drawn bits, as many as the chance MISSED to miss such a
    pair takes, buckets compared bit-sliced, and from each all links within WIDE of 64 bits and WIDER of 128 between texts
    that are not yet in one group; exact similarity decides on them. Texts of equal fingerprints are one group.

    Null texts count as empty. Of rows that repeat a doc_id and a text, any one stays. Columns stay as they are, whatever
    their names. Only ids and hashes move to find what goes. An empty table gives an empty one.
    """
    fps = materialise(wide_fingerprints(docs, words), "fp")
    kinds = materialise(fps.groupBy("fp").agg(F.min("more").alias("more")), "kinds")
    tables = sampled_masks(kinds.count(), similarity)
    found = broadcast_if_small(near_components(kinds, docs, fps, tables, words, similarity))
    group = F.coalesce("component", "fp")
    placed = fps.join(found, fps.fp == found.node, "left").groupBy(group.alias("group"), "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    placed = materialise(placed.withColumn("rank", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")), "placed")
    many = placed.groupBy("group").agg(F.min("rank").alias("first"), F.sum("n").alias("rows")).where("rows > 1").select(F.col("group").alias("of"), "first")
    out = placed.join(many, F.col("group") == F.col("of")).select(F.col("doc_id").alias("out_id"), F.col("h").alias("out_h"), (F.col("rank") == F.col("first")).alias("stays"), "n")
    out = materialise(out.where("not stays or n > 1"), "out")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("row_id"), F.xxhash64("text").alias("row_h"))
    own = F.col("row_id").eqNullSafe(F.col("out_id")) & (F.col("row_h") == F.col("out_h"))
    kept = rows.join(broadcast_if_small(out.select("out_id", "out_h")), own, "left_anti").select("row")
    again = rows.join(broadcast_if_small(out.where("stays").select("out_id", "out_h")), own, "left_semi").groupBy("row_id", "row_h").agg(F.first("row").alias("row")).select("row")
    return kept.unionByName(again).select("row.*")
