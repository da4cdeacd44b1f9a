"""Mixing sources to target weights by blocks of words. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, materialise, slots

WEIGHTS = (5, 2, 1)
MOST = 3
#: Most words in a block, block slots in an output shard, positions that are looked up by one key, and shards that are summed together.
BLOCK, SHARD, CHUNK, TOGETHER = 128, 8192, 16_384, 1024
SEED, ROUNDS = 42, 16


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """x's place under a keyed permutation of 0 to n - 1: in each round x swaps with its partner or not, as a hash of the two decides."""

    def one(a: Column, r: Column) -> Column:
        b = F.pmod(F.pmod(F.xxhash64(r, *key), n) - a, n)
        return F.when(F.xxhash64(r, F.greatest(a, b), *key).bitwiseAND(F.lit(1)) == 1, b).otherwise(a)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), x.cast("long"), one)


def targets(sized: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(sid, source, source_size, target) for each source: sources by code point, nulls last, weigh `weights` in turn.

    All words are shared by weight; a source stops at `most` times its size and what it leaves goes to the others by
    weight, until none is above. That ends where the sources that stop have the least cap for their weight: running
    sums in that order show where. Works on one row a source.
    """
    every = sized.groupBy(source).agg(F.sum("size").cast("long").alias("source_size"))
    no = F.row_number().over(W.orderBy(F.col(source).asc_nulls_last())) - 1
    x = every.withColumn("sid", no).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid"), F.lit(len(weights))) + 1))
    x = x.withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double")).withColumn("at", F.col("cap") / F.col("w"))
    order = W.orderBy("at", "sid")
    before, all_ = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = left / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    x = x.withColumn("share", share).withColumn("rank", F.row_number().over(order))
    x = x.withColumn("level", F.min(F.when(F.col("share") <= F.col("at"), F.struct("rank", "share"))).over(all_)["share"])
    return x.select("sid", source, "source_size", F.least(F.col("cap"), F.col("w") * F.coalesce("level", F.lit(0.0))).alias("target"))


def planned(sized: DataFrame, source: str, block: int = BLOCK) -> DataFrame:
    """`targets` with how a source is cut and taken: (.., len, blocks, passes, n, trim).

    A source's words are cut into blocks of equal length `len`, the last a little shorter. Its n slots are `passes` over all
    blocks and, for what is left of the target, some blocks of one more pass, of which the last gives its first `trim`
    words (0: all). So taken words miss the target by less than a block, and by at most one in so many as len or blocks is.
    """
    return cut_up(targets(sized, source), block)


def cut_up(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    size, some = F.col("source_size"), F.greatest(F.col("source_size"), F.lit(1))
    x = plan.withColumn("len", F.greatest(F.ceil(size / F.greatest(F.ceil(size / block), F.lit(1))), F.lit(1)).cast("long"))
    x = x.withColumn("blocks", F.ceil(size / F.col("len")).cast("long")).withColumn("words", F.round("target").cast("long"))
    x = x.withColumn("passes", F.floor(F.col("words") / some).cast("long")).withColumn("rest", F.col("words") - F.col("passes") * size)
    x = x.withColumn("trim", F.pmod("rest", "len")).withColumn("n", F.col("passes") * F.col("blocks") + F.floor(F.col("rest") / F.col("len")).cast("long") + (F.col("trim") > 0).cast("long"))
    return x.withColumn("n", F.when(size > 0, F.col("n")).otherwise(0)).drop("words", "rest")


def running(df: DataFrame, group: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds to each row what `value` sums to over the rows of its group of lower `order`, a dense number: by runs of TOGETHER numbers, then within each."""
    x = df.withColumn("run", F.floor(F.col(order) / TOGETHER))
    sums = x.groupBy(*group, "run").agg(F.sum(value).alias("all"))
    at = W.partitionBy(*group).orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*group, "run", F.coalesce(F.sum("all").over(at), F.lit(0)).alias("lower"))
    within = W.partitionBy(*group, "run").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return x.join(sums, [*group, "run"]).withColumn(name, F.col("lower") + F.col("inner")).drop("run", "inner", "lower")


def owned(positions: DataFrame, ranges: DataFrame) -> DataFrame:
    """positions (with column p) with the sid of the range (sid, low, high) that holds p; ranges don't overlap.

    Ranges are cut where multiples of CHUNK are, and both sides meet by p div CHUNK.
    """
    cells = ranges.where("high > low").select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / CHUNK), F.floor((F.col("high") - 1) / CHUNK))).alias("cell"))
    cells = cells.groupBy("cell").agg(F.collect_list(F.struct("low", "high", "sid")).alias("held"))
    x = positions.withColumn("cell", F.floor(F.col("p") / CHUNK)).join(broadcast_if_small(materialise(cells, "cells")), "cell")
    mine = F.filter("held", lambda r: (r["low"] <= F.col("p")) & (F.col("p") < r["high"]))
    return x.withColumn("sid", F.element_at(mine, 1)["sid"]).drop("cell", "held", "p")


def drawn(plan: DataFrame, shard: int = SHARD) -> DataFrame:
    """(shard, sid, c): a multinomial draw of each output shard's slots among the sources, by their shares of all slots."""
    x = plan.withColumn("high", F.sum("n").over(W.orderBy("sid"))).select("sid", (F.col("high") - F.col("n")).alias("low"), "high")
    total = plan.agg(F.sum("n")).first()[0] or 0
    at = plan.sparkSession.range(0, total, 1, 1 + int(total // (16 * CHUNK)))
    p = F.pmod(F.xxhash64(F.lit(SEED), F.lit(-1), "id"), F.lit(max(1, total)))
    return owned(at.select(F.floor(F.col("id") / shard).alias("shard"), p.alias("p")), x).groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("c"))


def shares(plan: DataFrame, shard: int = SHARD) -> DataFrame:
    """(shard, sid, m): the draw, mended so that each source has its n slots in all.

    A source drawn too often gives up slots of its shards in proportion; these go to the sources drawn too seldom, in
    the order of a permutation. About as many change as the root of all slots; a shard's number of slots stays.
    """
    c = materialise(drawn(plan, shard), "drawn")
    had = c.groupBy("sid").agg(F.sum("c").alias("had"))
    off = materialise(plan.select("sid", "n").join(had, "sid", "left").select("sid", F.coalesce("had", F.lit(0)).alias("had"), F.greatest(F.col("n") - F.coalesce("had", F.lit(0)), F.lit(0)).alias("short"), F.greatest(F.coalesce("had", F.lit(0)) - F.col("n"), F.lit(0)).alias("over")), "off")
    upto = lambda v: F.floor(v * F.col("over") / F.col("had")).cast("long")
    x = running(c, ["sid"], "shard", "c", "before").join(broadcast_if_small(off), "sid")
    x = materialise(x.select("shard", "sid", "c", (upto(F.col("before") + F.col("c")) - upto(F.col("before"))).alias("gives")), "given")
    freed = running(x.groupBy("shard").agg(F.sum("gives").alias("f")).withColumn("one", F.lit(0)), ["one"], "shard", "f", "low").where("f > 0")
    total = off.agg(F.sum("short")).first()[0] or 0
    slots_ = freed.select("shard", F.explode(F.sequence("low", F.col("low") + F.col("f") - 1)).alias("x"))
    wants = off.withColumn("high", F.sum("short").over(W.orderBy("sid"))).select("sid", (F.col("high") - F.col("short")).alias("low"), "high")
    gained = owned(slots_.select("shard", permuted(F.col("x"), F.lit(max(1, total)), F.lit(SEED), F.lit(-2)).alias("p")), wants)
    both = x.select("shard", "sid", (F.col("c") - F.col("gives")).alias("m")).unionByName(gained.select("shard", "sid", F.lit(1).cast("long").alias("m")))
    return both.groupBy("shard", "sid").agg(F.sum("m").alias("m")).where("m > 0")


def layout(plan: DataFrame, shard: int = SHARD) -> DataFrame:
    """(sid, slot, block, shard, words): which block of its source each slot of the mix takes, in which output shard, and how many of its words (0: all).

    A source's slots, numbered shard after shard, go through its blocks in passes, each pass by its own keyed
    permutation, so no block is taken more often than the target's multiple, rounded up.
    """
    m = materialise(shares(plan, shard), "shares")
    x = running(m, ["sid"], "shard", "m", "first").join(broadcast_if_small(plan.select("sid", "blocks", "n", "trim")), "sid")
    x = x.select("sid", "shard", "blocks", "n", "trim", F.explode(F.sequence("first", F.col("first") + F.col("m") - 1)).alias("slot"))
    pass_ = F.floor(F.col("slot") / F.col("blocks")).cast("long")
    block = permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.lit(SEED), F.col("sid"), pass_)
    return x.select("sid", "slot", block.alias("block"), "shard", F.when(F.col("slot") == F.col("n") - 1, F.col("trim")).otherwise(0).alias("words"))


def _taken(streamed: DataFrame, plan: DataFrame) -> DataFrame:
    """(rid, low, high, times, shard): stretches of each row's words, by their place in the source, and how often the mix takes them.

    streamed has rid, sid, size and `before`, the words of the source that stand before the row.
    """
    known = streamed.where("size > 0").join(broadcast_if_small(plan.select("sid", "len")), "sid")
    end, size = F.col("before") + F.col("size"), F.col("len")
    cut = known.select("rid", "sid", "len", "before", end.alias("end"), F.explode(F.sequence(F.floor(F.col("before") / size), F.floor((end - 1) / size))).alias("block"))
    slots_ = layout(plan)
    whole = F.col("words") == 0
    taken = slots_.groupBy("sid", "block").agg(F.sum(whole.cast("long")).alias("times"), F.max("words").alias("trim"), F.min("shard").alias("shard"))
    x = cut.join(taken.hint("merge"), ["sid", "block"])  # a few sources make many slots, which statistics don't tell
    low, high = F.greatest("before", F.col("block") * F.col("len")), F.least("end", (F.col("block") + 1) * F.col("len"))
    mid = F.least(F.greatest(F.col("block") * F.col("len") + F.col("trim"), low), high)
    part = lambda a, b, n: F.struct(a.alias("low"), b.alias("high"), n.alias("times"))
    parts = F.array(part(low, mid, F.col("times") + 1), part(mid, high, F.col("times")))
    x = x.select("rid", "shard", F.explode(F.filter(parts, lambda r: (r["high"] > r["low"]) & (r["times"] > 0))).alias("r"))
    return x.select("rid", "r.low", "r.high", "r.times", "shard")


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _streamed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, sid, size, before) of rows (rid, doc_id, source, size, h), and the plan."""
    plan = materialise(planned(rows, "source"), "plan")
    small = broadcast_if_small(plan.select(F.col("source").alias("of"), "sid"))
    known = rows.join(small, F.col("source").eqNullSafe(F.col("of"))).select("rid", "doc_id", "h", "sid", "size")
    return materialise(slots(known, ["sid"], ["doc_id", "size", "h"], rows.count(), "size").select("rid", "sid", "size", "before"), "streamed"), plan


def mix(docs: DataFrame, source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_shard) of every row: how many of its words the mix takes.

    The words of each source, document after document, are packed into blocks; slots of the mix take blocks, and a
    document's words are taken as often as their blocks. A source's taken words miss its target by less than a block.
    Null texts have size 0 and nothing taken (first_shard null); null sources are one source, last. Repeated rows and
    null ids are rows each, in any order among themselves. Other columns are left out, whatever their names. Reruns
    agree. A text's words are counted in one task, however long. An empty table gives an empty one.
    """
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).alias("source"), _size().alias("size"), F.xxhash64("text").alias("h"))
    rows = materialise(x.withColumn("rid", F.monotonically_increasing_id()), "sized")
    streamed, plan = _streamed(rows)
    took = _taken(streamed, plan).groupBy("rid").agg(F.sum((F.col("high") - F.col("low")) * F.col("times")).alias("t"), F.min("shard").alias("first_shard"))
    small = broadcast_if_small(plan.select(F.col("source").alias("of"), "source_size", "target"))
    out = rows.join(took, "rid", "left").join(small, F.col("source").eqNullSafe(F.col("of")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("t", F.lit(0)).cast("long").alias("taken"), "first_shard")


def mixed_documents(docs: DataFrame, source: str = "source") -> DataFrame:
    """docs' columns, a row for each document and pass of the mix that takes words of it: its text where all are taken, else those of the blocks taken.

    The n-th row of a document holds the words that are taken n times or more, with the blanks before each; n_chars, if
    there is one, follows the text. Documents without words are in no block and go. Rows are written once with a number
    of their own, so that rows that repeat an id or a text are told apart; other columns stay, whatever their names.
    """
    x = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(source).alias("source"), _size().alias("size"), F.xxhash64("text").alias("h"))
    rows = materialise(x.withColumn("rid", F.monotonically_increasing_id()), "sized")
    streamed, plan = _streamed(rows.select("rid", "doc_id", "source", "size", "h"))
    took = _taken(streamed, plan).join(streamed.select("rid", "before"), "rid")
    took = took.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct((F.col("low") - F.col("before")).alias("low"), (F.col("high") - F.col("before")).alias("high"), "times"))).alias("b"))
    x = rows.select("rid", "row", "size").join(took, "rid")
    x = x.select("row", "size", "b", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.transform("b", lambda b: b["times"])))).alias("n"))
    x = x.withColumn("taken", F.filter("b", lambda b: b["times"] >= F.col("n")))
    whole = F.aggregate("taken", F.lit(0).cast("long"), lambda s, b: s + b["high"] - b["low"]) == F.col("size")
    parts = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    x = x.withColumn("parts", F.when(~whole, parts))
    piece = lambda b: F.array_join(F.slice("parts", (b["low"] + 1).cast("int"), (b["high"] - b["low"]).cast("int")), "")
    text = F.when(F.col("parts").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform("taken", piece), ""))
    x = x.select("row", text.alias("new"))
    row = F.col("row").withField("text", F.col("new"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("new").cast(docs.schema["n_chars"].dataType))
    return x.select(row.alias("row")).select("row.*")
