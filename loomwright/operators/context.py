"""Context building over the hits of many queries, and chat history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import citations, compressed, grams, jaccard


def without_duplicates(hits: DataFrame, overlap: float = 0.5, similar: float = 0.85) -> DataFrame:
    """Hits (query_id, chunk_id, doc_id, start_offset, end_offset, content, score) that repeat no kept hit of higher score; ties, to nine places, by chunk_id.

    Repeated: of one document with spans that share at least `overlap` of the shorter, or 3-gram sets at least `similar`.
    A query's hits are few (a top-k), so the greedy choice is a fold over one array.
    """
    h = F.struct((-F.round("score", 9)).alias("order"), "chunk_id", "doc_id", "start_offset", "end_offset", grams(F.col("content")).alias("g"))
    lists = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(h)).alias("hs"))

    def same(a: Column, b: Column) -> Column:
        shared = F.greatest(F.lit(0), F.least(a["end_offset"], b["end_offset"]) - F.greatest(a["start_offset"], b["start_offset"]))
        shorter = F.least(a["end_offset"] - a["start_offset"], b["end_offset"] - b["start_offset"])
        return ((a["doc_id"] == b["doc_id"]) & (shorter > 0) & (shared >= overlap * shorter)) | (jaccard(a["g"], b["g"]) >= similar)

    kept = F.aggregate("hs", F.filter("hs", lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda k: same(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    ids = lists.select("query_id", F.explode(F.transform(kept, lambda x: x["chunk_id"])).alias("chunk_id"))
    return hits.join(ids, ["query_id", "chunk_id"], "left_semi")


def merged_neighbours(hits: DataFrame, gap: int = 5) -> DataFrame:
    """(query_id, doc_id, start_offset, end_offset, score, chunk_ids, content): hits of a document that follow each other, as one.

    In order of chunk number, a hit joins the open group if its number is one from that of the group's head, or if
    it starts within `gap` of the group's end; the score is the greatest, and texts are put together as they are, what
    they share twice. The head's number stays, so this is a fold.
    """
    h = F.struct(F.col("chunk_index").alias("no"), F.col("start_offset").alias("s"), F.col("end_offset").alias("e"), F.col("score").alias("score"), F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    lists = hits.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(h)).alias("hs"))
    group = lambda no, s, e, score, ids, text: F.struct(no.alias("no"), s.alias("s"), e.alias("e"), score.alias("score"), ids.alias("ids"), text.alias("text"))
    one = lambda x: group(x["no"], x["s"], x["e"], x["score"], F.array(x["id"]), x["text"])

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.abs(x["no"] - last["no"]) == 1) | (F.abs(x["s"] - last["e"]) <= gap)
        longer = group(last["no"], last["s"], F.greatest(last["e"], x["e"]), F.greatest(last["score"], x["score"]), F.concat(last["ids"], F.array(x["id"])), F.concat(last["text"], x["text"]))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(one(x))))

    rest = F.slice("hs", 2, F.greatest(F.size("hs") - 1, F.lit(0)))
    merged = F.aggregate(rest, F.array(one(F.col("hs")[0])), step)
    return lists.select("query_id", "doc_id", F.explode(merged).alias("m")).select("query_id", "doc_id", F.col("m.s").alias("start_offset"), F.col("m.e").alias("end_offset"), F.col("m.score").alias("score"), F.col("m.ids").alias("chunk_ids"), F.col("m.text").alias("content"))


def token_shares(hits: DataFrame, budget: int | Column, temperature: float = 1.0) -> DataFrame:
    """hits with `cap`, each hit's part of the budget by the softmax of its scaled score, with a floor, scaled back if caps exceed it."""
    w, budget = W.partitionBy("query_id"), F.lit(budget)
    low, high, n = F.min("score").over(w), F.max("score").over(w), F.count(F.lit(1)).over(w)
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)
    x = hits.withColumn("_e", F.exp(scaled / F.lit(temperature if temperature > 0 else 1.0))).withColumn("_n", n)
    floor = F.least(F.lit(16), F.greatest(F.floor(budget / (2 * F.col("_n"))), F.lit(1)))
    x = x.withColumn("_c", F.greatest(F.floor(budget * F.col("_e") / F.sum("_e").over(w)), floor))
    all_ = F.sum("_c").over(w)
    return x.withColumn("cap", F.when(all_ > budget, F.floor(F.col("_c") * budget / all_)).otherwise(F.col("_c")).cast("long")).drop("_e", "_n", "_c")


def interleaved(hits: DataFrame) -> DataFrame:
    """hits with `place`: odd ranks from the front, even ones from the back, so that the best stand at both ends."""
    key = F.when(F.col("rank") % 2 == 1, F.struct(F.lit(0).alias("end"), F.col("rank").alias("at"))).otherwise(F.struct(F.lit(1).alias("end"), (-F.col("rank")).alias("at")))
    return hits.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(key)))


def history(turns: DataFrame, last: int = 10, chars: int = 2000, total: int = 8000) -> DataFrame:
    """(conv_id, turn, role, text): the turns of a conversation that go into a prompt.

    Of the last `last` turns, those of users and assistants that aren't blank, cut to `chars`; from the newest back,
    each that still fits into `total` (a turn that doesn't is passed over).
    """
    order = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    recent = turns.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= last)
    said = recent.select("conv_id", "_n", "turn", "role", F.substring(F.regexp_replace("text", "(?U)^\\s+|\\s+$", ""), 1, chars).alias("text")).where("role in ('user', 'assistant') and text <> ''")
    lists = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_n", "turn", "role", "text"))).alias("ts"))

    def step(acc: Column, t: Column) -> Column:
        fits = acc["used"] + F.length(t["text"]) <= total
        return F.when(fits, F.struct((acc["used"] + F.length(t["text"])).alias("used"), F.concat(acc["ts"], F.array(t)).alias("ts"))).otherwise(acc)

    kept = F.aggregate("ts", F.struct(F.lit(0).alias("used"), F.filter("ts", lambda x: F.lit(False)).alias("ts")), step, lambda a: a["ts"])
    return lists.select("conv_id", F.explode(kept).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def ranked(hits: DataFrame, order: str = "score") -> DataFrame:
    """hits with `rank` from 1, by score, or by document and place in it; `interleaved` takes ranks by score."""
    if order not in ("score", "document"):
        raise ValueError(f"unknown order: {order}")
    keys = [F.round("score", 9).desc(), F.col("doc_id"), F.col("start_offset")] if order == "score" else [F.col("doc_id"), F.col("start_offset")]
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*keys)))


def fitted(hits: DataFrame) -> DataFrame:
    """(query_id, used, skipped, parts): in order of rank, each text that still fits into `budget`; others are passed over.

    A query's hits are a top-k, so one array holds them.
    """
    lists = hits.groupBy("query_id").agg(F.first("budget").alias("budget"), F.sort_array(F.collect_list(F.struct("rank", "content"))).alias("hs"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + F.length(x["content"]) <= F.col("budget")
        return F.when(fits, F.struct((acc["used"] + F.length(x["content"])).alias("used"), acc["skipped"].alias("skipped"), F.concat(acc["parts"], F.array(x["content"])).alias("parts"))).otherwise(
            F.struct(acc["used"].alias("used"), (acc["skipped"] + 1).alias("skipped"), acc["parts"].alias("parts"))
        )

    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("skipped"), F.array().cast("array<string>").alias("parts"))
    return lists.select("query_id", F.aggregate("hs", start, step).alias("x")).select("query_id", "x.used", "x.skipped", "x.parts")


def numbered(parts: Column) -> Column:
    """Texts as a prompt cites them: [1] and so on, parted by an empty line."""
    return F.array_join(F.transform(parts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n\n")


def build(hits: DataFrame, queries: DataFrame, most: int = 4096, reserved: int = 1024) -> DataFrame:
    """(query_id, context, used, skipped, n_input, n_merged, n_final): hits without repeats, merged, cut to their parts of the budget, and fitted.

    The budget is `most` less `reserved` and the query's own length, in code points.
    """
    room = queries.select("query_id", F.greatest(F.lit(0), F.lit(most - reserved) - F.length("text")).alias("budget"))
    x = ranked(merged_neighbours(without_duplicates(hits))).join(room, "query_id")
    w = W.partitionBy("query_id")
    shares = token_shares(x, F.col("budget")).withColumn("content", compressed(F.col("content"), F.col("cap"))).withColumn("n_merged", F.count(F.lit(1)).over(w))
    got = fitted(shares).join(shares.groupBy("query_id").agg(F.first("n_merged").alias("n_merged")), "query_id")
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_input"))
    return got.join(n, "query_id").select("query_id", numbered(F.col("parts")).alias("context"), "used", "skipped", "n_input", "n_merged", F.size("parts").alias("n_final"))


def dialogue(turns: DataFrame, last: int = 10, chars: int = 2000) -> DataFrame:
    """(conv_id, dialogue): the last turns of users and assistants as lines with their speakers, for a prompt that rewrites a query."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    text = F.substring(F.regexp_replace("text", "(?U)^\\s+|\\s+$", ""), 1, chars)
    said = F.when(F.col("role").isin("user", "assistant") & (text != ""), F.concat(F.when(F.col("role") == "user", "用户").otherwise("助手"), F.lit("："), text))
    x = turns.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= last).groupBy("conv_id")
    lines = x.agg(F.sort_array(F.collect_list(F.when(said.isNotNull(), F.struct(-F.col("_n"), said.alias("line"))))).alias("ls"))
    return lines.select("conv_id", F.when(F.size("ls") > 0, F.array_join("ls.line", "\n")).otherwise("（无）").alias("dialogue"))


def cited(answers: DataFrame, chunks: DataFrame, within: str = "query_id") -> DataFrame:
    """(query_id, place, number, chunk_id, doc_id, start_offset, end_offset, preview): the chunks that answers cite.

    answers(query_id, answer), chunks(query_id, number, chunk_id, doc_id, start_offset, end_offset, content) with numbers
    from 1. Answers that share their chunks, such as those of a conversation, have its key as `within` beside their query_id,
    and chunks have it in place of query_id, so that nothing is multiplied. Each number counts once, in order of first mention; numbers that no chunk has are passed over, and keep
    their place. A preview is the first 50 code points.
    """
    keys = list(dict.fromkeys(["query_id", within]))
    x = answers.select(*keys, F.posexplode(citations(F.col("answer"))).alias("place", "number"))
    return x.join(chunks, [within, "number"]).select("query_id", "place", "number", "chunk_id", "doc_id", "start_offset", "end_offset", F.substring("content", 1, 50).alias("preview"))


def messages(system: str, turns: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, messages): an array of (role, content): the system text, what `history` keeps of the turns, and context and question.

    asked(conv_id, context, question) has a row for each conversation to go on; turns are those before the question.
    """
    message = lambda role, text: F.struct(role.alias("role"), text.alias("content"))
    said = history(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    now = F.concat(F.lit("上下文：\n"), F.col("context"), F.lit("\n\n问题："), F.col("question"))
    before = F.coalesce(F.transform("ts", lambda m: message(m["role"], m["text"])), F.array().cast("array<struct<role:string,content:string>>"))
    every = F.concat(F.array(message(F.lit("system"), F.lit(system))), before, F.array(message(F.lit("user"), now)))
    return asked.join(said, "conv_id", "left").select("conv_id", every.alias("messages"))


def final_score(rerank: Column, score: Column) -> Column:
    """The score that a hit is shown with: the reranker's, else the search's, else 0."""
    return F.coalesce(rerank.cast("double"), score.cast("double"), F.lit(0.0))
