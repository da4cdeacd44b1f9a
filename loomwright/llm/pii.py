"""Personal data, and the terms that give it away. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, materialise, text_or_empty

KINDS = ("email", "ip", "card", "phone", "term")
#: Runs are taken whole (possessive), and a run is entered at its start or after a match only: then no long run is read
#: again and again, and matches are the same.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"

#: A term gives an entity away when their pointwise mutual information is at least this share of the entity's information
#: content, and at least SUPPORT different texts hold both. From REMOVE on it is removed, below it is generalised.
DISCLOSES, REMOVE, SUPPORT = 0.9, 0.97, 3

SPAN = "struct<start:int,k:int,end:int,value:string>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


_RULES = (
    (_EMAIL, lambda t: t.contains("@"), lambda m: F.lit(True)),
    (_IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    (_CARD, lambda t: t.rlike("[0-9]{2}|[0-9][ -][0-9]"), lambda m: (F.length(_digits(m)) <= 19) & F.call_function("luhn_check", _digits(m))),
    (_PHONE, lambda t: t.contains("+"), lambda m: F.length(_digits(m)).between(10, 15)),
)


def _spans(text: Column, k: int) -> Column:
    """The matches of a rule as spans: a match starts after all text before it, pieces and matches, in code points."""
    pattern, may, good = _RULES[k]
    none = F.array().cast(f"array<{SPAN}>")
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["gap"])
        end = start + F.coalesce(F.length(p["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(k).alias("k"), end.alias("end"), p["m"].alias("value"))
        return F.struct(end.alias("at"), F.when(p["m"].isNotNull(), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    every = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
    return F.when(may(text), F.filter(every, lambda s: good(s["value"]))).otherwise(none)


def base_spans(text: Column) -> Column:
    """array of (start, k, end, value) by start and kind, for email, ip, card and phone."""
    return F.array_sort(F.concat(*[_spans(text, k) for k in range(len(_RULES))]))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def disclosing(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term, share): terms that give an entity away, from how they are spread over the texts of docs.

    found has `key` and `entities` of each row with personal data. By rows, p(e) and p(t) are the shares of rows that
    hold an entity and a term; PMI(e, t) = log p(e, t) / (p(e) p(t)) and IC(e) = -log p(e). Terms are words in lower case.
    Only entities of SUPPORT different texts can have such terms, and terms that are too frequent among the rows with
    those entities fall out before the corpus is counted, as they are at least as frequent there.
    """
    mentions = found.select("key", F.explode(F.array_distinct("entities")).alias("entity"))
    known = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.count_distinct("key").alias("texts")).where(F.col("texts") >= SUPPORT)
    known = materialise(known, "entities")
    held = mentions.distinct().join(broadcast_if_small(known), "entity")
    keys = materialise(held.select("key", "entity", "n_e"), "held")
    some = docs.withColumn("key", F.md5("text")).join(broadcast_if_small(keys.select("key").distinct()), "key", "left_semi")
    terms = some.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.first("text").alias("text")).select("key", "rows", F.explode(F.array_distinct(_words(F.lower("text")))).alias("term"))
    terms = materialise(terms, "terms")
    local = terms.groupBy("term").agg(F.sum("rows").alias("local"))
    pairs = terms.join(keys, "key").groupBy("entity", "n_e", "term").agg(F.sum("rows").alias("n_et"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= SUPPORT)
    total = docs.count()
    share = lambda n_t: F.log(F.col("n_et") * float(total) / (F.col("n_e") * n_t)) / -F.log(F.col("n_e") / float(total))
    likely = F.col("n_e") < total
    pairs = materialise(pairs.join(local, "term").where(likely & (share(F.col("local")) >= DISCLOSES)).drop("texts", "local"), "pairs")
    wanted = pairs.select("term").distinct()
    corpus = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))).alias("term"))
    spread = corpus.join(broadcast_if_small(wanted), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t")) if wanted.limit(1).count() else wanted.withColumn("n_t", F.lit(0))
    return pairs.join(spread, "term").withColumn("share", share(F.col("n_t"))).where(F.col("share") >= DISCLOSES).select("entity", "term", "share")


def _term_spans(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, terms): the places of disclosing terms in the different texts that hold their entities."""
    given = materialise(disclosing(found, docs), "disclosing")
    marks = found.select("key", F.explode(F.array_distinct("entities")).alias("entity")).distinct().join(broadcast_if_small(given), "entity").groupBy("key", "term").agg(F.max("share").alias("share"))
    marks = materialise(marks, "marks")
    keys = broadcast_if_small(marks.select("key").distinct())
    texts = docs.withColumn("key", F.md5("text")).join(keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    parts = texts.select("key", F.posexplode(F.arrays_zip(F.split("text", WORD, -1).alias("gap"), _words(F.col("text")).alias("word"))).alias("at", "p"))
    order = W.partitionBy("key").orderBy("at")
    long = F.length("p.gap") + F.coalesce(F.length("p.word"), F.lit(0))
    placed = parts.select("key", F.col("p.word").alias("word"), F.sum(long).over(order).cast("int").alias("end"))
    hit = placed.where("word is not null").withColumn("term", F.lower("word")).join(marks, ["key", "term"])
    start = F.col("end") - F.length("word")
    span = F.struct(start.alias("start"), F.lit(4).alias("k"), F.col("end"), F.when(F.col("share") >= REMOVE, F.lit("remove")).otherwise("generalise").alias("value"))
    return materialise(hit.groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("terms")), "term-spans")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, spans) of every row; key is null without personal data."""
    t = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long"), t.alias("text"))
    found = rows.select("doc_id", base_spans(F.col("text")).alias("base"), "text").select("doc_id", "base", F.when(F.size("base") > 0, F.md5("text")).alias("key"))
    found = materialise(found.withColumn("entities", F.transform("base", lambda s: F.concat_ws(":", s["k"].cast("string"), F.lower(s["value"])))), "pii")
    terms = _term_spans(found.where("key is not null"), rows).withColumnRenamed("key", "_key")
    apart = F.filter(F.coalesce("terms", F.array().cast(f"array<{SPAN}>")), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    x = found.join(broadcast_if_small(terms), F.col("key") == F.col("_key"), "left")
    return x.select("doc_id", "key", "base", F.array_sort(F.concat("base", apart)).alias("spans"))


def joined(s: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_personal(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) of every row, from its whole text.

    spans has what the patterns find and, as `term`, words that give away a value found in the same text. Null texts are
    empty. Equal texts have equal spans; repeated rows are rows each. Other columns are left out, whatever their names. A
    text is scanned in one task, however long. An empty table gives an empty one.
    """
    x = spans(docs)
    n = lambda k: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")
    return x.select("doc_id", *[n(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n(4).alias("n_term"))


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans): values generalised to their kind in brackets; terms removed, or generalised to [TERM].

    Where spans overlap, the one that starts first is replaced and the rest of the other goes with it. One row for each
    different (doc_id, text); texts without spans are as they were.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").distinct()
    found = spans(rows).where("key is not null").distinct().select(F.col("doc_id").alias("_doc"), "key", "spans")
    x = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.md5("text") == F.col("key")), "left")
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(a: Column, s: Column) -> Column:
        mark = F.when(s["start"] < a["at"], F.lit("")).when(s["value"].eqNullSafe(F.lit("remove")) & (s["k"] == 4), F.lit("")).otherwise(F.element_at(label, s["k"] + 1))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), mark).alias("out"))

    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return x.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(clean).alias("text"), F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))
