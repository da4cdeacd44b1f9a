"""Quality rules with host verdicts."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import BLANKS, broadcast_if_small, by_text, materialise

SYMBOLS = b"#*$%&|<>"
#: A host is rejected when, for some rule, its shrunken share of failing documents less CERTAIN standard deviations of
#: its posterior is this or more, and no less than the hosts' mean: where most hosts fail, none is rejected for that.
HOST_RATE, CERTAIN = 0.5, 2.0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: What each rule counts as a failure: too short, mostly repeated, over one sign in ten a symbol, over a third of lines repeated.
RULES = {
    "short": lambda n: n("n_words") < 50,
    "repeated": lambda n: 100 * n("n_repeat_words") > 50 * n("n_words"),
    "symbols": lambda n: 10 * n("n_symbols") > n("word_chars"),
    "lines": lambda n: 3 * n("n_dup_lines") > n("n_lines"),
}
#: The rules that a document fails by itself; the others only tell of its host.
BASE = ("short", "repeated")


def count_rules(text: str) -> tuple[int, int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated 3-word windows, lines) of a whole text."""
    b = text.encode()
    words = b.split()
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    lines = [x for x in b.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > 3:
        grams = list(zip(words, words[1:], words[2:]))
        seen = Counter(grams)
        if len(seen) < len(grams):
            hit = bytearray(len(words))
            for i, g in enumerate(grams):
                if seen[g] > 1:
                    hit[i] = hit[i + 1] = hit[i + 2] = 1
            repeated = sum(hit)
    return len(words), chars, len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def counts(text: Column) -> Column:
    """A struct of the counts; a null text has no words."""
    fields = pa.struct([(c, pa.int64()) for c in COUNTS])
    f = arrow_udf(by_text(count_rules, fields), "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">")
    return f.asNondeterministic()(text)  # else a filter on it would run it twice


def failures(q: str) -> list[Column]:
    """A boolean column for each rule, from the counts in struct q."""
    return [rule(lambda c: F.col(f"{q}.{c}")).alias(name) for name, rule in RULES.items()]


def host_verdicts(facts: DataFrame, host: str = "host") -> DataFrame:
    """(host, n, rates, rejected) from facts with a boolean column for each rule; rates has the shrunken rate of each.

    The prior of a rule's failure rate is a beta whose mean and spread are those of the hosts, by moments; a host's rate
    is shrunk towards it by its own number of documents. Documents without a host are one host, null. What is gathered
    on the driver is three figures a rule.
    """
    hosts = facts.groupBy(host).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    r = {k: F.col(k) / F.col("n") for k in RULES}
    m = hosts.agg(F.avg(1 / F.col("n")).alias("inv"), *[F.avg(r[k]).alias(f"mean_{k}") for k in RULES], *[F.var_pop(r[k]).alias(f"var_{k}") for k in RULES]).first()
    rates, bad = [], F.lit(False)
    for k in RULES:
        mean = min(max(m[f"mean_{k}"] or 0.0, 1e-3), 1 - 1e-3)
        spread = mean * (1 - mean)
        between = max((m[f"var_{k}"] or 0.0) - spread * (m["inv"] or 0.0), 1e-4 * spread)  # without what the hosts' own sampling adds
        strength = min(max(spread / between - 1, 1.0), 1000.0)
        rate = (F.col(k) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
        rates.append(rate)
        bad = bad | (rate - CERTAIN * F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(strength) + 1)) >= F.lit(max(HOST_RATE, mean)))
    return hosts.select(host, "n", F.array(*rates).alias("rates"), bad.alias("rejected"))


def _judged(docs: DataFrame, kept: list[Column], host: str) -> tuple[DataFrame, DataFrame]:
    """(`kept` columns with counts q and rules, written once; rejected hosts)."""
    x = docs.select(*kept, F.col(host).alias("host"), counts(F.col("text")).alias("q"))
    facts = materialise(x.select("*", *failures("q")), "quality")
    bad = materialise(host_verdicts(facts).where("rejected").select(F.col("host").alias("bad_host"), F.lit(True).alias("rejected")), "hosts")
    return facts, broadcast_if_small(bad)


def _failed() -> Column:
    return reduce(Column.__or__, [F.col(r) for r in BASE])


def quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines) of every row.

    A row fails with under 50 words, or with over half of them in repeated 3-word windows; it is kept if it doesn't
    fail and its host isn't rejected. A host is judged by each of RULES over all its rows. Null texts have no words and
    fail; null hosts are one host. Repeated rows count each. Other columns are left out, whatever their names. A text is
    counted whole in one task, however long. An empty table gives an empty one.
    """
    facts, bad = _judged(docs, [F.col("doc_id")], host)
    x = facts.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    return x.select("doc_id", *[f"q.{c}" for c in COUNTS[:-1]], _failed().alias("base_failed"), (~_failed() & F.col("rejected").isNull()).alias("kept"), "q.n_lines")


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that `quality` keeps, with their columns as they are, whatever their names."""
    facts, bad = _judged(docs, [F.struct("*").alias("row")], host)
    return facts.where(~_failed()).join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left_anti").select("row.*")
