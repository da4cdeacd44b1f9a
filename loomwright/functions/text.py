"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Unicode's White_Space, and what counts as blank at the ends of texts: these and the separators from 1C to 1F.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = WHITE + "\x1c\x1d\x1e\x1f"
#: The same as a class of a pattern, without line feeds.
_SPACE = r"\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def clean(c: Column) -> Column:
    """No-break spaces and CR normalised, runs of blanks made one, at most one empty line, ends stripped. Patterns match only what changes."""
    for old, new in (("\u00a0", " "), ("\r\n", "\n"), ("\r", "\n"), ("\t", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return strip(F.regexp_replace(F.regexp_replace(c, " {2,}", " "), "\\n{3,}", "\n\n"))


def stable_id(c: Column) -> Column:
    """A 60-bit id: the first 15 hex digits of the SHA-256."""
    return F.conv(F.substring(F.sha2(c.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def terms(c: Column) -> Column:
    """Lower-case runs of letters and digits, and single CJK characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\x{4e00}-\x{9fff}]|[\p{L}\p{N}&&[^\x{4e00}-\x{9fff}]]++"), F.lit(0))


def grams(c: Column, n: int = 3) -> Column:
    """The set of character n-grams; a shorter string is its own only gram."""
    many = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) < n, F.array(c)).otherwise(F.array_distinct(many))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def citations(answer: Column) -> Column:
    """Numbers cited in brackets, each once, in order of first mention."""
    groups = F.regexp_extract_all(answer, F.lit(r"[\[【]\s*([\d\s,，、;；]+)\s*[\]】]"), F.lit(1))
    return F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"(\d+)"), F.lit(1)))), lambda x: x.try_cast("int")))


def query_variants(original: Column, reply: Column, most: int) -> Column:
    """The original and the lines of a reply without list marks and quotes, each once, at most so many."""
    lines = F.transform(F.split(reply, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[\s\d\-*•.、]+", ""), "^[\"'“”]+|[\"'“”]+$", "")))
    return F.slice(F.array_distinct(F.concat(F.array(original), F.filter(lines, lambda x: x != ""))), 1, most)


_MARK = r"。！？；\n.!?"
#: Fixed pattern: a run up to and with its end marks, or what is left at the end, unless it is blank. Where a blank one
#: begins nothing is found, nor at its other characters, so that the next match is the next sentence.
SENTENCE = rf"(?<![{_SPACE}])(?!(?<=\n)\n)(?=[{_SPACE}]*+(?:[^{_SPACE}\n]|\n++[。！？；.!?]))(?:[^{_MARK}]*+[{_MARK}]++|[^{_MARK}]++)"
#: The blank ones.
_BLANK_SENTENCE = rf"(?<=[{_MARK}])[{_SPACE}]++(?:\n++(?![{_MARK}])|\z)|\A[{_SPACE}]*+(?:\n++(?![{_MARK}])|\z)"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANK))


def sentences(c: Column) -> Column:
    """Sentences with their end marks, without blank ones; a text without any is its own only one."""
    found = F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0))
    return F.when(c.rlike(rf"[^{_SPACE}\n]"), found).otherwise(F.array(c))


def compressed(c: Column, cap: Column) -> Column:
    """A text within `cap` code points as it is; else the sentences from its head that fit, at least the head of the first.

    What fits is the text without blank sentences up to the last place within `cap` where a sentence ends. Only cap + 1 code
    points are looked at, unless a blank sentence begins there.
    """
    cap = F.greatest(cap, F.lit(0)).cast("int")
    head = F.substring(c, F.lit(1), cap + 1)
    told = F.when(head.rlike(_BLANK_SENTENCE), F.substring(F.regexp_replace(c, _BLANK_SENTENCE, ""), F.lit(1), cap + 1)).otherwise(head)

    def cut(x: Column) -> Column:
        ends = F.regexp_extract(x, rf"(?s)\A(.*[{_MARK}])[^{_MARK}]", 1)
        return F.when(x == "", F.substring(c, F.lit(1), cap)).when(F.length(x) <= cap, x).otherwise(F.coalesce(F.nullif(ends, F.lit("")), F.substring(x, F.lit(1), cap)))

    return F.when(F.length(c) <= cap, c).otherwise(F.transform(F.array(told), cut)[0])  # told is worked out once


def json_items(reply: Column, schema: str) -> Column:
    """The array in a reply, fenced or amid other words; an empty one where there is none. Texts in it may be of any length."""
    bare = F.regexp_replace(F.regexp_replace(strip(reply), r"^```(?:json)?\s*", ""), r"(?<!\s)\s*+```$", "")
    read = lambda x: F.from_json(x, f"array<{schema}>", {"maxStringLen": str(2**31 - 1)})
    whole = F.when(bare.startswith("["), read(bare))
    return F.coalesce(whole, read(F.nullif(F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.lit(""))), F.from_json(F.lit("[]"), f"array<{schema}>"))


def json_object(reply: Column, schema: str) -> Column:
    """The object in a reply, fenced or amid other words; null where there is none."""
    bare = F.regexp_replace(F.regexp_replace(strip(reply), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(found != "", F.from_json(found, schema))


def real_claim(claim: Column) -> Column:
    """A claim without blanks at its ends; null if no more than two code points are left."""
    return F.when(F.length(strip(claim)) > 2, strip(claim))


def needs_many(reply: Column) -> Column:
    """Whether a reply asks for several queries; a denial counts before an assent, silence as a denial."""
    return F.when(reply.contains("不需要"), False).when(reply.contains("需要"), True).otherwise(False)


def entity(reply: Column) -> Column:
    """The name in a reply, or null where it says that there is none."""
    x = F.regexp_replace(strip(reply), "^。+|。+$", "")
    return F.when((x == "") | F.lower(x).isin("无", "none", "未知", "不清楚"), None).otherwise(x)


def coverage(query: Column, content: Column) -> Column:
    """The share of a query's different characters that a text has."""
    chars = F.array_distinct(F.split(query, ""))
    return F.size(F.array_intersect(chars, F.split(content, ""))) / F.size(chars)


def json_string(c: Column) -> Column:
    """A text as JSON has it, in quotes."""
    whole = F.to_json(F.struct(c.alias("c")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def history_json(history: Column) -> Column:
    """An array of (role, content) as a JSON list with keys in order and a blank after each comma and colon."""
    one = lambda m: F.concat(F.lit('{"content": '), json_string(m["content"]), F.lit(', "role": '), json_string(m["role"]), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(history, one), ", "), F.lit("]"))


def cache_key(tenant: Column, user: Column, permissions: Column, documents: Column, strategy: Column, mode: Column, rerank: Column, version: Column, query: Column, history: Column | None = None) -> Column:
    """A key that changes with whatever may change the answer: who asks, what they may read, how, of which index, and after which turns.

    Parts that are null have a place of their own; history(role, content) adds one unless it is null or empty.
    """
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    may = F.when(F.coalesce(F.size(permissions), F.lit(0)) > 0, listed(permissions)).otherwise("none")
    docs = F.when(documents.isNull(), "all").when(F.size(documents) == 0, "none").otherwise(F.sha2(listed(documents).cast("binary"), 256))
    blank = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    parts = [F.lit("v2"), blank(tenant, "default"), blank(user, ""), may, docs, blank(strategy, ""), blank(mode, ""), F.when(rerank, "True").otherwise("False"), blank(version, "missing"), strip(blank(query, ""))]
    if history is not None:
        parts.append(F.when(F.size(history) > 0, history_json(history)))  # concat_ws leaves out this one alone
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)
