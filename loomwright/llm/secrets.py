"""Secret scans: patterns, and randomness tests against ordinary writing under false-discovery control."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text, materialise

KINDS = ("assign", "access", "hex", "random")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Runs that the battery looks at: this long, and with digits among letters or with both cases inside.
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_PLACE = {name: {c: i for i, c in enumerate(a)} for name, a in _ENCODINGS}
#: Bands of length that are weighted apart, and the share of false discoveries allowed.
BANDS, FDR = (16, 20, 24, 32, 40, 64, 128), 0.05
#: Runs that random strings are in fewer than 1 of 100 cases, by the battery's -log10 p, are not random. Evidence is in tenths of a power of ten.
UNLIKE, MOST = 2.0, 400
#: Ordinary writing, names and numbers: how often a character of one class (none, lower, upper, digit, sign) is followed by one of another, and letters by share in English, counted as LETTERS letters of each text. ODD of all letters are any, for names and abbreviations.
_NEXT = {"": (0.6, 0.25, 0.1, 0.05), "l": (0.84, 0.09, 0.03, 0.04), "u": (0.7, 0.22, 0.04, 0.04), "d": (0.13, 0.1, 0.65, 0.12), "s": (0.55, 0.2, 0.2, 0.05)}
_STEP = {(a, b): math.log10(p) for a, row in _NEXT.items() for b, p in zip("luds", row, strict=True)}
_ENGLISH = dict(zip("abcdefghijklmnopqrstuvwxyz", (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.15, 2.0, 0.1), strict=True))
LETTERS, ODD = 500, 0.3


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches: leftmost and apart within a kind, failing ones dropped."""
    found = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds the token."""
    have = set(token)
    return next((name for name, _ in _ENCODINGS if have <= _PLACE[name].keys()), None)


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str, name: str) -> float:
    """-log10 of the p-value that a random string of the encoding is as far from random as the token: 0 looks random.

    The least p of three tests, times three: chi-squared of the alphabet's use (by its cube-root normal form), runs
    above and below the middle of the alphabet, and serial correlation of neighbours.
    """
    at = [_PLACE[name][c] for c in token]
    n, k = len(at), len(_PLACE[name])
    x2 = sum(c * c for c in Counter(at).values()) * k / n - n
    d = k - 1
    p_chi = _tail(((x2 / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))) if x2 > 0 else 1.0
    up = [2 * a >= k for a in at]
    n1 = sum(up)
    n2 = n - n1
    if n1 and n2:
        runs = 1 + sum(a != b for a, b in zip(up, up[1:], strict=False))
        mean = 1 + 2 * n1 * n2 / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p_runs = 2 * _tail(max(0.0, abs(runs - mean) - 0.5) / math.sqrt(var))
    else:
        p_runs = 2.0 ** (1 - n)
    mean = (k - 1) / 2
    var = (k * k - 1) / 12
    r = sum((a - mean) * (b - mean) for a, b in zip(at, at[1:], strict=False)) / (var * math.sqrt(n - 1))
    p_serial = 2 * _tail(abs(r))
    return -math.log10(max(min(1.0, 3 * min(p_chi, p_runs, p_serial)), 1e-300))


def _mixed(token: str) -> bool:
    digits = sum(c.isdigit() for c in token)
    inner = token[1:]
    return (0 < digits < len(token) and any(c.isalpha() for c in token)) or (any("A" <= c <= "Z" for c in inner) and any("a" <= c <= "z" for c in inner))


def band(n: int) -> int:
    return sum(n >= b for b in BANDS) - 1


def outside(text: str, spans: list[tuple[int, int]]) -> str:
    """What of the text is outside the spans, which may overlap."""
    left, at = [], 0
    for s, e in sorted(spans):
        left.append(text[at:s])
        at = max(at, e)
    return "".join(left) + text[at:]


def letter_shares(text: str) -> dict[str, float]:
    """log10 of each letter's share in ordinary writing like this text: its own letters, LETTERS English ones, and ODD of any kind."""
    own = Counter(c for c in text.lower() if "a" <= c <= "z")
    n, all_ = sum(own.values()) + LETTERS, sum(_ENGLISH.values())
    return {c: math.log10((1 - ODD) * (own[c] + LETTERS * p / all_) / n + ODD / 26) for c, p in _ENGLISH.items()}


def _class(c: str) -> str:
    return "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "d" if "0" <= c <= "9" else "s"


def evidence(token: str, name: str, shares: dict[str, float]) -> int:
    """Tenths of -log10 of a p-value for the token as ordinary writing; 0 where it says nothing.

    The likelihood as a random string over that as ordinary writing: a ratio of x or more comes with ordinary writing in
    1 of x cases at most, whatever the length. A token that the battery finds unlike random strings has none.
    """
    if randomness(token, name) >= UNLIKE:
        return 0
    plain, was = 0.0, ""
    for c in token:
        k = _class(c)
        plain += _STEP[was, k] + (-1.0 if k == "d" else math.log10(0.25) if k == "s" else shares[c.lower()])
        was = k
    random = -len(token) * math.log10(len(_PLACE[name])) - math.log10(len(_ENCODINGS))
    return max(0, min(MOST, int(10 * (random - plain))))


def runs(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """(start, end) of the runs that the battery looks at: what base spans leave of a run counts if it is long enough itself."""
    found = []
    for m in _RUN.finditer(text):
        at = m.start()
        for s, e in [(s, e) for s, e, _ in base if s < m.end() and m.start() < e] + [(m.end(), m.end())]:
            if s - at >= BANDS[0] and _mixed(text[at:s]):
                found.append((at, s))
            at = max(at, e)
    return found


def scan(text: str) -> tuple[list, list, list, list, list]:
    """Base spans, and the runs outside them with their band of length and their evidence of being random.

    Ordinary writing is what the text has outside all its runs and base spans: a secret says nothing of how writing looks.
    """
    base = base_spans(text)
    mixed = runs(text, base)
    starts, ends, bands, proofs = [], [], [], []
    if mixed:
        shares = letter_shares(outside(text, mixed + [(s, e) for s, e, _ in base]))
    for s, e in mixed:
        if name := encoding(text[s:e]):
            starts.append(s), ends.append(e), bands.append(band(e - s)), proofs.append(evidence(text[s:e], name, shares))
    return base, starts, ends, bands, proofs


_FOUND = pa.struct([
    ("base", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))),
    *[(c, pa.list_(pa.int32())) for c in ("start", "end", "band", "evidence")],
])
_FOUND_DDL = "struct<base:array<struct<start:int,end:int,kind:string>>,start:array<int>,end:array<int>,band:array<int>,evidence:array<int>>"


def _scan(text: str) -> tuple:
    base, *rest = scan(text)
    return [{"start": s, "end": e, "kind": k} for s, e, k in base], *rest


def scanned(text: Column) -> Column:
    """What `scan` finds in each whole text."""
    return F.arrow_udf(by_text(_scan, _FOUND), _FOUND_DDL).asNondeterministic()(text)


def least_evidence(counts: dict[tuple[int, int], int]) -> dict[int, int]:
    """For each band of length, the least evidence accepted by Benjamini-Hochberg over all runs, from (band, evidence): runs.

    p-values are weighted by the band's length, weights being 1 on average over the runs.
    """
    n = sum(counts.values())
    mean = sum(BANDS[k] * c for (k, _), c in counts.items()) / n if n else 1
    weighted = sorted(((e / 10 + math.log10(BANDS[k] / mean), k, e, c) for (k, e), c in counts.items() if e > 0), reverse=True)
    taken, out, open_ = 0, {}, {}
    for w, k, e, c in weighted:
        taken += c
        open_[k] = e
        if w >= math.log10(n / (FDR * taken)):
            out = dict(open_)
    return out


def limits(found: DataFrame) -> dict[int, int]:
    """`least_evidence` of all rows' runs. Spark counts them into a table of at most len(BANDS) * (MOST + 1) rows."""
    runs = found.select(F.explode(F.arrays_zip("found.band", "found.evidence")).alias("x"))
    table = runs.groupBy("x.band", "x.evidence").agg(F.count(F.lit(1)).alias("n")).collect()
    return least_evidence({(r.band, r.evidence): r.n for r in table})


def accepted(least: dict[int, int]) -> Column:
    """All spans of a column `found`, by start and kind: those of the patterns, and the runs that count as random."""
    limit = F.array(*[F.lit(least.get(k, MOST + 1)) for k in range(len(BANDS))])
    runs = F.filter(F.arrays_zip("found.start", "found.end", "found.band", "found.evidence"), lambda x: x["evidence"] >= F.element_at(limit, x["band"] + 1))
    spans = F.concat(F.col("found.base"), F.transform(runs, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("random").alias("kind"))))
    order = F.array(*[F.lit(k) for k in KINDS])
    by = lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind"))
    return F.array_sort(F.transform(spans, by))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of every row, from its whole text.

    Null texts are empty: no spans, and the digest of nothing. Offsets are code points, ends exclusive. Repeated rows
    are rows each and count each in the control; runs of equal evidence are accepted or not together. Other columns are
    left out, whatever their names. A text is scanned whole in one task, however long. An empty table gives an empty one.
    """
    found = materialise(docs.select("doc_id", scanned(F.col("text")).alias("found")), "secrets")
    x = found.select("doc_id", accepted(limits(found)).alias("s"))
    count = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("s", lambda s: s["kind"] != "random")
    return x.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"), count("random"))


def redact(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """docs with each span of its texts replaced by the mark (spans that touch by one), and n_chars, if there is one, as the text then has.

    Null texts stay null; all other columns stay as they are, whatever their names. Texts are scanned once.
    """
    rows = materialise(docs.select(F.struct("*").alias("row"), scanned(F.col("text")).alias("found")), "secrets")
    x = rows.select("row", accepted(limits(rows)).alias("s"))
    text = F.col("row.text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, s):
        overlaps = s["start"] < a["at"]
        between = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(overlaps, a["out"]).otherwise(F.concat(a["out"], between, F.lit(mark))).alias("out"))

    clean = F.aggregate("s", start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    x = x.select("row", "s", F.when(text.isNull() | (F.size("s") == 0), text).otherwise(clean).alias("clean"))
    row = F.col("row").withField("text", F.col("clean"))
    if "n_chars" in docs.columns:
        n = F.when(F.size("s") == 0, F.col("row.n_chars")).otherwise(F.length("clean"))
        row = row.withField("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return x.select(row.alias("row")).select("row.*")
