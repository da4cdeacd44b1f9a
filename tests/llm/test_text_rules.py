"""SimHash, packing, sharding, quality rules and token files against brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwright.llm import packing, quality, sharding, simhash, tokens

from .conftest import plain


def slow_words(text):
    out, w = [], ""
    for c in text + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            if w:
                out.append(w)
            w = ""
        else:
            w += c
    return out


def slow_fingerprint(text):
    w = slow_words("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def slow_components(ids, linked):
    """Smallest id reachable by links from each id."""
    low = {i: i for i in ids}
    todo = True
    while todo:
        todo = False
        for a, b in linked:
            m = min(low[a], low[b])
            todo |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_simhash(name, request):
    df = request.getfixturevalue(name)
    rows = plain(df)
    fps = [(d, slow_fingerprint(t)) for d, t in rows]
    distinct = sorted({f for _, f in fps})
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 3]
    low = slow_components(distinct, links)
    first = defaultdict(list)
    for d, f in fps:
        if d is not None:
            first[low[f]].append(d)
    want = Counter((d, f, min(first[low[f]], default=None)) for d, f in fps)
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == want


def test_sliced_links_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    fp = np.repeat(rng.integers(0, 2**63, 40, dtype=np.uint64), 9)
    for i in range(len(fp)):
        for b in rng.integers(0, 64, rng.integers(0, 4)):
            fp[i] ^= np.uint64(1) << np.uint64(b)
    for radius in (0, 1, 3, 5):
        for starts in ([0, 360], [0, 7, 8, 100, 360]):
            a, b = simhash.sliced_links(fp, np.array(starts), radius)
            g = np.searchsorted(starts, np.arange(360), "right")
            assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i in range(360) for j in range(i + 1, 360) if g[i] == g[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= radius}
    # one bucket that is cut into many blocks gives the same components
    monkeypatch.setattr(simhash, "BLOCK", 16)
    near = [(int(i), int(f)) for i, f in enumerate(np.uint64(12345) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64)))]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    df = spark.createDataFrame([(i, f - 2**64 if f >> 63 else f) for i, f in near], "doc_id long, fp long")
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} == {0}


def test_links_through_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    df = spark.createDataFrame([(1, 0), (None, 7), (3, 63), (None, 1 << 40), (9, -1)], "doc_id long, fp long")
    assert {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()} == {(1, 0, 1), (None, 7, 1), (3, 63, 1), (None, 1 << 40, 1), (9, -1, 9)}


def slow_similar(a, b, n=5):
    grams = lambda t: {tuple(w[i : i + n]) for w in [slow_words(t.lower())] for i in range(max(1, len(w) - n + 1))}
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def near_copies(seed=3, groups=40):
    """(doc_id, text): texts with near copies, several to a text, of similarities about 0.7 to 1, far from the others."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        w = [f"w{i}" for i in rng.integers(0, 3000, rng.integers(80, 500))]
        out.append(" ".join(w))
        for _ in range(int(rng.integers(0, 5))):
            c = list(w)
            for i in rng.integers(0, len(c), rng.integers(0, 2 + len(c) // 40)):
                c[i] = f"x{rng.integers(0, 10_000)}"
            out.append(" ".join(c))
    return [(int(i), t) for i, t in zip(rng.permutation(len(out)), out)]


def test_keep_first_of_similar(spark):
    """Every group of texts linked at 0.8 is found but for few, none is joined below it, and one text of each stays."""
    rows = near_copies()
    ids, text = [d for d, _ in rows], dict(rows)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if slow_similar(text[a], text[b]) >= 0.8]
    low = slow_components(ids, links)
    got = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {d for d in ids if low[d] == d}
    assert len(links) > 40 and first <= got and len(got - first) <= 0.05 * (len(ids) - len(first))


def family(seed, size, words, changed):
    """A text and copies of it with so many words changed in each, which link here and there."""
    rng = np.random.default_rng(seed)
    w = [f"w{i}" for i in rng.integers(0, 3000, words)]
    out = []
    for _ in range(size):
        c = list(w)
        for i in rng.integers(0, words, changed):
            c[i] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(c))
    return out


@pytest.mark.parametrize("size, words, changed", [(200, 300, 4), (500, 200, 2), (60, 120, 2)])
def test_keep_first_of_large_families(spark, size, words, changed):
    """Of many copies of one text, of which a pair in twenty or so is similar enough, the groups are those of brute force."""
    texts = family(size, size, words, changed)
    sets = [{tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)} for t in texts]
    links = [(i, j) for i in range(size) for j in range(i + 1, size) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    low = slow_components(range(size), links)
    first = {i for i in range(size) if low[i] == i}
    got = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert first <= got and len(got - first) <= 0.05 * (size - len(first)), (len(first), len(got), len(links))


def test_sampled_masks():
    for n in (0, 1000, 10**7):
        tables = simhash.sampled_masks(n)
        assert len({m.bit_count() for m in tables}) == 1 and tables[0].bit_count() >= 10
    assert simhash.sampled_masks(10**7)[0].bit_count() > 10 and len(simhash.sampled_masks(10**7)) > len(simhash.sampled_masks(0))


def whole_ids(text):
    return tokens.loaded(tokens.TOKENIZER).tokenizer.encode(text, add_special_tokens=False).ids


def test_encode(monkeypatch):
    texts = ["", " ", "The the THE, the. the... the.,; don't DON'T it's 's", "É é É ß ẞ İ ΑΣ ΑΣ. ÷ × a÷b Ñandú, año2024 a1b2", "<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>Y Word", "a\u00a0b\u2003c\x1cd\te\rf", "x" * 200 + ". y", "中文 字。 한국 🙂🙂 ok!!! ?!", "\u0301a e\u0301 \n\u0301"]
    for cap in (1 << 20, 64):
        monkeypatch.setattr(tokens, "KEPT_BYTES", cap)
        tokens._LOADED.clear()
        for _ in range(2):
            for at in (texts, texts[::-1], texts[2:4], [None, *texts], []):
                ids, edge = tokens.encode(pa.array(at, pa.string()))
                assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:])] == [whole_ids(t or "") for t in at]
    monkeypatch.setattr(tokens, "AT_ONCE", 50)
    got = [ids[a:b].tolist() for _, ids, edge in tokens.encoded(pa.array(texts), 7) for a, b in zip(edge, edge[1:])]
    assert got == [[*whole_ids(t), 7] for t in texts]
    tokens._LOADED.clear()


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_packing(name, request):
    df = request.getfixturevalue(name)
    got = packing.pack_documents(df, keep_ids=True).collect()
    want = Counter()
    for d, t in plain(df):
        ids = whole_ids(t) + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[(d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(bins) <= max(-(-sum(r.length for r in got) // 4096) + 1, len(packing.best_fit([r.length for r in got], 4096)))


def test_local_search_empties_bins():
    bins = [[0, 1], [2, 3], [4]]  # 6+2 of 10, 5+2, 5
    got = packing.local_search([list(b) for b in bins], [6, 2, 5, 2, 5], 10)
    assert len(got) == 2 and sorted(i for b in got for i in b) == [0, 1, 2, 3, 4]
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 300).tolist()
    poor = [[i] for i in range(300)]
    after = packing.local_search(poor, lengths, 100)
    assert sorted(i for b in after for i in b) == list(range(300)) and all(sum(lengths[i] for i in b) <= 100 for b in after)
    assert len(after) <= 1.05 * len(packing.best_fit(lengths, 100))


def test_local_search_beats_best_fit():
    """Bins of three items that fill them wholly: best fit alone misses the least number, and the search comes closer."""
    rng = np.random.default_rng(4)
    fitted = searched = 0
    for _ in range(3):
        a = rng.integers(900, 1800, 120)
        b = rng.integers(900, 1800, 120)
        lengths = np.concatenate([a, b, 4096 - a - b]).tolist()
        first = packing.best_fit(lengths, 4096)
        after = packing.local_search([list(x) for x in first], lengths, 4096)
        assert sorted(i for x in after for i in x) == list(range(360)) and max(sum(lengths[i] for i in x) for x in after) <= 4096
        fitted, searched = fitted + len(first) - 120, searched + len(after) - 120
    assert 0 <= searched < fitted, (searched, fitted)


@pytest.mark.parametrize("low, high", [(2049, 4001), (1366, 2049), (1500, 4001), (1, 4097), (900, 1800)])
def test_local_search_ends_soon(low, high):
    """A whole group of pieces, of which few or none fit together, takes seconds."""
    import time

    lengths = np.random.default_rng(1).integers(low, high, packing.GROUP).tolist()
    first, at = packing.best_fit(lengths, 4096), time.process_time()
    after = packing.local_search(first, lengths, 4096)
    assert time.process_time() - at < 15
    assert packing.least_bins(np.array(lengths), 4096) <= len(after) <= len(first)
    assert sorted(i for b in after for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 4096 for b in after)
    if low > 1365 and high < 4001 or low > 2048:
        assert len(first) == packing.least_bins(np.array(lengths), 4096)


def test_least_bins():
    """Never above what a search through all packings of a few items finds."""
    rng = np.random.default_rng(5)

    def fewest(items, bins=()):
        if not items:
            return len(bins)
        best = 99
        for i, b in enumerate(bins):
            if b + items[0] <= 10:
                best = min(best, fewest(items[1:], (*bins[:i], b + items[0], *bins[i + 1 :])))
        return min(best, fewest(items[1:], (*bins, items[0])))

    for _ in range(60):
        items = sorted(rng.integers(1, 11, rng.integers(1, 8)).tolist(), reverse=True)
        assert packing.least_bins(np.array(items), 10) <= fewest(items)


def test_pack_levels_and_errors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    items = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(rng.integers(1, 4097, 3000))], "doc_id long, piece int, length long")
    got = packing.pack(items, group=200).collect()
    assert len(got) == 3000
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and len(fill) <= 1.03 * len(packing.best_fit([r.length for r in got], 4096))
    with pytest.raises(Exception, match="lengths must be"):
        packing.pack(items.withColumn("length", F.lit(5000))).collect()


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_sharding(name, request):
    df = request.getfixturevalue(name)
    got = sharding.shard(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in plain(df))
    groups = {t: set() for _, t in plain(df)}
    by = {zlib.crc32(t.encode()): t for t in groups}
    size = Counter()
    for r in got:
        groups[by[r.text_crc32]].add(r.shard)
        size[r.shard] += r.size
    assert all(len(x) == 1 for x in groups.values()) and set(size) <= set(range(24))
    for s in size:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    if name == "docs":
        mean = sum(size.values()) / 24
        assert max(size.values()) < 1.02 * max(mean, max(r.size for r in got)) and min(size.values()) > 0.9 * mean


def test_best_fit_decreasing():
    rng = np.random.default_rng(0)
    sizes = sorted(Counter(rng.integers(1, 60, 400).tolist()).items(), reverse=True)
    free: list[int] = []
    for (s, n), own in zip(sizes, sharding.best_fit_decreasing(sizes, 100)):
        assert sum(k for _, k in own) == n
        for b in (b for b, k in own for _ in range(k)):  # each went to the tightest bin of the time
            fit = [f for f in free if f >= s]
            if b == len(free):
                assert not fit
                free.append(100)
            else:
                assert free[b] == min(fit)
            free[b] -= s
    assert sharding.best_fit_decreasing(sizes, 100, len(free) - 1) is None
    for first in ([(5000, 1)], [(5000, 2)], []):  # groups above a share stand alone
        placed = sharding.place([*first, *sizes], 6)
        load = Counter()
        for (s, _), own in zip([*first, *sizes], placed, strict=True):
            for b, k in own:
                load[b] += s * k
        big = {b for (s, _), own in zip([*first, *sizes], placed) for b, _ in own if s == 5000}
        rest = [v for b, v in load.items() if b not in big]
        assert sum(load.values()) == sum(s * n for s, n in [*first, *sizes]) and all(load[b] == 5000 for b in big) and len(big) == sum(n for _, n in first)
        assert max(rest) - min(rest) <= 0.02 * max(rest) and len(load) == 6
    some = sharding.place([(100, 3)], 2)  # of three equal groups one stands alone, and two share the other shard
    assert sorted(k for _, k in some[0]) == [1, 2] and sharding.place([], 3) == []


def slow_counts(text):
    w = slow_words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if slow_words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(lines)


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_quality(name, request):
    df = request.getfixturevalue(name)
    got = quality.quality(df).collect()
    want = Counter()
    for d, t in plain(df):
        c = slow_counts(t)
        want[(d, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert Counter((r.doc_id, *(r[c] for c in quality.COUNTS), r.base_failed) for r in got) == want
    assert got[0].__fields__[:8] == ['doc_id', 'n_words', 'word_chars', 'n_symbols', 'n_dup_lines', 'n_repeat_words', 'base_failed', 'kept']
    assert not any(r.kept and r.base_failed for r in got)
    if name == "docs":
        assert all(r.kept != r.base_failed for r in got)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_host_verdicts(spark):
    """A host that mostly fails loses its good rows too; one failure says little of a host; a rule beside the base ones can reject."""
    rng = np.random.default_rng(0)
    long = lambda: " ".join(f"w{i}" for i in rng.permutation(10_000)[:60])
    marked = lambda: " ".join(f"#$%w{i}" for i in rng.permutation(10_000)[:60])
    rows = [("good", long())] * 95 + [("good", "short")] * 5 + [("bad", "short")] * 90 + [("bad", long())] * 10 + [("tiny", "short"), ("tiny", long())]
    rows += [("signs", marked()) for _ in range(40)] + [(f"h{i}", long() if i % 10 or k else "short") for i in range(40) for k in range(20)] + [(None, long())]
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    lost = Counter(s for i, (s, _) in enumerate(rows) if not got[i].base_failed and not got[i].kept)
    assert lost == {"bad": 10, "signs": 40}
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {i for i, r in got.items() if r.kept}
    few = spark.createDataFrame([(0, "one", "short"), (1, "one", long())], "doc_id long, source string, text string")
    assert [r.doc_id for r in quality.keep_good(few).collect()] == [1]


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_token_files(name, request):
    df = request.getfixturevalue(name)
    at, want = 0, []
    for d, t in sorted(plain(df), key=lambda x: (x[0] is not None, x[0])):
        ids = whole_ids(t) + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert Counter(map(tuple, tokens.token_files(df).collect())) == Counter(want)


def test_token_files_layout(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    path = f"file://{tmp_path}/t"
    tokens.write_tokens(docs, path)
    one = spark.read.parquet(f"{path}/ids").inputFiles()[0].removeprefix("file://")
    m = pq.ParquetFile(one).metadata.row_group(0)
    cols = {m.column(i).path_in_schema: m.column(i) for i in range(m.num_columns)}
    assert "RLE_DICTIONARY" in cols["ids.list.element"].encodings and "DELTA_BINARY_PACKED" in cols["doc_id"].encodings
    assert cols["doc_id"].has_offset_index and cols["doc_id"].has_column_index
    some = tokens.read_tokens(spark, path).where("doc_id between 5 and 7")
    assert [r.ids for r in some.orderBy("doc_id").collect()] == [whole_ids(t or "") + [2] for d, t in sorted(plain(docs)) if 5 <= d <= 7]
    text = some.select("doc_id", "ids")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,5)" in text and text.count("n_tokens") and "sum(n_tokens" not in text


def test_empty_tables(spark, docs):
    none = docs.where("false")
    for f in (simhash.near_duplicates, packing.pack_documents, sharding.shard, quality.quality, tokens.token_files):
        assert f(none).count() == 0
