"""Each stage of the pipeline against brute force over its own input, and the whole run against its stages."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from loomwright.llm import mixing
from loomwright.llm.common import materialise

from .test_spans_vectors import slow_secrets
from .test_text_rules import slow_components, slow_counts, slow_words, whole_ids


def good(rows):
    counts = [(r, slow_counts(r.text or "")) for r in rows]
    return Counter((r.doc_id, r.text) for r, c in counts if not (c[0] < 50 or 100 * c[4] > 50 * c[0]))


def first(rows):
    texts = sorted({r.text or "" for r in rows})
    grams = [{tuple(w[i : i + 5]) for w in [slow_words("".join(c.lower() if "A" <= c <= "Z" else c for c in t))] for i in range(max(1, len(w) - 4))} for t in texts]
    linked = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    low = slow_components(range(len(texts)), linked)
    of = {t: low[i] for i, t in enumerate(texts)}
    least = {}
    for r in rows:
        k = (r.doc_id is None, r.doc_id)
        least[of[r.text or ""]] = min(least.get(of[r.text or ""], k), k)
    return set(least.values())


def redacted(text):
    out, at = "", 0
    for a, b, _ in slow_secrets(text):
        if a >= at:
            out += text[at:a] + "<SECRET>"
        at = max(at, b)
    return out + text[at:]


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_stages(name, spark, sf_dir, request):
    docs = request.getfixturevalue(name)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "secret scans", "mixing sources", "best-fit packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = docs.collect()
        out = materialise(stage(spark, docs, sf_dir), f"stage{k}")
        got = out.collect()
        if k < 4:
            assert out.columns == docs.columns
            texts = Counter((r.doc_id, r.text) for r in got)
        if k == 0:
            assert texts == good(rows)
        elif k == 1:
            assert Counter((r.doc_id is None, r.doc_id) for r in got) == Counter(first(rows)) and texts <= Counter((r.doc_id, r.text) for r in rows)
        elif k == 2:
            assert texts == Counter((r.doc_id, redacted(r.text)) for r in rows)
        elif k == 3:
            size, words, of = Counter(), Counter(), {}
            for r in rows:
                size[r.source] += len(slow_words(r.text))
                of[r.doc_id] = (r.source, r.text)
            for r in got:
                words[r.source] += len(slow_words(r.text))
                assert Counter(slow_words(r.text)) <= Counter(slow_words(of[r.doc_id][1])) and r.n_chars == len(r.text)
            target = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(size.items()), "source string, size long")).collect()}
            assert all(abs(words[s] - target[s]) <= mixing.BLOCK for s in size) and max(Counter((r.doc_id, r.text) for r in got).values()) <= 3 * max(Counter(r.doc_id for r in rows).values())
        else:
            want = Counter()
            for r in rows:
                ids = whole_ids(r.text) + [1]
                for p, at in enumerate(range(0, len(ids), 4096)):
                    want[(r.doc_id, p, at, zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes()))] += 1
            assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in got) == want
        docs = out
    if name == "docs":
        cut = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
        assert cut(corpus_pipeline.run(spark, sf_dir)) == cut(docs)
