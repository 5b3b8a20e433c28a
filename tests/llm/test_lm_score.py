import math
import re
import zlib
from collections import Counter

import numpy as np

from cohortlens.llm.lm_score import LEVELS, Exact, Filter, Rules, level_means, level_of, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = Rules(unigram_bits=20, bigram_bits=22, frequent=40, chunk=500, segment_bytes=1 << 12)


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")] + [None]


def brute(docs):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter(t for d, x in docs if not held(d) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    out = []
    for d, x in docs:
        own = tokens(x)
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own)
        out.append((d, held(d), len(own), sum(count[t] > 0 for t in own), n, base))
    return sorted(out, key=repr)


def check(docs, frame):
    got = sorted((tuple(r) for r in frame.collect()), key=lambda r: repr(r[:5]))
    want = sorted(brute(docs), key=lambda r: repr(r[:5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert sorted(round(r[5], 6) for r in got) == sorted(round(r[5], 6) for r in want)
    assert all(r[6] <= 0 for r in got)


def test_base_equals_brute_force(make, odd):
    docs = odd + [(20 + i, f"The cat sat on the mat number {i} and {i * i} " * (i % 4 + 1)) for i in range(60)] + [(20, "again the same id")]
    check(docs, score(make(docs), rules=SMALL))
    check(docs, score(make(docs), rules=Rules(unigram_bits=20, bigram_bits=20, frequent=0)))


def test_documents_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([(r["doc_id"], r["text"]) for r in docs.collect()], score(docs, rules=Rules(unigram_bits=22, bigram_bits=23)))


def test_bigrams_help_on_held_out_text_with_structure(make):
    rng = np.random.default_rng(0)
    after = {i: rng.permutation(50)[:2] for i in range(50)}

    def text(seed):
        r, w, out = np.random.default_rng(seed), 0, []
        for _ in range(200):
            w = int(after[w][r.integers(2)])
            out.append(f"t{w}")
        return " ".join(out)

    rows = score(make([(i, text(i)) for i in range(120)]), rules=SMALL).where("held_out").collect()
    assert rows and sum(r["score"] for r in rows) > 0.5 * sum(r["base_score"] for r in rows)


def test_nothing_to_learn_from(make):
    assert score(make([])).count() == 0
    held = next(d for d in range(99) if zlib.crc32(str(d).encode()) % 7 == 2)
    row = score(make([(held, "some words here")]), rules=SMALL).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["base_score"] == 0


def test_filter_never_errs_downwards():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 63, 3000, np.uint64) * np.uint64(2))
    counts = np.maximum(1, rng.zipf(1.5, 3000).clip(1, 10**6))
    rules, bits, log2 = Rules(), 18, 4
    table = np.zeros(1 << (bits - 3), np.uint8)
    size = len(table) >> log2
    for s in range(1 << log2):
        own = (keys >> np.uint64(60)) == s
        table[s * size : (s + 1) * size] = np.frombuffer(Filter.region(keys[own], counts[own], bits - log2, rules, 1), np.uint8)
    found = Filter(table, bits, log2, rules, 1).level(keys)
    true = level_of(counts, rules.base)
    assert (found >= true).all() and (found == true).mean() > 0.97
    others = Filter(table, bits, log2, rules, 1).level(rng.integers(0, 1 << 63, 3000, np.uint64) * np.uint64(2) + np.uint64(1))
    assert (others > 0).mean() < 0.05
    pruned = np.zeros_like(table)
    for s in range(1 << log2):
        own = (keys >> np.uint64(60)) == s
        pruned[s * size : (s + 1) * size] = np.frombuffer(Filter.region(keys[own], counts[own], bits - log2, rules, 3), np.uint8)
    high = true >= 3
    assert (Filter(pruned, bits, log2, rules, 3).level(keys)[high] >= true[high]).all()


def test_levels_and_means():
    counts = np.arange(1, 2000)
    levels = level_of(counts, 1.5)
    means = level_means(1.5)
    for q in range(1, int(levels.max())):
        assert np.isclose(means[q], counts[levels == q].mean())
    assert level_of(np.array([10**12]), 1.5)[0] < LEVELS


def test_exact_counts():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 1000, np.uint64) * np.uint64(2))
    exact = Exact(keys[::2], np.arange(len(keys[::2])))
    found = exact.find(keys)
    assert (found[::2] == np.arange(len(keys[::2]))).all() and (found[1::2] == -1).all()
    assert (Exact(keys[:0], np.empty(0)).find(keys) == -1).all()


def test_filters_above_the_size_of_a_slice_lose_no_ngram(make, odd):
    docs = make(odd + [(20 + i, f"The cat sat on the mat number {i} and {i * i} while w{i % 17} ran " * (i % 4 + 1)) for i in range(200)])
    want = {(r["doc_id"], r["n_tokens"], r["base_score"], r["score"]) for r in score(docs, rules=Rules(unigram_bits=24, bigram_bits=24)).collect()}
    for one, two in ((10, 10), (24, 10), (10, 24)):
        rules = Rules(unigram_bits=one, bigram_bits=two, lookup_bytes=3000)
        assert {(r["doc_id"], r["n_tokens"], r["base_score"], r["score"]) for r in score(docs, rules=rules).collect()} == want
