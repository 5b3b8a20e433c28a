import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from cohortlens.llm import ranked_search
from cohortlens.llm.ranked_search import ImpactList, best_positions, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = T.StructType(
    [T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("doc_id", T.LongType())]
)


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    docs = [(i, plain_terms(t)) for i, t in docs if i is not None]
    docs = [(i, t) for i, t in docs if t]
    n_docs, n_terms = len(docs), sum(len(t) for _, t in docs)
    pooled = {}
    for i, t in items:
        if i is not None:
            pooled.setdefault(i, []).extend(plain_terms(t))
    out = []
    for item, terms in pooled.items():
        df = {t: sum(t in d for _, d in docs) for t in set(terms)}
        hits = []
        for doc, own in docs:
            m = 100 - 75 + 75 * len(own) * n_docs // n_terms
            score = 0
            for t in terms:
                if t in own:
                    tf = own.count(t)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
            if score:
                hits.append((-score, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(hits)[:k])]
    return sorted(out)


def found(spark, docs, items, **how):
    return sorted(tuple(r) for r in search(docs, spark.createDataFrame([(i, t, None, 1) for i, t in items], ITEMS), **how).collect())


def corpus(n, seed, words=60):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(words)] + ["Ünï", "ÄB", "x9", "9"]
    return [(i, " ".join(rng.choice(names[: rng.choice((5, 20, len(names)))]) + rng.choice(["", ",", "!", "_", "\n"]) for _ in range(rng.randint(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("shard", [7, 1 << 15])
def test_equals_brute_force(spark, make, odd, monkeypatch, shard):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(ranked_search, "FIRST_STEP", 2)
    docs = corpus(150, 1) + [(1000 + i, "w1 w1 w2 rare") for i in range(30)] + odd
    items = corpus(12, 2) + [(50, None), (51, ""), (52, "!!!"), (None, "w1"), (53, "w1"), (53, "w2 W1"), (54, "absent"), (55, "rare w1"), (56, "i̇ É")]
    assert found(spark, make(docs, 4), items) == brute(docs, items)
    assert found(spark, make(docs, 2), items, k=3) == brute(docs, items, 3)


def test_blocks_of_items(spark, make, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 300)
    docs, items = corpus(60, 3), corpus(15, 4) + [(3, "w1 w2")]
    assert found(spark, make(docs), items) == brute(docs, items)


def test_empty_tables_and_terms_in_every_document(spark, make):
    assert found(spark, make([]), [(1, "a")]) == []
    assert found(spark, make([(1, "a")]), []) == []
    docs = [(i, "same") for i in range(2000)]
    assert found(spark, make(docs), [(1, "same")]) == brute(docs, [(1, "same")])


def test_long_text(spark, make):
    docs = [(1, "a b " * 300_000 + "needle"), (2, "needle"), (3, "b")]
    assert found(spark, make(docs), [(1, "needle a")]) == brute(docs, [(1, "needle a")])


def test_terms():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(chr(rng.choice((rng.randrange(128), rng.randrange(0x2FF), 0x1F600))) for _ in range(40))
        assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)


def lists(rng, n_lists, n_docs, top):
    out = []
    for _ in range(n_lists):
        docs = np.flatnonzero(rng.random(n_docs) < rng.random())
        out.append((ImpactList(docs, rng.integers(1, top, len(docs))), int(rng.integers(1, 3))))
    return [x for x in out if len(x[0].docs)]


def test_best_positions_return_the_best_and_all_ties():
    rng = np.random.default_rng(6)
    for case in range(200):
        n = int(rng.integers(1, 400))
        own = lists(rng, int(rng.integers(1, 6)), n, 4 if case % 2 else 10**6)
        ids = rng.permutation(n)
        full = np.zeros(n, np.int64)
        for x, repeats in own:
            full[x.docs] += repeats * x.impacts
        docs, scores, _ = best_positions(own, n, ids, 5)
        want = np.lexsort((ids, -full))[:5]
        want = want[full[want] > 0]
        assert docs.tolist() == want.tolist() and scores.tolist() == full[want].tolist()


def last_read_depth(own, n, k, start):
    """Depth at which a threshold from last-read positions would have stopped."""
    full = np.zeros(n, np.int64)
    for x, repeats in own:
        full[x.docs] += repeats * x.impacts
    depth, step, longest = 0, start, max(len(x.docs) for x, _ in own)
    while depth < longest:
        depth, step = depth + step, 2 * step
        met = np.unique(np.concatenate([x.docs[x.order[:depth]] for x, _ in own]))
        kth = np.sort(full[met])[::-1][:k]
        bound = sum(r * int(x.impacts[x.order[depth - 1]]) for x, r in own if depth < len(x.docs))
        if len(kth) == k and bound < kth[-1]:
            break
    return depth


def test_stops_early_and_no_later_than_last_read_positions(monkeypatch):
    monkeypatch.setattr(ranked_search, "FIRST_STEP", 4)
    rng = np.random.default_rng(7)
    sooner = 0
    for _ in range(60):
        n = 4000
        good = rng.random(n)
        own = []
        for _ in range(3):
            docs = np.arange(n)
            own.append((ImpactList(docs, (10**6 * (good + 0.05 * rng.random(n))).astype(np.int64)), 1))
        depth = best_positions(own, n, docs, 5)[2]
        last = last_read_depth(own, n, 5, 4)
        assert depth <= last < n
        sooner += depth < last
    assert sooner


def test_does_not_stop_on_a_bound_equal_to_the_kth_score(monkeypatch):
    monkeypatch.setattr(ranked_search, "FIRST_STEP", 1)
    same = ImpactList(np.arange(50), np.full(50, 7))
    docs, scores, depth = best_positions([(same, 1)], 50, np.arange(50)[::-1], 3)
    assert docs.tolist() == [49, 48, 47] and scores.tolist() == [7, 7, 7] and depth >= 50
