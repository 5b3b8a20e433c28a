import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import minhash
from cohortlens.llm.components import connected
from cohortlens.llm.minhash import Rules, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text, width):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def smallest(links, nodes):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def brute(docs, width, percent=80):
    own = [(d, sets(t, width)) for d, t in docs]
    links = [
        (a, b)
        for i, (a, x) in enumerate(own)
        for b, y in own[:i]
        if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)
    ]
    low = smallest(links, {d for d, _ in docs})
    return sorted(((d, len(s), low[d], d is None or low[d] == d) for d, s in own), key=repr)


def found(docs, rules):
    return sorted((tuple(r) for r in near_duplicates(docs, rules=rules).collect()), key=repr)


def family(seed, size, words, edits, start):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(2000)}" for _ in range(words)]
    out = []
    for i in range(size):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = f"n{rng.randrange(10**6)}"
        out.append((start + i, " ".join(own)))
    return out


@pytest.mark.parametrize("rules", [Rules(), minhash.FOUR_WORDS])
def test_equals_brute_force(make, odd, rules):
    docs = odd + family(1, 12, 80, 2, 100) + family(2, 15, 120, 8, 200) + family(3, 10, 60, 6, 300)
    docs += [(400, "one two"), (401, "ONE  two"), (402, "one two three"), (403, "x " * 50), (404, "x " * 70)]
    docs += [(500 + i, docs[-8][1]) for i in range(5)] + [(None, docs[20][1])]
    assert found(make(docs), rules) == brute(docs, rules.width)


def test_large_group_in_blocks(make):
    docs = family(4, 150, 60, 5, 0)
    rules = Rules(width=4, block=16)
    assert found(make(docs), rules) == brute(docs, 4)


@pytest.mark.parametrize("parts", [1, 4])
def test_texts_that_share_an_id_are_one_document(make, parts):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = [(3, a), (5, a), (5, b), (9, b), (9, c), (12, c), (20, "alone"), (21, a + " end")]
    got = found(make(docs, parts), Rules(width=4))
    assert got == brute(docs, 4)
    assert {r[0]: r[2] for r in got} == {3: 3, 5: 3, 9: 3, 12: 3, 20: 20, 21: 3}


def test_chain_is_linked_through_its_members(make):
    words = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(words[6 * i : 6 * i + 100])) for i in range(10)]
    assert {r[2] for r in found(make(docs), Rules(width=4))} == {0}
    assert found(make(docs), Rules(width=4)) == brute(docs, 4)


def test_empty_and_very_long(make):
    assert near_duplicates(make([])).count() == 0
    long = " ".join(str(i) for i in range(120_000))
    assert [r[2] for r in found(make([(5, long), (6, long + " end"), (7, "other")]), Rules())] == [5, 5, 7]


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_links(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 380)]
    low = smallest(links, {x for p in links for x in p})
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {n: c for n, c in low.items() if n != c}


def test_no_links(spark):
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_pair_just_below_the_threshold_hides_no_link_of_large_sets():
    rules = Rules()
    rng = np.random.default_rng(3)
    n = 450_000
    base = rng.integers(0, 1 << 63, n, np.uint64)
    fresh = lambda m: rng.integers(1 << 63, (1 << 64) - 1, m, np.uint64)
    # Sets of one size that share 8 / 9 of it are at exactly 0.8.
    def sharing(common):
        return np.unique(np.concatenate([base[:common], fresh(n - common)]))

    family = {1: np.sort(base), 2: sharing(n * 8 // 9 - 1), 3: sharing(n * 8 // 9)}
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert jaccard(family[1], family[2]) < 0.8 <= jaccard(family[1], family[3])

    def row(node, part, component):
        own = family[node]
        cut = np.unique((own >> np.uint64(32)).astype("<u4")).tobytes()
        return {"own": part, "i": 0, "j": 1, "node": node, "component": component, "size": len(own), "minima": minhash.minima(own, rules).tobytes(), "cut": cut}

    # 2 and 3 are one component, so a false merge of 1 with 2 would leave out 1 and 3.
    us, vs = minhash._compare_block(pa.Table.from_pylist([row(1, 0, 1), row(2, 1, 2), row(3, 1, 2)]), rules)
    assert (3, 1) in set(zip(us, vs))
