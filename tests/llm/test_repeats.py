import hashlib
import random

import pytest

from cohortlens.llm.repeats import Rules, RunIndex, contexts, remove_repeats

SMALL = Rules(size=20, gram=8, hot=5, bucket=4, bits=20, chunk=50, segment_bytes=1 << 8)


def brute(docs, size):
    """By id (None first): documents of one id are one document."""
    key = lambda d: -(1 << 63) if d is None else d
    first = {}
    for doc, text in docs:
        data = (text or "").encode()
        for s in range(len(data) - size + 1):
            w, at = data[s : s + size], (key(doc), s)
            if w not in first or at < first[w]:
                first[w] = at
    out = []
    for doc, text in docs:
        data = (text or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - size + 1):
            if first[data[s : s + size]] < (key(doc), s):
                gone[s : s + size] = [True] * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(docs, rules):
    return sorted((tuple(r) for r in remove_repeats(docs, rules=rules).collect()), key=repr)


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 25))) for _ in range(4)]
    docs = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(1, 15))) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        docs.append((rng.randrange(100) if i % 9 == 0 else 1000 - i, " ".join(parts)))
    ids = {}
    docs = [d for d in docs if ids.setdefault(d[0], d) is d]
    return docs + [(5000 + i, docs[3][1]) for i in range(3)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(make, seed):
    docs = corpus(seed)
    assert found(make(docs), SMALL) == brute(docs, 20)


def test_contract_size_on_documents_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(docs, Rules()) == brute(pairs, 100)


def test_passage_in_very_many_documents(make):
    rng = random.Random(9)
    noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(60))
    passage = noise() + noise()
    docs = [(i, noise() + passage + noise()) for i in range(40)]
    assert found(make(docs), SMALL) == brute(docs, 20)


def test_runs_of_one_byte_and_periods(make):
    docs = [(1, "a" * 300), (2, "ab" * 100), (3, "b" + "ab" * 60), (4, "x" * 19), (5, "x" * 20), (6, "x" * 21), (7, "x" * 22)]
    assert found(make(docs), SMALL) == brute(docs, 20)


def test_odd_rows(make, odd):
    docs = odd + [(None, "q" * 10 + "rstuvwxyz" * 5), (None, "zz"), (20, "q" * 10 + "rstuvwxyz" * 5), (20, "q" * 10 + "rstuvwxyz" * 5)]
    assert found(make(docs), SMALL) == brute(docs, 20)
    assert remove_repeats(make([]), rules=SMALL).count() == 0
    row = remove_repeats(make([(1, "abc")]), rules=SMALL, keep_bytes=True).first()
    assert bytes(row["kept"]) == b"abc"


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_texts_that_share_an_id(make, parts):
    """Marks of one text stay off the other texts of its id, whatever the order of the rows."""
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    x, y, z = noise(300), noise(300), noise(120)
    docs = [(1, x), (2, x), (2, y), (2, x), (3, y[50:200] + z), (3, z + y[100:250]), (None, z), (None, noise(40) + z), (4, x[:150] + noise(30) + y[:150])]
    for seed in range(3):
        random.Random(seed).shuffle(docs)
        assert found(make(docs, parts), SMALL) == brute(docs, 20)
    assert {r[2] for r in found(make([(1, x), (2, x), (2, y)], parts), SMALL) if r[0] == 2} == {0, 300}


def test_contexts_cover_every_window_once():
    rng = random.Random(4)
    data = bytes(rng.choice(b"abcd") for _ in range(3000))
    _, place, first, last = contexts(data, SMALL)
    assert first[0] == 0 and last[-1] == len(data) - 20 and (first[1:] == last[:-1] + 1).all()
    assert (place >= last).all() and (place + 8 <= first + 20).all()


def test_index_is_run_compressed_and_finds_the_first_holder():
    rng = random.Random(6)
    base = bytes(rng.choice(b"abcd") for _ in range(120))
    strings = [base] + [base[:60] + bytes([65 + i]) + base[60:] for i in range(30)]
    index = RunIndex(strings, 20)
    assert index.runs < index.rows / 5
    marked = {(int(s), int(p)) for who, at in index.earlier() for s, p in zip(who, at, strict=True)}
    want = {
        (i, p)
        for i, s in enumerate(strings)
        for p in range(len(s) - 19)
        if any(s[p : p + 20] in t for t in strings[:i])
    }
    assert marked == want
