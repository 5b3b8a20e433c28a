import re

from cohortlens.llm.quality_rules import Rules, clean, judge, keep_clean, line_fails, repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """The counts of the contract, from the text as characters."""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + o for i, w in enumerate(windows) if windows.count(w) > 1 for o in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), n < 50 or 100 * len(marked) > 50 * n


TEXTS = [
    "",
    "one",
    "a a a a a a",
    "a b c a b c a b c x",
    "x y\nx y\n\n \nx y",
    "été # * $ x%y <b>|",
    "word " * 60,
    " ".join(f"w{i}" for i in range(80)) + ".",
    "a\x1fb c d e",
]


def test_counts_equal_brute_force():
    for text in TEXTS:
        n, chars, symbols, dup, repeat, _, _, failed, _, _ = judge(text.encode())
        assert (n, chars, symbols, dup, repeat, failed) == brute(text), text


def test_lines():
    fails = lambda line: line_fails(line.encode(), line.encode().split())
    assert fails("All rights reserved by nobody in particular.")
    assert fails("Home | News | Sport | Weather")
    assert fails("one*** two### three&&& four")
    assert fails("EVERY!! WORD!! IS!! LOUD!!")
    assert fails("Next page")
    assert not fails("Next page.")
    assert not fails("A line of some length that is only cut off in the")
    assert not fails("Prices rose by 3% & fell again over the following months of the year, they said.")


def test_documents_that_lose_too_much_are_rejected(make):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    bad = " | ".join(f"item{i}" for i in range(70))
    rows = {r["doc_id"]: r for r in clean(make([(1, good), (2, bad), (3, good + "\n" + "Next page"), (4, bad + "\n" + good)])).collect()}
    assert rows[1]["kept"] and rows[1]["text"] == good
    assert not rows[2]["kept"] and not rows[2]["base_failed"]
    assert rows[3]["kept"] and rows[3]["text"] == good and rows[3]["n_words_lost"] == 2
    assert not rows[4]["kept"]


def test_odd_rows(make, odd):
    done = clean(make(odd)).collect()
    assert len(done) == len(odd)
    assert all(r["base_failed"] and not r["kept"] for r in done)
    assert clean(make([])).count() == 0


def test_stage_keeps_all_columns(make):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    docs = make([(1, good + "\nNext page"), (2, None), (3, "short")])
    done = keep_clean(docs)
    assert done.columns == docs.columns
    rows = done.collect()
    assert [(r["doc_id"], r["text"], r["n_chars"], r["key"]) for r in rows] == [(1, good, len(good), "k")]


def test_repeated_words_of_overlapping_windows():
    assert repeated_words(b"a a a a".split()) == 4
    assert repeated_words(b"a b c d".split()) == 0
    assert Rules().lost_percent == 50
