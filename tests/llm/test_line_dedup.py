import re

from cohortlens.llm.line_dedup import dedup_lines

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def brute(docs, min_chars, min_docs):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))
    holders = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        gone = lambda x: doc is not None and len(holders.get(key(x), ())) >= min_docs and doc < max(holders[key(x)])
        left = [x for x in lines if not gone(x)]
        out.append((doc, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def found(docs, **rules):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["row"]["text"] or "") for r in dedup_lines(docs, **rules).collect()), key=repr)


def test_equals_brute_force(make, odd):
    long = "This line is shared by many documents, really so."
    accents = "É" * 40
    docs = [(i, f"own {i}\n{long if i % 2 else '  ' + long.upper() + chr(11)}\nx\n{long}\n" + ("\n" + accents if i % 3 else "\né" * 50)) for i in range(20, 40)]
    docs += [(50, long), (50, "other text\n" + long), (None, long), (3, "short\nshort"), (4, "short\n"), (5, "\n\n")]
    docs += odd
    assert found(make(docs)) == brute(docs, 40, 5)
    assert found(make(docs), min_chars=1, min_docs=2) == brute(docs, 1, 2)


def test_threshold_and_keeper(make):
    line = "x" * 40
    docs = [(i, line) for i in range(5)]
    assert [r[2] for r in found(make(docs))] == [1, 1, 1, 1, 0]
    assert all(r[2] == 0 for r in found(make(docs[:4])))
    assert all(r[2] == 0 for r in found(make([(i, "x" * 39) for i in range(9)])))


def test_input_columns_come_back_and_empty_table(make):
    docs = make([(1, "a\nb")])
    row = dedup_lines(docs).first()
    assert row["row"].asDict() == docs.first().asDict()
    assert dedup_lines(make([])).count() == 0
