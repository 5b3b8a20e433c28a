import random

from pyspark.sql import types as T

from cohortlens.llm.decontaminate import NUMBERS, UNITS, Rules, consistent_windows, contaminated

ITEM = "Alice bought 3 kg of apples for 12 dollars, and Bob paid 5 dollars for 2 kg of pears; how much did Alice spend on each of her 3 kg?"
OTHER = "A plain question about the history of the old stone bridge that crosses the river near the mill, built long ago by monks."
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("window", T.StringType())])


def filler(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "and", "river", "stone", "walked", "quickly", "under", "green", f"w{rng.randrange(500)}"]) for _ in range(n))


def run(spark, make, docs, items, rules=Rules()):
    table = spark.createDataFrame([(i, t, "w") for i, t in items], ITEMS)
    return {(r["doc_id"], r["item_id"]): r for r in contaminated(make(docs), table, rules).collect()}


def test_copies_and_new_parameters_are_found(spark, make):
    renamed = ITEM.replace("Alice", "Maria").replace("Bob", "Kevin").replace(" 3 ", " 7 ").replace("12", "40").replace(" 5 ", " 9 ").replace(" 2 ", " 4 ")
    mixed = ITEM.replace("3 kg of", "7 kg of")  # the same number stands for two values
    docs = [
        (1, filler(1) + ". " + ITEM + " " + filler(2)),
        (2, filler(3) + ". " + renamed + " " + filler(4)),
        (3, filler(5)),
        (4, filler(6) + ". " + ITEM.lower().replace(",", "") + " " + filler(7)),
        (5, OTHER),
        (6, filler(8) + " history of the old stone bridge " + filler(9)),
        (7, filler(10) + ". " + ITEM.replace("3 kg", "3kg") + " " + filler(11)),
    ]
    found = run(spark, make, docs, [(10, ITEM), (11, OTHER), (12, ""), (13, None), (None, OTHER)])
    assert set(found) == {(1, 10), (2, 10), (4, 10), (5, 11), (7, 10)}
    assert found[(2, 10)]["reparameterised"] and not found[(1, 10)]["reparameterised"]
    assert found[(5, 11)]["n_matched"] == found[(5, 11)]["n_windows"]
    assert not run(spark, make, [(1, mixed)], [(10, ITEM)], Rules(coverage=0.9))


def test_slot_consistency():
    match = lambda i, a, b: {"doc_at": 100 + i, "item_at": i, "item_slots": a, "doc_slots": b}
    assert consistent_windows([match(0, ["3"], ["7"]), match(1, ["3"], ["7"]), match(2, [], [])]) == {0, 1, 2}
    assert consistent_windows([match(0, ["3"], ["7"]), match(1, ["3"], ["8"]), match(2, [], [])]) == {2}
    assert consistent_windows([match(0, ["3"], ["7"]), match(1, ["3"], ["8"]) | {"doc_at": 500}]) == {0, 1}


def test_short_items_have_a_window_of_their_own(spark, make):
    found = run(spark, make, [(1, "So they say: Four legs good, indeed."), (2, "four good legs")], [(5, "four legs good")])
    assert set(found) == {(1, 5)}


def test_hot_passage_and_repeated_rows(spark, make):
    docs = [(i, filler(i) + ". " + OTHER) for i in range(60)] + [(3, filler(3) + ". " + OTHER)]
    found = run(spark, make, docs, [(11, OTHER), (11, OTHER)])
    assert set(found) == {(i, 11) for i in range(60)}


def test_odd_rows(spark, make, odd):
    assert run(spark, make, odd + [(None, OTHER)], [(11, OTHER)]) == {}
    assert run(spark, make, [], [(11, OTHER)]) == {}
    assert run(spark, make, [(1, OTHER)], []) == {}
    long = filler(1, 60_000) + ". " + OTHER
    assert set(run(spark, make, [(1, long)], [(11, OTHER)])) == {(1, 11)}


def test_planted_items_of_the_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "benchmark"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {(d, r["item_id"]) for r in items.collect() for d, t in texts.items() if r["text"] in t}
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()}
    assert want <= found


def test_names_at_the_start_of_each_sentence(spark, make):
    item = "Tom has 3 pens. Ann has 4 pens. Sue has 5 pens. Who has the most pens?"
    renamed = "Jim has 6 pens. Eva has 8 pens. Kay has 9 pens. Who has the most pens?"
    spelled = "Jim has six pens. Eva has eight pens. Kay has twenty-one pens. Who has the most pens?"
    mixed = "Jim has 6 pens. Eva has 6 cups. The 2 of us have 9 pens. Who has the most cups?"
    docs = [(i, filler(i) + ". " + x + " " + filler(10 + i)) for i, x in enumerate((item, renamed, spelled, mixed, OTHER))]
    found = run(spark, make, docs, [(10, item)])
    assert set(found) == {(0, 10), (1, 10), (2, 10)}
    assert found[(1, 10)]["reparameterised"] and found[(1, 10)]["n_matched"] == found[(1, 10)]["n_windows"]


def test_items_of_numbers_and_units_are_found_as_copies(spark, make):
    sums, short = "12 + 30 * 4 = 132", "5 kg"
    long = "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24"
    docs = [(1, filler(1) + ". " + sums + ". " + filler(2)), (2, "12 + 30 * 5 = 162"), (3, "a box of 5 kg"), (4, "so " + long), (5, filler(3)), (6, long.replace("12", "99"))]
    found = run(spark, make, docs, [(20, sums), (21, short), (22, long), (23, "+ - *")])
    assert set(found) == {(1, 20), (4, 22), (6, 22)}
    assert not any(r["reparameterised"] for r in found.values())
    assert found[(4, 22)]["n_matched"] == found[(4, 22)]["n_windows"] == 19 and found[(6, 22)]["n_matched"] == 13


def _words(text):
    """(plain word, slot type or None, whether capitalised, whether it opens a sentence), by the words of the docstring."""
    out, opens = [], True
    strip = "!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~"
    for raw in text.split():
        word = raw.strip(strip).lower()
        if word:
            kind = "number" if word[0].isdigit() or word in NUMBERS.split() else "unit" if word in UNITS.split() else None
            out.append((word, kind, kind is None and raw.lstrip(strip)[0].isupper(), opens))
        opens = raw.endswith((".", "!", "?", ":"))
    return out


def _templates(words, width, rules):
    """{(place, variant): (template, slot values)}"""
    out = {}
    for i in range(len(words) - width + 1):
        part = words[i : i + width]
        for variant in ("names", "wide", "plain"):
            def slot(w):
                word, kind, capital, opens = w
                return kind or ("name" if capital and (variant == "wide" or variant == "names" and not opens) else None)
            if variant == "wide" and not any(c and o for _, _, c, o in part):
                continue
            slots = [slot(w) for w in part]
            if slots.count(None) >= min(rules.literals, width):
                template = tuple(k and "<" + k + ">" or w[0] for w, k in zip(part, slots))
                out[i, variant] = template, tuple(w[0] for w, k in zip(part, slots) if k)
    return out


def _brute(docs, items, rules):
    found = set()
    for item, text in items:
        words = _words(text)
        width = min(rules.width, len(words))
        mine = _templates(words, width, rules)
        for doc, body in docs:
            theirs = _templates(_words(body), width, rules)
            matches = {
                (d - i, i, d, a, b, "wide" in (v, w))
                for (i, v), (x, a) in mine.items()
                for (d, w), (y, b) in theirs.items()
                if x == y
            }
            good, taken = set(), set()
            diagonals = {}
            for m in matches:
                diagonals.setdefault(m[0], []).append(m)
            for _, group in sorted(diagonals.items(), key=lambda g: (-len({m[1] for m in g[1]}), g[0])):
                for some in ([m for m in group if not m[5]], group):
                    values = {}
                    for _, _, _, a, b, _ in some:
                        for x, y in zip(a, b):
                            values.setdefault(x, set()).add(y)
                    good |= {i for _, i, d, a, _, wide in some if all(len(values[x]) == 1 for x in a) and not (wide and d in taken)}
                taken |= {d for _, i, d, _, _, wide in group if wide and i in good}
            if good and len(good) >= rules.coverage * len({i for i, _ in mine}):
                found.add((doc, item, len(good)))
    return found


def test_equals_a_brute_force_matcher(spark, make):
    rng = random.Random(11)
    names, nouns = ["Ann", "Bob", "Eva", "Tom"], ["pens", "cups", "of", "and", "sells", "has", "box", "the"]

    def sentence():
        return " ".join([rng.choice(names), *(rng.choice([rng.choice(nouns), rng.choice(nouns), str(rng.randrange(9)), "kg", rng.choice(names)]) for _ in range(7))]) + "."

    items = [(i, " ".join(sentence() for _ in range(rng.choice([1, 2, 3])))) for i in range(12)]

    def changed(text):
        swap = dict(zip(names, rng.sample(names, 4))) | dict(zip("012345678", rng.sample("012345678", 9)))
        return " ".join(w if rng.random() < 0.03 else swap.get(w.strip("."), w.strip(".")) + "." * w.endswith(".") for w in text.split())

    docs = [(i, " ".join([sentence(), changed(items[i % 12][1]), sentence(), *([items[(i * 5) % 12][1]] if i % 3 == 0 else [])])) for i in range(40)]
    for rules in (Rules(), Rules(width=4, coverage=0.3), Rules(width=5, coverage=0.9)):
        found = {(d, i, r["n_matched"]) for (d, i), r in run(spark, make, docs, items, rules).items()}
        assert found == _brute(docs, items, rules) and len(found) > 20
