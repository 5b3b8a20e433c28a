"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

Words are taken from whole texts, stripped of punctuation and lower-cased. A word with a digit at its start or of NUMBERS is a number slot, a word of UNITS
a unit slot (5kg counts as both), a capitalised word inside a sentence a name slot. Every run of `width` words gives
two template windows, one with names as slots and one with names as words, so that copies in one case are met, too. A run with a
capitalised word at the start of a sentence gives a third, wide one, in which that is a name slot as well. Windows with
fewer than `literals` plain words say nothing and are left out; an item shorter than `width` is one window of its own length.
An item without any template window (arithmetic, for example) has literal windows instead, in which numbers, units and names are
words as they stand: it is found by copies only. Such an item has words of `shortest` bytes together or is left out, as `5 kg` stands anywhere.

Windows of documents are joined with those of items by hash. A match has a diagonal, its place in the document minus that in the
item. On one diagonal each slot value of the item must stand for one value in the document: 3 may become 7, but everywhere. Windows
of diagonals that break this don't count. Wide windows must agree with all windows of their diagonal; the others are judged
without them, too, so that a sentence that starts otherwise costs no other window. Sentences of one pattern look alike in wide
windows, so a wide window of the document counts on one diagonal only, that with the most matches. A document is contaminated by an item if it matches at least `coverage` of the item's
windows.

Before the join, windows are looked up in a bit table of fixed size that the items' windows set: what is broadcast doesn't grow
with the benchmark, and windows of clean documents never leave their task. A passage that many documents hold is
a hot key of the join; adaptive execution splits it, and matches are gathered per document and item.

Null and empty texts match nothing, nor do items without any window (no words, or too short for literal ones). Rows without an id are not reported. Documents or items
that share an id are one; copies give the same matches. Columns other than ids and texts are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bit_table, columns_of, is_set, map_rows, roll, stage, texts_of

#: Fixed list: units of measure, money and time that count as slots.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds ounce ounces "
    "ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur gbp percent % ° °c °f meter meters metre metres kilometer kilometers kilometre "
    "kilometres centimeter centimeters centimetre centimetres hz khz mhz w kw mw v kv a j kj n pa kpa mol k"
)
#: Fixed list: spelled-out numbers, also joined by hyphens.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
)
_NUMBERS = frozenset(NUMBERS.encode().split())
_UNITS = frozenset(UNITS.encode().split())
#: Bits of the table of item windows: 4 MB.
TABLE_BITS = 25
_GLUED = re.compile(rb"(?<=\d)(?=[A-Za-z%\xc2])")
_STRIP = "!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»…"
_SENTENCE = (b".", b"!", b"?", b":", b'."', b'!"', b'?"')
_CAPITAL, _ENDS, _NUMBER, _UNIT, _SKIP = 1, 2, 4, 8, 16
_SLOT = np.array([0x6E756D62, 0x756E6974, 0x6E616D65], np.uint64)
#: Keeps literal windows apart from templates that happen to have no slot.
_LITERAL = np.uint64(0x6C69746572616C73)
REMEMBERED = 250_000


@dataclass(frozen=True)
class Rules:
    width: int = 6
    literals: int = 2
    coverage: float = 0.4
    shortest: int = 8


class _Words(dict):
    """Word -> row of two arrays: hash of the stripped, lower-cased word, and what kind of word it is."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros(REMEMBERED, np.uint64)
        self.kinds = np.zeros(REMEMBERED, np.uint8)

    def __missing__(self, word: bytes) -> int:
        i = len(self)
        bare = plain(word)
        first = word.decode().lstrip(_STRIP)[:1]
        self.hashes[i] = xxhash.xxh3_64_intdigest(bare)
        kind = _ENDS if word.endswith(_SENTENCE) else 0
        if not bare:
            kind |= _SKIP
        elif bare[:1].isdigit() or _NUMBERS.issuperset(bare.split(b"-")):
            kind |= _NUMBER
        elif bare in _UNITS:
            kind |= _UNIT
        elif first.isupper():
            kind |= _CAPITAL
        self.kinds[i] = kind
        self[word] = i
        return i

    def look(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        hashes, kinds = [], []
        for start in range(0, len(words), 50_000):
            some = words[start : start + 50_000]
            if len(self) + len(some) > REMEMBERED:
                self.clear()
            at = np.fromiter(map(self.__getitem__, some), np.int64, len(some))
            hashes.append(self.hashes[at])
            kinds.append(self.kinds[at])
        return np.concatenate(hashes), np.concatenate(kinds)


def plain(word: bytes) -> bytes:
    return word.decode().strip(_STRIP).lower().encode()


_known: list[_Words] = []


def forget() -> None:
    _known.clear()


def windows(
    data: bytes, widths: list[int], rules: Rules, literal: list[int] = ()
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], int, bool]]:
    """For each width and variant: (hashes, starts among the words, slot mask of all words, words, width, whether they are wide).

    literal: widths of literal windows, which have no slots.
    """
    if not _known:
        _known.append(_Words())
    words = _GLUED.sub(b" ", data).split()
    if not words:
        return []
    hashes, kinds = _known[0].look(words)
    ends = (kinds & _ENDS) > 0
    first = np.concatenate([[True], ends[:-1]])
    stay = (kinds & _SKIP) == 0
    at = np.flatnonzero(stay)
    hashes, kinds, first = hashes[at], kinds[at], first[at]
    number, unit = (kinds & _NUMBER) > 0, (kinds & _UNIT) > 0
    capital = (kinds & _CAPITAL) > 0
    name, opening = capital & ~first, capital & first
    base = np.where(number, _SLOT[0], np.where(unit, _SLOT[1], hashes))
    kept = [words[i] for i in at] if len(at) < len(words) else words
    out = []
    for names, wide in ((name, False), (capital, True), (None, False)):
        if names is not None and not (opening if wide else names).any():
            continue  # the same as another variant
        value = base if names is None else np.where(names, _SLOT[2], base)
        slots = number | unit if names is None else number | unit | names
        before = np.concatenate([[0], np.cumsum(~slots)])
        opened = np.concatenate([[0], np.cumsum(opening)])
        for width in widths:
            n = len(value) - width + 1
            if n > 0:
                rolled = roll(value, width)
                good = before[width:] - before[:n] >= min(rules.literals, width)
                if wide:
                    good &= opened[width:] > opened[:n]
                good = np.flatnonzero(good)
                out.append((rolled[good], good, slots, kept, width, wide))
    for width in literal:
        n = len(hashes) - width + 1
        if n > 0:
            out.append((roll(hashes, width) ^ _LITERAL, np.arange(n), np.zeros(len(hashes), bool), kept, width, False))
    return out


def _slot_values(words: list[bytes], slots: np.ndarray, start: int, width: int) -> list[str]:
    return [plain(words[i]).decode("utf-8", "replace") for i in range(start, start + width) if slots[i]]


def item_windows(items: DataFrame, rules: Rules, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, window, width, item_at, item_slots, n_windows, item_wide, literal)."""
    rows = columns_of(items, id_col, text_col).where("doc_id IS NOT NULL")

    def run(batches):
        for batch in batches:
            out = []
            for item, data in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                words = [w for w in map(plain, _GLUED.sub(b" ", data).split()) if w]
                width = min(rules.width, len(words))
                found = windows(data, [width], rules) if width else []
                literal = not any(len(starts) for _, starts, *_ in found)
                if literal and sum(map(len, words)) >= rules.shortest:
                    found = windows(data, [], rules, [width])
                n = len({int(i) for _, starts, *_ in found for i in starts})
                for hashes, starts, slots, words, _, wide in found:
                    for h, i in zip(hashes.view(np.int64).tolist(), starts.tolist(), strict=True):
                        out.append((item, h, width, i, _slot_values(words, slots, i, width), n, wide, literal))
            yield _rows(out, ["item_id", "window", "width", "item_at", "item_slots", "n_windows", "item_wide", "literal"], 4, (6, 7))

    schema = "item_id long, window long, width long, item_at long, item_slots array<string>, n_windows long, item_wide boolean, literal boolean"
    return map_rows(rows, run, schema, forget)


def _rows(out: list[tuple], names: list[str], text_at: int, flags: tuple[int, ...]) -> pa.RecordBatch:
    kinds = {text_at: pa.list_(pa.string())} | {i: pa.bool_() for i in flags}
    cols = [pa.array([r[i] for r in out], kinds.get(i, pa.int64())) for i in range(len(names))]
    return pa.RecordBatch.from_arrays(cols, names)


def doc_windows(docs: DataFrame, items: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, window, doc_at, doc_slots, doc_wide) of documents, only those whose bit an item set. items: from item_windows."""
    table = bit_table(items.select(F.pmod("window", F.lit(1 << TABLE_BITS))), TABLE_BITS)
    # As many as `width` different ones at most, of each kind.
    kinds = items.select("width", "literal").distinct().collect()
    widths, literal = (sorted(r["width"] for r in kinds if r["literal"] is kind) for kind in (False, True))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    mask = np.uint64((1 << TABLE_BITS) - 1)

    def run(batches):
        table = shared.value
        for batch in batches:
            out = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                for hashes, starts, slots, words, width, wide in windows(data, widths, rules, literal):
                    bits = (hashes & mask).astype(np.int64)
                    hit = np.flatnonzero(is_set(table, bits))
                    for k in hit.tolist():
                        i = int(starts[k])
                        out.append((doc, int(hashes[k].astype(np.int64)), i, _slot_values(words, slots, i, width), wide))
            yield _rows(out, ["doc_id", "window", "doc_at", "doc_slots", "doc_wide"], 3, (4,))

    schema = "doc_id long, window long, doc_at long, doc_slots array<string>, doc_wide boolean"
    return map_rows(docs.where("doc_id IS NOT NULL"), run, schema, forget)


def consistent_windows(matches: list[dict]) -> set[int]:
    """Item windows matched on diagonals where each slot value of the item stands for one value of the document."""
    diagonals: dict[int, list[dict]] = {}
    for m in matches:
        diagonals.setdefault(m["doc_at"] - m["item_at"], []).append(m)
    out: set[int] = set()
    taken: set[int] = set()
    for group in sorted(diagonals.values(), key=lambda g: (-len({m["item_at"] for m in g}), g[0]["doc_at"] - g[0]["item_at"])):
        plain_ones = [m for m in group if not m.get("wide")]
        for some in [group] if len(plain_ones) == len(group) else [plain_ones, group]:
            means: dict[str, set] = {}
            for m in some:
                for a, b in zip(m["item_slots"], m["doc_slots"], strict=False):
                    means.setdefault(a, set()).add(b)
            good = [m for m in some if all(len(means[a]) == 1 for a in m["item_slots"])]
            # Sentences of one pattern look alike in wide windows: one of the document counts for one diagonal.
            out |= {m["item_at"] for m in good if not m.get("wide") or m["doc_at"] not in taken}
        taken |= {m["doc_at"] for m in group if m.get("wide") and m["item_at"] in out}
    return out


def contaminated(
    docs: DataFrame, items: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, reparameterised): one row for each document and item that it contains.

    reparameterised: some slot of the item has another value in the document.
    """
    known = stage(item_windows(items, rules, item_col, item_text), "item-windows")
    hits = doc_windows(columns_of(docs, id_col, text_col), known, rules)
    wide = (F.col("doc_wide") | F.col("item_wide")).alias("wide")
    pairs = (
        hits.join(known.drop("literal"), "window")
        .groupBy("doc_id", "item_id")
        .agg(F.max("n_windows").alias("n_windows"), F.collect_set(F.struct("doc_at", "item_at", "doc_slots", "item_slots", wide)).alias("matches"))
    )

    def judge(batches):
        for batch in batches:
            out = []
            for doc, item, n, matches in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "n_windows", "matches")), strict=True):
                good = consistent_windows(matches)
                if len(good) >= rules.coverage * n and good:
                    changed = any(m["item_slots"] != m["doc_slots"] for m in matches if m["item_at"] in good)
                    out.append((doc, item, len(good), n, changed))
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "n_matched", "n_windows", "reparameterised"])

    return map_rows(pairs, judge, "doc_id long, item_id long, n_matched long, n_windows long, reparameterised boolean")
