"""Quality rules, line first: bad lines are removed, then documents that lose too much text are rejected.

Lines are separated by newline characters. A line without a word is blank: it is kept and counts for nothing. Each other line
fails if one of these holds (thresholds in Rules):

- boilerplate: it contains one of PHRASES, in any case of A-Z;
- navigation: at least `bars` separators standing alone (`|`, `>`, `»`, `*`), or words joined by them;
- symbols: more than `symbol_percent` characters of [#*$%&|<>] for 100 words;
- shouting: more than `shout_percent` of its words end in `!!`;
- punctuation: it has under `short_words` words and doesn't end in sentence punctuation or a closing mark.

A document is rejected if it fails the base (under 50 words, or more than half of its words in repeated three-word windows)
or if over `lost_percent` of its words stood in failed lines.

Null or empty texts have no words and fail the base. Every input row gives one row, repeated rows and null ids included.
Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import columns_of, map_rows, texts_of

#: Phrases that mark a line as boilerplate.
PHRASES = (
    "all rights reserved",
    "licensed under",
    "privacy policy",
    "terms of service",
    "terms of use",
    "cookie policy",
    "accept cookies",
    "use cookies",
    "lorem ipsum",
    "enable javascript",
    "click here",
    "sign up for our newsletter",
    "skip to content",
)
SYMBOLS = b"#*$%&|<>"
#: Last characters of a line that ends properly.
ENDS = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")", "]", "。", "！", "？")


@dataclass(frozen=True)
class Rules:
    bars: int = 3
    symbol_percent: int = 30
    shout_percent: int = 30
    short_words: int = 4
    lost_percent: int = 50
    least_words: int = 50
    repeat_percent: int = 50


_PHRASE = re.compile(b"|".join(re.escape(p.encode()) for p in PHRASES))
_ENDS = tuple(x.encode() for x in ENDS)
_BARS = {b"|", b">", "»".encode(), b"*"}
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_NOT_CONTINUED = bytes(range(0x80, 0xC0))

RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines_failed long, n_words_lost long, base_failed boolean, kept boolean, text string"
)


def line_fails(line: bytes, words: list[bytes], rules: Rules = Rules()) -> bool:
    n = len(words)
    if _PHRASE.search(line.lower()):
        return True
    if sum(w in _BARS for w in words) >= rules.bars:
        return True
    if 100 * len(line.translate(None, _NOT_SYMBOL)) > rules.symbol_percent * n:
        return True
    if 100 * sum(w.endswith(b"!!") for w in words) > rules.shout_percent * n:
        return True
    return n < rules.short_words and not words[-1].endswith(_ENDS)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count: dict[tuple, int] = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    total, reached = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + 3 - max(i, reached)
            reached = i + 3
    return total


def judge(data: bytes, rules: Rules = Rules()) -> tuple:
    """All result columns after the id, for one text."""
    lines = data.split(b"\n")
    kept, words, seen = [], [], set()
    dup = failed = lost = 0
    for line in lines:
        own = line.split()
        if own:
            dup += line in seen
            seen.add(line)
            words += own
            if line_fails(line, own, rules):
                failed, lost = failed + 1, lost + len(own)
                continue
        kept.append(line)
    n = len(words)
    repeat = repeated_words(words)
    base_failed = n < rules.least_words or 100 * repeat > rules.repeat_percent * n
    stay = not base_failed and 100 * lost <= rules.lost_percent * n
    chars = len(b"".join(words).translate(None, _NOT_CONTINUED))
    symbols = len(data.translate(None, _NOT_SYMBOL))
    return n, chars, symbols, dup, repeat, failed, lost, base_failed, stay, b"\n".join(kept)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document with its counts, the verdict `kept`, and the text without its failed lines.

    Each document is judged alone, so the job is one pass without a shuffle.
    """
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [judge(data, rules) for data in texts_of(batch)]
            cols = [batch.column("doc_id")]
            for i, name in enumerate(names[1:]):
                kind = pa.bool_() if name in ("base_failed", "kept") else pa.binary() if name == "text" else pa.int64()
                cols.append(pa.array([r[i] for r in rows], kind))
            cols[-1] = cols[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return map_rows(columns_of(docs, id_col, text_col), run, RESULT)


def keep_clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, all their columns, with cleaned texts and their n_chars.

    Null texts are rejected. Other columns may have any name; those named text and n_chars are rewritten.
    """

    def run(batches):
        for batch in batches:
            rows = [judge(data, rules) for data in texts_of(batch)]
            stay = pa.array([r[8] for r in rows], pa.bool_())
            text = pa.array([r[9] for r in rows], pa.binary()).cast(pa.string())
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", text).filter(stay)

    done = map_rows(docs, run, docs.schema)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done
