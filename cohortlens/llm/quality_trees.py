"""Quality classifier: histogram gradient-boosted trees over document statistics, walked as flat arrays.

1. One pass over the texts computes STATISTICS of each document, whole texts always, and writes them beside the ids: a few dozen small numbers
   instead of a text, so nothing after that touches texts again.
2. Labelled rows are learned from unless crc32(doc_id as text) mod 3 is 1. Where there are more than `Settings.most_rows` of them, those with
   the smallest hashes of doc_id are taken, by a threshold on the hash that leaves about as many: the one documented bound of this operator.
   Only these rows' statistics come to the driver (at most some 20 MB).
3. Trees are grown level by level: statistics are put into at most `bins` quantile bins, gradients and hessians of the logistic loss are summed
   by (node, statistic, bin) in one histogram, and the split with the best gain is taken. All trees have the same depth, so the model is
   three arrays: statistic and threshold of each inner node in heap order, value of each leaf.
4. Tasks score blocks of documents: all trees of all documents step down one level at a time, by array lookups.

The score is the logistic function of the summed leaves, 0 to 1. Nothing but the text decides it: labels, language, source and id are not looked at.

Defined results: every row has a row, repeated ids too. Null and empty texts have all statistics 0 and get the score of these. A row without an
id is not held out and not learned from. Labels other than 0 and 1, without an id or without a document are ignored; a document with
several labels counts once for each. Without labels every score is 0.5. Columns other than those named are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import columns_of, map_rows, stage, texts_of

STATISTICS = (
    "words_log", "word_length", "word_length_most", "words_distinct", "word_top_share", "words_as_before", "words_repeated",
    "upper_share", "words_upper_first", "words_all_upper", "digit_share", "symbol_share", "bar_words", "words_symbol_end", "words_shout_end",
    "punctuation_share", "comma_share", "sentence_length", "beyond_ascii", "control_share", "byte_entropy",
    "lines_log", "line_words", "lines_repeated", "lines_ended", "lines_blank", "links", "at_signs",
)
N = len(STATISTICS)

_SYMBOLS = np.frombuffer(b"#*$%&|<>~^=_+\\{}[]@", np.uint8)
_ENDS = np.frombuffer(b".!?", np.uint8)
_OTHERS = np.frombuffer(b",.;:!?\"'()-", np.uint8)
_LINK = re.compile(rb"https?://|www\.")
_SYMBOL_END = re.compile(rb"[#*$%&|<>~^=_+\\]+(?:[ \t\n\x0b\x0c\r]|\Z)")
_ENDED = (b".", b"!", b"?", b":", b'"', b")")


@dataclass(frozen=True)
class Settings:
    """What is learned and how. most_rows bounds the labelled rows that are learned from, whatever the input."""

    most_rows: int = 60_000
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    ridge: float = 2.0
    least_weight: float = 2.0
    folds: int = 3
    held_out_fold: int = 1


def statistics(data: bytes) -> list[float]:
    """STATISTICS of one text."""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * N
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = len(data)
    share = count[count > 0] / size
    own: dict[bytes, int] = {}
    for w in words:
        own[w] = own.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    before = sum(a == b for a, b in zip(words, words[1:]))
    windows = len(set(zip(words, words[1:], words[2:])))
    lines = data.split(b"\n")
    full = [x for x in (line.strip() for line in lines) if x]
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    sentences = int(count[_ENDS].sum())
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float(np.log1p(lengths.max())),
        len(own) / n**0.7,
        max(own.values()) / n,
        before / n,
        1 - windows / max(1, n - 2) if n > 2 else 0.0,
        float(count[65:91].sum()) / letters,
        sum(w[:1].isupper() for w in words) / n,
        sum(w.isupper() for w in words) / n,
        float(count[48:58].sum()) / size,
        float(count[_SYMBOLS].sum()) / size,
        sum(c * (w in (b"|", b"*", b">", b"-")) for w, c in own.items()) / n,
        len(_SYMBOL_END.findall(data)) / n,
        data.count(b"!!") / n,
        float(count[_OTHERS].sum()) / size,
        float(count[44]) / n,
        n / (sentences + 1),
        float(count[128:].sum()) / size,
        float(count[:9].sum() + count[14:32].sum() + count[127]) / size,
        float(-(share * np.log2(share)).sum()),
        float(np.log1p(len(lines))),
        n / max(1, len(full)),
        1 - len(set(full)) / max(1, len(full)),
        sum(x.endswith(_ENDED) for x in full) / max(1, len(full)),
        1 - len(full) / len(lines),
        len(_LINK.findall(data)) / n,
        float(count[64]) / n,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, x array<float>), one row a document."""

    def run(batches):
        for batch in batches:
            table = [statistics(data) for data in texts_of(batch)]
            x = pa.array(np.array(table, np.float32).reshape(-1), pa.float32())
            ends = pa.array(np.arange(0, N * len(table) + 1, N, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, x)], ["doc_id", "x"])

    return map_rows(columns_of(docs, id_col, text_col), run, "doc_id long, x array<float>")


@dataclass
class Trees:
    """A model as flat arrays; node i's children are 2i + 1 and 2i + 2, and going right means statistic > threshold."""

    base: float
    statistic: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2^depth

    def raw(self, x: np.ndarray) -> np.ndarray:
        n_trees, inner = self.statistic.shape
        total = np.full(len(x), self.base)
        if not n_trees:
            return total
        rows, trees = np.arange(len(x))[:, None], np.arange(n_trees)[None, :]
        node = np.zeros((len(x), n_trees), np.int64)
        for _ in range(inner.bit_length()):
            node = 2 * node + 1 + (x[rows, self.statistic[trees, node]] > self.threshold[trees, node])
        return total + self.leaf[trees, node - inner].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.raw(x))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def fit(x: np.ndarray, y: np.ndarray, how: Settings = Settings()) -> Trees:
    """Boosted trees of rows x statistics `x` for labels `y` in {0, 1}."""
    inner, leaves = (1 << how.depth) - 1, 1 << how.depth
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if not len(y):
        return Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    # Thresholds of each statistic: its quantiles, which are values of rows; a bin ends at its threshold.
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, how.bins) / how.bins, method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    cell = binned + how.bins * np.arange(x.shape[1])[None, :]
    width = how.bins * x.shape[1]
    raw = np.full(len(y), base)
    statistic, threshold, leaf = [], [], []
    for _ in range(how.trees):
        p = logistic(raw)
        g, h = p - y, p * (1 - p)
        own_s, own_t = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        node = np.zeros(len(y), np.int64)
        for level in range(how.depth):
            first, n = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * width + cell).reshape(-1)
            sums = [
                np.bincount(at, np.repeat(v, x.shape[1]), minlength=n * width).reshape(n, x.shape[1], how.bins).cumsum(axis=2) for v in (g, h)
            ]
            gl, hl = sums
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + how.ridge) + (gt - gl) ** 2 / (ht - hl + how.ridge) - gt**2 / (ht + how.ridge)
            gain[(hl < how.least_weight) | (ht - hl < how.least_weight)] = 0
            best = gain.reshape(n, -1).argmax(axis=1)
            for i, b in enumerate(best):
                j, k = divmod(int(b), how.bins)
                if gain[i, j, k] > 1e-9 and k < len(edges[j]):
                    own_s[first + i], own_t[first + i] = j, edges[j][k]
            node = 2 * node + 1 + (x[np.arange(len(y)), own_s[node]] > own_t[node])
        down = node - inner
        value = -how.rate * np.bincount(down, g, leaves) / (np.bincount(down, h, leaves) + how.ridge)
        raw += value[down]
        statistic.append(own_s)
        threshold.append(own_t)
        leaf.append(value)
    return Trees(base, np.array(statistic), np.array(threshold), np.array(leaf))


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def learn(found: DataFrame, labels: DataFrame, how: Settings = Settings()) -> Trees:
    """Trees from the statistics (doc_id, x) of the labelled rows outside the held-out fold."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & (fold(F.col("doc_id"), how.folds) != how.held_out_fold)
    )
    n = usable.count()
    # A threshold on 30 hash bits: the same rows whatever the partitions.
    least = (1 << 30) if n <= how.most_rows else (how.most_rows << 30) // n
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < least)
    rows = found.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "x").toArrow()
    y = rows["y"].to_numpy().astype(np.float64)
    x = np.array(rows["x"].to_pylist(), np.float32).reshape(len(y), N)
    # One order of rows, so that sums and hence trees don't depend on the partitions.
    order = np.lexsort((*x.T, y, rows["doc_id"].to_numpy()))
    return fit(x[order], y[order], how)


def score_statistics(found: DataFrame, trees: Trees, how: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) from (doc_id, x)."""
    shared = found.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, N)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(x))], ["doc_id", "score"])

    scored = map_rows(found.select("doc_id", "x"), run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), how.folds) == how.held_out_fold, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from `labels` (doc_id, quality)."""
    found = stage(document_statistics(docs, id_col, text_col), "statistics")
    return score_statistics(found, learn(found, labels, how), how)
