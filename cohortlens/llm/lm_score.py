"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Tokens of a text are its words (A-Z lower-cased, split at ASCII white space) and one end mark. Bigrams and unigrams of the training
documents are counted over the whole corpus. A count c has the level 1 + floor(log c / log base); an n-gram of level q is put
into a Bloom filter q times, as (n-gram, 1) to (n-gram, q). To look it up, levels are probed upwards until one is missing, and the last
one found stands for the mean count of its level. Filters err upwards only, and rarely by more than one level.

The probability of w after v interpolates the two: weight(v) * c(v w) / c(v) + (1 - weight(v)) * (c(w) + 1) / (N + V + 1). The weight belongs to the
level of c(v). It is the one that makes the training text most probable when the token at hand is taken out of the counts; a pass over all training
documents gathers what is needed as a small table. An unseen context has weight 0.

Filters are as large as their counts need and hold every n-gram. They are broadcast in slices of the hash space of a fixed size. A task
holds one slice at a time: it looks up the n-grams of many texts at once, sorted, slice by slice. So neither a task nor the driver
holds more than a slice of each filter, whatever the corpus.

The levels of a document's tokens are written once; the weights are fitted on them and the scores summed from them.

The base score needs exact unigram counts: the most frequent words (at most `frequent`) are broadcast with their counts, all other
words of a document are joined with theirs.

Counting moves packed runs of sorted hashes, one for each map chunk and segment of the hash space; the number of
segments follows the input, so a group stays bounded.

Null and empty texts have the end mark only. Rows without an id are training documents. Every input row gives one row. An empty training set gives
c = N = V = 0 everywhere.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import columns_of, hashed_words, is_set, map_rows, mixed, pack, pack_sorted, segment_bounds, stage, texts_of, unpack, unpack_sorted

END = np.uint64(0x5E9D_0E4D_0E4D_5E9D)
START = np.uint64(0x57A2_757A_2757_A275)
_NEXT = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bigram hashes lose their low bits, which halves what is moved.
_SHORT = np.uint64(0xFFFF_FFFF_FFFF_0000)


@dataclass(frozen=True)
class Rules:
    base: float = 1.5
    probes: int = 3
    #: log2 of the most bits of a slice of the filters: 16 MB and 32 MB. Smaller inputs take as many as they need.
    unigram_bits: int = 27
    bigram_bits: int = 28
    #: Words whose exact counts are broadcast: 16 MB.
    frequent: int = 1 << 20
    #: Tokens counted in memory before they are handed on.
    chunk: int = 3_000_000
    #: Bytes of text for each segment of the hash space.
    segment_bytes: int = 1 << 24
    #: Bytes of text that are looked up at once when a filter has several slices.
    lookup_bytes: int = 1 << 22


LEVELS = 64  # more than any count below 2^63 / base 1.5 needs up to 10^11


def level_of(counts: np.ndarray, base: float) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(counts) / np.log(base) + 1e-9), LEVELS - 1).astype(np.int64)


def level_means(base: float) -> np.ndarray:
    """Mean of the counts of each level; 0 for level 0."""
    out = np.zeros(LEVELS)
    for q in range(1, LEVELS):
        low, high = np.ceil(base ** (q - 1) - 1e-9), np.ceil(base**q - 1e-9) - 1
        out[q] = (low + max(low, high)) / 2
    return out


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, contexts, ends): hashes of all tokens with each text's end mark, and of the token before each."""
    words, ends = hashed_words(texts)
    k = np.arange(1, len(texts) + 1)
    tokens = np.empty(len(words) + len(texts), np.uint64)
    ends = ends + k
    is_end = np.zeros(len(tokens), bool)
    is_end[ends - 1] = True
    tokens[is_end] = END
    tokens[~is_end] = words
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate([[0], ends[:-1]]).astype(np.int64)] = START
    return tokens, before, ends


def bigrams_of(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mixed(before * _NEXT + tokens) & _SHORT


def count_ngrams(docs: DataFrame, rules: Rules, log2: int) -> DataFrame:
    """(n, segment, types, total, keys, counts, levels): one row for each order and segment. docs: text of training documents."""

    def flush(n: int, held: list[np.ndarray]):
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        bounds = segment_bounds(values, log2)
        rows = [(n, s, pack_sorted(values[a:b]), pack(counts[a:b])) for s, (a, b) in enumerate(itertools.pairwise(bounds)) if b > a]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(cols, ["n", "segment", "keys", "counts"])

    def run(batches):
        one, two, size = [], [], 0
        for batch in batches:
            tokens, before, _ = tokens_of(texts_of(batch))
            one.append(tokens)
            two.append(bigrams_of(before, tokens))
            size += len(tokens)
            if size >= rules.chunk:
                yield flush(1, one)
                yield flush(2, two)
                one, two, size = [], [], 0
        if size:
            yield flush(1, one)
            yield flush(2, two)

    def merge(key, table):
        keys = np.concatenate([unpack_sorted(x) for x in table["keys"].to_pylist()])
        counts = np.concatenate([unpack(x) for x in table["counts"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        levels = np.bincount(level_of(counts, rules.base), minlength=LEVELS)
        return pa.table(
            {
                "n": pa.array([key[0].as_py()], pa.int32()),
                "segment": pa.array([key[1].as_py()], pa.int64()),
                "types": pa.array([len(keys)], pa.int64()),
                "total": pa.array([int(counts.sum())], pa.int64()),
                "keys": pa.array([pack_sorted(keys)], pa.binary()),
                "counts": pa.array([pack(counts)], pa.binary()),
                "levels": pa.array([levels.tolist()], pa.list_(pa.int64())),
            }
        )

    chunks = map_rows(docs.select("text"), run, "n int, segment long, keys binary, counts binary")
    schema = "n int, segment long, types long, total long, keys binary, counts binary, levels array<long>"
    return chunks.groupBy("n", "segment").applyInArrow(merge, schema)


class Filter:
    """A log-frequency Bloom filter of fixed size, in regions by the top bits of the hash."""

    def __init__(self, table: np.ndarray, bits: int, log2: int, rules: Rules, least: int):
        self.table, self.bits, self.log2, self.probes, self.least = table, bits, log2, rules.probes, least
        self.means = level_means(rules.base)

    @staticmethod
    def place(keys: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
        """Bit of one probe inside a region of 2**bits bits."""
        y = mixed(mixed(keys) + np.uint64(level * int(_NEXT) % (1 << 64)))
        y = (y & np.uint64(0xFFFFFFFF)) + np.uint64(probe) * ((y >> np.uint64(32)) | np.uint64(1))
        return (y & np.uint64((1 << bits) - 1)).astype(np.int64)

    @classmethod
    def region(cls, keys: np.ndarray, counts: np.ndarray, bits: int, rules: Rules, least: int) -> bytes:
        """The bits of one region; n-grams below level `least` are left out, and levels below it are implied."""
        flags = np.zeros(1 << bits, bool)
        levels = level_of(counts, rules.base)
        for q in range(least, int(levels.max(initial=0)) + 1):
            own = keys[levels >= q]
            for probe in range(rules.probes):
                flags[cls.place(own, q, probe, bits)] = True
        return np.packbits(flags, bitorder="little").tobytes()

    def level(self, keys: np.ndarray, skip: int = 0) -> np.ndarray:
        """Level of each key, 0 if it is not there. skip: top bits that chose this filter as a slice of a larger one."""
        inside = self.bits - self.log2
        region = (keys << np.uint64(skip) >> np.uint64(64 - self.log2)).astype(np.int64) << inside if self.log2 else np.zeros(len(keys), np.int64)
        out = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        for q in range(self.least, LEVELS):
            for probe in range(self.probes):
                live = live[is_set(self.table, region[live] + self.place(keys[live], q, probe, inside))]
            if not len(live):
                break
            out[live] = q
        return out


def bits_needed(merged: DataFrame, n: int, log2: int, rules: Rules) -> int:
    """log2 of the bits that leave at most half of them set when all n-grams are in."""
    rows = merged.where(F.col("n") == n).select(F.posexplode("levels").alias("q", "types")).groupBy("q").agg(F.sum("types").alias("types")).collect()
    # An n-gram of level q has q entries; at half of the bits set, ln 2 * bits probes have been put in.
    needed = rules.probes * sum(r["types"] * r["q"] for r in rows) / 0.69
    return max(log2 + 6, int(needed).bit_length())


class Slices:
    """A filter in slices by the top bits of the hash, each broadcast on its own."""

    def __init__(self, slices: list, log2: int):
        self.slices, self.log2 = slices, log2

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Level of each of the sorted keys, 0 if it is not there."""
        bounds = segment_bounds(keys, self.log2)
        out = np.zeros(len(keys), np.int64)
        for shared, (a, b) in zip(self.slices, itertools.pairwise(bounds), strict=True):
            if b > a:
                out[a:b] = shared.value.level(keys[a:b], self.log2)
                if len(self.slices) > 1:
                    vars(shared).pop("_value", None)  # a worker would keep each slice that it has read
        return out


def build_filter(merged: DataFrame, n: int, log2: int, most: int, rules: Rules) -> Slices:
    """Regions are built in tasks and put together on the driver, a slice of 2**most bits at a time."""
    bits = bits_needed(merged, n, log2, rules)
    # A slice is a region at least.
    cut = min(max(0, bits - most), log2)
    inside, own = bits - log2, log2 - cut

    def run(batches):
        for batch in batches:
            out = []
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                out.append(Filter.region(unpack_sorted(keys), unpack(counts), inside, rules, 1))
            yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(out, pa.binary())], ["segment", "bits"])

    rows = merged.where(F.col("n") == n).select("segment", "keys", "counts")
    size = 1 << (inside - 3)
    slices = []
    for i in range(1 << cut):
        table = np.zeros(size << own, np.uint8)
        regions = rows.where(F.col("segment").between(i << own, (i + 1 << own) - 1))
        for row in map_rows(regions, run, "segment long, bits binary").toLocalIterator():
            at = row["segment"] - (i << own)
            table[at * size : (at + 1) * size] = np.frombuffer(row["bits"], np.uint8)
        slices.append(merged.sparkSession.sparkContext.broadcast(Filter(table, bits - cut, own, rules, 1)))
    return Slices(slices, cut)


class Exact:
    """Sorted hashes with counts, found through the top bits of the hash."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.bits = max(1, int(len(keys)).bit_length())
        self.start = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Count of each key, -1 if it is not there."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        at = self.start[(keys >> np.uint64(64 - self.bits)).astype(np.int64)]
        live = np.arange(len(keys))
        while len(live):
            inside = at[live] < len(self.keys)
            live = live[inside]
            own = self.keys[at[live]]
            same = own == keys[live]
            out[live[same]] = self.counts[at[live[same]]]
            live = live[own < keys[live]]
            at[live] += 1
        return out


def _frequent(merged: DataFrame, rules: Rules, types: dict[int, int]) -> tuple[Exact, DataFrame]:
    """The words of the highest levels, `frequent` at most, and the table (word, c) of the others."""
    least, sum_ = LEVELS, 0
    while least > 1 and sum_ + types.get(least - 1, 0) <= rules.frequent:
        least -= 1
        sum_ += types.get(least, 0)
    rows = merged.where("n = 1").select("segment", "keys", "counts")

    def split(high: bool):
        def run(batches):
            for batch in batches:
                for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    keys, counts = unpack_sorted(keys), unpack(counts)
                    own = (level_of(counts, rules.base) >= least) == high
                    yield pa.RecordBatch.from_arrays([pa.array(keys[own].view(np.int64)), pa.array(counts[own].astype(np.int64))], ["word", "c"])

        return map_rows(rows, run, "word long, c long")

    top = split(True).toArrow()
    return Exact(top["word"].to_numpy().view(np.uint64), top["c"].to_numpy()), split(False)


#: Ratios of the two estimates are kept as quarters of their binary logarithm.
_RATIOS, _ZERO = 160, 80


def levels_of(one: Slices, two: Slices, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels of the token, its context and the bigram; each different n-gram is looked up once."""
    words, at = np.unique(tokens, return_inverse=True)
    own = one.level(words)
    # Contexts are tokens of the same batch, but for the start of a text, which every text has.
    found = np.searchsorted(words, before)
    found[found == len(words)] = 0
    known = np.where(words[found] == before, own[found], 0)
    pairs, back = np.unique(bigrams_of(before, tokens), return_inverse=True)
    return own[at], known, two.level(pairs)[back]


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Levels of the tokens, contexts and bigrams of all documents of a batch, and where each document starts."""
    shared = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(shared.decompress(x), np.uint8).reshape(3, -1) for x in batch.column("levels").to_pylist()]
    w, v, vw = np.concatenate(rows, axis=1).astype(np.int64)
    return w, v, vw, np.concatenate([[0], np.cumsum([r.shape[1] for r in rows])[:-1]]).astype(np.int64)


class Model:
    """What a worker needs to score the levels of a text."""

    def __init__(self, rules: Rules, total: int, types: int, weights: np.ndarray):
        self.means, self.total, self.types, self.weights = level_means(rules.base), total, types, weights

    def probability(self, w: np.ndarray, v: np.ndarray, vw: np.ndarray) -> np.ndarray:
        word = (self.means[w] + 1) / (self.total + self.types + 1)
        context = np.maximum(self.means[v], 1)
        weight = self.weights[v]
        return weight * np.minimum(1, self.means[vw] / context) + (1 - weight) * word


def fit_weights(described: DataFrame, total: int, types: int, rules: Rules) -> np.ndarray:
    """Weight of the bigram estimate for each level of the context. described: levels of training documents."""

    def run(batches):
        means = level_means(rules.base)
        seen = np.zeros(LEVELS * _RATIOS, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            w, v, vw, _ = _unpacked(batch)
            pair = np.maximum(means[vw] - 1, 0) / np.maximum(means[v] - 1, 1)
            word = np.maximum(means[w], 1) / (total + types)
            ratio = np.full(len(w), 0)
            some = pair > 0
            ratio[some] = np.clip(np.round(4 * np.log2(np.minimum(pair[some], 1) / word[some])) + _ZERO, 1, _RATIOS - 1)
            seen += np.bincount(v * _RATIOS + ratio, minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["at", "n"])

    rows = map_rows(described.select("levels"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(LEVELS * _RATIOS)
    for row in rows:
        table[row["at"]] = row["n"]
    table = table.reshape(LEVELS, _RATIOS)
    ratio = 2.0 ** ((np.arange(_RATIOS) - _ZERO) / 4)
    ratio[0] = 0
    grid = np.linspace(0, 0.95, 96)
    gain = table @ np.log(1 + grid[None, :] * (ratio[:, None] - 1))
    weights = grid[gain.argmax(axis=1)]
    weights[0] = 0
    return weights


def forget() -> None:
    """Nothing is kept for lookups; what counting has freed goes back to the system before them."""


def held_out(doc_id) -> F.Column:
    """The fold that is scored but not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per input row."""
    spark = docs.sparkSession
    docs = columns_of(docs, id_col, text_col).withColumn("held_out", held_out("doc_id"))
    train = docs.where("NOT held_out")
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log2 = min(max(4, (size // rules.segment_bytes).bit_length()), rules.unigram_bits - 6)
    merged = stage(count_ngrams(train, rules, log2), "ngrams")
    totals = merged.where("n = 1").agg(F.sum("total"), F.sum("types")).first()
    total, types = int(totals[0] or 0), int(totals[1] or 0)
    by_level = merged.where("n = 1").select(F.posexplode("levels").alias("q", "t")).groupBy("q").agg(F.sum("t").alias("t")).collect()
    exact, others = _frequent(merged, rules, {r["q"]: r["t"] for r in by_level})
    one = build_filter(merged, 1, log2, rules.unigram_bits, rules)
    two = build_filter(merged, 2, log2, rules.bigram_bits, rules)
    at_once = rules.lookup_bytes if one.log2 or two.log2 else 0
    frequent = spark.sparkContext.broadcast(exact)

    def describe(row: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        exact = frequent.value
        tokens, before, ends = tokens_of(texts_of(batch))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        levels = np.stack(levels_of(one, two, tokens, before)).astype(np.uint8)
        counts = exact.find(tokens)
        logs = np.log10(np.maximum(counts, 0) + 1)
        rest = counts < 0
        n = len(starts)
        words, times = [[]] * n, [[]] * n
        for i in np.flatnonzero(np.add.reduceat(rest, starts)).tolist():
            own = tokens[starts[i] : ends[i]][rest[starts[i] : ends[i]]]
            words[i], times[i] = np.unique(own.view(np.int64), return_counts=True)
        packer = zstandard.ZstdCompressor(level=1)
        cols = {
            "row": pa.array(np.arange(row, row + n)),
            "doc_id": batch.column("doc_id"),
            "held_out": batch.column("held_out"),
            "n_tokens": pa.array(ends - starts),
            "known": pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
            "logs": pa.array(np.add.reduceat(logs, starts)),
            "words": pa.array(words, pa.list_(pa.int64())),
            "times": pa.array(times, pa.list_(pa.int64())),
            "levels": pa.array([packer.compress(levels[:, a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(cols)

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        held, size = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += batch.nbytes
            if held and (batch is None or size >= at_once):
                some = pa.concat_batches(held)
                held, size = [], 0
                if some.num_rows:
                    yield describe(row, some)
                    row += some.num_rows

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, words array<long>, times array<long>, levels binary"
    described = stage(map_rows(docs, run, schema, forget), "described")
    model = Model(rules, total, types, fit_weights(described.where("NOT held_out"), total, types, rules))
    per_token = np.log10(total + types + 1)

    def sum_up(batches):
        for batch in batches:
            if batch.num_rows:
                w, v, vw, starts = _unpacked(batch)
                logs = np.log10(model.probability(w, v, vw))
                yield batch.drop_columns(["levels"]).append_column("score", pa.array(np.add.reduceat(logs, starts)))

    kept = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double"
    scored = map_rows(described.drop("words", "times"), sum_up, kept)
    rest = described.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rest = (
        rest.join(others, "word")
        .groupBy("row")
        .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_logs"))
    )
    known = F.col("known") + F.coalesce("more_known", F.lit(0))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        known.alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(per_token))).alias("base_score"),
        "score",
    )
