"""Removal of long repeats: every byte covered by a string of `size` bytes that also starts earlier.

Texts are UTF-8 bytes; earlier means in a document of a smaller id, or before it in the same document. Strings don't cross documents.

1. Anchors. Of the `gram`-byte strings in a window of `size` bytes, the one with the smallest hash is its anchor, the leftmost
   among equals. Equal windows have equal anchors at equal places, so windows need comparing within one anchor only. Consecutive windows
   with the same anchor form a context: the bytes from the first window's start to the last one's end.
2. Anchors that occur once are sorted out by a table of fixed size that the repeated ones set bits in.
3. Equal contexts of an anchor are found by their digests. All but the first of them lose all their windows; nothing else needs them.
4. Anchors with several different contexts are indexed, many to a bucket. The index of a bucket is the run-length Burrows-Wheeler transform of
   its contexts, in order of their places, with one sample for each interval of suffixes that agree in `size` bytes: the first context
   that holds such a string. Contexts are streamed through it from right to left by LF steps, so the match length grows by one
   byte a step; from `size` on, the sample at the current row says whether the string occurs earlier, and its window is marked.
5. An anchor in more than `hot` different contexts (the edge of a passage that very many documents quote) is not indexed as one group:
   its windows are told apart by digest one by one, which splits it over all tasks.

All shuffles carry anchors, digests, places or contexts; texts move by document id, only those with contexts to read or windows
to remove, as far as the pre-filter can tell.

Null texts are empty. Rows without an id count as one document before all others; rows that share an id count as one document, so
equal strings at equal places in them are not earlier than each other. Each row gives a row, and what is found in one text is removed
from that text only: texts are told apart by id and a digest (`text_key`).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import byte_hashes, columns_of, is_set, map_rows, maybe, pack_sorted, segment_bounds, stage, texts_of, unpack_sorted

PIECE = 1 << 20


@dataclass(frozen=True)
class Rules:
    #: At least 7, and not below gram.
    size: int = 100
    gram: int = 40
    #: Different contexts of an anchor from which its windows are compared one by one.
    hot: int = 1000
    #: Contexts of an index bucket, about.
    bucket: int = 4000
    #: log2 of the bits of the table of repeated anchors: 32 MB.
    bits: int = 28
    #: Anchors counted in memory before they are handed on, and bytes of text for each segment of their hash space.
    chunk: int = 2_000_000
    segment_bytes: int = 1 << 24


def contexts(data: bytes, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first window, last window) of each context of one text."""
    out = []
    for start in range(0, max(len(data) - rules.size + 1, 0), PIECE):
        # Windows that start in this piece.
        piece = data[start : start + PIECE + rules.size - 1]
        grams = byte_hashes(piece, rules.gram)
        n = len(piece) - rules.size + 1
        # The place stands in the low bits, so equal hashes give the leftmost.
        low = np.uint64((1 << 22) - 1)
        best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        span, width = rules.size - rules.gram + 1, 1
        while 2 * width <= span:
            best = np.minimum(best[: len(best) - width], best[width:])
            width *= 2
        best = np.minimum(best[:n], best[span - width : span - width + n])
        at = (best & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [n - 1]])
        out.append((grams[at[first]], at[first] + start, first + start, last + start))
    if not out:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated_anchors(docs: DataFrame, rules: Rules, log2: int) -> np.ndarray:
    """A bit for each anchor hash that occurs more than once, by its highest bits. docs: text."""
    inside = rules.bits - log2

    def flush(held):
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        rows = []
        for many in (False, True):
            own = values[(counts > 1) == many]
            bounds = segment_bounds(own, log2)
            rows += [(s, many, pack_sorted(own[a:b])) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["segment", "many", "keys"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for data in texts_of(batch):
                # 48 bits are enough for a pre-filter, and pack better.
                held.append(contexts(data, rules)[0] & np.uint64(0xFFFF_FFFF_FFFF_0000))
                size += len(held[-1])
                if size >= rules.chunk:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def merge(key, table):
        keys = []
        for many, data in zip(table["many"].to_pylist(), table["keys"].to_pylist(), strict=True):
            keys += [unpack_sorted(data)] * (2 if many else 1)
        keys = np.sort(np.concatenate(keys))
        twice = keys[1:][keys[1:] == keys[:-1]]
        flags = np.zeros(1 << inside, bool)
        flags[((twice >> np.uint64(64 - rules.bits)) & np.uint64((1 << inside) - 1)).astype(np.int64)] = True
        return pa.table({"segment": pa.array([key[0].as_py()]), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()])})

    chunks = map_rows(docs.select("text"), run, "segment long, many boolean, keys binary")
    table = np.zeros(1 << (rules.bits - 3), np.uint8)
    size = 1 << (inside - 3)
    for row in chunks.groupBy("segment").applyInArrow(merge, "segment long, bits binary").toLocalIterator():
        table[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return table


def occurrences(docs: DataFrame, rules: Rules, table: np.ndarray) -> DataFrame:
    """(anchor, context, doc_id, text_key, place, ahead, more) of contexts whose anchor may be repeated.

    context is a 64-bit digest, which with the anchor's makes 128 bits. The first window starts `ahead` bytes before the
    anchor's place, and `more` windows follow it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        table = shared.value
        for batch in batches:
            out = []
            for doc, key, data in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), texts_of(batch), strict=True):
                anchor, place, first, last = contexts(data, rules)
                own = np.flatnonzero(is_set(table, (anchor >> np.uint64(64 - rules.bits)).astype(np.int64)))
                if len(own):
                    anchor, place, first, last = anchor[own], place[own], first[own], last[own]
                    # The anchor's place in the context is part of what makes it.
                    digests = [
                        xxhash.xxh3_64_intdigest(data[a:b], p)
                        for a, b, p in zip(first.tolist(), (last + rules.size).tolist(), (place - first).tolist(), strict=True)
                    ]
                    out.append((np.full(len(own), doc), np.full(len(own), key), anchor.view(np.int64), place, place - first, last - first, np.array(digests, np.uint64).view(np.int64)))
            if out:
                doc, key, anchor, place, ahead, more, digests = (np.concatenate([x[i] for x in out]) for i in range(7))
                cols = [pa.array(x) for x in (anchor, digests, doc, key)] + [pa.array(x.astype(np.int32)) for x in (place, ahead, more)]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "context", "doc_id", "text_key", "place", "ahead", "more"])

    return map_rows(docs, run, "anchor long, context long, doc_id long, text_key long, place int, ahead int, more int")


class RunIndex:
    """Run-length Burrows-Wheeler transform of some strings, with the first holder of each long substring."""

    def __init__(self, strings: list[bytes], size: int):
        self.size, m = size, len(strings)
        lengths = np.fromiter(map(len, strings), np.int64, m)
        # Each string is followed by an end mark of its own; marks sort before all bytes, in the order of the strings.
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(int(ends[-1]) + 1, np.int64)
        raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64)
        text[:] = raw + 1
        text[ends] = 0
        owner = np.repeat(np.arange(m), lengths + 1)
        end_of = ends[owner]
        # The widest prefix whose ranks doubling gives, within a long substring.
        width = 7 << ((size // 7).bit_length() - 1)
        rows, rank = self._suffixes(text, owner, end_of, ends, int(lengths.max()), width)
        before = np.where(rows > 0, text[rows - 1], 0)
        starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.run_start, self.run_symbol = starts, before[starts]
        run_length = np.diff(np.concatenate([starts, [len(before)]]))
        # LF of a run's first row: rows of smaller symbols, and of the same symbol in earlier runs.
        order = np.argsort(self.run_symbol, kind="stable")
        target = np.cumsum(run_length[order]) - run_length[order]
        self.run_target = np.empty(len(starts), np.int64)
        self.run_target[order] = target
        # Intervals of suffixes that agree in `size` bytes, and the first string that holds each.
        long_ = end_of - np.arange(len(text)) >= size
        tail = rank[np.minimum(np.arange(len(text)) + size - width, len(text) - 1)]
        head, tail, long_ = rank[rows], tail[rows], long_[rows]
        same = (head[1:] == head[:-1]) & (tail[1:] == tail[:-1]) & long_[1:] & long_[:-1]
        self.interval = np.flatnonzero(np.concatenate([[True], ~same]))
        self.holder = np.minimum.reduceat(owner[rows], self.interval)
        self.lengths, self.runs, self.rows = lengths, len(starts), len(text)

    @staticmethod
    def _suffixes(text, owner, end_of, ends, longest, wanted):
        """Suffixes in order, by doubling, and their ranks by the first `wanted` symbols."""
        n, at = len(text), np.arange(len(text))
        key = np.zeros(n, np.uint64)
        for i in range(7):
            place = at + i
            symbol = np.where(place <= end_of, text[np.minimum(place, n - 1)], 0)
            key = (key << np.uint64(9)) | symbol.astype(np.uint64)
        _, rank = np.unique(key, return_inverse=True)
        rank = rank.reshape(-1) + len(ends)
        rank[ends] = np.arange(len(ends))
        width, kept = 7, None
        while True:
            if width == wanted:
                kept = rank
            if width > longest and kept is not None:
                return np.argsort(rank), kept
            place = at + width
            second = np.where(place <= end_of, rank[np.minimum(place, n - 1)], owner)
            key = (rank.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
            order = np.argsort(key)
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            rank, width = new, 2 * width

    def earlier(self, rank: np.ndarray | None = None):
        """Streams all strings from their ends: yields (string numbers, start) of windows that an earlier string holds.

        rank: never decreasing numbers of the strings; those of the same number are not earlier than each other.
        """
        rank = np.arange(len(self.lengths)) if rank is None else rank
        strings = np.arange(len(self.lengths))
        row, left = strings.copy(), self.lengths.copy()
        step = 0
        while len(strings):
            run = np.searchsorted(self.run_start, row, "right") - 1
            row = self.run_target[run] + row - self.run_start[run]
            left = left - 1
            step += 1
            if step >= self.size:
                first = self.holder[np.searchsorted(self.interval, row, "right") - 1]
                hit = rank[first] < rank[strings]
                yield strings[hit], left[hit]
            more = left > 0
            strings, row, left = strings[more], row[more], left[more]


def _index(table: pa.Table, size: int) -> pa.Table:
    """Windows (doc_id, text_key, from, to) of one bucket's contexts that occur earlier."""
    doc, key = table["doc_id"].to_numpy(), table["text_key"].to_numpy()
    place = table["place"].to_numpy()
    order = np.lexsort([place, doc])
    by_place = np.stack([doc[order], place[order]])
    rank = np.cumsum(np.concatenate([[0], (by_place[:, 1:] != by_place[:, :-1]).any(axis=0)]))
    data = table["data"].to_pylist()
    first = table["first"].to_numpy()
    index = RunIndex([data[i] for i in order.tolist()], size)
    whose, starts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for strings, start in index.earlier(rank):
        whose.append(order[strings])
        starts.append(start)
    whose = np.concatenate(whose)
    at = np.concatenate(starts) + first[whose]
    by = np.lexsort([at, whose])
    whose, at = whose[by], at[by]
    # Neighbouring windows become one interval.
    new = np.flatnonzero(np.concatenate([[True], (whose[1:] != whose[:-1]) | (at[1:] != at[:-1] + 1)])[: len(at)])
    last = np.concatenate([new[1:] - 1, [len(at) - 1]])[: len(new)]
    return pa.table({"doc_id": pa.array(doc[whose[new]]), "text_key": pa.array(key[whose[new]]), "from": pa.array(at[new].astype(np.int32)), "to": pa.array(at[last].astype(np.int32))})


def repeated_windows(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, text_key, from, to): starts of windows that occur earlier, as intervals. docs: doc_id (not null), text_key, text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log2 = min(max(4, (size // rules.segment_bytes).bit_length()), rules.bits - 3)
    found = stage(occurrences(docs, rules, repeated_anchors(docs, rules, log2)), "occurrences")
    place = F.struct("doc_id", "place", "text_key", "ahead", "more")
    kinds = stage(found.groupBy("anchor", "context").agg(F.min(place).alias("at"), F.count("*").alias("n")), "contexts")

    # All but the first of equal contexts.
    again = kinds.where("n > 1").select("anchor", "context", F.col("at.doc_id").alias("d"), F.col("at.place").alias("p"))
    later = (F.col("doc_id") > F.col("d")) | ((F.col("doc_id") == F.col("d")) & (F.col("place") > F.col("p")))
    first = F.col("place") - F.col("ahead")
    whole = found.join(again, ["anchor", "context"]).where(later).select("doc_id", "text_key", first.alias("from"), (first + F.col("more")).alias("to"))

    # The first of each, for anchors that have several.
    several = kinds.select("anchor").groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    firsts = stage(kinds.join(several, "anchor").select("anchor", "m", "at.*"), "firsts")
    buckets = max(1, firsts.where(F.col("m") <= rules.hot).count() // rules.bucket)
    by_doc = firsts.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "m", "place", "ahead", "more")).alias("own"))
    by_doc = stage(by_doc, "firsts-by-document")
    texts = maybe(docs, "doc_id", by_doc.select("doc_id")).where("maybe").drop("maybe").join(by_doc, ["doc_id", "text_key"])

    def read(batches):
        for batch in batches:
            out = []
            names = (batch.column(c).to_pylist() for c in ("doc_id", "text_key", "own"))
            for doc, key, own, data in zip(*names, texts_of(batch), strict=True):
                for x in own:
                    a = x["place"] - x["ahead"]
                    b = a + x["more"]
                    if x["m"] <= rules.hot:
                        out.append((x["anchor"], True, doc, key, x["place"], a, data[a : b + rules.size]))
                    else:
                        out += [(x["anchor"], False, doc, key, x["place"], s, xxhash.xxh3_128_digest(data[s : s + rules.size])) for s in range(a, b + 1)]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, ["anchor", "indexed", "doc_id", "text_key", "place", "first", "data"])

    pieces = stage(map_rows(texts, read, "anchor long, indexed boolean, doc_id long, text_key long, place int, first int, data binary"), "pieces")
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(buckets))
    length = rules.size

    def index(table):
        return _index(table, length)

    indexed = pieces.where("indexed").groupBy(bucket.alias("bucket")).applyInArrow(index, "doc_id long, text_key long, from int, to int")

    hot = pieces.where("NOT indexed").withColumn("off", F.col("place") - F.col("first"))
    same = hot.groupBy("anchor", "off", "data").agg(F.min(F.struct("doc_id", "place")).alias("at"), F.count("*").alias("n")).where("n > 1")
    same = same.select("anchor", "off", "data", F.col("at.doc_id").alias("d"), F.col("at.place").alias("p"))
    single = hot.join(same, ["anchor", "off", "data"]).where(later).select("doc_id", "text_key", F.col("first").alias("from"), F.col("first").alias("to"))
    return whole.union(indexed).union(single)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), keep_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and kept binary if asked for: one row per input row."""
    docs = columns_of(docs, id_col, text_col)
    nothing = -(1 << 63)
    keyed = docs.select(F.coalesce("doc_id", F.lit(nothing)).alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    by_doc = stage(repeated_windows(keyed, rules).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("from", "to")).alias("marks")), "windows-by-document")
    split = maybe(keyed, "doc_id", by_doc.select("doc_id"))
    kept = ", kept binary" if keep_bytes else ""

    def cut(batches):
        for batch in batches:
            out = []
            for doc, data, marks in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("marks").to_pylist(), strict=True):
                cover = np.zeros(len(data) + 1, np.int64)
                for x in marks or ():
                    cover[x["from"]] += 1
                    cover[x["to"] + rules.size] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and bool(gone[0])))
                rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), rest))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if keep_bytes else 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(len(names))], names)

    touched = split.where("maybe").drop("maybe").join(by_doc, ["doc_id", "text_key"], "left")
    touched = map_rows(touched, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + kept)
    text = F.coalesce("text", F.lit(""))
    rest = split.where("NOT maybe").select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
        *([text.cast("binary").alias("kept")] if keep_bytes else []),
    )
    both = touched.union(rest)
    return both.withColumn("doc_id", F.when(F.col("doc_id") != nothing, F.col("doc_id")))
