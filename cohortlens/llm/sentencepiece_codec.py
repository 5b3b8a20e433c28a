"""SentencePiece encoding and decoding by streaming Viterbi.

Positions of a text are taken from left to right. At each one, every piece that ends there extends the best path to
its start, and the best of these is kept with a pointer back. Only the last `longest piece` positions can still be
extended; as soon as the back pointers of all of them meet in one boundary, everything up to it is final: its ids are
committed and forgotten. So memory is bounded by the window, not by the text.

What "best" means depends on the model:

- unigram: the largest sum of piece scores; a character without a piece costs the lowest score minus 10.
- bpe: the path the merges would take. A sequence of pieces is the merge result exactly if each pair of neighbours is: merging the
  pair's characters alone gives the pair back. So a piece extends the path to its start only if it may follow that
  path's last piece; every position has one such path at most, and the ids equal those of the library.

The text gets the space mark in front and for every space, as the model's normaliser does with identity rules, a dummy
prefix and kept white space; other normalisers are refused. A character that no piece has becomes its UTF-8 bytes' pieces.
Decoding joins pieces, turns byte pieces into bytes (malformed ones into U+FFFD) and marks into spaces, and removes the first
space. A text that holds the mark itself comes back with a space in its place; all others come back as they were.

No piece has the mark behind another character, and many pairs of characters stand side by side in no piece: paths always meet
there. The stretches between such points repeat a lot, so a worker keeps their ids in a table of fixed size.

Null and empty texts have no ids and decode to the empty text. Every input row gives one row.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import columns_of, map_rows, texts_of

MARK = "▁"
#: Stretches, and pairs of pieces, that a worker remembers.
REMEMBERED = 700_000
REMEMBERED_PAIRS = 100_000


class Codec:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds = spec.trainer_spec.model_type
        norm = spec.normalizer_spec
        if kinds not in (1, 2):
            raise ValueError("only unigram and bpe models are supported")
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only identity normalisation with a dummy prefix and kept white space is supported")
        if spec.trainer_spec.treat_whitespace_as_suffix or any(p.type in (4, 5) for p in spec.pieces):
            raise ValueError("models with user-defined or unused pieces, or space marks at the end, are not supported")
        del sentencepiece
        self.merges = kinds == 2
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in spec.pieces if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == 2)
        self.longest = max(map(len, self.ids))
        self.lowest = min(self.score.values()) - 10
        self.tails = {p[i:] for p in self.ids for i in range(len(p))}
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.raw = [b""] * len(spec.pieces)
        for p, i in self.ids.items():
            self.raw[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces with a space mark behind another character are not supported")
        # Characters that only stand alone: every path has a boundary on both sides of them.
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        self.stretch = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+" if "\n" not in joined else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: best score first, leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, a: str, b: str) -> bool:
        """Whether merging leaves the boundary between the pieces a and b."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(a + b) == [a, b]
        return known

    def stream(self, text: str):
        """Yields lists of pieces, each as soon as it is final. text: with marks."""
        # last[j]: the last piece of the best path to boundary start + j, None if no path reaches it; sums: its score.
        start, last, sums = 0, [""], [0.0]
        merges, tails, score, pairs = self.merges, self.tails, self.score, self.pairs
        window = 2 * self.longest
        for end in range(1, len(text) + 1):
            begin = end - 1
            piece = text[begin]
            ending = [piece]  # pieces that end here, shortest first; a single character always counts
            while begin > start:
                begin -= 1
                piece = text[begin:end]
                if piece not in tails:
                    break
                if piece in score:
                    ending.append(piece)
            at = end - start
            best, most = None, 0.0
            if merges:
                while ending:
                    piece = ending.pop()
                    before = last[at - len(piece)]
                    if before is None:
                        continue
                    fits = before == "" or pairs.get((before, piece))
                    if fits is None:
                        fits = self.follows(before, piece)
                    if fits:
                        best = piece
                        break
            else:
                for piece in reversed(ending):
                    if last[at - len(piece)] is not None:
                        own = sums[at - len(piece)] + score.get(piece, self.lowest)
                        if best is None or own > most:
                            best, most = piece, own
            last.append(best)
            sums.append(most)
            if at > window:
                done = self._meet(start, last)
                if done > start:
                    yield self._path(start, last, done)
                    # The path's last piece decides what may follow; the boundary itself becomes the new origin.
                    last, sums = last[done - start :], sums[done - start :]
                    start = done
        if start < len(text):
            yield self._path(start, last, len(text))

    def _meet(self, start: int, last: list) -> int:
        """The last boundary on all paths that can still be extended."""
        live = {start + i for i in range(max(0, len(last) - self.longest), len(last)) if last[i] is not None}
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            live.add(far - len(last[far - start]))
        return live.pop()

    def _path(self, start: int, last: list, end: int) -> list[str]:
        out = []
        while end > start:
            piece = last[end - start]
            out.append(piece)
            end -= len(piece)
        return out[::-1]

    def _ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def _of(self, stretch: str) -> bytes:
        """Ids of a stretch between two sure boundaries, as 32-bit integers."""
        got = self.known.get(stretch)
        if got is None:
            # Two neighbours that stand side by side in no piece have a boundary between them, too.
            inside = self.inside
            cuts = [i for i in range(1, len(stretch)) if stretch[i - 1 : i + 1] not in inside]
            if cuts:
                got = b"".join([self._of(stretch[i:j]) for i, j in zip([0, *cuts], [*cuts, len(stretch)], strict=True)])
            else:
                ids = [i for pieces in self.stream(stretch) for piece in pieces for i in self._ids(piece)]
                got = np.array(ids, "<i4").tobytes()
            if len(stretch) <= 64:
                if len(self.known) >= self.remembered:
                    self.known.clear()
                self.known[stretch] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<i4")
        stretches = self.stretch.findall(MARK + text.replace(" ", MARK))
        found = list(map(self.known.get, stretches))
        if None in found:
            found = [self._of(x) if ids is None else ids for x, ids in zip(stretches, found, strict=True)]
        return np.frombuffer(b"".join(found), "<i4")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


@functools.lru_cache(maxsize=2)
def codec(path: str, remembered: int = REMEMBERED) -> Codec:
    return Codec(path, remembered)


def forget() -> None:
    codec.cache_clear()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): one row per input row."""

    def run(batches):
        model = codec(path)
        for batch in batches:
            ids = [model.encode(x.decode()) for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_rows(columns_of(docs, id_col, text_col), run, "doc_id long, ids array<int>", forget)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): a null list decodes to the empty text; ids the model doesn't have, and control pieces, to nothing."""
    rows = encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids"))

    def run(batches):
        model = codec(path)
        for batch in batches:
            known = range(len(model.raw))
            texts = [model.decode([i for i in x or [] if i in known]) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_rows(rows, run, "doc_id long, text string", forget)


def encode_and_decode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED
) -> DataFrame:
    """(doc_id, n_chars, n_pieces, ids_crc32, ids, decoded, same): both ways in one pass; one row per input row.

    ids_crc32 is that of the ids as little-endian 32-bit integers; same says whether the decoded text is the input's.
    """
    kinds = {
        "doc_id": (T.LongType(), None),
        "n_chars": (T.LongType(), pa.int64()),
        "n_pieces": (T.LongType(), pa.int64()),
        "ids_crc32": (T.LongType(), pa.int64()),
        "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
        "decoded": (T.StringType(), pa.string()),
        "same": (T.BooleanType(), pa.bool_()),
    }

    def run(batches):
        model = codec(path, remembered)
        for batch in batches:
            texts = [x.decode() for x in texts_of(batch)]
            ids = [model.encode(x) for x in texts]
            back = [model.decode(x.tolist()) for x in ids]
            cols = {
                "n_chars": [len(x) for x in texts],
                "n_pieces": [len(x) for x in ids],
                "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids],
                "ids": ids,
                "decoded": back,
                "same": [a == b for a, b in zip(texts, back, strict=True)],
            }
            arrays = [pa.array(v, kinds[k][1]) for k, v in cols.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], list(kinds))

    schema = T.StructType([T.StructField(k, kind) for k, (kind, _) in kinds.items()])
    return map_rows(columns_of(docs, id_col, text_col), run, schema, forget)
