"""Token counts: batch encoding inside Arrow functions, returning lengths only.

The tokenizer file decides the library: .json is read by tokenizers, .model by sentencepiece. Both are used as they are by
default: no begin, end or added special tokens, special strings inside texts as the library handles them, no
truncation, no padding. The file is opened once per Python worker and must exist on every worker.

Texts are encoded in batches of about equal bytes. A text longer than `most_bytes` is encoded in pieces, cut where no
token can cross: for sentencepiece models whose pieces hold the space mark only at their start, before a single
space between two other characters. The space is left out of the next piece, because the model puts one in front of every
text; models without that dummy prefix, or of another kind, are encoded whole, and so are .json tokenizers. Counts are exact.

Null and empty texts have 0 bytes; an empty text has no tokens. Every input row gives one row.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, columns_of, map_rows, texts_of

#: Bytes of a batch, and the length from which a text is cut.
BATCH = 1 << 20
MOST_BYTES = 1 << 16
LIMIT = 4096


class _Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = self.model.encode("a", out_type=str)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # Cutting needs the dummy prefix, kept white space, and no piece with the mark behind another character.
        self.cuts = (
            bool(probe)
            and probe[0].startswith("▁")
            and self.model.decode(self.model.encode("a  b")) == "a  b"
            and not any("▁" in p.lstrip("▁") for p in pieces)
        )

    def cut(self, text: str, most: int) -> list[str]:
        if not self.cuts or len(text) <= most:
            return [text]
        out, start = [], 0
        for m in re.finditer(r"(?<=[^ ▁]) (?=[^ ▁])", text):
            if m.start() - start >= most:
                out.append(text[start : m.start()])
                start = m.end()
        return [*out, text[start:]]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


class _Json:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def cut(self, text: str, most: int) -> list[str]:
        return [text]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def counter(path: str):
    return _Pieces(path) if path.endswith(".model") else _Json(path)


def forget() -> None:
    counter.cache_clear()


def lengths_of(texts: list[bytes], path: str, most_bytes: int = MOST_BYTES) -> list[int]:
    """Tokens of each text."""
    model = counter(path)
    owners, pieces = [], []
    for i, data in enumerate(texts):
        for piece in model.cut(data.decode(), most_bytes):
            owners.append(i)
            pieces.append(piece)
    out = [0] * len(texts)
    for start, end in by_bytes(pieces, BATCH):
        for i, n in zip(owners[start:end], model.lengths(pieces[start:end]), strict=True):
            out[i] += n
    return out


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per input row, in one pass without a shuffle."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            n = pa.array(lengths_of(texts, path, most_bytes), pa.int64())
            over = pa.array([x > limit for x in n.to_pylist()], pa.bool_())
            size = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, n, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_rows(columns_of(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", forget)
