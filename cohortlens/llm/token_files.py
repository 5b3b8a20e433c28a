"""Token-id files: bit-plane shuffled blocks, each plane compressed with zstandard, and a chunk index at the end.

Documents are range-partitioned and sorted by id, encoded, closed with an end id, and their ids cut into blocks of a fixed size.
A block's ids (32 bits each) are transposed: byte planes hold the first, second, third and fourth bytes of all ids, bit planes
the single bits. High planes are nearly constant, so they almost vanish when compressed. Each partition becomes one file:

    record of one block: the compressed planes, one after another
    ...
    index record:        zstandard frame with the documents (ids, null marks, lengths) and the blocks (offset, ids, plane sizes)
    trailer:             length of the index record (8 bytes, little endian), magic

Records end in one newline byte, because Spark's text writer puts the files down: they go wherever Spark can write, through its
commit protocol, and a lost task leaves no half file. Files in name order hold documents in ascending id order, null ids first, equal
ids by text. Reading goes through the binaryFile source and decodes block by block, so memory is bounded by the file as
stored. Ranges hold about FILE_BYTES of text at most, so files stay far below the 2 GB that source can read; only rows
that share one id, or have none, are not parted, and could make a larger file.

Null texts are empty; each document has at least its end id. An empty table writes no file, and reads back as no document.

Encoding uses the tokenizers library. If the tokenizer drops white space before it merges (checked in its file), the words between
spaces and newlines are independent, and a worker keeps the ids of words in two tables of fixed size; else whole texts are encoded.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import columns_of, map_rows, texts_of

BLOCK = 1 << 16
#: Words of the young half of the table.
REMEMBERED = 300_000
#: Text of a file, about: more shuffle partitions are asked for where the session's would hold more.
FILE_BYTES = 1 << 27
#: Put between words that are encoded together; one token by itself.
_MARK = "\x01"
MAGIC = b"IDPLANE1"
_TRAILER = struct.Struct("<Q8s")


def _independent_words(spec: dict) -> bool:
    """Whether text between spaces or newlines is encoded on its own, whatever stands beside it."""
    norm = spec.get("normalizer") or {}
    steps = norm.get("normalizers", [norm] if norm else [])
    plain = all(
        x.get("type") in ("NFC", "Lowercase") or (x.get("type") == "Replace" and x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " ")
        for x in steps
    )
    pre = spec.get("pre_tokenizer") or {}
    pres = pre.get("pretokenizers", [pre])
    first = pres[0]
    split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    pattern = str((first.get("pattern") or {}).get("Regex", ""))
    rest = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") for x in pres[1:])
    added = all(not (x.get("lstrip") or x.get("rstrip") or x.get("normalized") or " " in x["content"]) for x in spec.get("added_tokens", []))
    return bool(plain and split and rest and added and "[^\\s" in pattern and " " not in pattern)


#: Letters up to here stay as they are under NFC, and every version of Unicode knows them as letters.
_PLAIN_END = "\u0250"


def _letters(spec: dict) -> dict[int, str] | None:
    """What the model is given for each plain lower-case letter, where a word of such letters reaches it in one piece; else None."""
    pres = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if spec["model"].get("type") != "BPE" or spec["model"].get("dropout") or len(pres) != 2 or pres[1].get("use_regex"):
        return None
    from tokenizers.pre_tokenizers import ByteLevel

    bytes_of = ByteLevel(add_prefix_space=False, use_regex=False)
    return {ord(c): bytes_of.pre_tokenize_str(c)[0][0] for c in map(chr, range(ord(_PLAIN_END))) if c.isalpha() and c == c.lower()}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = _independent_words(spec)
        self.by_letters = self.by_word and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\")
        self.lower = "'Lowercase'" in str(spec.get("normalizer")) and all(x["content"].startswith("<|") for x in spec.get("added_tokens", []))
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        #: Ids of words, in two generations: a full young table becomes the old one, and what is met again moves up. So frequent
        #: words are encoded once a worker, and rare ones are forgotten.
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.letters = _letters(spec) if self.by_letters and self.lower else None
        alone = self.model.encode(_MARK, add_special_tokens=False).ids
        self.mark = alone[0] if len(alone) == 1 else None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single words. Those of plain lower-case letters go to the library's model at once, the others through its whole course."""
        if self.letters is None:
            return self._marked(words)
        plain = [w.isalpha() and max(w) < _PLAIN_END and w == w.lower() for w in words]
        rest = iter(self._marked([w for w, own in zip(words, plain, strict=True) if not own]))
        split, letters = self.model.model.tokenize, self.letters
        return [
            array("I", [x.id for x in split(w.translate(letters))]).tobytes() if own else next(rest) for w, own in zip(words, plain, strict=True)
        ]

    def _marked(self, words: list[str]) -> list[bytes]:
        """Ids of single words of any kind: many are encoded as one text, with a mark between them whose token tells where the next one begins."""
        out = []
        for start in range(0, len(words), 512):
            some = words[start : start + 512]
            ids = np.array(self.model.encode_batch_fast([f" {_MARK} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark) if self.mark is not None else ()
            if len(cuts) != len(some) - 1:
                # A word that holds the mark itself, or a tokenizer that splits it.
                out += self._ids(some)
                continue
            data, first = ids.tobytes(), 0
            for cut in (4 * cuts).tolist():
                out.append(data[first:cut])
                first = cut + 4
            out.append(data[first:])
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian 32-bit integers."""
        if not self.by_word:
            return self._ids([x.decode() for x in texts])
        known = self.known
        if len(known) > REMEMBERED:
            self.old, self.known = known, {}
            known = self.known
        known[""] = b""
        if self.lower:
            # Fewer different words; a special token's string must not come about by it.
            texts = [x if b"<|" in x else x.lower() for x in texts]
        parts = [x.decode().replace("\n", " ").split(" ") for x in texts]
        words = list(itertools.chain.from_iterable(parts))
        found = list(map(known.get, words))
        missing = {w for w, ids in zip(words, found, strict=True) if ids is None}
        if missing:
            again = missing & self.old.keys()
            known.update((w, self.old[w]) for w in again)
            missing -= again
            # A full stop or comma behind a letter is split off by the pattern, so the word before it may be known already.
            ended = [w for w in missing if w[-1] in ".," and len(w) > 1 and w[-2].isalpha()] if self.by_letters else []
            wanted = (missing.difference(ended) | {w[:-1] for w in ended} | {".", ","}).difference(known)
            again = wanted & self.old.keys()
            known.update((w, self.old[w]) for w in again)
            wanted = list(wanted - again)
            known.update(zip(wanted, self._words(wanted), strict=True))
            known.update((w, known[w[:-1]] + known[w[-1]]) for w in ended)
            found = [known[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        ids = iter(found)
        return [b"".join(itertools.islice(ids, len(x))) for x in parts]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def forget() -> None:
    encoder.cache_clear()


def planes_of(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(4)]
    spread = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(spread[:, i]).tobytes() for i in range(32)]


def ids_of(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(x, np.uint8) for x in planes], axis=1)
    else:
        spread = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x in planes], axis=1)
        raw = np.packbits(spread, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class FileWriter:
    """Turns the documents of one partition into the records of its file."""

    def __init__(self, bits: bool = False, block: int = BLOCK, level: int = 3):
        import zstandard

        self.zip = zstandard.ZstdCompressor(level=level)
        self.bits, self.block = bits, block
        self.rest = np.empty(0, "<u4")
        self.docs: list[tuple[int | None, int]] = []
        self.blocks: list[list[int]] = []
        self.at = 0

    def add(self, doc_ids: list, encoded: list[bytes]) -> list[bytes]:
        self.docs += zip(doc_ids, (len(x) // 4 for x in encoded), strict=True)
        ids = np.concatenate([self.rest, np.frombuffer(b"".join(encoded), "<u4")])
        whole = len(ids) // self.block * self.block
        self.rest = ids[whole:]
        return [self._record(ids[i : i + self.block]) for i in range(0, whole, self.block)]

    def _record(self, ids: np.ndarray) -> bytes:
        packed = [self.zip.compress(x) for x in planes_of(ids, self.bits)]
        record = b"".join(packed)
        self.blocks.append([self.at, len(ids), *map(len, packed)])
        self.at += len(record) + 1
        return record

    def close(self) -> list[bytes]:
        if not self.docs:
            return []
        out = [self._record(self.rest)] if len(self.rest) else []
        nulls = np.array([x is None for x, _ in self.docs], np.uint8)
        ids = np.array([x or 0 for x, _ in self.docs], "<i8")
        sizes = np.array([n for _, n in self.docs], "<i8")
        blocks = np.array(self.blocks, "<i8")
        head = struct.pack("<QQQ", len(ids), *blocks.shape)
        index = self.zip.compress(head + nulls.tobytes() + ids.tobytes() + sizes.tobytes() + blocks.tobytes())
        return [*out, index + _TRAILER.pack(len(index), MAGIC)]


class FileReader:
    """Documents of one file, block by block."""

    def __init__(self, content: bytes):
        import zstandard

        self.content, self.unzip = content, zstandard.ZstdDecompressor()
        size, magic = _TRAILER.unpack(content[-_TRAILER.size - 1 : -1])
        if magic != MAGIC:
            raise ValueError("not a file of id planes")
        end = len(content) - 1 - _TRAILER.size
        index = self.unzip.decompress(content[end - size : end])
        n, rows, cols = struct.unpack_from("<QQQ", index)
        at = 24
        self.nulls = np.frombuffer(index, np.uint8, n, at)
        self.doc_ids = np.frombuffer(index, "<i8", n, at + n)
        self.sizes = np.frombuffer(index, "<i8", n, at + 9 * n)
        self.blocks = np.frombuffer(index, "<i8", rows * cols, at + 17 * n).reshape(rows, cols)

    def block(self, i: int) -> np.ndarray:
        at, n, *sizes = self.blocks[i].tolist()
        planes = []
        for size in sizes:
            planes.append(self.unzip.decompress(self.content[at : at + size]))
            at += size
        return ids_of(planes, n)

    def documents(self):
        """(doc_id, ids) of each document."""
        held, have, nxt = [], 0, 0
        for doc_id, null, size in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.sizes.tolist(), strict=True):
            while have < size:
                held.append(self.block(nxt))
                have += len(held[-1])
                nxt += 1
            ids = held[0] if len(held) == 1 else np.concatenate(held) if held else np.empty(0, "<u4")
            yield None if null else doc_id, ids[:size]
            held, have = [ids[size:]], have - size


def write_ids(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: bool = False,
    block: int = BLOCK,
) -> None:
    """Encode every text, append end_id, and write the files to `folder`, which must not exist."""
    end = np.array([end_id], "<u4").tobytes()
    texts = columns_of(docs, id_col, text_col)
    # Files follow bytes, not records: as many ranges as the text needs, where that is more than the session asks for.
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    needed = -(-size // FILE_BYTES)
    asked = [needed] if needed > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    # Sampling for the ranges reads the ids only; the texts are encoded once, behind the exchange.
    rows = texts.repartitionByRange(*asked, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        model, out = encoder(tokenizer), FileWriter(bits, block)
        for batch in batches:
            encoded = [x + end for x in model.encode(texts_of(batch))]
            yield _records(out.add(batch.column("doc_id").to_pylist(), encoded))
        yield _records(out.close())

    # The cast keeps the bytes as they are.
    map_rows(rows, run, "value binary", forget).select(F.col("value").cast("string")).write.option("lineSep", "\n").text(folder)


def _records(values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"])


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(file, doc_id, at, ids array<long>): every document of the files with its place in its file."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at = 0
                for doc_id, ids in FileReader(content).documents():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([doc_id], pa.int64()), pa.array([at], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))],
                        ["file", "doc_id", "at", "ids"],
                    )
                    at += len(ids)

    return map_rows(_files(spark, folder), run, "file string, doc_id long, at long, ids array<long>")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; start counts the ids of all documents before this one."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, at = [], 0
                for doc_id, ids in FileReader(content).documents():
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                cols = [pa.array([path] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4))]
                yield pa.RecordBatch.from_arrays(cols, ["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = map_rows(_files(spark, folder), run, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    # One row per file: the only thing that is put in one order.
    files = docs.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select(F.col("file").alias("name"), F.coalesce(before, F.lit(0)).alias("before"))
    return docs.join(files, F.col("file") == F.col("name")).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0").select("path", "content")
