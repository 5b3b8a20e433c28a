"""Shared helpers: column handling, word hashing inside Arrow tasks, and the fixed-size pre-filter."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import stage  # noqa: F401

#: What is handed to a Python task at once.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"
#: Bits of the pre-filter in maybe_in: 16 MB, whatever the input.
FILTER_BITS = 27
#: What separates words: the space and the five ASCII controls that bytes.split() takes, too.
SPACE = b" \t\n\x0b\x0c\r"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0xD6E8FEB86659FD93)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def columns_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): the two columns an operator needs, whatever else the table carries."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


_held: list[Callable[[], None] | None] = [None]


def hold(forget: Callable[[], None] | None) -> None:
    """A Python worker serves one task after another: what it keeps for one operator goes before another one's task runs."""
    if _held[0] is not forget:
        if _held[0] is not None:
            _held[0]()
        gc.collect()
        _give_back()
    _held[0] = forget


def _give_back() -> None:
    """Freed memory that the allocators keep goes back to the system, since a worker shares its machine with others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_rows(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema,
    forget: Callable[[], None] | None = None,
) -> DataFrame:
    """mapInArrow with batches bounded by rows and bytes, so that long texts don't add up in a worker.

    forget: a function of a module that empties what its tasks keep in the worker.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def task(batches):
        hold(forget)
        yield from fn(batches)

    return df.mapInArrow(task, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def by_bytes(texts: list, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about equal bytes, at least one text each."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


# Words are hashed all at once: a polynomial with one random coefficient per byte, taken as the difference of running sums.
_POINT = 0xA24BAED4963EE40B
_BYTE = np.random.default_rng(7_042_024).integers(1, 1 << 63, 256, np.uint64)
_COEFFICIENT = _BYTE.copy()
_COEFFICIENT[65:91] = _COEFFICIENT[97:123]
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACE, np.uint8))
#: Bytes hashed at once; a longer text is cut between words.
PIECE = 1 << 19


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(x: int) -> np.ndarray:
        out = np.full(n, x, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return of(_POINT), of(pow(_POINT, -1, 1 << 64))


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one piece."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    up, down = _powers(1 << max(PIECE.bit_length(), n.bit_length()))
    space = np.ones(n + 2, bool)
    space[1:-1] = _IS_SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_COEFFICIENT[raw] * up[:n], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts]), starts


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z taken as a-z, and where each text's words end among them."""
    hashes, counts = [], []
    for first, last in by_bytes(texts, PIECE):
        if last - first == 1 and len(texts[first]) > PIECE:
            own = [_hash_piece(x)[0] for x in _cut(texts[first])]
            hashes += own
            counts.append(np.array([sum(map(len, own))]))
            continue
        found, starts = _hash_piece(b"\n".join(texts[first:last]))
        bounds = np.cumsum([len(x) + 1 for x in texts[first:last]])
        hashes.append(found)
        counts.append(np.diff(np.searchsorted(starts, bounds), prepend=0))
    if not counts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def _cut(data: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(data):
        found = _GAP.search(data, start + PIECE)
        end = found.start() if found else len(data)
        yield data[start:end]
        start = end


_GAP = re.compile(b"[" + re.escape(SPACE) + b"]")


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def roll(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive hashes; of the whole sequence if it is shorter; none for none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = hashes[: n - width + 1].copy()
    for j in range(1, width):
        out *= _ROLL
        out += hashes[j : n - width + 1 + j]
    return mixed(out)


def bit_table(positions: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**bits bits, set where the one-column table `positions` says. Its size is fixed, so it may be broadcast."""
    # Spark's bitmaps count from 1.
    parts = (
        positions.select((positions[positions.columns[0]] + 1).alias("bit"))
        .groupBy(F.expr("bitmap_bucket_number(bit)").alias("part"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("map"))
        .toArrow()
    )
    table = np.zeros(1 << (bits - 3), np.uint8)
    for part, bitmap in zip(parts["part"].to_pylist(), parts["map"].to_pylist(), strict=True):
        piece = np.frombuffer(bitmap, np.uint8)
        at = (part - 1) * len(piece)
        table[at : at + len(piece)] = piece[: len(table) - at]
    return table


def is_set(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def maybe(rows: DataFrame, column: str, values: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """rows with a boolean column `maybe`: false only where the long `column` is surely not in the one-column table `values`.

    The values set bits in a table of fixed size (2**bits), which is all that is broadcast. The more values, the
    more other rows are marked; the join that follows decides. It keeps rows without a partner out of the shuffle.
    """
    most = F.lit(1 << bits)
    table = bit_table(values.select(F.pmod(F.xxhash64(values[values.columns[0]]), most)), bits)
    shared = rows.sparkSession.sparkContext.broadcast(table)
    kind = T.StructType([*rows.schema.fields, T.StructField("maybe", T.BooleanType())])

    def mark(batches):
        table = shared.value
        for batch in batches:
            hit = pa.array(is_set(table, batch.column("__bit").to_numpy()))
            yield batch.drop_columns(["__bit"]).append_column("maybe", hit)

    return map_rows(rows.withColumn("__bit", F.pmod(F.xxhash64(F.col(column)), most)), mark, kind)


def byte_hashes(data: bytes, size: int) -> np.ndarray:
    """64-bit hash of every run of `size` bytes."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    if n < size:
        return np.empty(0, np.uint64)
    up, down = _powers(1 << max(PIECE.bit_length(), n.bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
    return mixed((total[size:] - total[:-size]) * down[: n - size + 1])


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers as compressed byte planes."""
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<u8").reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def segment_bounds(values: np.ndarray, log2: int) -> np.ndarray:
    """Bounds of the segments in sorted hashes."""
    if not log2:
        return np.array([0, len(values)])
    inner = np.arange(1, 1 << log2, dtype=np.uint64) << np.uint64(64 - log2)
    return np.concatenate([[0], np.searchsorted(values, inner), [len(values)]])
