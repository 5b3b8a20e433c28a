"""Line dedup: explode normalised lines, hash, count distinct documents, drop frequent lines, reassemble by position.

A line's key is the line without ASCII white space at its ends, with A-Z in lower case. A key of at least `min_chars` code
points found in at least `min_docs` distinct documents is dropped from all of them but the one with the largest id, which
keeps every line with it. All other lines stay where they are, joined by newline characters again.

Null and empty texts have one empty line. A line repeated in one document counts once. Rows without an id count for no
document and lose nothing; rows that share an id are one document for the count, and each gives a row of its own.

Keys travel as 16-byte hashes. A key in a third of all documents is pre-aggregated before the shuffle, and the join that sends its
verdict back is a sort-merge join that adaptive execution splits. The texts move once, by document id.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import SPACE, columns_of, map_rows, stage, texts_of

MIN_CHARS = 40
MIN_DOCS = 5

_CONTINUED = bytes(range(0x80, 0xC0))


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """16-byte hash of the line's key; None if the key is too short to count."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.translate(None, _CONTINUED)) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, keys array<binary>): for each document that loses lines, the keys it loses. docs: doc_id, text."""

    def explode(batches):
        for batch in batches:
            ids, keys = [], []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                own = {k for k in (line_key(x, min_chars) for x in data.split(b"\n")) if k}
                ids += [doc_id] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    lines = stage(map_rows(docs.where("doc_id IS NOT NULL"), explode, "doc_id long, key binary"), "lines")
    frequent = (
        lines.groupBy("key")
        .agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("key", "keeper")
    )
    return (
        lines.join(frequent, "key")
        .where(F.col("doc_id") < F.col("keeper"))
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("keys"))
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """One row per input row, with the text that is left.

    Returns (doc_id, n_lines, n_dropped, row): `row` is the input row as a struct with its text rewritten, so that no column of the
    input can clash with a result.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.struct("*").alias("row"))
    lost = stage(dropped_keys(columns_of(docs, id_col, text_col), min_chars, min_docs), "lost-lines")
    # A sort-merge join at any size: what documents lose grows with them, so a plan that broadcasts it holds for small inputs only.
    lost = lost.withColumnRenamed("doc_id", "lost_id").hint("merge")
    marked = rows.join(lost, F.col("doc_id") == F.col("lost_id"), "left").drop("lost_id")

    def drop(batches):
        for batch in batches:
            row = pa.RecordBatch.from_struct_array(batch.column("row"))
            texts, before, gone = [], [], []
            for data, keys in zip(texts_of(row, text_col), batch.column("keys").to_pylist(), strict=True):
                lines = data.split(b"\n")
                if keys:
                    keys = set(keys)
                    left = [x for x in lines if line_key(x, min_chars) not in keys]
                    data = b"\n".join(left)
                texts.append(data)
                before.append(len(lines))
                gone.append(len(lines) - len(left) if keys else 0)
            row = row.set_column(row.schema.get_field_index(text_col), text_col, pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(before, pa.int64()), pa.array(gone, pa.int64()), row.to_struct_array()],
                ["doc_id", "n_lines", "n_dropped", "row"],
            )

    kind = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
            T.StructField("row", rows.schema["row"].dataType),
        ]
    )
    return map_rows(marked, drop, kind)
