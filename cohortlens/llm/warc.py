"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing. Each page is one record with an HTTP header block and its html in UTF-8. Of pages with equal payloads of at
least `min_bytes`, the one with the largest id is a response; the others are revisit records, which carry the header block, the payload's
digest and the id of the response. Record ids are derived from page ids, so a retried task writes the same record. Spark's text
writer puts the records down with CRLF CRLF between them, so archives can be written wherever Spark can.

Reading. The magic line that starts a record can also stand inside a payload, so finding it proves nothing. For each place where it stands
behind two line ends and a header with a content length follows, a task emits the offset and the offset of the record that would follow. Inside a range
of `range_bytes`, such links are followed at once to the first offset beyond the range. Pointer jumping then doubles the known ranges: from
the offsets that file starts lead to, each round goes twice as far, so rounds grow with the logarithm of the ranges in a
file. Only records that the chain from offset 0 reaches are kept. A chain that breaks (truncated or damaged file) ends there.

Archives are read through the binaryFile source: one file is one cell and must be below 2 GB. The writer therefore bounds files by bytes:
pages below `large_bytes` go at most `file_bytes` / `large_bytes` to a file, the others are written apart, as many to a file as the largest
of them allows. Bytes are kept as they are, so payloads in other encodings survive.

Null html is an empty payload, a null url an empty one; tabs and line ends in urls are percent-encoded, other
control characters become question marks. Repeated rows are written as often as they come; those that repeat the response's id are
responses, too. Pages without an id are responses without a record id, and no other page refers to them.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_rows, stage

MAGIC = b"WARC/1.0\r\n"
MIN_BYTES = 1000
#: A file holds about this many payload bytes at most, or one record.
FILE_BYTES = 1 << 29
#: Payloads from here on are written to files of their own.
LARGE_BYTES = 1 << 19
RANGE_BYTES = 1 << 22
#: Archives carry this date; the pages have none.
DATE = "2000-01-01T00:00:00Z"


def choose_responses(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is the response's id for pages that revisit it."""
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"),
        F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # Compared by SHA-256 besides the digest that archives carry, since SHA-1 can be made to collide.
    rows = rows.withColumn("same", F.sha2(F.col("html"), 256))
    large = F.octet_length("html") >= min_bytes
    groups = (
        rows.where(large & F.col("page_id").isNotNull())
        .groupBy("same")
        .agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("same").alias("key"), "response")
    )
    # Only groups of two or more are joined; adaptive execution broadcasts them if they are few and splits a hot one.
    found = rows.join(stage(groups, "responses"), F.col("same") == F.col("key"), "left")
    refers = F.when(large & (F.col("page_id") < F.col("response")), F.col("response"))
    return found.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def _weight() -> F.Column:
    """Bytes of a record's parts that have no bound of their own: the payload and the url, of which a byte may become three."""
    html, url = (F.coalesce(F.octet_length(c).cast("long"), F.lit(0)) for c in ("html", "url"))
    return html + 3 * url


def _record_id(page_id) -> F.Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def record_text(rows: DataFrame) -> DataFrame:
    """One string column `value`: a record without the CRLF CRLF at its end."""
    eol = "\r\n"
    size = F.octet_length("html")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), size.cast("string"), F.lit(eol + eol)
    )
    revisit = F.col("refers_to").isNotNull()
    url = F.col("url")
    for char, code in (("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        url = F.replace(url, F.lit(char), F.lit(code))
    url = F.regexp_replace(url, r"[\x00-\x1F\x7F]", "?")
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    head = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.coalesce(F.concat(F.lit(f"{eol}WARC-Record-ID: "), _record_id(F.col("page_id"))), F.lit("")),
        F.lit(f"{eol}WARC-Date: {DATE}{eol}WARC-Target-URI: "),
        url,
        F.lit(f"{eol}WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(
            revisit,
            F.concat(
                F.lit(f"{eol}WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest{eol}WARC-Refers-To: "),
                _record_id(F.col("refers_to")),
            ),
        ).otherwise(""),
        F.lit(f"{eol}Content-Type: application/http; msgtype=response{eol}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(eol + eol),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = MIN_BYTES,
    file_bytes: int = FILE_BYTES,
    large_bytes: int = LARGE_BYTES,
) -> None:
    rows = choose_responses(pages, id_col, url_col, html_col, min_bytes)
    texts = pages.select(pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    largest = texts.agg(F.max(_weight())).first()[0] or 0

    def put(some: DataFrame, most: int, mode: str) -> None:
        writer = record_text(some).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, file_bytes // most))
        writer.mode(mode).text(folder)

    if largest < large_bytes:
        put(rows, large_bytes, "error")
    else:
        put(rows.where(_weight() < large_bytes), large_bytes, "error")
        put(rows.where(_weight() >= large_bytes), largest, "append")


_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*(?=\r\n)", re.I)


def candidates(content: bytes) -> list[tuple[int, int, int]]:
    """(offset, end of header, offset behind the record) wherever a record may start and a header with a length follows.

    A record starts the file or stands behind the two line ends that close the one before it. So no header
    reaches into the next candidate, and the work follows the bytes however many magic lines a payload holds.
    """
    out, at = [], 0 if content.startswith(MAGIC) else -1
    if at < 0:
        at = _next_start(content, 0)
    while at >= 0:
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            break
        found = _LENGTH.search(content, at, end + 2)
        if found:
            after = end + 4 + int(found[1]) + 4
            if after <= len(content):
                out.append((at, end + 4, after))
        at = _next_start(content, end)
    return out


def _next_start(content: bytes, since: int) -> int:
    at = content.find(b"\r\n\r\n" + MAGIC, since)
    return at + 4 if at >= 0 else -1


_FOUND = (
    "file string, offset long, next long, exit long, record_type string, record_id string, url string, digest string, "
    "refers_to string, payload_bytes long, payload binary, block_digest string"
)


def _header(raw: bytes) -> dict[bytes, str]:
    out = {}
    for line in raw.split(b"\r\n"):
        name, _, value = line.partition(b":")
        out[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    return out


def _candidates(spark: SparkSession, folder: str, range_bytes: int, payloads: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0")
    names = [x.split()[0] for x in _FOUND.split(", ")]
    kinds = {"offset": pa.int64(), "next": pa.int64(), "exit": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                links = candidates(content)
                exits: dict[int, int] = {}
                for at, _, after in reversed(links):
                    inside = after // range_bytes == at // range_bytes
                    exits[at] = exits.get(after, after) if inside else after
                rows = []
                for at, body, after in links:
                    head = _header(content[at:body])
                    block = content[body : after - 4]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    fields = _header(http)
                    size = len(payload)
                    revisit = head.get(b"warc-type") == "revisit"
                    if revisit and fields.get(b"content-length", "").isdigit():
                        size = int(fields[b"content-length"])
                    own = None if revisit else hashlib.sha1(payload).hexdigest()
                    rows.append(
                        (path, at, after, exits[at], head.get(b"warc-type"), head.get(b"warc-record-id"), head.get(b"warc-target-uri"),
                         (head.get(b"warc-payload-digest") or "").removeprefix("sha1:") or None, head.get(b"warc-refers-to"), size,
                         payload if payloads and not revisit else None, own)
                    )
                cols = [pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(cols, names)

    return map_rows(files.select("path", "content"), run, _FOUND)


def _entries(links: DataFrame) -> DataFrame:
    """(file, offset): where the chain from each file's start enters each of its ranges.

    links: (file, offset, exit). Pointer jumping: after k rounds `reached` holds the first 2^k entries and `jump` leads 2^k ranges on.
    """
    reached, jump = stage(links.where("offset = 0").select("file", "offset"), "reached"), links
    n = reached.count()
    while True:
        step = reached.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reached = stage(reached.union(step).distinct(), "reached")
        if (now := reached.count()) == n:
            return reached
        n = now
        far = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("far"))
        jump = stage(jump.join(far, ["file", "exit"]).select("file", "offset", F.col("far").alias("exit")), "jump")


def _walk(key, table):  # without type hints, which Spark would take for those of another kind of function
    """Records of one range that the chain passes, from the place where it enters the range."""
    follows, at = {}, []
    for offset, after in zip(table["offset"].to_pylist(), table["next"].to_pylist(), strict=True):
        if after is None:
            at.append(offset)
        else:
            follows[offset] = after
    passed = []
    for offset in at:
        while offset in follows:
            passed.append(offset)
            offset = follows[offset]
    return pa.table({"file": pa.array([key[0].as_py()] * len(passed), pa.string()), "offset": pa.array(passed, pa.int64())})


def read_warc(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """Records of all archives: file, offset, record_type, record_id, url, digest, refers_to, payload_bytes, payload, block_digest.

    digest is the one the header states, block_digest the one of the payload as read. payload_bytes of a revisit is that of the
    payload it stands for, as its header block says; its payload and block_digest are null.
    """
    found = stage(_candidates(spark, folder, range_bytes, payloads), "candidates")
    entries = _entries(found.select("file", "offset", "exit"))
    parts = found.select("file", "offset", "next").union(entries.select("file", "offset", F.lit(None).cast("long")))
    # A group is a range of one file, so its size is bounded.
    part = F.floor(F.col("offset") / range_bytes)
    passed = parts.groupBy("file", part.alias("part")).applyInArrow(_walk, "file string, offset long")
    return found.join(passed, ["file", "offset"]).drop("next", "exit")
