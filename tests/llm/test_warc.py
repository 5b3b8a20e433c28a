import hashlib
import time

import pytest
from pyspark.sql import functions as F, types as T

from cohortlens.llm.warc import MAGIC, candidates, read_warc, write_warc
from cohortlens.session import scratch_path

PAGES = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("digest", T.StringType())]
)
BIG = "<p>größer</p>" * 100
TRAP = "x" * 500 + "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" + "y" * 700


@pytest.fixture
def archive(spark):
    def build(rows, **more):
        to = scratch_path(spark, "warc")
        write_warc(spark.createDataFrame([(*r, "z") for r in rows], PAGES).repartition(2), to, **more)
        return to

    return build


def pages_of(df):
    page = lambda c: F.coalesce(F.regexp_extract(c, r"page:(-?\d+)", 1), F.lit(""))
    return sorted(
        (r["p"], r["payload_bytes"], r["d"], r["record_type"], r["f"] or None)
        for r in df.select(
            page("record_id").alias("p"), "payload_bytes", F.coalesce("block_digest", "digest").alias("d"), "record_type", page("refers_to").alias("f")
        ).collect()
    )


def brute(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        last = max(p for p, _, h in rows if (h or "") == (html or ""))
        again = len(data) >= 1000 and page < last
        out.append((str(page), len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", str(last) if again else None))
    return sorted(out)


ROWS = [(1, "http://a", BIG), (2, "http://b\r\nInjected: 1", BIG), (3, None, BIG), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "t", TRAP), (-9, "t", TRAP)]


@pytest.mark.parametrize("range_bytes", [1 << 22, 700, 64])
def test_round_trip_with_magic_inside_payloads(spark, archive, range_bytes):
    to = archive(ROWS)
    records = read_warc(spark, to, range_bytes=range_bytes)
    assert pages_of(records) == brute(ROWS)
    payloads = {r["record_id"]: r["payload"] for r in records.where("record_type = 'response'").collect()}
    assert bytes(payloads["<urn:page:8>"]).decode() == TRAP and bytes(payloads["<urn:page:3>"]).decode() == BIG


def test_one_large_file_of_many_ranges(spark, archive):
    rows = [(i, f"http://x/{i}", TRAP if i % 3 else f"page {i} " * 150) for i in range(1, 200)]
    to = archive(rows, file_bytes=1 << 30)
    assert pages_of(read_warc(spark, to, range_bytes=1000, payloads=False)) == brute(rows)


def test_records_behind_a_damage_are_not_reached(spark, archive, tmp_path):
    to = archive([(i, "u", "text" * i) for i in range(1, 6)])
    content = b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").load(to).where("path LIKE '%part-%'").collect())
    links = candidates(content)
    broken = content[: links[2][0]] + b"garbage" + content[links[2][0] :]
    (tmp_path / "part-0").write_bytes(broken)
    assert read_warc(spark, str(tmp_path)).count() == 2
    assert content.startswith(MAGIC)


def test_null_ids_repeats_and_empty(spark, archive):
    rows = [(None, "u", BIG), (None, None, None), (3, "u", BIG), (3, "u", BIG)]
    got = pages_of(read_warc(spark, archive(rows)))
    assert [r[3] for r in got] == ["response"] * 4 and [r[0] for r in got] == ["", "", "3", "3"]
    assert read_warc(spark, archive([])).count() == 0


def _sizes(spark, to):
    return sorted(r["length"] for r in spark.read.format("binaryFile").load(to).where("path LIKE '%part-%'").select("length").collect())


def test_files_are_bounded_by_bytes(spark, archive):
    rows = [(i, "u", f"{i} " * 200) for i in range(1, 60)] + [(100 + i, "u", f"{i}" * 3_000_000) for i in range(1, 4)] + [(200, "v" * 5000, "t")]
    to = archive(rows, file_bytes=20_000, large_bytes=2_000)
    sizes = _sizes(spark, to)
    assert len(sizes) > 8 and sizes[-4] < 30_000 and sizes[-3] > 2_900_000 and sizes[-1] < 3_100_000
    assert pages_of(read_warc(spark, to, range_bytes=1 << 16)) == brute(rows)


def test_many_magic_lines_take_linear_time():
    record = lambda body: MAGIC + b"WARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    open_ended = record(MAGIC * 100_000)
    closed = record((b"\r\n\r\n" + MAGIC) * 100_000)
    started = time.process_time()
    for content in (open_ended, closed):
        links = candidates(content + record(b"next"))
        assert links[0][0] == 0 and links[0][2] == len(content) and links[-1][0] == len(content)
    assert time.process_time() - started < 5


def test_a_header_may_name_the_magic():
    content = MAGIC + b"WARC-Target-URI: http://x/WARC/1.0\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert candidates(content) == [(0, len(content) - 6, len(content))]
