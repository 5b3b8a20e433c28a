"""Row rules, quarantine, drift and the ingestion plan on dirty rows."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import text
from cohortlens.operators import quality
from cohortlens.plans import ingest
from cohortlens.sources import files, publish, versions

from fixtures import raw

CASES = [
    ({}, None),
    ({"transaction type": "\u00a0P2M "}, None),
    ({"timestamp": "2024-6-5 1:2:3"}, None),
    ({"transaction type": "P2P", "merchant_category": "Food"}, None),
    ({"transaction id": "  "}, "NORMALIZATION"),
    ({"timestamp": "2024-02-30 10:00:00"}, "NORMALIZATION"),
    ({"amount (INR)": "NaN"}, "NORMALIZATION"),
    ({"fraud_flag": "maybe"}, "NORMALIZATION"),
    ({"timestamp": "2023-12-31 10:00:00"}, "TIMESTAMP"),
    ({"amount (INR)": "-3"}, "AMOUNT"),
    ({"amount (INR)": "42099.01"}, "AMOUNT"),
    ({"transaction_status": "pending"}, "STATUS"),
    ({"network_type": "2G"}, "PAYMENT_CONTEXT"),
    ({"sender_bank": "Canara"}, "BANKING"),
    ({"merchant_category": ""}, "MERCHANT"),
    ({"merchant_category": "Gadgets"}, "MERCHANT"),
    ({"transaction id": "DUP"}, "DUPLICATE_ID"),
    ({"transaction id": " DUP"}, "DUPLICATE_ID"),
    ({"transaction id": "DUP", "sender_bank": "Canara"}, "BANKING"),
]


def judged(spark, overrides):
    return quality.quarantine_duplicates(quality.judge_rows(quality.normalize_rows(raw(spark, overrides), "set")))


def test_every_category(spark):
    got = {r["source_row_index"]: r["error_category"] for r in judged(spark, [c for c, _ in CASES]).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


def test_several_failures_keep_rule_order(spark):
    row = judged(spark, [{"receiver_bank": "Canara", "network_type": "2G", "amount (INR)": "0"}]).first()
    assert row["error_category"] == "AMOUNT"
    assert row["validation_error"] == "amount not positive: 0.00; unknown network: 2G; unknown receiver_bank: Canara"
    assert row["offending_fields"] == ["amount", "network", "receiver_bank"]


def test_duplicates_name_their_count_and_keep_the_raw_row(spark):
    _, rejected = quality.split_rows(judged(spark, [{"transaction id": "D"}] * 3 + [{}]))
    rows = rejected.collect()
    assert len(rows) == 3 and all("appears 3 times" in r["validation_error"] for r in rows)
    assert all(r["raw_record"]["sender_bank"] == "SBI" for r in rows)


def test_method_error_comes_first(spark):
    row = judged(spark, [{"transaction type": " ", "timestamp": "x"}]).first()
    assert row["validation_error"] == "cannot convert payment_method"


def test_header_drift(spark):
    from cohortlens.functions import vocabulary as v

    renamed = ["txn_id" if c == "transaction id" else c for c in v.SOURCE_COLUMNS]
    df = spark.createDataFrame([("ok", list(v.SOURCE_COLUMNS)), ("renamed", renamed), ("twice", [*v.SOURCE_COLUMNS, "amount (INR) "])], "file string, names array<string>")
    got = {r["file"]: r for r in quality.header_drift(df).collect()}
    assert not got["ok"]["fatal"]
    assert got["renamed"]["missing_required"] == ["transaction id"] and got["renamed"]["unexpected"] == ["txn_id"] and got["renamed"]["fatal"]
    assert got["twice"]["duplicated"] == ["amount (INR)"] and got["twice"]["fatal"]


def test_type_drift_needs_half_of_all_rows(spark):
    rows = raw(spark, [{"amount (INR)": f"abc{i % 7}" if i % 3 else "1"} for i in range(42)] + [{"amount (INR)": None}])
    got = quality.type_drift(rows, {"amount (INR)": text.money(F.col("`amount (INR)`"))}).first()
    assert got["changed"] and got["examples"] == [f"abc{i}" for i in range(5)] and got["sampled"] == 43
    late = raw(spark, [{}] * 1500 + [{"amount (INR)": "abc"}] * 1600)
    assert quality.type_drift(late, {"amount (INR)": text.money(F.col("`amount (INR)`"))}).first()["changed"]


def test_ingest_publishes_only_its_partition(spark):
    folder = tempfile.mkdtemp(prefix="ingest-")
    target, bad = os.path.join(folder, "facts"), os.path.join(folder, "bad")
    first = ingest.ingest(raw(spark, [{}, {}, {"sender_bank": "Canara"}]), "one", target, bad, 1)
    ingest.ingest(raw(spark, [{}] * 4), "two", target, bad, 2)
    ingest.ingest(raw(spark, [{}] * 5), "one", target, bad, 3)
    counts = {r["source_dataset"]: r["count"] for r in versions.read(spark, target).groupBy("source_dataset").count().collect()}
    assert first.published and counts == {"one": 5, "two": 4}
    assert spark.read.parquet(bad).count() == 1
    ingest.ingest(raw(spark, [{}, {}, {"sender_bank": "Canara"}]), "one", target, bad, 1)  # a retry
    assert spark.read.parquet(bad).count() == 1
    ingest.ingest(raw(spark, [{"sender_bank": "Canara"}]), "two", target, bad, 4)
    assert {r["source_dataset"] for r in versions.read(spark, target).select("source_dataset").distinct().collect()} == {"one"}


def test_files_are_read_by_their_own_headers(spark):
    folder = tempfile.mkdtemp(prefix="csv-")
    for name, lines in (("a.csv", " x ,y\n1,2\n3,4\n"), ("b.csv", "y,x,z\n20,10,30\n"), ("c.csv", "x,y\n")):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as out:
            out.write(lines)
    rows = files.read_text_csv(spark, folder).orderBy("source_row_index").collect()
    assert [(r["x"], r["y"], r["z"], r["source_row_index"]) for r in rows] == [("1", "2", None, 0), ("3", "4", None, 1), ("10", "20", "30", 2)]


def test_stacked_headers_go_by_position(spark):
    path = tempfile.mkdtemp(prefix="stack-") + "/f.csv"
    with open(path, "w", encoding="utf-8") as out:
        out.write("title,,\nBank,UPI,\nname,count,value\nSBI,1,2\nname,count,value\ntitle,,\n")
    rows = files.read_stacked_header_csv(spark, path)
    assert rows.columns == ["Bank_name", "UPI_count", "UPI_value"] and rows.count() == 3


def test_staging_mismatch_is_seen(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    row = publish.stage_and_verify(df, tempfile.mkdtemp(prefix="stage-") + "/s", 3, "id").first()
    assert row["staged_rows"] == 3 and row["distinct_ids"] == 2 and not row["passed"]


def test_row_index_follows_the_file(spark):
    folder = tempfile.mkdtemp(prefix="csv-") + "/f.csv"
    with open(folder, "w", encoding="utf-8") as out:
        out.write(" a ,b\n" + "".join(f"{i},x{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = files.read_text_csv(spark, folder).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5000 and all(int(r["a"]) == r["source_row_index"] for r in rows)


@pytest.mark.parametrize("encoding,want", [("utf-8", "UTF-8"), ("cp1252", "windows-1252")])
def test_encoding_detection(spark, encoding, want):
    path = tempfile.mkdtemp(prefix="enc-") + "/f.csv"
    with open(path, "w", encoding=encoding) as out:
        out.write("name\ncafé – “x”\n")
    rows, used = files.read_csv_detecting_encoding(spark, path)
    assert used == want and rows.first()["name"] == "café – “x”"


def test_messages_are_counted_with_one_evaluation_of_a_row(spark):
    rows = [("-5", 0, None), ("5", 1, None), ("5", 2, None), ("100", 3, None), ("5", 4, "region")]
    df = spark.createDataFrame(rows, "paid string, source_row_index long, stuck string").select(
        text.money(F.col("paid")).alias("amount"), F.col("stuck").alias("normalization_error"), "source_row_index"
    )
    rules = [r for r in quality.payment_rules() if r.category == "AMOUNT"]
    counted = quality.count_messages(quality.collect_failures(df, rules))
    assert {tuple(r) for r in counted.collect()} == {("amount not positive: -5.00", 1), ("amount outside the audited range: 5.00", 2)}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "amount" in x]


def test_text_with_visible_ends_is_kept_and_white_space_at_one_end_is_not(spark):
    values = ["a", "a b", "!~", " a", "a ", "é", "　é", "a\x1f", "\x7fa", "", " ", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in values], "v string").select(text.clean_text(F.col("v"))).collect()]
    assert got == ["a", "a b", "!~", "a", "a", "é", "é", "a", "\x7fa", None, None, None]
    odd = ["2024-02-30 10:00:00", "2024-3-1 4:5:6", "2024-03-01T04:05:06", "2024-03-01 24:00:00", "2024-03-01 4:5:60", "2024-13-01 1:1:1", "24-03-01 1:1:1", "2024-03-01 1:1:1 UTC"]
    times = [r[0] for r in spark.createDataFrame([(x,) for x in odd], "v string").select(text.local_time(F.col("v")).cast("string")).collect()]
    assert times == [None, "2024-02-29 22:35:06", None, None, None, None, None, None]
