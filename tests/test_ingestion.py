"""Versions and manifest, file identities, ledger and the ingestion job: accept, skip, force, drift, retry, failure before the switch."""

import os
import shutil
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import quality, verification
from cohortlens.plans import ingest
from cohortlens.sources import files, ledger, versions

from fixtures import raw


def rows(spark, n, version=0):
    return spark.range(n).select("id", F.lit(version).alias("version"))


def counts(spark, target, number=None):
    return {r["source_dataset"]: r["count"] for r in versions.read(spark, target, number).groupBy("source_dataset").count().collect()}


# ---------------------------------------------------------------------------------------------------------- versions
def test_a_switch_replaces_one_dataset_and_keeps_history(spark, tmp_path):
    target = str(tmp_path / "facts")
    assert versions.read(spark, target).count() == 0
    versions.publish(rows(spark, 3), target, "one")
    versions.publish(rows(spark, 4), target, "two / ü")
    versions.publish(rows(spark, 5, 1), target, "one")
    assert counts(spark, target) == {"one": 5, "two / ü": 4} and counts(spark, target, 2) == {"one": 3, "two / ü": 4}
    versions.publish(rows(spark, 0), target, "two / ü")
    assert counts(spark, target) == {"one": 5}
    versions.rollback(spark, target, 2)
    assert counts(spark, target) == {"one": 3, "two / ü": 4} and versions.manifest(spark, target).number == 5


def test_other_schemas_are_put_together_by_name(spark, tmp_path):
    target = str(tmp_path / "facts")
    versions.publish(rows(spark, 2), target, "a")
    versions.publish(spark.range(1).select("id", F.lit("x").alias("note"), F.lit("2024").alias("source_dataset")), target, "2024")
    got = {(r["source_dataset"], r["id"], r["version"], r["note"]) for r in versions.read(spark, target).collect()}
    assert got == {("a", 0, 0, None), ("a", 1, 0, None), ("2024", 0, None, "x")}


def test_failure_between_write_and_switch_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "facts")
    versions.publish(rows(spark, 3), target, "one")

    def dies(*_):
        raise RuntimeError("lost the driver")

    with monkeypatch.context() as m:
        m.setattr(versions, "_write_once", dies)
        with pytest.raises(RuntimeError):
            versions.publish(rows(spark, 9), target, "one")
    assert counts(spark, target) == {"one": 3}
    (folder,) = os.listdir(tmp_path / "facts/data")
    assert folder.startswith("source_dataset=one-") and len(os.listdir(tmp_path / "facts/data" / folder)) == 2
    assert len(versions.vacuum(spark, target, least_age=0)) == 1 and counts(spark, target) == {"one": 3}


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    target = str(tmp_path / "facts")
    versions.publish(rows(spark, 1), target, "one")
    mine = versions.write_version(rows(spark, 7), target, "mine")
    calls = []

    def change(m):
        calls.append(m.number)
        if len(calls) == 1:  # somebody else switches between our reading and our writing
            versions.publish(rows(spark, 2), target, "theirs")
        return m.with_version("mine", mine)

    versions.switch(spark, target, change)
    assert calls == [1, 2] and counts(spark, target) == {"one": 1, "theirs": 2, "mine": 7}


def test_vacuum_spares_young_folders(spark, tmp_path):
    target = str(tmp_path / "facts")
    versions.write_version(rows(spark, 2), target, "one")
    versions.publish(rows(spark, 1), target, "one")
    assert versions.vacuum(spark, target) == [] and len(versions.vacuum(spark, target, least_age=0)) == 1


# -------------------------------------------------------------------------------------------------------- identities
def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(data)


TEXT = b"".join(b"line %d of this file\r\n" % (i * i) for i in range(5000)) + b"\xff\xfe not text \x00\n" + b"\n\nend"


def prints(spark, path):
    return {r["name"]: (r["length"], r["lines"], r["sha256"], r["state"]) for r in files.file_fingerprints(spark, str(path)).collect()}


def test_file_identity_depends_on_bytes_alone(spark, tmp_path):
    write(str(tmp_path / "a/one.csv"), TEXT)
    write(str(tmp_path / "a/sub dir/two.csv"), TEXT)
    write(str(tmp_path / "a/changed.csv"), TEXT.replace(b"line 16 ", b"line 17 "))
    write(str(tmp_path / "a/swapped.csv"), TEXT.replace(b"line 16 of this file\r\nline 25 of this file\r\n", b"line 25 of this file\r\nline 16 of this file\r\n"))
    write(str(tmp_path / "a/ended.csv"), TEXT + b"\n")
    write(str(tmp_path / "a/empty.csv"), b"")
    whole = prints(spark, tmp_path / "a")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        split = prints(spark, tmp_path / "a")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert whole == split
    assert whole["one.csv"] == whole["two.csv"] and whole["one.csv"][:2] == (len(TEXT), 5004)
    assert len({x[2] for x in whole.values()}) == 5
    assert whole["empty.csv"][0] == 0 and whole["empty.csv"][3] == "EMPTY"


def test_parts_of_a_file_have_its_identity(spark, tmp_path):
    write(str(tmp_path / "whole/f.csv"), TEXT)
    lines = TEXT.split(b"\n")
    for i, (a, b) in enumerate(((0, 1000), (1000, 1001), (1001, 4999), (4999, len(lines)))):
        write(str(tmp_path / f"parts/part-{i}.csv"), b"\n".join(lines[a:b]) + (b"\n" if b < len(lines) else b""))
    one = files.content_identity(spark, str(tmp_path / "whole")).first()
    many = files.content_identity(spark, str(tmp_path / "parts")).first()
    assert (one["files"], many["files"]) == (1, 4)
    assert tuple(one)[1:] == tuple(many)[1:]


def test_tree_has_the_shape_it_says(spark, tmp_path, monkeypatch):
    """Against a plain loop, with a small fan so that several levels have nodes."""
    from hashlib import sha256

    monkeypatch.setattr(files, "LEAF_LINES", 7)
    monkeypatch.setattr(files, "FAN", 3)
    write(str(tmp_path / "f/f.txt"), TEXT)
    level = {}
    for i, line in enumerate(TEXT.split(b"\n")):
        level[i] = sha256(line).hexdigest()
    for children in (7, 3, 3, 3):
        up = {}
        for i in sorted(level):
            up[i // children] = up.get(i // children, "") + level[i]
        level = {i: sha256(x.encode()).hexdigest() for i, x in up.items()}
    # With a small fan the root is not one node; the test only needs the lowest tree to be whole.
    short = b"\n".join(TEXT.split(b"\n")[:150])
    write(str(tmp_path / "g/g.txt"), short)
    level = {i: sha256(x).hexdigest() for i, x in enumerate(short.split(b"\n"))}
    for children in (7, 3, 3, 3):
        up = {}
        for i in sorted(level):
            up[i // children] = up.get(i // children, "") + level[i]
        level = {i: sha256(x.encode()).hexdigest() for i, x in up.items()}
    assert set(level) == {0}
    want = sha256(f"{len(short)}:150:{level[0]}".encode()).hexdigest()
    assert prints(spark, tmp_path / "g")["g.txt"][2] == want


def moved(df):
    """Bytes that the exchanges of a DataFrame collected without adaptive execution were given."""

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    return sum(n.metrics().apply("dataSize").value() for n in nodes(df._jdf.queryExecution().executedPlan()) if n.nodeName() == "Exchange")


def test_an_identity_moves_leaves_instead_of_lines(spark, tmp_path):
    data = b"".join(b"payment %d\n" % i for i in range(30_000))
    write(str(tmp_path / "one/a.csv"), data)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(data) // 2 + 1))
    try:
        identity = files.content_identity(spark, str(tmp_path / "one"))
        assert identity.collect()[0]["lines"] == 30_000
        # Half of a leaf on either side of the cut between two splits is moved as line digests.
        assert moved(identity) < 30_000 * 8
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_leaves_are_the_same_from_rows_in_any_order(spark):
    lines = spark.range(0, 5000, 1, 3).select(
        F.concat(F.lit("file"), (F.col("id") % 2).cast("string")).alias("_file"), F.expr("id div 2").alias("_line"), F.sha2(F.col("id").cast("string"), 256).alias("_d")
    )
    want = {tuple(r) for r in files._roots(lines.orderBy("_file", "_line"), ["_file"]).collect()}
    assert {x[:2] for x in want} == {("file0", 2500), ("file1", 2500)}
    assert {tuple(r) for r in files._roots(lines, ["_file"]).collect()} == want
    assert {tuple(r) for r in files._roots(lines.repartition(3, "_d"), ["_file"]).collect()} == want


def test_compressed_files_are_identified_by_their_lines(spark, tmp_path):
    import gzip

    write(str(tmp_path / "a/f.csv.gz"), gzip.compress(TEXT, mtime=0))
    write(str(tmp_path / "b/f.csv.gz"), gzip.compress(TEXT.replace(b"line 16 ", b"line 17 "), mtime=0))
    one, other = prints(spark, tmp_path / "a")["f.csv.gz"], prints(spark, tmp_path / "b")["f.csv.gz"]
    assert one[1] == 5004 and one[2] != other[2] and one[0] == len(gzip.compress(TEXT, mtime=0))


# ------------------------------------------------------------------------------------------------------ judged write
def test_one_write_two_folders_and_counts(spark, tmp_path):
    judged = quality.judge_rows(quality.normalize_rows(raw(spark, [{}] * 5 + [{"sender_bank": "Canara"}] * 2), "set"))
    done = quality.write_judged(judged, str(tmp_path / "j"))
    assert (done.rows_read, done.rows_failing, done.passing.count(), done.failing.count()) == (7, 2, 5, 2)
    assert sorted(x for x in os.listdir(tmp_path / "j") if "=" in x) == ["verdict=failing", "verdict=passing"]
    scans = done.passing.select("transaction_id")._jdf.queryExecution().executedPlan().toString()
    assert "raw_record" not in scans and "verdict=failing" not in scans
    clean = quality.write_judged(quality.judge_rows(quality.normalize_rows(raw(spark, [{}]), "set")), str(tmp_path / "k"))
    assert clean.failing.count() == 0 and clean.rows_failing == 0


# ------------------------------------------------------------------------------------------------------ verification
def test_report_is_one_aggregation_with_typed_rows(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", -1.0), (2, None, 2.0)], "id int, kind string, amount double")
    checks = [
        verification.row_count("rows", 3),
        verification.all_distinct("ids", "id"),
        verification.none_of("positive", ~(F.col("amount") > 0), F.col("id")),
        verification.value_counts("kinds", F.col("kind"), {"a": 1, "b": 1}),
        verification.bounds("ids_in", F.col("id"), 1, 2),
        verification.Check("total", F.sum(F.col("amount").cast("decimal(12,2)")), Decimal("6.00")),
        verification.Check("nothing", F.max(F.lit(None).cast("int")), 1),
        verification.Check("elsewhere", F.count_if(F.expr("raise_error('must not run')").isNull()), 0, skipped="another file"),
    ]
    report = verification.verify(df, checks)
    got = {r["name"]: (r["state"], r["value_type"], r["expected"], r["actual"], r["detail"]) for r in report.collect()}
    assert got == {
        "rows": ("PASSED", "integer", "3", "3", ""),
        "ids": ("FAILED", "integer", "0", "1", ""),
        "positive": ("FAILED", "integer", "0", "1", "for example 2"),
        "kinds": ("FAILED", "text", "a=1,b=1,*=0", "a=1,b=1,*=1", ""),
        "ids_in": ("PASSED", "text", "1..2", "1..2", ""),
        "total": ("PASSED", "decimal", "6.00", "6.00", ""),
        "nothing": ("FAILED", "integer", "1", None, ""),
        "elsewhere": ("SKIPPED", "integer", "0", None, "another file"),
    }
    assert tuple(verification.overall(report).first()) == (7, 4, 1, False, "ids, positive, kinds, nothing")
    assert report.columns == list(verification.REPORT)
    with pytest.raises(ValueError):
        verification.verify(df, checks[:1] * 2)


def test_a_report_scans_its_table_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    checks = [verification.row_count("rows", 10), verification.none_of("neg", F.col("id") < 0), verification.bounds("b", F.col("id"), 0, 9)]
    plan = verification.verify(spark.read.parquet(str(tmp_path / "t")), checks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    assert {r["state"] for r in verification.verify(spark.range(0), [verification.row_count("rows", 0)]).collect()} == {"PASSED"}


# --------------------------------------------------------------------------------------------------------- ingestion
def csv(spark, path, overrides, drop=None):
    df = raw(spark, overrides).drop("source_row_index")
    df = df.drop(drop) if drop else df
    df.coalesce(1).write.option("header", True).csv(path)
    return path


def test_accept_skip_force_drift_retry_and_failure_before_the_switch(spark, tmp_path, monkeypatch):
    house = ingest.Warehouse(str(tmp_path / "house"))
    good = csv(spark, str(tmp_path / "good"), [{}] * 6 + [{"sender_bank": "Canara"}, {"transaction id": "D"}, {"transaction id": "D"}])
    with pytest.raises(ingest.UnknownDataset):
        ingest.run_ingestion(spark, good, house)
    assert house.facts(spark).count() == 0
    identity = house.register(spark, good, "pay")
    assert house.register(spark, good, "pay") == identity and house.registry(spark).count() == 1
    with pytest.raises(ingest.UnknownDataset):
        house.register(spark, good, "other")

    first = ingest.run_ingestion(spark, good, house)
    assert (first.status, first.rows_read, first.rows_valid, first.rows_rejected) == (ledger.SUCCEEDED, 9, 6, 3)
    assert counts(spark, house.folder("facts")) == {"pay": 6}
    bad = spark.read.parquet(house.folder("quarantine"))
    assert {r["error_category"] for r in bad.collect()} == {"BANKING", "DUPLICATE_ID"} and all(r["raw_record"]["sender_state"] for r in bad.collect())

    again = ingest.run_ingestion(spark, good, house)
    assert (again.status, again.prior_run_id, again.fingerprint) == (ledger.SKIPPED, first.run_id, first.fingerprint)
    assert versions.manifest(spark, house.folder("facts")).number == 1
    forced = ingest.run_ingestion(spark, good, house, force=True)
    assert (forced.status, forced.fingerprint) == (ledger.SUCCEEDED, first.fingerprint) and counts(spark, house.folder("facts")) == {"pay": 6}

    cut = csv(spark, str(tmp_path / "cut"), [{}] * 4, drop="sender_bank")
    house.register(spark, cut, "cut")
    with pytest.raises(ingest.SchemaDrift):
        ingest.run_ingestion(spark, cut, house)
    garbled = csv(spark, str(tmp_path / "garbled"), [{"amount (INR)": "abc"}] * 4)
    house.register(spark, garbled, "garbled")
    with pytest.raises(ingest.SchemaDrift):
        ingest.run_ingestion(spark, garbled, house)

    # A failure after the version was written and before the switch: the old rows stay, a retry succeeds.
    more = csv(spark, str(tmp_path / "more"), [{}] * 11)
    house.register(spark, more, "more")
    with monkeypatch.context() as m:
        m.setattr(versions, "switch", lambda *_: (_ for _ in ()).throw(RuntimeError("lost the store")))
        with pytest.raises(RuntimeError):
            ingest.run_ingestion(spark, more, house)
    assert counts(spark, house.folder("facts")) == {"pay": 6}
    assert ingest.run_ingestion(spark, more, house).status == ledger.SUCCEEDED
    assert counts(spark, house.folder("facts")) == {"pay": 6, "more": 11}

    # A copy that doesn't pass its checks isn't switched to.
    with monkeypatch.context() as m:
        m.setattr(verification, "payment_checks", lambda rows, audited=None: [verification.row_count("rows", rows + 1)])
        with pytest.raises(ingest.VerificationFailed, match="rows"):
            ingest.run_ingestion(spark, more, house, force=True)
    assert counts(spark, house.folder("facts")) == {"pay": 6, "more": 11}
    states = [r["status"] for r in house.ledger(spark).runs().orderBy("run_id").collect()]
    assert states == [ledger.REFUSED, ledger.SUCCEEDED, ledger.SKIPPED, ledger.SUCCEEDED, ledger.REFUSED, ledger.REFUSED, ledger.FAILED, ledger.SUCCEEDED, ledger.FAILED]
    # Another code version is another key.
    other = ingest.Warehouse(house.root, code_version="2")
    assert ingest.run_ingestion(spark, good, other).status == ledger.SUCCEEDED
    shutil.rmtree(house.root)


def test_missing_and_empty_sources_are_refused(spark, tmp_path):
    house = ingest.Warehouse(str(tmp_path / "house"))
    write(str(tmp_path / "none/a.csv"), b"")
    with pytest.raises(ingest.SourceMissing):
        ingest.run_ingestion(spark, str(tmp_path / "none"), house)
    os.makedirs(tmp_path / "nofile")
    with pytest.raises(ingest.SourceMissing):
        ingest.run_ingestion(spark, str(tmp_path / "nofile"), house)


def test_a_load_leaves_no_judged_copy(spark, tmp_path, monkeypatch):
    from cohortlens.session import checkpoint_dir

    def copies():
        folder = checkpoint_dir(spark).removeprefix("file:")
        return {x for x in os.listdir(folder) if x.startswith("judged-")} if os.path.isdir(folder) else set()

    before = copies()
    done = ingest.load(raw(spark, [{}] * 3 + [{"transaction id": "D"}] * 2), "a", str(tmp_path / "facts"), str(tmp_path / "bad"), "1")
    assert copies() == before and (done.rows_read, done.rows_valid) == (5, 3)
    assert versions.open_version(spark, str(tmp_path / "facts"), done.version).count() == 3 and spark.read.parquet(str(tmp_path / "bad")).count() == 2
    with monkeypatch.context() as m:
        m.setattr(versions, "write_version", lambda *_: (_ for _ in ()).throw(RuntimeError("lost the store")))
        with pytest.raises(RuntimeError):
            ingest.load(raw(spark, [{}] * 3), "a", str(tmp_path / "facts"), str(tmp_path / "bad"), "2")
    assert copies() == before


def test_ids_are_checked_without_sorting_rows_by_them(spark):
    df = raw(spark, [{}, {}, {"transaction id": "T0"}]).withColumnRenamed("transaction id", "transaction_id")
    checks = [verification.row_count("rows", 3), verification.all_distinct("ids", "transaction_id"), verification.none_of("state", F.col("sender_state") == "Goa", F.col("sender_state"))]
    report = verification.verify(df, checks)
    assert "SortAggregate(key=[transaction_id" not in report._jdf.queryExecution().executedPlan().toString()
    assert [(r["position"], r["state"], r["actual"]) for r in report.collect()] == [(1, "PASSED", "3"), (2, "FAILED", "1"), (3, "PASSED", "0")]
    assert [r["actual"] for r in verification.verify(df, checks[1:2]).collect()] == ["1"]


def test_tasks_over_ids_are_small(spark, tmp_path, monkeypatch):
    from cohortlens.session import small_tasks

    names = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "3000")
    try:
        with pytest.raises(RuntimeError):
            with small_tasks(spark):
                assert [spark.conf.get(n) for n in names] == ["3000", str(16 << 20)]
                raise RuntimeError
        assert spark.conf.get(names[0]) == "3000"
    finally:
        spark.conf.unset(names[0])
    assert [spark.conf.get(n) for n in names] == before
    # A file is at least one task's, so files are small, too.
    monkeypatch.setattr(quality, "FILE_ROWS", 2)
    monkeypatch.setattr(versions, "FILE_ROWS", 2)
    judged = quality.write_judged(quality.judge_rows(quality.normalize_rows(raw(spark, [{}] * 5).coalesce(1), "set")), str(tmp_path / "j"))
    assert len([x for x in os.listdir(tmp_path / "j/verdict=passing") if x.startswith("part-")]) == 3 and judged.passing.count() == 5
    one = versions.write_version(rows(spark, 5).coalesce(1), str(tmp_path / "facts"), "one")
    assert len([x for x in os.listdir(tmp_path / "facts/data" / one.folder) if x.startswith("part-")]) == 3 and one.rows == 5


def test_the_dirty_csv_is_packed_and_has_every_row(spark, tmp_path, monkeypatch):
    from cohortlens.catalog import quality_queries, source_queries, tables

    spark.range(1, 61).selectExpr(
        "id AS l_orderkey", "id * 7 AS l_partkey", "id * 3 AS l_suppkey", "CAST(id % 7 AS INT) AS l_linenumber", "substr('ARN', CAST(id % 3 AS INT) + 1, 1) AS l_returnflag",
        "timestamp_seconds(id * 86400) AS l_shipdate",
    ).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(source_queries, "_CSV_ROWS", 25)
    t = tables.Tables(spark, str(tmp_path))
    made = source_queries._source_csv(t)
    want = quality_queries.raw_rows(t).drop("source_row_index")
    for name, without in (("whole", []), ("cut", ["sender_bank"])):
        parts = [x for x in os.listdir(made[name].removeprefix("file:")) if x.startswith("part-")]
        assert len(parts) == 3 and all(x.endswith(".csv.gz") for x in parts)
        got = files.read_text_csv(spark, made[name])
        assert sorted(r["source_row_index"] for r in got.collect()) == list(range(60))
        # As for any CSV, an empty text and a NULL are one.
        plain = [F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in want.columns if c not in without]
        assert sorted(map(str, got.drop("source_row_index").collect())) == sorted(map(str, want.select(*plain).collect()))


def test_audited_content_is_checked_and_other_content_skips_those_checks(spark, tmp_path):
    target, bad = str(tmp_path / "facts"), str(tmp_path / "bad")
    rows_ = raw(spark, [{}] * 3)
    known = {"status_counts": {"SUCCESS": 3}, "method_counts": {"P2M": 3}, "amounts": ("1500.00", "1500.00"), "flagged": 0}
    assert ingest.load(rows_, "a", target, bad, "1", known).passed
    wrong = ingest.load(rows_, "a", target, bad, "2", {**known, "flagged": 1})
    assert not wrong.passed and verification.overall(wrong.report).first()["failures"] == "flagged"
    assert verification.overall(ingest.load(rows_, "a", target, bad, "3").report).first()["skipped"] == 4


def test_abandoned_runs_are_listed(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    log = ledger.Ledger(spark, str(tmp_path / "runs"))
    assert log.runs().count() == 0 and log.prior_success("d", "s", "1", "1") is None
    log.append("1", 1, ledger.RUNNING)
    log.append("2", 1, ledger.RUNNING)
    log.append("2", 2, ledger.FAILED, detail="x")
    later = datetime.now(timezone.utc) + timedelta(hours=1)
    assert [r["run_id"] for r in log.abandoned(later).collect()] == ["1"]
    with pytest.raises(ValueError):
        log.append("3", 1, ledger.RUNNING, colour="red")
