"""Planted causes: found, ranked, explained; quiet windows stay quiet; residuals against brute force."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import detect, metrics, whatif
from cohortlens.plans import incident
from cohortlens.spec import DetectionConfig, FactSpec, Windows

from fixtures import payments

SPEC = FactSpec(simulated="overlaid")
WINDOWS = Windows(datetime(2024, 3, 10), datetime(2024, 3, 13))
NOW = (WINDOWS.current_start, WINDOWS.current_end)


@pytest.fixture(scope="module")
def fact(spark):
    return payments(spark, 20000).withColumn("overlaid", F.lit(False)).cache()


def planted(fact, *causes):
    for i, (definition, multiplier) in enumerate(causes):
        fact = whatif.stress(fact, SPEC, definition, F.lit(0.05), multiplier, f"incident-{i}", *NOW)
    return fact


@pytest.fixture(scope="module")
def one_cause(fact):
    return incident.analyse_incident(planted(fact, ({"gateway": "gateway_C"}, 6.0)), SPEC, WINDOWS)


def roles(found):
    return {r["cohort_key"]: r["alert_role"] for r in found.classified.collect()}


def test_windows():
    assert WINDOWS.prior_start == datetime(2024, 3, 7)
    with pytest.raises(ValueError):
        Windows(datetime(2024, 3, 10), datetime(2024, 3, 10))
    with pytest.raises(ValueError):
        SPEC.check_dimensions(["colour"])


def test_planted_gateway_is_the_primary_and_the_cause(one_cause):
    got = roles(one_cause.detection)
    assert got["gateway=gateway_C"] == "PRIMARY"
    assert [k for k, r in got.items() if r == "PRIMARY"] == ["gateway=gateway_C"]
    row = one_cause.conclusion.first()
    assert row["verdict"] == "CONFIDENT" and row["predicted_gateway"] == "gateway_C" and row["predicted_type"] == "gateway_degradation"
    assert len(row["alternatives"]) == 4 and one_cause.hypotheses.count() == 5


def test_narrower_cohorts_are_suppressed_by_their_parent(one_cause):
    hidden = one_cause.detection.ranked.where("suppressed").collect()
    assert hidden and all(r["suppressed_by"] == "gateway=gateway_C" for r in hidden if r["cohort_key"].startswith("gateway=gateway_C"))
    reported = one_cause.detection.reported.agg(F.max("rank")).first()[0]
    assert all(r["rank"] > reported for r in hidden)


def test_evidence_is_numbered_and_complete(one_cause):
    rows = one_cause.evidence.collect()
    assert [r["evidence_id"] for r in sorted(rows, key=lambda r: (r["subject_order"], r["type_order"]))] == list(range(1, len(rows) + 1))
    kinds = {r["evidence_type"] for r in rows if r["cohort_key"] == "gateway=gateway_C"}
    assert {"failure_rate", "latency", "response_mix", "control_comparison", "blast_radius", "temporal_alignment", "gmv_impact"} <= kinds


def test_two_independent_causes_both_stay_primary(fact):
    got = roles(incident.detect_incident(planted(fact, ({"gateway": "gateway_C"}, 7.0), ({"gateway": "gateway_A"}, 6.0)), SPEC, WINDOWS))
    assert got["gateway=gateway_C"] == got["gateway=gateway_A"] == "PRIMARY"


def test_issuer_cause_names_no_gateway(fact):
    row = incident.analyse_incident(planted(fact, ({"sender_bank": "SBI"}, 7.0)), SPEC, WINDOWS, roles=False).conclusion.first()
    assert row["predicted_gateway"] is None and row["predicted_segment"] == "sender_bank=SBI"


def test_quiet_window_reports_nothing(fact):
    done = incident.analyse_incident(fact, SPEC, WINDOWS, roles=False)
    assert done.detection.ranked.count() == 0
    row = done.conclusion.first()
    assert row["verdict"] == "INSUFFICIENT_EVIDENCE" and row["root_cause"] is None and row["affected_volume"] == 0


def test_result_does_not_depend_on_row_order(fact, one_cause):
    shuffled = planted(fact, ({"gateway": "gateway_C"}, 6.0)).repartition(3, "amount")
    again = incident.analyse_incident(shuffled, SPEC, WINDOWS, roles=False)
    assert again.fingerprint.first() == one_cause.fingerprint.first()


def test_residuals_match_filtering_even_with_null_dimensions(fact):
    """Subtraction from cells equals removing the rows, with `<>` dropping NULLs as well."""
    holed = planted(fact, ({"gateway": "gateway_C"}, 6.0)).withColumn("region", F.when(F.substring("txn_id", -1, 1) != "3", F.col("region")))
    found = incident.detect_incident(holed, SPEC, WINDOWS, DetectionConfig(min_absolute_delta=0.005, min_sigma=1.0))
    pairs = found.verdicts.collect()
    assert pairs and any(r["confounder_key"].startswith("region=") for r in pairs)
    for r in pairs:
        dim, value = r["confounder_key"].split("=")
        rest = holed.where(F.col(dim) != value)
        for part in r["cohort_key"].split("|"):
            d, x = part.split("=")
            rest = rest.where(F.col(d) == x) if x != "NULL" else rest.where(F.col(d).isNull())
        now = metrics.in_window(F.col("ts"), *NOW)
        bad = F.col("status") == "FAILED"
        want = rest.where(F.col("ts") < F.lit(NOW[1])).agg(
            F.count_if(~now), F.count_if(~now & bad), F.count_if(now), F.count_if(now & bad)
        ).first()
        assert (r["rb_volume"], r["rb_failures"], r["rc_volume"], r["rc_failures"]) == tuple(want), r


def test_cohort_absent_from_baseline_is_not_scanned(fact):
    new = fact.withColumn("network", F.when(metrics.in_window(F.col("ts"), *NOW), F.lit("6G")).otherwise(F.col("network")))
    scored = detect.score_cohorts(metrics.measure(new, SPEC, WINDOWS)[1], SPEC)
    assert scored.where("cohort_key LIKE 'network=%'").count() == 0


def test_population_of_an_empty_window_is_zero(fact):
    row = metrics.population_metrics(fact.where("1 = 0"), SPEC).first()
    assert row["volume"] == 0 and row["failure_rate"] == 0.0 and row["latency_p95"] == 0.0


def test_interpolated_percentile(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 12)], "latency_ms double").select(
        F.lit("t").alias("txn_id"), F.lit(WINDOWS.current_start).alias("ts"), F.lit(1).cast("decimal(12,2)").alias("amount"),
        F.lit("SUCCESS").alias("status"), "latency_ms", F.lit("APPROVED").alias("response_code"), F.lit(False).alias("overlaid"),
        *[F.lit("x").alias(d) for d in SPEC.dims],
    )
    table = metrics.measure(df, SPEC, WINDOWS, sets=[("gateway",)])[1]
    assert {r["latency_p95"] for r in table.collect()} == {10.5}


def test_located_percentiles_equal_buffered_ones(fact):
    spread = fact.withColumn("latency_ms", F.col("latency_ms") * (F.rand(3) - 0.2)).cache()
    cells, table = metrics.measure(spread, SPEC, WINDOWS)
    columns = ["window", "cohort_key", "latency_p50", "latency_p95", "latency_p99"]
    got = {tuple(r)[:2]: tuple(r)[2:] for r in table.select(*columns).collect()}
    rows = metrics.with_windows(metrics.scanned_rows(spread, SPEC, WINDOWS))
    buffered = F.percentile("latency_ms", [0.5, 0.95, 0.99])
    want = {}
    for dims in (*SPEC.dimension_sets, ()):
        for r in rows.groupBy("window", metrics.cohort_key(dims).alias("k")).agg(buffered.alias("p")).collect():
            want[(r["window"], r["k"])] = tuple(r["p"])
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    assert cells.columns[0] == "slice" and "latency_value" not in cells.columns


def test_only_facts_of_open_buckets_are_spread_over_sets(fact):
    """One window, one set and one bucket are open: each fact of that bucket is repeated once, all others never."""
    rows = metrics.scanned_rows(fact.withColumn("latency_ms", F.col("latency_ms") + F.lit(0.25)), SPEC, WINDOWS)
    sets = (*SPEC.dimension_sets, ())
    value = rows.select("slice", F.col("latency_ms").alias("v"), metrics.coarse_bucket(F.col("latency_ms")).alias("b"))
    bucket = value.where("slice = 'current'").groupBy("b").count().orderBy(F.desc("count")).first()["b"]
    everyone = (1 << len(SPEC.dims)) - 1
    wanted = fact.sparkSession.createDataFrame([("current", everyone, "ALL", bucket)], "window string, gid long, cohort_key string, _b long")
    got = metrics.values_in_open_buckets(rows, wanted, SPEC, sets)
    held = value.where((F.col("slice") == "current") & (F.col("b") == bucket)).count()
    assert held > 1 and got.agg(F.sum("_w")).first()[0] == held
    assert {r["cohort_key"] for r in got.select("cohort_key").distinct().collect()} == {"ALL"}
    assert got.count() <= held < rows.count()


def test_facts_without_latency_stay_in_the_counts(fact):
    some = F.when(F.substring("txn_id", -1, 1) != "7", F.col("latency_ms"))
    table = metrics.measure(fact.withColumn("latency_ms", some), SPEC, WINDOWS, sets=[("gateway",)])[1]
    whole = metrics.measure(fact, SPEC, WINDOWS, sets=[("gateway",)])[1]
    counts = ["window", "cohort_key", "volume", "failures", "value_total"]
    assert sorted(map(tuple, table.select(*counts).collect())) == sorted(map(tuple, whole.select(*counts).collect()))
    none = metrics.measure(fact.withColumn("latency_ms", F.lit(None).cast("double")), SPEC, WINDOWS, sets=[("gateway",)])[1]
    assert {r["latency_p95"] for r in none.collect()} == {0.0}


def test_cells_are_bounded_by_dimensions_and_few_latency_buckets(spark):
    """A doubling of the latency gives as many cells as there are steps, however many values and facts it holds."""
    df = spark.range(256, 2048).select(
        F.col("id").cast("string").alias("txn_id"), F.lit(WINDOWS.current_start).alias("ts"), F.lit(1).cast("decimal(12,2)").alias("amount"),
        F.lit("SUCCESS").alias("status"), F.col("id").cast("double").alias("latency_ms"), F.lit("APPROVED").alias("response_code"),
        F.lit(False).alias("overlaid"), *[F.lit("x").alias(d) for d in SPEC.dims],
    )
    assert metrics.bucket_cells(metrics.scanned_rows(df, SPEC, WINDOWS), SPEC).count() <= 3 * 8 + 1
    row = metrics.measure(df, SPEC, WINDOWS, sets=[("gateway",)])[1].where("cohort_key = 'ALL'").first()
    assert (row["volume"], row["latency_p50"], row["latency_p99"]) == (1792, 1151.5, pytest.approx(256 + 0.99 * 1791))


def test_fact_is_computed_once(spark):
    """Latencies that are drawn anew whenever the fact is computed: percentiles fit the cells only if both come from one draw."""
    df = spark.range(3000).select(
        F.col("id").cast("string").alias("txn_id"), F.lit(WINDOWS.current_start).alias("ts"), F.lit(1).cast("decimal(12,2)").alias("amount"),
        F.lit("SUCCESS").alias("status"), F.expr("1000D + abs(hash(uuid()) % 100000) / 1000D").alias("latency_ms"), F.lit("APPROVED").alias("response_code"),
        F.lit(False).alias("overlaid"), *[F.lit("x").alias(d) for d in SPEC.dims],
    )
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    metrics.measure(df.mapInPandas(count, df.schema), SPEC, WINDOWS, sets=[("gateway",)])[1].collect()
    assert seen.value == 3000
