"""Calibration, overlays, samples, sweeps and the least-intervention choice."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import whatif
from cohortlens.spec import FactSpec

from fixtures import payments, stress_overlay

NOW = (datetime(2024, 3, 10), datetime(2024, 3, 13))


def test_calibration_hand_values(spark):
    # Published relative rates per gateway, their traffic shares and the observed failures.
    rows = [("A", 0.26, 1.85), ("B", 0.27, 2.85), ("C", 0.13, 3.83), ("D", 0.21, 2.39), ("E", 0.13, 3.40)]
    observed = 12376 / 250000
    df = spark.createDataFrame([(g, w, r, observed) for g, w, r in rows], "gateway string, weight double, reference_rate double, observed_rate double")
    got = {r["gateway"]: r for r in whatif.calibrate_rates(df, "gateway").collect()}
    assert sum(r["weight"] * r["failure_probability"] for r in got.values()) == pytest.approx(observed, abs=1e-12)
    assert got["A"]["failure_probability"] == pytest.approx(0.0402, abs=2e-4)
    assert got["C"]["failure_probability"] == pytest.approx(0.0621, abs=2e-4)


def test_added_probability(spark):
    p = F.lit(0.062075)
    eff = whatif.effective_probability(p, F.lit(3.5))
    row = spark.range(1).select(eff.alias("e"), whatif.added_probability(p, eff).alias("a"), whatif.added_probability(p, p).alias("z")).first()
    assert row["e"] == pytest.approx(0.217263, abs=1e-6) and row["a"] == pytest.approx(0.165458, abs=1e-6) and row["z"] == 0.0


def test_overlay_changes_only_members_and_equals_inline_stress(spark):
    spec = FactSpec()
    fact = payments(spark, 3000)
    args = ({"gateway": "gateway_C"}, F.lit(0.05), 6.0, "i", *NOW)
    overlay = stress_overlay(fact, spec, *args)
    assert overlay.where("outcome_changed AND NOT in_affected_cohort").count() == 0
    assert overlay.where("observed_status = 'FAILED' AND status <> 'FAILED'").count() == 0
    inline = whatif.stress(fact, spec, *args).where("overlaid").select("txn_id", "status", "response_code")
    joined = overlay.select("txn_id", "status", "response_code")
    assert inline.exceptAll(joined).count() == 0 and joined.exceptAll(inline).count() == 0 and overlay.where("outcome_changed").count() > 0


def world(spark, elsewhere=False):
    rows = [(1, f"T{i}", float(i % 90 + 10), "gateway_C", "FAILED" if i % 10 == 0 else "SUCCESS", "FAILED" if i % 3 == 0 or i % 10 == 0 else "SUCCESS", 0.3, elsewhere, 100.0) for i in range(1000)]
    cohort = spark.createDataFrame(
        rows, "incident_id int, txn_id string, amount double, gateway string, observed_status string, current_status string, p_current double, degraded_elsewhere boolean, latency_ms double"
    ).withColumn("amount", F.col("amount").cast("decimal(12,2)"))
    incidents = spark.createDataFrame([(1, "gateway_C", "baseline")], "incident_id int, source_gateway string, policy string")
    gates = spark.createDataFrame([("gateway_A", True, "baseline"), ("gateway_B", False, "baseline"), ("gateway_C", True, "baseline")], "gateway string, is_eligible boolean, policy string")
    options = whatif.build_candidates(incidents, gates).withColumn("p_target", F.when(F.col("target_gateway") == "gateway_A", 0.05)).withColumn("multiplier", F.lit(4.0))
    traffic = spark.createDataFrame([("gateway_A", 2000, 5000), ("gateway_B", 2000, 5000), ("gateway_C", 1000, 5000)], "gateway string, window_rows bigint, window_total bigint")
    return cohort, options, traffic


def test_sweep_against_brute_force(spark):
    import hashlib

    cohort, options, traffic = world(spark)
    got = {r["candidate_key"]: r for r in whatif.sweep(cohort, options, traffic).collect()}
    assert set(got) == {"NO_ACTION", "REROUTE_TRAFFIC:gateway_A:10", "REROUTE_TRAFFIC:gateway_A:20", "REROUTE_TRAFFIC:gateway_A:30"}
    rows = cohort.collect()
    order = sorted(rows, key=lambda r: hashlib.sha256(f"{whatif.SELECTION_DOMAIN}|{r['txn_id']}|1".encode()).hexdigest())
    now = sum(r["current_status"] == "FAILED" for r in rows)
    for percent in (10, 20, 30):
        moved = order[: int(len(rows) * percent / 100)]
        row = got[f"REROUTE_TRAFFIC:gateway_A:{percent}"]
        fixed = sum(r["current_status"] == "FAILED" and r["observed_status"] == "SUCCESS" for r in moved)
        assert row["rerouted"] == len(moved) and row["projected_failures"] == pytest.approx(now - fixed)
        assert row["expected_retained"] == pytest.approx(sum(float(r["amount"]) for r in moved) * 0.25, abs=0.01)
        assert row["concentration_after"] == pytest.approx((2000 + len(moved)) / 5000)
    idle = got["NO_ACTION"]
    assert idle["projected_failures"] == idle["baseline_failures"] == now and idle["success_delta"] == 0.0 and idle["expected_retained"] == 0.0
    assert idle["projected_at_risk"] == idle["baseline_at_risk"] and idle["concentration_after"] == 0.4


def test_a_segment_incident_follows_the_moved_rows(spark):
    cohort, options, traffic = world(spark, elsewhere=True)
    row = {r["candidate_key"]: r for r in whatif.sweep(cohort, options, traffic).collect()}["REROUTE_TRAFFIC:gateway_A:30"]
    assert row["expected_retained"] == pytest.approx(float(row["expected_retained"]))
    p_then = 1 - 0.05 * 4
    moved = whatif.moved_groups(cohort, options).where("candidate_key = 'REROUTE_TRAFFIC:gateway_A:30'").collect()
    assert sum(r["n"] for r in moved) == 300 and {round(r["gain"], 6) for r in moved} == {round(0.3 - (1 - p_then), 6)}
    added = (0.05 * 4 - 0.05) / (1 - 0.05)
    lost = sum(r["n"] * r["p_fails"] for r in moved if r["current_status"] == "SUCCESS")
    assert lost == pytest.approx(added * sum(r["n"] for r in moved if r["current_status"] == "SUCCESS"))
    flips = sum(r["n"] * (r["p_fails"] - (r["current_status"] == "FAILED")) for r in moved)
    assert row["projected_failures"] == pytest.approx(row["baseline_failures"] + flips)


def choice(spark, rows):
    df = spark.createDataFrame(rows, "incident_id int, action_type string, candidate_key string, traffic_percentage double, expected_retained double, success_delta double, invalid_reason string")
    return whatif.choose(df).first()


def test_least_intervention(spark):
    idle = (1, "NO_ACTION", "NO_ACTION", 0.0, 0.0, 0.0, None)
    assert choice(spark, [idle, (1, "R", "big", 30.0, 2000.0, 0.1, None), (1, "R", "small", 10.0, 1950.0, 0.1, None)])["chosen"] == "small"
    assert choice(spark, [idle, (1, "R", "big", 30.0, 2000.0, 0.1, None), (1, "R", "small", 10.0, 1500.0, 0.1, None)])["chosen"] == "big"
    assert choice(spark, [idle, (1, "R", "weak", 10.0, 999.0, 0.1, None)])["chosen"] == "NO_ACTION"
    got = choice(spark, [idle, (1, "R", "bad", 10.0, 9999.0, 0.1, "TARGET_NOT_HEALTHY")])
    assert got["chosen"] == "NO_ACTION" and "valid" in got["reason"]


def test_risk_hand_value(spark):
    df = spark.createDataFrame([("R", "HEALTHY", 0.35, 100.0, 264, None)], "action_type string, target_health string, concentration_after double, latency_delta_ms double, population bigint, rca_confidence double")
    row = whatif.assess_risk(df).first()
    assert row["risk_score"] == pytest.approx(0.38625) and row["capacity_risk"] == "UNAVAILABLE"


def test_health_intervals(spark):
    health = spark.createDataFrame(
        [("a", "HEALTHY", 0, 100), ("b", "HEALTHY", 0, 100), ("b", "DEGRADED", 40, 50), ("c", "HEALTHY", 0, 30), ("d", "DEGRADED", 0, 100), ("e", "HEALTHY", 0, 100), ("e", "DEGRADED", 90, 95)],
        "g string, health_state string, valid_from int, valid_to int",
    )
    spans = spark.createDataFrame([(x, 10, 60) for x in "abcdef"], "g string, s int, e int")
    got = {r["g"]: r["target_health"] for r in whatif.health_over_span(spans, health, "g", "s", "e").collect()}
    assert got == {"a": "HEALTHY", "b": "NOT_HEALTHY", "c": "NO_HEALTH_RECORD", "d": "NOT_HEALTHY", "e": "HEALTHY", "f": "NO_HEALTH_RECORD"}
    at = whatif.health_at(spark.createDataFrame([("b", 45), ("c", 20), ("c", 50), ("z", 1)], "g string, t int"), health, "g", "t")
    assert {(r["g"], r["t"]): r["health_state"] for r in at.collect()} == {("b", 45): "HEALTHY", ("c", 20): "HEALTHY", ("c", 50): "HEALTHY", ("z", 1): "none"}
