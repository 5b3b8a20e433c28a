"""Gates fail closed, verification can say no, and unavailable is never zero."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import decide

CANDIDATE = {
    "action_type": "REROUTE_TRAFFIC", "simulation_status": "VALID", "current_fingerprint": "f", "input_fingerprint": "f", "rca_verdict": "CONFIDENT",
    "confidence": 0.8, "evidence_strength": 0.7, "sigma": 9.0, "severity": "HIGH", "alert_role": "PRIMARY", "target_eligible": True,
    "target_health": "HEALTHY", "traffic_percentage": 30.0, "concentration_after": 0.4, "expected_retained": 1000.0,
}
SCHEMA = (
    "action_type string, simulation_status string, current_fingerprint string, input_fingerprint string, rca_verdict string, confidence double, evidence_strength double, "
    "sigma double, severity string, alert_role string, target_eligible boolean, target_health string, traffic_percentage double, concentration_after double, expected_retained double"
)


def decision(spark, **change):
    row = {**CANDIDATE, **change}
    return decide.policy_decision(spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA)).first()


def test_all_gates_pass_at_their_bounds(spark):
    assert decision(spark)["policy_result"] == "PERMITTED"


@pytest.mark.parametrize(
    "change,code",
    [
        ({"simulation_status": "INVALID"}, "SIMULATION_INVALID"), ({"current_fingerprint": "g"}, "STALE_SIMULATION"), ({"rca_verdict": "UNCERTAIN"}, "RCA_NOT_CONFIDENT"),
        ({"confidence": 0.59}, "CONFIDENCE_BELOW_THRESHOLD"), ({"confidence": None}, "CONFIDENCE_BELOW_THRESHOLD"), ({"evidence_strength": 0.49}, "EVIDENCE_STRENGTH_BELOW_THRESHOLD"),
        ({"sigma": None}, "SIGNIFICANCE_BELOW_THRESHOLD"), ({"severity": "MEDIUM"}, "SEVERITY_BELOW_THRESHOLD"), ({"alert_role": None}, "ALERT_NOT_PRIMARY"),
        ({"target_eligible": None}, "TARGET_NOT_ELIGIBLE"), ({"target_health": "NO_HEALTH_RECORD"}, "TARGET_NOT_HEALTHY"), ({"traffic_percentage": 30.5}, "TRAFFIC_SHIFT_EXCEEDS_BOUND"),
        ({"concentration_after": 0.41}, "CONCENTRATION_EXCEEDS_BOUND"), ({"expected_retained": 999.99}, "BENEFIT_BELOW_NO_ACTION_MARGIN"),
    ],
)
def test_each_gate_blocks_alone(spark, change, code):
    row = decision(spark, **change)
    assert row["policy_result"] == "BLOCKED" and row["reason_codes"] == code


def test_no_action_needs_no_case(spark):
    assert decision(spark, action_type="NO_ACTION", confidence=None, severity="NONE", target_eligible=None)["policy_result"] == "PERMITTED"
    assert decision(spark, action_type="NO_ACTION", simulation_status="INVALID")["policy_result"] == "BLOCKED"


@pytest.mark.parametrize(
    "improvement,attainment,ok,want",
    [
        (0.1, 0.9, False, "RECOVERY_NOT_VERIFIED"), (None, None, True, "RECOVERY_NOT_VERIFIED"), (0.0024, 2.0, True, "RECOVERY_NOT_VERIFIED"), (-0.1, 1.0, True, "RECOVERY_NOT_VERIFIED"),
        (0.1, None, True, "PARTIALLY_EFFECTIVE"), (0.1, 0.19, True, "RECOVERY_NOT_VERIFIED"), (0.1, 0.5, True, "PARTIALLY_EFFECTIVE"), (0.1, 0.8, True, "RECOVERY_EFFECTIVE"),
    ],
)
def test_verdicts(spark, improvement, attainment, ok, want):
    df = spark.createDataFrame([(improvement, attainment, ok, "X")], "measured_improvement double, attainment double, integrity_ok boolean, failed_checks string")
    assert decide.outcome_verdict(df).first()["outcome"] == want


def test_zero_projection_has_no_attainment(spark):
    df = spark.createDataFrame([(0.3, 0.2, 0.0, 10.0, 5.0), (0.3, 0.2, 0.2, 10.0, 5.0), (0.3, None, 0.2, 10.0, None)], "pre_failure_rate double, post_failure_rate double, projected_delta double, pre_at_risk double, post_at_risk double")
    a, b, c = decide.measure(df).collect()
    assert a["attainment"] is None and b["attainment"] == pytest.approx(0.5) and b["recovered"] == 5.0
    assert c["measured_improvement"] is None and c["recovered"] is None


def test_transition_audit(spark):
    log = spark.createDataFrame([(1, 1, "DRAFT"), (1, 2, "PERMITTED"), (1, 30, "APPROVED"), (2, 1, "DRAFT"), (2, 40, "BLOCKED")], "r int, t int, s string")
    bad = decide.transition_audit(log, "r", ["t"], "s", F.floor(F.col("t") / 10)).collect()
    assert [(r["r"], r["previous_status"], r["s"]) for r in bad] == [(1, "PERMITTED", "APPROVED")]


def test_empty_batch_is_unavailable_not_zero(spark):
    recs = spark.createDataFrame([], "incident_id int, recommendation_id int, action_type string, policy_result string, expected_retained decimal(18,2)")
    other = spark.createDataFrame([], "status string")
    ver = spark.createDataFrame([], "status string, outcome string, recovered decimal(18,2), transactions_moved bigint")
    row = decide.batch_summary(recs, other, other, ver).first()
    assert row["incidents_evaluated"] == 0 and row["total_projected"] == 0.0
    assert row["intervention_rate"] is None and not row["intervention_rate_available"] and row["recovery_uplift"] is None


def test_citations_need_an_earlier_exposure(spark):
    cited = spark.createDataFrame([(1, 2, 10, False), (1, 2, 11, False), (1, 3, 12, True), (1, 5, 11, False)], "run_id int, turn int, cited_id int, rejected boolean")
    shown = spark.createDataFrame([(1, 10, 1), (1, 11, 4), (1, 11, 4)], "run_id int, exposed_id int, turn int")
    row = decide.citation_metrics(cited, shown).first()
    assert (row["total_claims"], row["grounded_claims"], row["unsupported_claims"], row["blocked_fabrications"]) == (3, 2, 1, 1)
