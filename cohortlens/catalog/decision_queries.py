"""Policy, recovery, verification and run logs, on decision tables derived from orders, events and conversations."""

from __future__ import annotations

import re

from pyspark.sql import Window, functions as F

from ..operators import decide, ranking, whatif
from ..plans import incident
from .detect_queries import ROLES_SQL, _found
from .evidence_queries import EVIDENCE_SQL, SUBJECT_SQL, _analysis
from .tables import query
from .whatif_queries import SWEEP_SQL, cohort

VERSION = "policy-1"


# One description of every derived column, as SQL text both engines read; {sha} and {mins} differ in spelling.
def _money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


def _share(x: str, whole: int = 100) -> str:
    return f"CAST({x} AS DOUBLE) / {whole}"


BASE = {
    "k": "o_orderkey",
    "incident_id": "o_custkey",
    "created_at": "o_orderdate",
    "now_at": "o_orderdate + {mins(k % 45)}",
    "action_type": "CASE WHEN k % 7 = 0 THEN 'NO_ACTION' ELSE 'REROUTE_TRAFFIC' END",
    "policy_result": "CASE WHEN k % 7 <> 0 AND k % 5 = 1 THEN 'BLOCKED' ELSE 'PERMITTED' END",
    "expected_retained": _money("o_totalprice"),
    "rec_status": "CASE k % 6 WHEN 2 THEN 'EXPIRED' WHEN 4 THEN 'REJECTED' ELSE 'APPROVED' END",
    "rec_expires_at": "o_orderdate + {mins(30)}",
    "simulation_id": "CASE WHEN k % 41 = 0 THEN NULL ELSE k + 1000000 END",
    "target_gateway": "CASE WHEN k % 7 = 0 THEN NULL ELSE concat('gateway_', substr('ABCDE', CAST(k % 5 + 1 AS INT), 1)) END",
    "traffic_percentage": f"{_share('k % 4 + 1', 1)} * 10",
    "confidence": _share("k % 100"),
    "evidence_strength": _share("k * 7 % 100"),
    "sigma": _share("k % 130", 10),
    "severity": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' WHEN '4' THEN 'LOW' ELSE 'NONE' END",
    "alert_role": "CASE WHEN k % 6 = 0 THEN 'DERIVATIVE' WHEN k % 47 = 0 THEN NULL ELSE 'PRIMARY' END",
    "rca_verdict": "CASE WHEN k % 100 >= 60 THEN 'CONFIDENT' ELSE 'UNCERTAIN' END",
    "concentration_after": _share("k * 3 % 50"),
    "target_health": "CASE WHEN k % 17 = 0 THEN 'NOT_HEALTHY' ELSE 'HEALTHY' END",
    "target_eligible": "k % 19 <> 0",
    "simulation_status": "CASE WHEN k % 23 = 0 THEN 'INVALID' ELSE 'VALID' END",
    "input_fingerprint": "{sha(concat('in|', k))}",
    "current_fingerprint": "{sha(concat('in|', k + CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END))}",
    "rec_fingerprint": "{sha(concat('rec|', k))}",
    "rec_policy_version": "CASE WHEN k % 43 = 0 THEN 'policy-0' ELSE 'policy-1' END",
    "has_approval": "k % 7 <> 0 AND k % 5 <> 1 AND k % 4 <> 0",
    "approval_status": "CASE k % 9 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'EXPIRED' ELSE 'APPROVED' END",
    "approval_expires_at": "o_orderdate + {mins(15 + k % 20)}",
    "approval_fingerprint": "{sha(concat('rec|', k + CASE WHEN k % 31 = 0 THEN 1 ELSE 0 END))}",
    "has_action": "k % 7 <> 0 AND k % 5 <> 1 AND k % 4 <> 0 AND k % 9 > 2 AND k % 3 <> 1",
    "action_status": "CASE k % 10 WHEN 0 THEN 'REJECTED' WHEN 5 THEN 'ROLLED_BACK' ELSE 'EXECUTED' END",
    "pre_failure_rate": _share("k % 40 + 20"),
    "post_failure_rate": f"CASE WHEN k % 53 = 0 THEN NULL ELSE {_share('k % 40 + 20 - (k % 12 - 2)')} END",
    "projected_delta": f"CASE WHEN k % 11 = 0 THEN NULL ELSE {_share('k % 7')} END",
    "pre_at_risk": _money("o_totalprice"),
    "post_at_risk": f"CAST({_money('o_totalprice')} - k % 50 AS DECIMAL(18,2))",
    "traffic_moved": "k % 200",
    "cohort_definition": "CASE WHEN k % 59 = 0 THEN NULL ELSE 'gateway=gateway_C' END",
    "pre_a": "k % 100 + 50",
    "post_a": "k % 100 + 40",
    "post_b": "80 + CASE WHEN k % 37 = 0 THEN 1 ELSE 0 END",
    "recorded_moved": "CASE WHEN k % 61 = 0 THEN k % 200 + 1 ELSE k % 200 END",
    "has_verification": "k % 7 <> 0 AND k % 5 <> 1 AND k % 4 <> 0 AND k % 9 > 2 AND k % 3 <> 1 AND k % 10 <> 0 AND k % 2 = 0",
    "verification_state": "CASE WHEN k % 16 = 6 THEN 'INELIGIBLE' ELSE 'COMPLETE' END",
    "verified_outcome": "CASE k % 3 WHEN 0 THEN 'RECOVERY_EFFECTIVE' WHEN 1 THEN 'PARTIALLY_EFFECTIVE' ELSE 'RECOVERY_NOT_VERIFIED' END",
    "recovered": _money("k % 50"),
}


def _spell(text: str, sha: str, mins: str) -> str:
    """Replace {sha(x)} and {mins(x)} by an engine's own spelling."""
    out = ""
    while "{" in text:
        head, rest = text.split("{", 1)
        body, text = rest.split("}", 1)
        kind, inner = body.split("(", 1)
        out += head + (sha if kind == "sha" else mins).format(inner[:-1])
    return out + text


ORD_SQL = "ord0 AS (SELECT *, o_orderkey AS k FROM orders),\nord AS MATERIALIZED (SELECT " + ", ".join(
    f"{_spell(e, 'sha256({0})', 'to_minutes(CAST({0} AS INTEGER))')} AS {n}" for n, e in BASE.items() if n != "k"
) + ", k FROM ord0)"


def decisions(t):
    """One row per decision, wide."""
    rows = t.orders.withColumn("k", F.col("o_orderkey"))
    text = [f"{_spell(e, 'sha2({0}, 256)', 'make_dt_interval(0, 0, CAST({0} AS INT), 0)')} AS {n}" for n, e in BASE.items() if n != "k"]
    return rows.selectExpr(*text, "k")


def recs(t):
    return decisions(t).select(F.col("k").alias("recommendation_id"), "incident_id", "action_type", "policy_result", "expected_retained")


def approvals(t):
    return decisions(t).where("has_approval").select(
        (F.col("k") * 10).alias("approval_id"), F.col("k").alias("recommendation_id"), F.col("approval_status").alias("status"),
        F.col("approval_expires_at").alias("expires_at"), "now_at",
    )


def actions(t):
    return decisions(t).where("has_action").select((F.col("k") * 100).alias("action_id"), F.col("k").alias("recommendation_id"), F.col("action_status").alias("status"))


def verifications(t):
    return decisions(t).where("has_verification").select(
        (F.col("k") * 1000).alias("verification_id"), (F.col("k") * 100).alias("action_id"), F.col("verification_state").alias("status"),
        F.col("verified_outcome").alias("outcome"), "recovered", F.col("traffic_moved").alias("transactions_moved"), F.lit("v1").alias("model_version"),
    )


# ----------------------------------------------------------------------------------------------------------- gates
# Gate names, reason codes and bounds, in the order they are reported.
_GATES = [
    ("simulation_status", "SIMULATION_INVALID", "simulation_status = 'VALID'", True),
    ("simulation_freshness", "STALE_SIMULATION", "current_fingerprint = input_fingerprint", True),
    ("rca_verdict", "RCA_NOT_CONFIDENT", "rca_verdict = 'CONFIDENT'", False),
    ("rca_confidence", "CONFIDENCE_BELOW_THRESHOLD", "confidence >= 0.60", False),
    ("evidence_strength", "EVIDENCE_STRENGTH_BELOW_THRESHOLD", "evidence_strength >= 0.50", False),
    ("significance_sigma", "SIGNIFICANCE_BELOW_THRESHOLD", "sigma >= 6.0", False),
    ("severity", "SEVERITY_BELOW_THRESHOLD", "severity IN ('CRITICAL', 'HIGH')", False),
    ("alert_role", "ALERT_NOT_PRIMARY", "alert_role = 'PRIMARY'", False),
    ("target_eligible", "TARGET_NOT_ELIGIBLE", "target_eligible", False),
    ("target_healthy", "TARGET_NOT_HEALTHY", "target_health = 'HEALTHY'", False),
    ("traffic_shift", "TRAFFIC_SHIFT_EXCEEDS_BOUND", "traffic_percentage <= 30.0", False),
    ("post_action_concentration", "CONCENTRATION_EXCEEDS_BOUND", "concentration_after <= 0.40", False),
    ("expected_benefit", "BENEFIT_BELOW_NO_ACTION_MARGIN", "expected_retained >= 1000.0", False),
]
GATES_SQL = f"""{ORD_SQL}, gates AS ({' UNION ALL '.join(
    f"SELECT k, {i} AS i, '{g}' AS gate, coalesce({test}, false) AS passed, '{code}' AS code FROM ord" + ("" if always else " WHERE action_type <> 'NO_ACTION'")
    for i, (g, code, test, always) in enumerate(_GATES))}),
decided AS (SELECT k, coalesce(string_agg(code, ',' ORDER BY i) FILTER (NOT passed), '') AS reason_codes, CASE WHEN bool_and(passed) THEN 'PERMITTED' ELSE 'BLOCKED' END AS gate_result FROM gates GROUP BY 1)"""


@query("g01_policy_gates", f"WITH {GATES_SQL} SELECT gate, passed, CASE WHEN NOT passed THEN code END AS reason_code, count(*) AS rows FROM gates GROUP BY ALL")
def _(t):
    return decide.gate_table(decisions(t), ["k"]).groupBy("gate", "passed", "reason_code").agg(F.count(F.lit(1)).alias("rows"))


@query("g02_policy_decision", f"WITH {GATES_SQL} SELECT k, gate_result AS policy_result, reason_codes FROM decided")
def _(t):
    return decide.policy_decision(decisions(t).drop("policy_result")).select("k", "policy_result", "reason_codes")


@query(
    "g03_recommendations",
    f"""WITH {GATES_SQL} SELECT k AS incident_id, o.action_type, o.target_gateway, d.gate_result AS policy_result, d.gate_result AS status, o.now_at + INTERVAL '30' MINUTE AS expires_at,
  sha256('recommendation|' || concat_ws('|', k, o.action_type, coalesce(o.target_gateway, 'NULL'), o.traffic_percentage, o.expected_retained, o.confidence, o.severity)) AS recommendation_fingerprint
FROM ord o JOIN decided d USING (k)""",
)
def _(t):
    decided = decide.policy_decision(decisions(t).drop("policy_result", "incident_id").withColumn("incident_id", F.col("k")))
    return decide.recommendations(decided, F.col("now_at")).select(
        "incident_id", "action_type", "target_gateway", "policy_result", "status", "expires_at", "recommendation_fingerprint"
    )


@query(
    "g04_expiry_sweep",
    f"""WITH {ORD_SQL} SELECT CASE WHEN approval_status = 'PENDING' AND approval_expires_at < now_at THEN 'EXPIRED' ELSE approval_status END AS status,
  approval_status = 'PENDING' AND approval_expires_at < now_at AS expired_now, count(*) AS rows FROM ord WHERE has_approval GROUP BY 1, 2""",
)
def _(t):
    return decide.expire_pending(approvals(t), F.col("now_at")).groupBy("status", "expired_now").agg(F.count(F.lit(1)).alias("rows"))


# Rejection codes, in the order they are tested.
_CHECKS = [
    ("RECOMMENDATION_NOT_APPROVED", "rec_status = 'APPROVED'"), ("APPROVAL_NOT_FOUND", "has_approval"), ("APPROVAL_NOT_APPROVED", "approval_status = 'APPROVED'"),
    ("APPROVAL_EXPIRED", "now_at <= approval_expires_at"), ("RECOMMENDATION_EXPIRED", "now_at <= rec_expires_at"), ("APPROVAL_FINGERPRINT_MISMATCH", "approval_fingerprint = rec_fingerprint"),
    ("SIMULATION_INVALID", "simulation_status = 'VALID'"), ("STALE_SIMULATION", "current_fingerprint = input_fingerprint"), ("POLICY_VERSION_CHANGED", "rec_policy_version = 'policy-1'"),
    ("POLICY_REVALIDATION_FAILED", "policy_result = 'PERMITTED'"), ("TARGET_NOT_HEALTHY", "action_type = 'NO_ACTION' OR target_health = 'HEALTHY'"), ("TARGET_NOT_ELIGIBLE", "action_type = 'NO_ACTION' OR target_eligible"),
]


@query(
    "g05_bulk_revalidation",
    f"""WITH {ORD_SQL} SELECT k, CASE {' '.join(f"WHEN NOT coalesce({test}, false) THEN '{code}'" for code, test in _CHECKS)} END AS rejection FROM ord""",
)
def _(t):
    recs_ = decisions(t).withColumn("recommendation_id", F.col("k"))
    side = decisions(t).where("has_approval").select(
        F.col("k").alias("approval_recommendation"), *["approval_status", "approval_expires_at", "approval_fingerprint"]
    )
    joined = recs_.drop("approval_status", "approval_expires_at", "approval_fingerprint").join(
        side, F.col("recommendation_id") == F.col("approval_recommendation"), "left"
    )
    return decide.revalidate(joined, F.col("now_at"), VERSION).select("k", "rejection")


_LEGAL = (("view", "click"), ("click", "purchase"), ("signup", "view"), ("view", "view"), ("purchase", "view"))


@query(
    "g06_transition_audit",
    f"""WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_status FROM events)
SELECT user_id, event_id, previous_status, event_type FROM l WHERE previous_status IS NOT NULL AND previous_status || '>' || event_type NOT IN ({', '.join(f"'{a}>{b}'" for a, b in _LEGAL)})""",
)
def _(t):
    log = t.events.select("user_id", "event_id", "event_type", "ts")
    bad = decide.transition_audit(log, "user_id", ["ts", "event_id"], "event_type", F.date_trunc("day", "ts"), _LEGAL)
    return bad.select("user_id", "event_id", "previous_status", "event_type")


RECOVERY_SQL = """CASE WHEN r.has_verification AND r.verification_state = 'COMPLETE' THEN 'VERIFIED' WHEN r.has_action AND r.action_status = 'EXECUTED' THEN 'VERIFYING'
  WHEN r.has_action AND r.action_status = 'REJECTED' THEN 'EXECUTION_REJECTED' WHEN r.has_action THEN r.action_status WHEN r.action_type = 'NO_ACTION' THEN 'NO_ACTION'
  WHEN r.policy_result <> 'PERMITTED' THEN 'POLICY_BLOCKED' WHEN NOT r.has_approval THEN 'AWAITING_APPROVAL_REQUEST' WHEN r.approval_status = 'PENDING' THEN 'AWAITING_APPROVAL'
  WHEN r.approval_status = 'REJECTED' THEN 'APPROVAL_REJECTED' WHEN r.approval_status = 'EXPIRED' THEN 'APPROVAL_EXPIRED' ELSE 'APPROVED' END"""


@query(
    "g07_recovery_state",
    f"""WITH {ORD_SQL}, r AS (SELECT * FROM ord QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY k DESC) = 1)
SELECT incident_id, k AS recommendation_id, CASE WHEN has_action THEN k * 100 END AS action_id, {RECOVERY_SQL} AS recovery_state, CASE WHEN has_verification THEN verified_outcome END AS outcome FROM r""",
)
def _(t):
    return decide.recovery_state(recs(t), actions(t), verifications(t), approvals(t))


@query(
    "g08_pre_post_metrics",
    f"""WITH {SWEEP_SQL} SELECT incident_id, count(*) AS population, round(count(*) FILTER (observed_status = 'FAILED') / count(*)::DOUBLE, 6) AS post_failure_rate,
  round(count(*) FILTER (current_status = 'FAILED') / count(*)::DOUBLE, 6) AS pre_failure_rate, CAST(coalesce(sum(amount) FILTER (current_status = 'FAILED'), 0) AS DOUBLE) AS pre_at_risk FROM cohort GROUP BY 1""",
)
def _(t):
    pairs = cohort(t).select(
        "incident_id", "amount", F.lit(False).alias("rerouted"), "current_status", F.col("observed_status").alias("projected_status"),
        F.col("latency_ms").alias("current_latency_ms"), F.col("latency_ms").alias("projected_latency_ms"),
    )
    table = whatif.impact_of_pairs(pairs, ["incident_id"])
    n = F.col("population")
    return table.select(
        "incident_id", "population", F.round(F.col("projected_failures") / n, 6).alias("post_failure_rate"),
        F.round(F.col("baseline_failures") / n, 6).alias("pre_failure_rate"), F.col("baseline_at_risk").cast("double").alias("pre_at_risk"),
    )


# ---------------------------------------------------------------------------------------------------- verification
def executed(t):
    rows = decisions(t).where("has_action")
    alloc = [F.create_map(F.lit("A"), F.col(a).cast("bigint"), F.lit("B"), F.col(b).cast("bigint") if b else F.lit(70).cast("bigint")) for a, b in (("pre_a", None), ("post_a", "post_b"))]
    rows = rows.withColumn("recommendation_id", F.col("k")).withColumn("window_start", F.col("created_at"))
    recorded = rows.withColumn("_moved", F.col("traffic_moved")).withColumn("traffic_moved", F.col("recorded_moved"))
    recorded = recorded.withColumn("execution_fingerprint", decide.execution_fingerprint()).withColumn("traffic_moved", F.col("_moved")).drop("_moved")
    return recorded.withColumn("pre_allocation", alloc[0]).withColumn("post_allocation", alloc[1])


MEASURE_SQL = f"""{ORD_SQL}, act AS (SELECT * FROM ord WHERE has_action),
meas AS (
  SELECT *, round(pre_failure_rate - post_failure_rate, 6) AS measured_improvement, round((1.0::DOUBLE - post_failure_rate) - (1.0::DOUBLE - pre_failure_rate), 6) AS measured_delta,
    round(CAST(pre_at_risk - post_at_risk AS DOUBLE), 2) AS recovered_value,
    concat_ws(',', CASE WHEN simulation_id IS NULL THEN 'SIMULATION_LINEAGE' END, CASE WHEN recorded_moved <> traffic_moved THEN 'EXECUTION_FINGERPRINT' END,
      CASE WHEN cohort_definition IS NULL THEN 'COHORT_DEFINITION_PRESENT' END, CASE WHEN post_failure_rate IS NULL THEN 'ACTUAL_OUTCOME_PRESENT' END,
      CASE WHEN pre_a + 70 <> post_a + post_b THEN 'POPULATION_STABLE' END) AS failed_checks FROM act
),
attained AS (SELECT *, CASE WHEN projected_delta <> 0 THEN round(measured_delta / projected_delta, 6) END AS attainment FROM meas)"""


@query(
    "v01_measured_outcome",
    f"""WITH {MEASURE_SQL} SELECT k, measured_improvement, measured_delta, recovered_value, round(measured_delta - projected_delta, 6) AS variance, attainment FROM attained""",
)
def _(t):
    return decide.measure(executed(t).drop("recovered")).select(
        "k", "measured_improvement", "measured_delta", F.col("recovered").cast("double").alias("recovered_value"), "variance", "attainment"
    )


@query("v02_integrity_checks", f"WITH {MEASURE_SQL} SELECT k, failed_checks, failed_checks = '' AS integrity_ok FROM meas")
def _(t):
    return decide.integrity_checks(executed(t)).select("k", "failed_checks", "integrity_ok")


@query(
    "v03_outcome_verdict",
    f"""WITH {MEASURE_SQL} SELECT k, CASE WHEN failed_checks <> '' OR measured_improvement IS NULL OR measured_improvement < 0.0025 THEN 'RECOVERY_NOT_VERIFIED' WHEN attainment IS NULL THEN 'PARTIALLY_EFFECTIVE'
  WHEN attainment < 0.20 THEN 'RECOVERY_NOT_VERIFIED' WHEN attainment >= 0.80 THEN 'RECOVERY_EFFECTIVE' ELSE 'PARTIALLY_EFFECTIVE' END AS outcome FROM attained""",
)
def _(t):
    return decide.outcome_verdict(decide.measure(decide.integrity_checks(executed(t)))).select("k", "outcome")


@query(
    "v04_verification_eligibility",
    f"""WITH {ORD_SQL} SELECT k * 100 AS action_id, action_status AS status, CASE WHEN action_status IN ('EXECUTED', 'ROLLED_BACK') THEN 'COMPLETE' ELSE 'INELIGIBLE' END AS verification_status FROM ord WHERE has_action AND NOT has_verification""",
)
def _(t):
    return decide.to_verify(actions(t), verifications(t), "v1").select("action_id", "status", "verification_status")


@query(
    "v05_stale_recommendations",
    f"""WITH {ORD_SQL} SELECT k, concat_ws(',', CASE WHEN now_at > rec_expires_at THEN 'EXPIRED' END, CASE WHEN simulation_id IS NULL THEN 'MISSING_SIMULATION' END,
  CASE WHEN simulation_id IS NOT NULL AND current_fingerprint <> input_fingerprint THEN 'INPUTS_CHANGED' END) AS stale_reasons FROM ord""",
)
def _(t):
    return decide.stale_reasons(decisions(t), F.col("now_at")).select("k", "stale_reasons")


@query(
    "a14_batch_summary",
    f"""WITH {ORD_SQL}, s AS (SELECT count(DISTINCT incident_id) AS incidents_evaluated, count(*) FILTER (action_type = 'NO_ACTION') AS no_action_count, count(*) FILTER (action_type <> 'NO_ACTION') AS interventions_proposed,
  count(*) FILTER (action_type <> 'NO_ACTION' AND policy_result <> 'PERMITTED') AS policy_blocked_count, count(*) FILTER (has_approval) AS approvals_requested,
  count(*) FILTER (has_approval AND approval_status = 'APPROVED') AS approvals_granted, count(*) FILTER (has_approval AND approval_status = 'REJECTED') AS approvals_rejected,
  count(*) FILTER (has_approval AND approval_status = 'EXPIRED') AS approvals_expired, count(*) FILTER (has_action AND action_status = 'EXECUTED') AS interventions_executed,
  count(*) FILTER (has_action AND action_status = 'REJECTED') AS executions_rejected, count(*) FILTER (has_verification AND verification_state = 'COMPLETE') AS interventions_verified,
  count(*) FILTER (has_verification AND verification_state = 'COMPLETE' AND verified_outcome = 'RECOVERY_EFFECTIVE') AS recovery_effective_count,
  count(*) FILTER (has_verification AND verification_state = 'COMPLETE' AND verified_outcome = 'PARTIALLY_EFFECTIVE') AS partially_effective_count,
  count(*) FILTER (has_verification AND verification_state = 'COMPLETE' AND verified_outcome = 'RECOVERY_NOT_VERIFIED') AS recovery_not_verified_count,
  CAST(sum(expected_retained) FILTER (action_type <> 'NO_ACTION') AS DOUBLE) AS total_projected,
  CAST(sum(recovered) FILTER (has_verification AND verification_state = 'COMPLETE' AND verified_outcome <> 'RECOVERY_NOT_VERIFIED') AS DOUBLE) AS total_recovered,
  CAST(sum(traffic_moved) FILTER (has_verification AND verification_state = 'COMPLETE') AS BIGINT) AS transactions_moved FROM ord)
SELECT *, round(interventions_proposed / (interventions_proposed + no_action_count)::DOUBLE, 6) AS intervention_rate, round(no_action_count / (interventions_proposed + no_action_count)::DOUBLE, 6) AS no_action_rate,
  round((recovery_effective_count + partially_effective_count) / interventions_verified::DOUBLE, 6) AS verification_success_rate, round(total_recovered / total_projected, 6) AS recovery_uplift FROM s""",
)
def _(t):
    table = decide.batch_summary(recs(t), approvals(t), actions(t), verifications(t))
    return table.select(*[c for c in table.columns if not c.endswith("_available")])


# --------------------------------------------------------------------------------------------------------- ranking
@query("w09_latest_per_key", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(t):
    return ranking.latest_per_key(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("w10_evidence_page", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') > 25 AS truncated FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    rows = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")
    page = rows.limit(26)
    # One row more than shown tells whether anything was left out; the page is at most 26 rows.
    position = F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey"))
    size = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return page.withColumn("n", position).withColumn("truncated", size > 25).where("n <= 25").select("o_orderkey", "o_totalprice", "truncated")


@query(
    "w12_duplicate_claims",
    """WITH r AS (SELECT l_orderkey AS idempotency_key, l_shipdate AS requested_at, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS request_id FROM lineitem),
w AS (SELECT idempotency_key, arg_min(request_id, (requested_at, request_id)) AS claimed_by FROM r GROUP BY 1)
SELECT CASE WHEN request_id = claimed_by THEN 'CLAIMED' ELSE 'DUPLICATE_EXECUTION' END AS claim, count(*) AS rows, min(request_id) AS lowest, max(claimed_by) AS highest FROM r JOIN w USING (idempotency_key) GROUP BY 1""",
)
def _(t):
    requests = t.lineitem.select(
        F.col("l_orderkey").alias("idempotency_key"), F.col("l_shipdate").alias("requested_at"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("request_id")
    )
    marked = ranking.claim_winners(requests, "idempotency_key", "requested_at", "request_id")
    return marked.groupBy("claim").agg(F.count(F.lit(1)).alias("rows"), F.min("request_id").alias("lowest"), F.max("claimed_by").alias("highest"))


# ----------------------------------------------------------------------------------------------------------- joins
@query(
    "j10_incident_overview",
    """SELECT c_custkey AS incident_id, o.o_orderkey AS run_id, o.o_totalprice AS sigma FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0) o ON o_custkey = c_custkey
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) = 1""",
)
def _(t):
    runs = t.orders.where("o_orderstatus = 'F' AND o_orderkey % 3 = 0").select(F.col("o_custkey").alias("incident_id"), F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("sigma"))
    best = ranking.latest_per_key(runs.withColumn("neg", -F.col("run_id")), ["incident_id"], ["sigma", "neg"]).drop("neg")
    return t.customer.select(F.col("c_custkey").alias("incident_id")).join(best, "incident_id", "left")


@query(
    "j11_lineage_chain",
    f"""WITH {ORD_SQL} SELECT k * 100 AS action_id, k * 10 AS approval_id, k AS recommendation_id, simulation_id, incident_id, c_name AS source_name, sha256(c_name) AS source_hash
FROM ord JOIN customer ON c_custkey = incident_id WHERE has_action""",
)
def _(t):
    chain = (
        actions(t).select("action_id", "recommendation_id")
        .join(approvals(t).select("recommendation_id", "approval_id"), "recommendation_id")
        .join(decisions(t).select(F.col("k").alias("recommendation_id"), "simulation_id", "incident_id"), "recommendation_id")
        .join(t.customer.select(F.col("c_custkey").alias("incident_id"), F.col("c_name").alias("source_name")), "incident_id")
    )
    return chain.select("action_id", "approval_id", "recommendation_id", "simulation_id", "incident_id", "source_name", F.sha2("source_name", 256).alias("source_hash"))


@query(
    "j13_evidence_to_anomaly",
    f"""{EVIDENCE_SQL} SELECT e.evidence_id, e.cohort_key, r.rank::INTEGER AS rank, r.suppressed_by AS parent FROM evid e JOIN ranked r USING (cohort_key)""",
)
def _(t):
    done = _analysis(t)
    return done.evidence.select("evidence_id", "cohort_key").join(done.detection.ranked.select("cohort_key", "rank", F.col("suppressed_by").alias("parent")), "cohort_key")


@query(
    "j14_handoff",
    ROLES_SQL + "," + re.sub(r"\bresidual\b", "residual_e", SUBJECT_SQL.replace("residual_counts", "residual_counts_e"))
    + " SELECT c.cohort_key, c.alert_role, c.derived_from, coalesce(string_agg(e.evidence_id::VARCHAR, ',' ORDER BY e.evidence_id), '') AS evidence_ids FROM classified c LEFT JOIN evid e USING (cohort_key) GROUP BY ALL",
)
def _(t):
    return incident.handoff(_found(t), _analysis(t)).select(
        "cohort_key", "alert_role", "derived_from", F.array_join(F.transform("evidence", lambda e: e["evidence_id"].cast("string")), ",").alias("evidence_ids")
    )


# -------------------------------------------------------------------------------------------------------- run logs
TOOLS = ("get_incident_context", "get_detection_evidence", "get_gateway_health", "run_counterfactual", "propose_action")


def calls(t):
    i = ((F.col("conv_id") + F.col("turn")) % 5).cast("int")
    return t.conversations.where("role = 'assistant'").select(
        F.col("conv_id").alias("run_id"), "turn", F.element_at(F.array(*[F.lit(x) for x in TOOLS]), i + 1).alias("tool"), (F.length("text") % 3).cast("string").alias("request"),
        F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, "TIMEOUT").otherwise("SUCCESS").alias("outcome"), F.length("text").cast("double").alias("latency_ms"),
    )


def runs(t):
    return t.conversations.groupBy(F.col("conv_id").alias("run_id")).agg(
        F.count(F.lit(1)).alias("turns"), (F.sum(F.length("text")) * 100).cast("double").alias("elapsed_ms")
    ).withColumn("status", F.when(F.col("run_id") % 3 == 0, "FAILED").otherwise("SUCCEEDED"))


CALLS_SQL = f"""calls AS (SELECT conv_id AS run_id, turn, (['{"', '".join(TOOLS)}'])[(conv_id + turn) % 5 + 1] AS tool, (length(text) % 3)::VARCHAR AS request,
  CASE WHEN (conv_id + turn) % 4 = 0 THEN 'TIMEOUT' ELSE 'SUCCESS' END AS outcome, length(text)::DOUBLE AS latency_ms FROM conversations WHERE role = 'assistant'),
runs AS (SELECT conv_id AS run_id, count(*) AS turns, (sum(length(text)) * 100)::DOUBLE AS elapsed_ms, CASE WHEN conv_id % 3 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status FROM conversations GROUP BY 1, 4)"""


@query(
    "a16_run_metrics",
    f"""WITH {CALLS_SQL}, d AS (SELECT run_id, sum(n - 1) AS repeats FROM (SELECT run_id, tool, request, count(*) AS n FROM calls GROUP BY 1, 2, 3) GROUP BY 1),
r AS (SELECT run_id, latency_ms, row_number() OVER (PARTITION BY run_id ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM calls),
p AS (SELECT run_id, max(latency_ms) FILTER (rn = floor(0.95 * (n - 1)) + 1) AS p95 FROM r GROUP BY 1),
c AS (SELECT run_id, count(*) AS tool_calls, count(DISTINCT tool) AS unique_tools, count(*) FILTER (outcome <> 'SUCCESS') AS failed_calls, count(*) FILTER (tool = 'run_counterfactual') AS simulations, sum(latency_ms) AS ms FROM calls GROUP BY 1)
SELECT runs.run_id, turns, coalesce(tool_calls, 0) AS tool_calls, coalesce(unique_tools, 0) AS unique_tools, coalesce(failed_calls, 0) AS failed_calls, CAST(coalesce(repeats, 0) AS BIGINT) AS repeated_calls, coalesce(simulations, 0) AS simulations,
  round(CASE WHEN coalesce(tool_calls, 0) > 0 THEN (tool_calls - repeats) / tool_calls::DOUBLE ELSE 1.0 END, 4) AS tool_efficiency, round(ms / tool_calls, 1) AS mean_latency_ms, round(p95, 1) AS p95_latency_ms,
  turns <= 12 AND coalesce(tool_calls, 0) <= 20 AND coalesce(simulations, 0) <= 8 AND elapsed_ms <= 210000 AS budget_compliant
FROM runs LEFT JOIN c USING (run_id) LEFT JOIN d USING (run_id) LEFT JOIN p USING (run_id)""",
)
def _(t):
    return decide.run_metrics(calls(t), runs(t))


@query(
    "a16_citation_grounding",
    """WITH cit AS (SELECT conv_id AS run_id, turn, (conv_id * 7 + turn * 3) % 10 AS cited_id, turn % 5 = 0 AS rejected FROM conversations WHERE role = 'user'),
exp AS (SELECT conv_id AS run_id, min(turn) AS seen, (conv_id * 7 + (turn + 1) * 3) % 10 AS cited_id FROM conversations WHERE role = 'assistant' AND turn % 4 <> 3 GROUP BY 1, 3),
j AS (SELECT c.run_id, rejected, coalesce(e.seen <= c.turn, false) AS grounded FROM cit c LEFT JOIN exp e USING (run_id, cited_id))
SELECT run_id, count(*) FILTER (NOT rejected) AS total_claims, count(*) FILTER (NOT rejected AND grounded) AS grounded_claims, count(*) FILTER (NOT rejected AND NOT grounded) AS unsupported_claims,
  count(*) FILTER (rejected AND NOT grounded) AS blocked_fabrications, round(CASE WHEN count(*) FILTER (NOT rejected) > 0 THEN count(*) FILTER (NOT rejected AND grounded) / (count(*) FILTER (NOT rejected))::DOUBLE ELSE 1.0 END, 4) AS grounded_rate FROM j GROUP BY 1""",
)
def _(t):
    c = F.col("conv_id")
    cited = t.conversations.where("role = 'user'").select(c.alias("run_id"), "turn", ((c * 7 + F.col("turn") * 3) % 10).alias("cited_id"), (F.col("turn") % 5 == 0).alias("rejected"))
    shown = t.conversations.where("role = 'assistant' AND turn % 4 <> 3").select(c.alias("run_id"), "turn", ((c * 7 + (F.col("turn") + 1) * 3) % 10).alias("exposed_id"))
    return decide.citation_metrics(cited, shown)


@query(
    "a17_run_replay",
    f"""WITH {CALLS_SQL}, u AS (SELECT run_id, list(DISTINCT tool) AS used FROM calls GROUP BY 1),
m AS (SELECT runs.run_id, status, array_to_string(list_sort(list_filter(['get_gateway_health', 'run_counterfactual'], lambda x: NOT list_contains(coalesce(used, []), x))), ',') AS missing_tools FROM runs LEFT JOIN u USING (run_id))
SELECT run_id, missing_tools, status <> 'SUCCEEDED' AS status_differs, missing_tools = '' AND status = 'SUCCEEDED' AS matches FROM m""",
)
def _(t):
    return decide.replay_divergence(calls(t), runs(t), ["get_gateway_health", "run_counterfactual"], "SUCCEEDED")
