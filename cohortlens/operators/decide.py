"""Rule tables over decisions: policy gates, recommendations, revalidation, lifecycle audits, recovery and verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import digest
from ..functions.stats import rate
from .ranking import bucketed_lag, latest_per_key, nearest_rank_low

# Policy thresholds and lifetimes.
MIN_CONFIDENCE = 0.60
MIN_EVIDENCE_STRENGTH = 0.50
MIN_SIGMA = 6.0
ALLOWED_SEVERITIES = ("CRITICAL", "HIGH")
MAX_SHIFT = 30.0
MAX_CONCENTRATION = 0.40
NO_ACTION_MARGIN = 1000.0
RECOMMENDATION_TTL_MINUTES = 30
APPROVAL_TTL_MINUTES = 15
MIN_IMPROVEMENT = 0.0025
ATTAINMENT_EFFECTIVE = 0.80
ATTAINMENT_FLOOR = 0.20

# Legal recommendation transitions.
LEGAL_TRANSITIONS = (
    ("DRAFT", "PERMITTED"), ("DRAFT", "BLOCKED"), ("DRAFT", "ABANDONED"),
    ("PERMITTED", "AWAITING_APPROVAL"), ("PERMITTED", "SUPERSEDED"), ("PERMITTED", "EXPIRED"), ("PERMITTED", "ABANDONED"),
    ("AWAITING_APPROVAL", "APPROVED"), ("AWAITING_APPROVAL", "REJECTED"), ("AWAITING_APPROVAL", "EXPIRED"), ("AWAITING_APPROVAL", "ABANDONED"),
    ("APPROVED", "EXECUTED"), ("APPROVED", "EXPIRED"), ("APPROVED", "ABANDONED"),
)
# Budgets of one agent run.
MAX_TURNS, MAX_TOOL_CALLS, MAX_SIMULATIONS = 12, 20, 8
TOTAL_BUDGET_MS, TURN_GRACE_MS = 180_000.0, 30_000.0


# --------------------------------------------------------------------------------------------------- policy gates
def policy_gates() -> list[tuple[str, str, Column, Column, str, bool]]:
    """(gate, reason code, passed, observed, required, applies to NO_ACTION). A missing value never passes."""
    c = F.col

    def text(name):
        return c(name).cast("string")

    def at_least(gate, code, name, bound):
        return (gate, code, c(name) >= bound, text(name), f">= {bound}", False)

    def at_most(gate, code, name, bound):
        return (gate, code, c(name) <= bound, text(name), f"<= {bound}", False)

    return [
        ("simulation_status", "SIMULATION_INVALID", c("simulation_status") == "VALID", c("simulation_status"), "VALID", True),
        ("simulation_freshness", "STALE_SIMULATION", c("current_fingerprint") == c("input_fingerprint"), c("current_fingerprint"), "input fingerprint", True),
        ("rca_verdict", "RCA_NOT_CONFIDENT", c("rca_verdict") == "CONFIDENT", c("rca_verdict"), "CONFIDENT", False),
        at_least("rca_confidence", "CONFIDENCE_BELOW_THRESHOLD", "confidence", MIN_CONFIDENCE),
        at_least("evidence_strength", "EVIDENCE_STRENGTH_BELOW_THRESHOLD", "evidence_strength", MIN_EVIDENCE_STRENGTH),
        at_least("significance_sigma", "SIGNIFICANCE_BELOW_THRESHOLD", "sigma", MIN_SIGMA),
        ("severity", "SEVERITY_BELOW_THRESHOLD", c("severity").isin(*ALLOWED_SEVERITIES), c("severity"), "CRITICAL or HIGH", False),
        ("alert_role", "ALERT_NOT_PRIMARY", c("alert_role") == "PRIMARY", c("alert_role"), "PRIMARY", False),
        ("target_eligible", "TARGET_NOT_ELIGIBLE", c("target_eligible"), text("target_eligible"), "true", False),
        ("target_healthy", "TARGET_NOT_HEALTHY", c("target_health") == "HEALTHY", c("target_health"), "HEALTHY over the whole window", False),
        at_most("traffic_shift", "TRAFFIC_SHIFT_EXCEEDS_BOUND", "traffic_percentage", MAX_SHIFT),
        at_most("post_action_concentration", "CONCENTRATION_EXCEEDS_BOUND", "concentration_after", MAX_CONCENTRATION),
        at_least("expected_benefit", "BENEFIT_BELOW_NO_ACTION_MARGIN", "expected_retained", NO_ACTION_MARGIN),
    ]


def gate_table(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One row per candidate and applicable gate: verdict, reason code, observed and required."""
    idle = F.col("action_type") == "NO_ACTION"
    items = []
    for gate, code, passed, observed, required, always in policy_gates():
        ok = F.coalesce(passed, F.lit(False))
        row = F.struct(
            F.lit(gate).alias("gate"), ok.alias("passed"), F.when(~ok, code).alias("reason_code"),
            observed.alias("observed"), F.lit(required).alias("required"),
        )
        items.append(row if always else F.when(~idle, row))
    gates = F.filter(F.array(*items), lambda g: g.isNotNull())
    return candidates.select(*keys, F.explode(gates).alias("g")).select(*keys, "g.*")


def policy_decision(candidates: DataFrame) -> DataFrame:
    """PERMITTED or BLOCKED with every failing reason code, in gate order; a projection, no regrouping."""
    idle = F.col("action_type") == "NO_ACTION"
    codes = [
        F.when((F.lit(True) if always else ~idle) & ~F.coalesce(passed, F.lit(False)), code)
        for _, code, passed, _, _, always in policy_gates()
    ]
    reasons = F.concat_ws(",", *codes)
    return candidates.withColumn("reason_codes", reasons).withColumn(
        "policy_result", F.when(F.col("reason_codes") == "", "PERMITTED").otherwise("BLOCKED")
    )


def recommendations(decided: DataFrame, now: Column) -> DataFrame:
    """Figures copied from candidate and conclusion, a time to live and a content fingerprint."""
    figures = ["incident_id", "action_type", "target_gateway", "traffic_percentage", "expected_retained", "confidence", "severity"]
    content = [F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in figures]
    return decided.select(
        *figures,
        "policy_result",
        "reason_codes",
        F.col("policy_result").alias("status"),
        (now + F.make_dt_interval(mins=F.lit(RECOMMENDATION_TTL_MINUTES))).alias("expires_at"),
        digest("recommendation", *content).alias("recommendation_fingerprint"),
    )


def expire_pending(approvals: DataFrame, now: Column) -> DataFrame:
    """Close pending approvals whose window has passed."""
    late = (F.col("status") == "PENDING") & (F.col("expires_at") < now)
    return approvals.withColumn("expired_now", late).withColumn("status", F.when(F.col("expired_now"), "EXPIRED").otherwise(F.col("status")))


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """Code of the first check that does not hold; NULL when all do. An unknown outcome fails."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in checks])


def revalidate(actions: DataFrame, now: Column, policy_version: str) -> DataFrame:
    """The ordered execution checks over a joined action table; the first failing code rejects."""
    c = F.col
    idle = c("action_type") == "NO_ACTION"
    code = first_failure(
        [
            ("RECOMMENDATION_NOT_FOUND", c("rec_status").isNotNull()),
            ("RECOMMENDATION_NOT_APPROVED", c("rec_status") == "APPROVED"),
            ("APPROVAL_NOT_FOUND", c("approval_recommendation") == c("recommendation_id")),
            ("APPROVAL_NOT_APPROVED", c("approval_status") == "APPROVED"),
            ("APPROVAL_EXPIRED", now <= c("approval_expires_at")),
            ("RECOMMENDATION_EXPIRED", now <= c("rec_expires_at")),
            ("APPROVAL_FINGERPRINT_MISMATCH", c("approval_fingerprint") == c("rec_fingerprint")),
            ("SIMULATION_INVALID", c("simulation_status") == "VALID"),
            ("STALE_SIMULATION", c("current_fingerprint") == c("input_fingerprint")),
            ("POLICY_VERSION_CHANGED", c("rec_policy_version") == policy_version),
            ("POLICY_REVALIDATION_FAILED", c("policy_result") == "PERMITTED"),
            ("TARGET_NOT_HEALTHY", idle | (c("target_health") == "HEALTHY")),
            ("TARGET_NOT_ELIGIBLE", idle | c("target_eligible")),
        ]
    )
    return actions.withColumn("rejection", code).withColumn("executable", F.col("rejection").isNull())


def transition_audit(log: DataFrame, key: str, order: list[str], status: str, bucket: Column, legal=LEGAL_TRANSITIONS) -> DataFrame:
    """Status changes that are not on the legal list; the previous status comes from a lag that never sorts a key whole."""
    moves = bucketed_lag(log, key, order, status, bucket, "previous_status")
    pair = F.concat_ws(">", "previous_status", status)
    allowed = pair.isin(*[f"{a}>{b}" for a, b in legal])
    return moves.where(F.col("previous_status").isNotNull() & ~allowed)


# --------------------------------------------------------------------------------------------------------- recovery
def recovery_state(recs: DataFrame, actions: DataFrame, verifications: DataFrame, approvals: DataFrame) -> DataFrame:
    """Where each incident stands: the furthest artefact of its latest recommendation wins."""
    rec = latest_per_key(recs.select("incident_id", "recommendation_id", "action_type", "policy_result"), ["incident_id"], ["recommendation_id"])
    act = latest_per_key(actions.select("recommendation_id", "action_id", F.col("status").alias("action_status")), ["recommendation_id"], ["action_id"])
    ver = latest_per_key(
        verifications.select("action_id", "verification_id", F.col("status").alias("verification_status"), "outcome"), ["action_id"], ["verification_id"]
    )
    app = latest_per_key(approvals.select("recommendation_id", "approval_id", F.col("status").alias("approval_status")), ["recommendation_id"], ["approval_id"])
    joined = rec.join(act, "recommendation_id", "left").join(ver, "action_id", "left").join(app, "recommendation_id", "left")
    c = F.col
    state = (
        F.when(c("verification_status") == "COMPLETE", "VERIFIED")
        .when(c("action_status") == "EXECUTED", "VERIFYING")
        .when(c("action_status") == "REJECTED", "EXECUTION_REJECTED")
        .when(c("action_status").isNotNull(), c("action_status"))
        .when(c("action_type") == "NO_ACTION", "NO_ACTION")
        .when(F.upper("policy_result") != "PERMITTED", "POLICY_BLOCKED")
        .when(c("approval_status").isNull(), "AWAITING_APPROVAL_REQUEST")
        .when(c("approval_status") == "PENDING", "AWAITING_APPROVAL")
        .when(c("approval_status") == "REJECTED", "APPROVAL_REJECTED")
        .when(c("approval_status") == "EXPIRED", "APPROVAL_EXPIRED")
        .otherwise("APPROVED")
    )
    return joined.select("incident_id", "recommendation_id", "action_id", state.alias("recovery_state"), "outcome")


def measure(actions: DataFrame) -> DataFrame:
    """Measured improvement, recovered value, variance and attainment; missing or zero projections give NULL, never 0."""
    c = F.col
    improvement = F.round(c("pre_failure_rate") - c("post_failure_rate"), 6)
    delta = F.round((1.0 - c("post_failure_rate")) - (1.0 - c("pre_failure_rate")), 6)
    return (
        actions.withColumn("measured_improvement", improvement)
        .withColumn("measured_delta", delta)
        .withColumn("recovered", F.round(c("pre_at_risk") - c("post_at_risk"), 2))
        .withColumn("variance", F.round(F.col("measured_delta") - c("projected_delta"), 6))
        .withColumn("attainment", F.when(c("projected_delta") != 0, F.round(F.col("measured_delta") / c("projected_delta"), 6)))
    )


def integrity_checks(actions: DataFrame) -> DataFrame:
    """Lineage, recomputed fingerprint, presence of every input, and allocation totals conserved."""
    c = F.col
    recomputed = execution_fingerprint()

    def total(name):
        return F.aggregate(F.map_values(c(name)), F.lit(0).cast("bigint"), lambda a, v: a + v)

    checks = {
        "SIMULATION_LINEAGE": c("simulation_id").isNotNull(),
        "EXECUTION_FINGERPRINT": recomputed == c("execution_fingerprint"),
        "COHORT_DEFINITION_PRESENT": c("cohort_definition").isNotNull(),
        "MEASUREMENT_WINDOW_PRESENT": c("window_start").isNotNull(),
        "PRE_ACTION_BASELINE_PRESENT": c("pre_failure_rate").isNotNull(),
        "ACTUAL_OUTCOME_PRESENT": c("post_failure_rate").isNotNull(),
        "POPULATION_STABLE": total("pre_allocation") == total("post_allocation"),
    }
    broken = F.concat_ws(",", *[F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in checks.items()])
    return actions.withColumn("failed_checks", broken).withColumn("integrity_ok", F.col("failed_checks") == "")


def execution_fingerprint() -> Column:
    c = F.col
    return digest(
        "execution", c("recommendation_id").cast("string"), F.coalesce(c("simulation_id").cast("string"), F.lit("NULL")),
        c("traffic_moved").cast("string"), F.coalesce(c("post_at_risk").cast("decimal(18,2)").cast("string"), F.lit("NULL")),
    )


def outcome_verdict(measured: DataFrame) -> DataFrame:
    """Integrity before merit, then the size of the effect, then how much of the projection was attained."""
    m, a, ok = F.col("measured_improvement"), F.col("attainment"), F.col("integrity_ok")
    verdict = (
        F.when(~ok | m.isNull() | (m < MIN_IMPROVEMENT), "RECOVERY_NOT_VERIFIED")
        .when(a.isNull(), "PARTIALLY_EFFECTIVE")
        .when(a < ATTAINMENT_FLOOR, "RECOVERY_NOT_VERIFIED")
        .when(a >= ATTAINMENT_EFFECTIVE, "RECOVERY_EFFECTIVE")
        .otherwise("PARTIALLY_EFFECTIVE")
    )
    reasons = F.concat_ws(
        "; ",
        F.when(~ok, F.concat(F.lit("integrity failed: "), F.col("failed_checks"))),
        F.when(ok & m.isNull(), "no measurable movement"),
        F.when(ok & (m < MIN_IMPROVEMENT), "improvement below the meaningful threshold"),
        F.when(ok & (m >= MIN_IMPROVEMENT), "failure rate improved"),
        F.when(ok & (m >= MIN_IMPROVEMENT) & a.isNull(), "no projection to compare with"),
        F.when(ok & (m >= MIN_IMPROVEMENT) & (a < ATTAINMENT_FLOOR), "attained less than the floor"),
        F.when(ok & (m >= MIN_IMPROVEMENT) & (a >= ATTAINMENT_FLOOR) & (a < ATTAINMENT_EFFECTIVE), "short of the effective bar"),
        F.when(ok & (m >= MIN_IMPROVEMENT) & (a >= ATTAINMENT_EFFECTIVE), "attained the projection"),
    )
    return measured.withColumn("outcome", verdict).withColumn("reasons", reasons)


def to_verify(actions: DataFrame, existing: DataFrame, version: str) -> DataFrame:
    """Executed or rolled-back actions without a verdict under this version; others are ineligible, with the reason."""
    done = existing.where(F.col("model_version") == version).select("action_id")
    fresh = actions.join(done, "action_id", "left_anti")
    eligible = F.col("status").isin("EXECUTED", "ROLLED_BACK")
    return fresh.withColumn("verification_status", F.when(eligible, "COMPLETE").otherwise("INELIGIBLE")).withColumn(
        "ineligible_reason", F.when(~eligible, F.concat(F.lit("status "), F.col("status"), F.lit(" is not verifiable")))
    )


def stale_reasons(recs: DataFrame, now: Column) -> DataFrame:
    """Why a recommendation can no longer be acted on: expired, no simulation, inputs changed."""
    reasons = F.concat_ws(
        ",",
        F.when(now > F.col("rec_expires_at"), "EXPIRED"),
        F.when(F.col("simulation_id").isNull(), "MISSING_SIMULATION"),
        F.when(F.col("simulation_id").isNotNull() & ~F.col("current_fingerprint").eqNullSafe(F.col("input_fingerprint")), "INPUTS_CHANGED"),
    )
    return recs.withColumn("stale_reasons", reasons).withColumn("is_stale", F.col("stale_reasons") != "")


def batch_summary(recs: DataFrame, approvals: DataFrame, actions: DataFrame, verifications: DataFrame) -> DataFrame:
    """Population counts and value totals; each table is reduced on its own, the one-row results are stacked and merged.

    Rates over an empty population are NULL with a flag. A blocked recommendation still adds to the projected total;
    an unverified outcome adds nothing to the recovered one. The two totals are never summed.
    """
    c = F.col
    idle = c("action_type") == "NO_ACTION"
    none = F.lit(0).cast("decimal(18,2)")
    keys = recs.groupBy("incident_id").agg(
        F.count_if(idle).alias("no_action_count"),
        F.count_if(~idle).alias("interventions_proposed"),
        F.count_if(~idle & (F.upper("policy_result") != "PERMITTED")).alias("policy_blocked_count"),
        F.sum(F.when(~idle, c("expected_retained").cast("decimal(18,2)"))).alias("projected"),
    )
    r = keys.agg(
        F.count("incident_id").alias("incidents_evaluated"),
        *[F.sum(n).alias(n) for n in ("no_action_count", "interventions_proposed", "policy_blocked_count")],
        F.sum("projected").alias("total_projected"),
    )

    def counted(df, name, statuses):
        return [F.count_if(c("status") == s).alias(n) for s, n in statuses]

    a = approvals.agg(
        F.count(F.lit(1)).alias("approvals_requested"),
        *counted(approvals, "a", (("APPROVED", "approvals_granted"), ("REJECTED", "approvals_rejected"), ("EXPIRED", "approvals_expired"))),
    )
    x = actions.agg(*counted(actions, "x", (("EXECUTED", "interventions_executed"), ("REJECTED", "executions_rejected"))))
    done = c("status") == "COMPLETE"
    credited = done & c("outcome").isin("RECOVERY_EFFECTIVE", "PARTIALLY_EFFECTIVE")
    v = verifications.agg(
        F.count_if(done).alias("interventions_verified"),
        *[
            F.count_if(done & (c("outcome") == o)).alias(n)
            for o, n in (
                ("RECOVERY_EFFECTIVE", "recovery_effective_count"),
                ("PARTIALLY_EFFECTIVE", "partially_effective_count"),
                ("RECOVERY_NOT_VERIFIED", "recovery_not_verified_count"),
            )
        ],
        F.sum(F.when(credited, c("recovered").cast("decimal(18,2)"))).alias("total_recovered"),
        F.sum(F.when(done, c("transactions_moved"))).alias("transactions_moved"),
    )
    stacked = reduce(lambda p, q: p.unionByName(q, allowMissingColumns=True), (a, x, v), r)
    counts = [n for n in stacked.columns if n not in ("total_projected", "total_recovered")]
    one = stacked.agg(
        *[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in counts],
        *[F.coalesce(F.max(n), none).cast("double").alias(n) for n in ("total_projected", "total_recovered")],
    )
    decisions = c("interventions_proposed") + c("no_action_count")
    rates = {
        "intervention_rate": (c("interventions_proposed"), decisions, decisions > 0),
        "no_action_rate": (c("no_action_count"), decisions, decisions > 0),
        "verification_success_rate": (
            c("recovery_effective_count") + c("partially_effective_count"), c("interventions_verified"), c("interventions_verified") > 0
        ),
        "recovery_uplift": (c("total_recovered"), c("total_projected"), (c("total_projected") > 0) & (c("interventions_verified") > 0)),
    }
    return one.select(
        "*",
        *[F.when(ok, F.round(num / den, 6)).alias(n) for n, (num, den, ok) in rates.items()],
        *[ok.alias(f"{n}_available") for n, (_, _, ok) in rates.items()],
    )


# -------------------------------------------------------------------------------------------------------- run logs
def run_metrics(calls: DataFrame, runs: DataFrame) -> DataFrame:
    """Per agent run: tool use, repeated calls, budgets, latency. `calls` has run_id, tool, request, outcome, latency_ms.

    Repeats are counted from (run, tool, canonical request) groups, so a run of any length is aggregated, not walked.
    """
    distinct = calls.groupBy("run_id", "tool", "request").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") != "SUCCESS").alias("bad"), F.sum("latency_ms").alias("ms")
    )
    per_tool = distinct.groupBy("run_id", "tool").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("ms").alias("ms"), F.sum(F.col("n") - 1).alias("repeats")
    )
    used = per_tool.groupBy("run_id").agg(
        F.sum("n").alias("tool_calls"),
        F.count(F.lit(1)).alias("unique_tools"),
        F.sum("bad").alias("failed_calls"),
        F.sum("repeats").alias("repeated_calls"),
        F.sum(F.when(F.col("tool") == "run_counterfactual", F.col("n")).otherwise(0)).alias("simulations"),
        F.sum("ms").alias("_ms"),
    )
    p95 = nearest_rank_low(calls, ["run_id"], "latency_ms", {"p95": 0.95})
    joined = runs.join(used, "run_id", "left").join(p95, "run_id", "left")
    calls_n = F.coalesce("tool_calls", F.lit(0))
    within = (F.col("turns") <= MAX_TURNS) & (calls_n <= MAX_TOOL_CALLS) & (F.coalesce("simulations", F.lit(0)) <= MAX_SIMULATIONS)
    return joined.select(
        "run_id",
        "turns",
        calls_n.alias("tool_calls"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("unique_tools", "failed_calls", "repeated_calls", "simulations")],
        F.round(F.when(calls_n > 0, (calls_n - F.col("repeated_calls")) / calls_n).otherwise(1.0), 4).alias("tool_efficiency"),
        F.when(calls_n > 0, F.round(F.col("_ms") / calls_n, 1)).alias("mean_latency_ms"),
        F.round("p95", 1).alias("p95_latency_ms"),
        (within & (F.col("elapsed_ms") <= TOTAL_BUDGET_MS + TURN_GRACE_MS)).alias("budget_compliant"),
    )


def citation_metrics(citations: DataFrame, exposures: DataFrame) -> DataFrame:
    """Citations a run's tools had returned by that turn are grounded; a rejected turn's inventions count as blocked.

    `citations`: run_id, turn, cited_id, rejected. `exposures`: run_id, exposed_id, turn. Only the first exposure
    matters, so it is reduced to one row per (run, id) before the join.
    """
    first = exposures.groupBy("run_id", F.col("exposed_id").alias("cited_id")).agg(F.min("turn").alias("_seen"))
    joined = citations.join(first, ["run_id", "cited_id"], "left")
    grounded = F.coalesce(F.col("_seen") <= F.col("turn"), F.lit(False))
    return joined.groupBy("run_id").agg(
        F.count_if(~F.col("rejected")).alias("total_claims"),
        F.count_if(~F.col("rejected") & grounded).alias("grounded_claims"),
        F.count_if(~F.col("rejected") & ~grounded).alias("unsupported_claims"),
        F.count_if(F.col("rejected") & ~grounded).alias("blocked_fabrications"),
    ).withColumn(
        "grounded_rate",
        F.round(F.when(F.col("total_claims") > 0, rate(F.col("grounded_claims"), F.col("total_claims"))).otherwise(1.0), 4),
    )


def replay_divergence(calls: DataFrame, runs: DataFrame, expected_tools: list[str], expected_status: str) -> DataFrame:
    """Recorded runs against an expectation: tools never called and a different final status."""
    used = calls.where(F.col("tool").isin(*expected_tools)).groupBy("run_id").agg(F.collect_set("tool").alias("_used"))
    joined = runs.join(used, "run_id", "left")
    wanted = F.array(*[F.lit(x) for x in expected_tools])
    missing = F.array_sort(F.array_except(wanted, F.coalesce("_used", F.array().cast("array<string>"))))
    return joined.select(
        "run_id",
        F.array_join(missing, ",").alias("missing_tools"),
        (F.col("status") != expected_status).alias("status_differs"),
        ((F.size(missing) == 0) & (F.col("status") == expected_status)).alias("matches"),
    )
