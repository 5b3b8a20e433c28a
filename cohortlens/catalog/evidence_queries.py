"""Evidence, explanations and conclusions on the planted cause and on a quiet window."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribute, detect, evidence
from ..plans import incident
from ..spec import DetectionConfig
from .detect_queries import DETECT_SQL
from .tables import (
    FACT, PLANTED_FACT, WINDOWS, metrics_sql, payments, planted, query, shared, residual_sql, scored_sql, windowed_sql, z_sql, FACT_SQL,
)

CONFIG = DetectionConfig()
DIMS = FACT.dims

SUBJECT_SQL = f"""
best AS MATERIALIZED (SELECT * FROM reported WHERE depth = 1 QUALIFY row_number() OVER (PARTITION BY dim_set ORDER BY rank) = 1),
subj AS MATERIALIZED (
  SELECT r.*, CAST(CASE WHEN r.rank <= 5 THEN r.rank ELSE CASE r.dim_set
    {' '.join(f"WHEN '{d}' THEN {6 + i}" for i, d in enumerate(DIMS))} END END AS INTEGER) AS subject_order
  FROM reported r WHERE r.rank <= 5 OR r.cohort_key IN (SELECT cohort_key FROM best)
),
lead_conf AS MATERIALIZED (
  SELECT s.cohort_key, {', '.join(f's.{d} AS s_{d}' for d in DIMS)}, s.absolute_delta, b.cohort_key AS confounder_key,
    b.dim_set AS conf_dim, string_split(b.cohort_key, '=')[2] AS conf_value
  FROM subj s JOIN best b ON b.dim_set <> s.dim_set
  QUALIFY row_number() OVER (PARTITION BY s.cohort_key ORDER BY b.rank) = 1
),
{residual_sql('lead_conf').strip()},
ctl AS MATERIALIZED (
  SELECT s.cohort_key,
    sum(m.volume) FILTER (m."window" = 'baseline') AS b_volume, sum(m.failures) FILTER (m."window" = 'baseline') AS b_failures,
    sum(m.volume) FILTER (m."window" = 'current') AS c_volume, sum(m.failures) FILTER (m."window" = 'current') AS c_failures
  FROM subj s JOIN metrics m ON m.dim_set = s.dim_set AND m.cohort_key <> s.cohort_key GROUP BY s.cohort_key
),
peer AS MATERIALIZED (
  SELECT s.cohort_key, count(*) FILTER (o.b_volume > 0) AS comparable, count(*) FILTER (o.absolute_delta >= 0.02) AS moved
  FROM subj s JOIN scored o ON o.dim_set = s.dim_set AND o.cohort_key <> s.cohort_key GROUP BY s.cohort_key
),
wide AS MATERIALIZED (
  SELECT s.*, round(ctl.b_failures / ctl.b_volume::DOUBLE, 6) AS ctl_b, round(ctl.c_failures / ctl.c_volume::DOUBLE, 6) AS ctl_c,
    {z_sql('ctl.b_failures', 'ctl.b_volume', 'ctl.c_failures', 'ctl.c_volume')} AS ctl_z,
    ctl.c_volume AS ctl_volume, ctl.c_failures AS ctl_failures,
    peer.comparable, peer.moved, (peer.moved + 1) / (peer.comparable + 1)::DOUBLE AS radius,
    p.volume AS p_volume, p.failure_rate AS p_rate, {z_sql('p.failures', 'p.volume', 's.c_failures', 's.c_volume')} AS p_z,
    r.confounder_key, r.independence AS kept, r.residual_delta, r.residual_sigma,
    r.rb_failures / r.rb_volume::DOUBLE AS rb_rate, r.rc_failures / r.rc_volume::DOUBLE AS rc_rate,
    {z_sql('s.b_infra', 's.b_volume', 's.c_infra', 's.c_volume')} AS infra_z
  FROM subj s JOIN ctl USING (cohort_key) JOIN peer USING (cohort_key)
  LEFT JOIN metrics p ON p.cohort_key = s.cohort_key AND p."window" = 'prior' AND p.volume > 0
  LEFT JOIN (SELECT * FROM residual WHERE NOT residual_missing) r ON r.cohort_key = s.cohort_key
),
tall AS MATERIALIZED (
  SELECT subject_order, 0 AS type_order, 'failure_rate' AS evidence_type, 'failure_rate' AS metric_name, cohort_key,
    b_failure_rate AS baseline_value, c_failure_rate AS current_value, absolute_delta AS delta, relative_delta, sigma, c_source_layer AS source_layer FROM wide
  UNION ALL SELECT subject_order, 1, 'latency', 'latency_p95', cohort_key, b_latency_p95, c_latency_p95, c_latency_p95 - b_latency_p95,
    CASE WHEN b_latency_p95 <> 0 THEN (c_latency_p95 - b_latency_p95) / b_latency_p95 ELSE 0 END, NULL, c_source_layer FROM wide
  UNION ALL SELECT subject_order, 2, 'response_mix', 'infrastructure_side_rate', cohort_key, b_infra_rate, c_infra_rate, c_infra_rate - b_infra_rate,
    CASE WHEN b_infra_rate <> 0 THEN (c_infra_rate - b_infra_rate) / b_infra_rate ELSE 0 END, infra_z, c_source_layer FROM wide
  UNION ALL SELECT subject_order, 3, 'control_comparison', 'control_failure_rate', cohort_key, ctl_b, ctl_c, ctl_c - ctl_b,
    CASE WHEN ctl_b <> 0 THEN (ctl_c - ctl_b) / ctl_b ELSE 0 END, ctl_z, c_source_layer FROM wide
  UNION ALL SELECT subject_order, 4, 'blast_radius', 'blast_radius', cohort_key, NULL, radius, NULL, NULL, NULL, c_source_layer FROM wide
  UNION ALL SELECT subject_order, 5, 'temporal_alignment', 'failure_rate_vs_preceding_window', cohort_key, p_rate, c_failure_rate, c_failure_rate - p_rate,
    CASE WHEN p_rate <> 0 THEN (c_failure_rate - p_rate) / p_rate ELSE 0 END, p_z, c_source_layer FROM wide WHERE p_volume > 0
  UNION ALL SELECT subject_order, 6, 'confounding_check', 'independence_from_' || confounder_key, cohort_key, rb_rate, rc_rate, residual_delta, kept,
    residual_sigma, c_source_layer FROM wide WHERE confounder_key IS NOT NULL
  UNION ALL SELECT subject_order, 7, 'gmv_impact', 'gmv_at_risk', cohort_key, b_value_at_risk::DOUBLE, c_value_at_risk::DOUBLE,
    (c_value_at_risk - b_value_at_risk)::DOUBLE,
    CASE WHEN b_value_at_risk <> 0 THEN (c_value_at_risk::DOUBLE - b_value_at_risk::DOUBLE) / b_value_at_risk::DOUBLE ELSE 0 END, NULL, 'OBSERVED' FROM wide
),
evid AS MATERIALIZED (SELECT row_number() OVER (ORDER BY subject_order, type_order) AS evidence_id, * FROM tall)"""
EVIDENCE_SQL = f"{DETECT_SQL},{SUBJECT_SQL}"
VALUES = ("baseline_value", "current_value", "delta", "relative_delta", "sigma")


@shared
def _analysis(t):
    return incident.analyse_incident(planted(t), PLANTED_FACT, WINDOWS, CONFIG, roles=False)


def _reported(t):
    return _analysis(t).detection.reported


@query("w02_evidence_subjects", f"""{EVIDENCE_SQL} SELECT subject_order, cohort_key, CAST(rank AS INTEGER) AS rank FROM subj""")
def _(t):
    return evidence.subjects(_reported(t), PLANTED_FACT).select("subject_order", "cohort_key", "rank")


@query("w03_best_per_dimension", f"""{EVIDENCE_SQL} SELECT dim_set, cohort_key, round(score, 6) AS score FROM best""")
def _(t):
    return evidence.best_per_dimension(_reported(t)).select("dim_set", "cohort_key", F.round("score", 6).alias("score"))


@query("w04_leading_confounder", f"""{EVIDENCE_SQL} SELECT cohort_key, confounder_key FROM lead_conf""")
def _(t):
    reported = _reported(t)
    return evidence.leading_confounders(evidence.subjects(reported, PLANTED_FACT), reported, PLANTED_FACT).select(
        "cohort_key", "confounder_key"
    )


def _evidence_query(name: str, kind: str | None) -> None:
    """One query per evidence type, and one for the whole table."""
    where = f"WHERE evidence_type = '{kind}'" if kind else ""
    rounded = ", ".join(f"round({v}, 6) AS {v}" for v in VALUES)

    @query(name, f"""{EVIDENCE_SQL} SELECT evidence_id, subject_order, evidence_type, metric_name, cohort_key, {rounded}, source_layer FROM evid {where}""")
    def _(t):
        tall = _analysis(t).evidence
        tall = tall.where(F.col("evidence_type") == kind) if kind else tall
        return tall.select(
            "evidence_id", "subject_order", "evidence_type", "metric_name", "cohort_key",
            *[F.round(v, 6).alias(v) for v in VALUES], "source_layer",
        )


for _i, _kind in enumerate(
    ("failure_rate", "latency", "response_mix", "control_comparison", "blast_radius", "temporal_alignment", "confounding_check", "gmv_impact", None)
):
    _evidence_query(f"e{_i + 1:02d}_{_kind or 'evidence_table'}", _kind)


def _clamp(x: str, low: str = "0.0", high: str = "1.0") -> str:
    return f"least(greatest({x}, {low}), {high})"


_KINDS = ("failure_rate", "response_mix", "control_comparison", "blast_radius", "temporal_alignment", "confounding_check")
HYPOTHESIS_SQL = f"""
ids AS MATERIALIZED (SELECT cohort_key, {', '.join(f"max(evidence_id) FILTER (evidence_type = '{k}') AS id_{k}" for k in _KINDS)} FROM evid GROUP BY cohort_key),
frame(hypothesis_type, dim) AS (VALUES ('gateway_degradation', 'gateway'), ('issuer_degradation', 'sender_bank'),
  ('payment_method_degradation', 'payment_method'), ('network_segment_degradation', 'network')),
part AS MATERIALIZED (
  SELECT f.hypothesis_type, f.dim, w.*, i.* EXCLUDE (cohort_key), {_clamp('w.sigma / 12.0')} AS signal,
    {_clamp('(w.absolute_delta - (w.ctl_c - w.ctl_b)) / w.absolute_delta')} AS divergence,
    greatest(0.0, 1.0 - w.radius) AS localisation,
    CASE WHEN w.p_volume > 0 THEN {_clamp('w.p_z / 12.0')} ELSE 0.0 END AS temporal,
    CASE WHEN w.confounder_key IS NOT NULL THEN {_clamp('w.kept')} ELSE 1.0 END AS retained,
    (w.c_infra / w.c_failures::DOUBLE - w.b_infra / w.b_failures::DOUBLE)
      * CASE WHEN f.hypothesis_type IN ('gateway_degradation', 'network_segment_degradation') THEN 1 ELSE -1 END AS alignment
  FROM frame f LEFT JOIN best b ON b.dim_set = f.dim LEFT JOIN wide w ON w.cohort_key = b.cohort_key LEFT JOIN ids i ON i.cohort_key = w.cohort_key
),
local_h AS MATERIALIZED (
  SELECT hypothesis_type, string_split(cohort_key, '=')[2] AS subject_value,
    CASE WHEN cohort_key IS NULL THEN 0.0 ELSE {_clamp("0.30 * signal + 0.20 * divergence + 0.15 * localisation + 0.05 * temporal + 0.30 * retained + 0.15 * " + _clamp('alignment / 0.10', '-1.0', '1.0'))} END AS h_score,
    CASE WHEN cohort_key IS NULL THEN 0.0 ELSE {_clamp('score / 12.0')} END AS strength, coalesce(severity, 'NONE') AS severity, coalesce(sigma, 0.0) AS sigma,
    array_to_string(list_filter([id_failure_rate, CASE WHEN ctl_c - ctl_b < 0.02 THEN id_control_comparison END, CASE WHEN radius <= 0.5 THEN id_blast_radius END,
      CASE WHEN p_z >= 3 THEN id_temporal_alignment END, CASE WHEN retained >= 0.35 THEN id_confounding_check END,
      CASE WHEN alignment > 0.01 THEN id_response_mix END], lambda x: x IS NOT NULL), ',') AS supporting,
    array_to_string(list_filter([CASE WHEN ctl_c - ctl_b >= 0.02 THEN id_control_comparison END, CASE WHEN radius > 0.5 THEN id_blast_radius END,
      CASE WHEN p_z < 3 THEN id_temporal_alignment END, CASE WHEN retained < 0.35 THEN id_confounding_check END,
      CASE WHEN alignment < -0.01 THEN id_response_mix END], lambda x: x IS NOT NULL), ',') AS contradicting
  FROM part
),
pop AS MATERIALIZED (
  SELECT b.volume AS b_volume, b.failures AS b_failures, c.volume AS c_volume, c.failures AS c_failures,
    c.failure_rate - b.failure_rate AS delta, {z_sql('b.failures', 'b.volume', 'c.failures', 'c.volume')} AS sigma,
    (SELECT count(*) FILTER (absolute_delta >= 0.02) / count(*)::DOUBLE FROM scored WHERE dim_set = 'gateway') AS breadth
  FROM metrics b, metrics c WHERE b.dim_set = 'ALL' AND c.dim_set = 'ALL' AND b."window" = 'baseline' AND c."window" = 'current'
),
without AS MATERIALIZED (
  SELECT count(*) FILTER (ts >= TIMESTAMP '1997-01-01' AND status = 'FAILED') / count(*) FILTER (ts >= TIMESTAMP '1997-01-01')::DOUBLE
       - count(*) FILTER (ts < TIMESTAMP '1997-01-01' AND status = 'FAILED') / count(*) FILTER (ts < TIMESTAMP '1997-01-01')::DOUBLE AS left_delta
  FROM planted pf WHERE ts < TIMESTAMP '1998-01-01' AND NOT EXISTS (
    SELECT 1 FROM reported r WHERE r.rank = 1 AND r.depth = 1 AND string_split(r.cohort_key, '=')[2] =
      CASE r.dim_set {' '.join(f"WHEN '{d}' THEN pf.{d}" for d in DIMS)} END)
),
systemic AS MATERIALIZED (
  SELECT 'systemic_degradation' AS hypothesis_type, NULL AS subject_value,
    CASE WHEN delta < 0.02 THEN least(0.15, s) ELSE s END AS h_score,
    {_clamp('CASE WHEN round(sigma, 4) > 0 AND round(delta, 6) > 0 THEN round(sigma, 4) * least(1.0, round(delta, 6) / 0.15) ELSE 0.0 END / 12.0')} AS strength,
    CASE WHEN round(sigma, 4) >= 9 THEN 'CRITICAL' WHEN round(sigma, 4) >= 6 THEN 'HIGH' WHEN round(sigma, 4) >= 4 THEN 'MEDIUM'
         WHEN round(sigma, 4) >= 3 THEN 'LOW' ELSE 'NONE' END AS severity, round(sigma, 4) AS sigma,
    coalesce((SELECT string_agg(evidence_id::VARCHAR, ',' ORDER BY evidence_id) FROM evid WHERE evidence_type = 'blast_radius' AND current_value >= 0.6), '') AS supporting,
    coalesce((SELECT string_agg(evidence_id::VARCHAR, ',' ORDER BY evidence_id) FROM evid WHERE evidence_type = 'blast_radius' AND current_value < 0.6), '') AS contradicting
  FROM (SELECT *, {_clamp(f"(0.5 * {_clamp('sigma / 12.0')} + 0.5 * breadth) * CASE WHEN delta > 0 THEN {_clamp('left_delta / delta')} ELSE 1.0 END")} AS s FROM pop, without)
),
every AS MATERIALIZED (SELECT * FROM local_h UNION ALL SELECT * FROM systemic),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY h_score DESC, hypothesis_type) AS h_rank, lead(h_score) OVER (ORDER BY h_score DESC, hypothesis_type) AS nxt FROM every),
hyps AS MATERIALIZED (
  SELECT *, CASE WHEN h_rank = 1 AND h_score > 0 THEN (h_score - nxt) / h_score ELSE 0.0 END AS margin,
    CASE WHEN h_rank = 1 AND h_score > 0 THEN {_clamp('h_score * (0.5 + 0.5 * (h_score - nxt) / h_score)')} ELSE {_clamp('h_score * 0.5')} END AS attribution
  FROM ordered
),
final_h AS MATERIALIZED (SELECT *, round(sqrt(strength * attribution), 4) AS confidence FROM hyps)"""
HYPS_SQL = f"{EVIDENCE_SQL},{HYPOTHESIS_SQL}"


def _hypotheses(t):
    return _analysis(t).hypotheses


@query(
    "h03_ranked_hypotheses",
    f"""{HYPS_SQL} SELECT hypothesis_type, subject_value, round(h_score, 6) AS hypothesis_score, severity, round(sigma, 4) AS sigma,
  CAST(h_rank AS INTEGER) AS hypothesis_rank, round(margin, 6) AS margin FROM final_h""",
)
def _(t):
    return _hypotheses(t).select(
        "hypothesis_type", "subject_value", F.round("hypothesis_score", 6).alias("hypothesis_score"), "severity",
        F.round("sigma", 4).alias("sigma"), "hypothesis_rank", F.round("margin", 6).alias("margin"),
    )


@query(
    "h01_localised_scores",
    f"""{HYPS_SQL} SELECT hypothesis_type, subject_value, round(h_score, 6) AS hypothesis_score FROM final_h WHERE hypothesis_type <> 'systemic_degradation'""",
)
def _(t):
    return _hypotheses(t).where("hypothesis_type <> 'systemic_degradation'").select(
        "hypothesis_type", "subject_value", F.round("hypothesis_score", 6).alias("hypothesis_score")
    )


@query(
    "h02_systemic_score",
    f"""{HYPS_SQL} SELECT hypothesis_type, round(h_score, 6) AS hypothesis_score, round(strength, 6) AS strength FROM final_h WHERE hypothesis_type = 'systemic_degradation'""",
)
def _(t):
    return _hypotheses(t).where("hypothesis_type = 'systemic_degradation'").select(
        "hypothesis_type", F.round("hypothesis_score", 6).alias("hypothesis_score"), F.round("strength", 6).alias("strength")
    )


@query("h04_cited_evidence", f"""{HYPS_SQL} SELECT hypothesis_type, supporting, contradicting FROM final_h""")
def _(t):
    return _hypotheses(t).select(
        "hypothesis_type",
        F.array_join(F.col("supporting").cast("array<string>"), ",").alias("supporting"),
        F.array_join(F.col("contradicting").cast("array<string>"), ",").alias("contradicting"),
    )


@query(
    "h05_confidence",
    f"""{HYPS_SQL} SELECT hypothesis_type, round(strength, 6) AS strength, round(attribution, 6) AS attribution, confidence FROM final_h""",
)
def _(t):
    return _hypotheses(t).select(
        "hypothesis_type", F.round("strength", 6).alias("strength"), F.round("attribution", 6).alias("attribution"), "confidence"
    )


@query("w05_winner_margin", f"""{HYPS_SQL} SELECT hypothesis_type, round(margin, 6) AS margin, round(nxt, 6) AS runner_up FROM final_h WHERE h_rank = 1""")
def _(t):
    hyps = _hypotheses(t)
    both = hyps.where("hypothesis_rank <= 2").agg(
        F.max(F.when(F.col("hypothesis_rank") == 1, F.col("hypothesis_type"))).alias("hypothesis_type"),
        F.round(F.max(F.when(F.col("hypothesis_rank") == 1, F.col("margin"))), 6).alias("margin"),
        F.round(F.max(F.when(F.col("hypothesis_rank") == 2, F.col("hypothesis_score"))), 6).alias("runner_up"),
    )
    return both


VERDICT_SQL = """CASE WHEN (subject_value IS NULL AND hypothesis_type <> 'systemic_degradation') OR confidence < 0.35 THEN 'INSUFFICIENT_EVIDENCE'
  WHEN confidence >= 0.60 THEN 'CONFIDENT' ELSE 'UNCERTAIN' END"""


@query("r01_verdict", f"""{HYPS_SQL} SELECT hypothesis_type, confidence, {VERDICT_SQL} AS verdict FROM final_h""")
def _(t):
    has = F.col("subject_value").isNotNull() | (F.col("hypothesis_type") == attribute.SYSTEMIC)
    return _hypotheses(t).select("hypothesis_type", "confidence", attribute.verdict(F.col("confidence"), has).alias("verdict"))


@query(
    "r02_root_cause",
    f"""{HYPS_SQL}, judged AS (SELECT *, {VERDICT_SQL} AS verdict FROM final_h WHERE h_rank = 1)
SELECT j.verdict, CASE WHEN j.verdict <> 'INSUFFICIENT_EVIDENCE' THEN j.hypothesis_type END AS predicted_type,
  CASE WHEN j.verdict <> 'INSUFFICIENT_EVIDENCE' AND j.hypothesis_type = 'gateway_degradation' THEN j.subject_value END AS predicted_gateway,
  j.confidence, j.severity, round(j.sigma, 4) AS sigma, round(j.strength, 4) AS strength,
  w.cohort_key AS affected_cohort, w.c_volume AS affected_volume, CAST(w.ctl_volume AS BIGINT) AS control_volume, CAST(w.ctl_failures AS BIGINT) AS control_failures,
  j.supporting, j.contradicting, CAST(4 AS INTEGER) AS alternatives
FROM judged j LEFT JOIN wide w ON w.rank = 1""",
)
def _(t):
    row = _analysis(t).conclusion
    ids = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("supporting", "contradicting")]
    return row.select(
        "verdict", "predicted_type", "predicted_gateway", "confidence", "severity", "sigma", "strength", "affected_cohort",
        "affected_volume", "control_volume", "control_failures", *ids, F.size("alternatives").alias("alternatives"),
    )


@query(
    "r03_quiet_window",
    f"""WITH {FACT_SQL},{windowed_sql()},{metrics_sql()},{scored_sql()}
SELECT count(*) FILTER (verdict = 'ANOMALOUS') AS candidates, count(*) AS scanned FROM scored""",
)
def _(t):
    _, table = incident.scan(payments(t), FACT, WINDOWS)
    scored = detect.score_cohorts(table, FACT, CONFIG)
    return scored.agg(F.count_if(F.col("verdict") == "ANOMALOUS").alias("candidates"), F.count(F.lit(1)).alias("scanned"))


def _six(x: str) -> str:
    return f"coalesce(CAST(CAST({x} AS DECIMAL(30,6)) AS VARCHAR), 'NULL')"


@query(
    "r04_analysis_fingerprint",
    f"""{HYPS_SQL}, judged AS (SELECT *, {VERDICT_SQL} AS verdict, coalesce(subject_value, '(no candidate)') AS subject FROM final_h WHERE h_rank = 1),
lines AS (
  SELECT '0' AS k, concat_ws('|', verdict, CASE WHEN verdict = 'INSUFFICIENT_EVIDENCE' THEN 'None' WHEN hypothesis_type = 'gateway_degradation' THEN 'Gateway ' || subject || ' is degraded'
    WHEN hypothesis_type = 'issuer_degradation' THEN 'Issuer ' || subject || ' is failing transactions' WHEN hypothesis_type = 'payment_method_degradation' THEN 'Payment method ' || subject || ' is degraded'
    WHEN hypothesis_type = 'network_segment_degradation' THEN 'Network ' || subject || ' is degraded' ELSE 'The whole system is degraded' END, {_six('confidence')}) AS line FROM judged
  UNION ALL SELECT printf('1%02d', h_rank), concat_ws('|', hypothesis_type, coalesce(subject_value, 'None'), {_six('h_score')}) FROM final_h
  UNION ALL SELECT concat_ws('|', '2', cohort_key, evidence_type), concat_ws('|', evidence_type, metric_name, cohort_key, {', '.join(_six(v) for v in ('baseline_value', 'current_value', 'delta', 'sigma'))}, source_layer) FROM evid)
SELECT sha256(string_agg(line, chr(10) ORDER BY k, line)) AS analysis_fingerprint FROM lines""",
)
def _(t):
    return _analysis(t).fingerprint


@query(
    "a18_rca_evaluation",
    f"""{HYPS_SQL}, judged AS (SELECT *, {VERDICT_SQL} AS verdict FROM final_h WHERE h_rank = 1)
SELECT 1 AS incident_id, hypothesis_type AS predicted_type, 'gateway_degradation' AS true_type, subject_value AS predicted_gateway,
  (SELECT 'gateway_' || substr('ABCDE', CAST(min(l_suppkey % 5) FILTER (l_suppkey % 5 = 2) + 1 AS INTEGER), 1) FROM lineitem) AS true_gateway,
  subject_value = 'gateway_C' AS gateway_correct, hypothesis_type = 'gateway_degradation' AS type_correct,
  subject_value = 'gateway_C' AND hypothesis_type = 'gateway_degradation' AS correct FROM judged""",
)
def _(t):
    found = _analysis(t).conclusion.withColumn("incident_id", F.lit(1))
    truth = payments(t).where("gateway = 'gateway_C'").agg(F.max("gateway").alias("true_gateway")).select(
        F.lit(1).alias("incident_id"), F.lit("gateway_degradation").alias("true_type"), "true_gateway"
    )
    return attribute.evaluate(found, truth, "incident_id")
