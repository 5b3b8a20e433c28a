"""Calibration, assignment, overlays, nested samples, reroute sweeps, risk and the least-intervention choice."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.hashing import digest, lane_uniform, weighted_choice
from ..functions.stats import rate
from ..operators import metrics, ranking, whatif
from ..session import materialize, stage
from .metric_queries import ASSIGNED_SQL, NOW_SQL, assigned
from .tables import FACT, FACT_SQL, P_BASE, WINDOWS, lane_sql, payments, query, shared

CURRENT = (WINDOWS.current_start, WINDOWS.current_end)
MULTIPLIER = 2.0


# ------------------------------------------------------------------------------------- role tables from the data
def _letter(column):
    return F.concat(F.lit("gateway_"), F.substring(F.lit("ABCDE"), (column % 5 + 1).cast("int"), F.lit(1)))


def health(t):
    """Validity intervals: the first four suppliers cover everything, later ones are ten-day stretches."""
    key = F.col("s_suppkey")
    base = key < 5
    start = F.date_add(F.lit("1995-01-01").cast("date"), (key * 13 % 2500).cast("int"))
    return t.supplier.where(key != 4).select(
        _letter(key).alias("gateway"),
        F.when(base, "HEALTHY").when(key % 5 == 3, "DEGRADED").otherwise("HEALTHY").alias("health_state"),
        F.when(base, F.lit("1990-01-01").cast("timestamp")).otherwise(start.cast("timestamp")).alias("valid_from"),
        F.when(base, F.lit("2010-01-01").cast("timestamp")).otherwise(F.date_add(start, 10).cast("timestamp")).alias("valid_to"),
    )


@shared
def gateways(t):
    """One row per gateway: traffic weight and calibrated failure probability from the baseline, and eligibility."""
    base = payments(t).where(F.col("ts") < F.lit(WINDOWS.current_start))
    counts = base.groupBy("gateway").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "FAILED").alias("f"))
    counts = counts.crossJoin(counts.agg(F.sum("n").alias("all_n"), F.sum("f").alias("all_f")))  # one row
    inputs = counts.select(
        "gateway",
        (F.col("n") / F.col("all_n")).alias("weight"),
        (100.0 * F.col("f") / F.col("n")).alias("reference_rate"),
        (F.col("all_f") / F.col("all_n")).alias("observed_rate"),
    )
    eligible = t.supplier.groupBy(_letter(F.col("s_suppkey")).alias("gateway")).agg(F.bool_or(F.col("s_suppkey") % 5 != 1).alias("is_eligible"))
    return materialize(whatif.calibrate_rates(inputs, "gateway").join(eligible, "gateway").withColumn("policy", F.lit("baseline")))


GATEWAY_SQL = f"""{FACT_SQL},
health AS (
  SELECT 'gateway_' || substr('ABCDE', CAST(s_suppkey % 5 + 1 AS INTEGER), 1) AS gateway,
    CASE WHEN s_suppkey < 5 THEN 'HEALTHY' WHEN s_suppkey % 5 = 3 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health_state,
    CASE WHEN s_suppkey < 5 THEN TIMESTAMP '1990-01-01' ELSE TIMESTAMP '1995-01-01' + to_days(CAST(s_suppkey * 13 % 2500 AS INTEGER)) END AS valid_from,
    CASE WHEN s_suppkey < 5 THEN TIMESTAMP '2010-01-01' ELSE TIMESTAMP '1995-01-01' + to_days(CAST(s_suppkey * 13 % 2500 + 10 AS INTEGER)) END AS valid_to
  FROM supplier WHERE s_suppkey <> 4
),
gw_in AS (
  SELECT gateway, n / sum(n) OVER ()::DOUBLE AS weight, 100.0::DOUBLE * f / n AS reference_rate, sum(f) OVER ()::DOUBLE / sum(n) OVER () AS observed_rate
  FROM (SELECT gateway, count(*) AS n, count(*) FILTER (status = 'FAILED') AS f FROM fact WHERE ts < TIMESTAMP '1997-01-01' GROUP BY 1)
),
gw_rel AS (
  SELECT *, 1.0::DOUBLE + 0.6::DOUBLE * (reference_rate / (sum(reference_rate * weight) OVER () / sum(weight) OVER ()) - 1.0::DOUBLE) AS relative FROM gw_in
),
gw AS MATERIALIZED (
  SELECT *, relative * (observed_rate * sum(weight) OVER () / sum(relative * weight) OVER ()) AS failure_probability, gateway <> 'gateway_B' AS is_eligible FROM gw_rel
),
span AS (SELECT min(ts) AS span_start, max(ts) AS span_end FROM fact WHERE {NOW_SQL}),
target_health AS MATERIALIZED (
  SELECT g.gateway, CASE
    WHEN count(*) FILTER (h.valid_from <= s.span_start AND h.valid_to >= s.span_end) = 0 THEN 'NO_HEALTH_RECORD'
    WHEN count(*) FILTER (h.health_state <> 'HEALTHY' AND h.valid_from < s.span_end AND h.valid_to > s.span_start) > 0 THEN 'NOT_HEALTHY'
    ELSE 'HEALTHY' END AS target_health
  FROM gw g CROSS JOIN span s LEFT JOIN health h ON h.gateway = g.gateway GROUP BY 1
)"""


def spanned(t, targets):
    """Targets with the window's real traffic span attached (one row, joined on the policy they share)."""
    span = metrics.traffic_span(payments(t), FACT, *CURRENT).withColumn("policy", F.lit("baseline"))
    return targets.withColumn("policy", F.lit("baseline")).join(span, "policy")


@shared
def target_health(t):
    targets = spanned(t, gateways(t).select("gateway"))
    judged_ = whatif.health_over_span(targets, health(t), "gateway", "span_start", "span_end")
    return materialize(judged_.select("gateway", "target_health"))


# -------------------------------------------------------------------------------------------------- calibration
@query("c01_rate_calibration", f"""WITH {GATEWAY_SQL} SELECT gateway, round(relative, 6) AS relative, round(failure_probability, 6) AS failure_probability,
  abs((SELECT sum(weight * failure_probability) FROM gw) - observed_rate) < 1e-9 AS mean_preserved FROM gw""")
def _(t):
    table = gateways(t)
    table = table.crossJoin(table.agg(F.sum(F.col("weight") * F.col("failure_probability")).alias("_mean")))  # one row
    mean = F.col("_mean")
    return table.select(
        "gateway", F.round("relative", 6).alias("relative"), F.round("failure_probability", 6).alias("failure_probability"),
        (F.abs(mean - F.col("observed_rate")) < 1e-9).alias("mean_preserved"),
    )


@query("c02_posterior_assignment", f"""WITH {FACT_SQL},{ASSIGNED_SQL} SELECT route, status, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS amount FROM assigned GROUP BY 1, 2""")
def _(t):
    return assigned(t).groupBy("route", "status").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").cast("double").alias("amount"))


@query(
    "c03_effective_probability",
    f"""WITH {GATEWAY_SQL} SELECT gateway, round(least(1.0, failure_probability * 2.0), 6) AS p_effective,
  round((least(1.0, failure_probability * 2.0) - failure_probability) / (1.0 - failure_probability), 6) AS p_added, round(least(1.0, failure_probability * 4.0), 6) AS p_clamped FROM gw""",
)
def _(t):
    p = F.col("failure_probability")
    effective = whatif.effective_probability(p, F.lit(2.0))
    return gateways(t).select(
        "gateway", F.round(effective, 6).alias("p_effective"), F.round(whatif.added_probability(p, effective), 6).alias("p_added"),
        F.round(whatif.effective_probability(p, F.lit(4.0)), 6).alias("p_clamped"),
    )



@query(
    "c04_stress_overlay",
    f"""WITH {FACT_SQL} SELECT gateway = 'gateway_C' AS in_affected_cohort, status AS observed_status, count(*) AS rows,
  sum(CASE WHEN status = 'FAILED' THEN 1.0::DOUBLE WHEN gateway = 'gateway_C' THEN (0.66::DOUBLE - 0.33::DOUBLE) / (1.0::DOUBLE - 0.33::DOUBLE) ELSE 0.0 END) AS expected_failures
FROM fact WHERE {NOW_SQL} GROUP BY 1, 2""",
)
def _(t):
    """The stress in expectation; nothing is drawn."""
    return whatif.expected_failures(payments(t), FACT, {"gateway": "gateway_C"}, F.lit(P_BASE), MULTIPLIER, *CURRENT)


# ----------------------------------------------------------------------------------------------------- incidents
def incidents(t):
    """One incident per gateway and one on an issuer segment, which has no source gateway to move traffic from."""
    per_gateway = gateways(t).select(
        (F.ascii(F.substring("gateway", -1, 1)) - 64).cast("int").alias("incident_id"), F.col("gateway").alias("source_gateway"), "policy"
    )
    segment = per_gateway.where("incident_id = 1").select(F.lit(6).alias("incident_id"), F.lit(None).cast("string").alias("source_gateway"), "policy")
    return per_gateway.unionByName(segment)


@shared
def cohort(t):
    """Affected rows of every incident with their outcome under it, written once: the one world all candidates share.

    Each row names its incidents itself, so no incident table is joined.
    """
    rows = payments(t).where(metrics.in_window(F.col("ts"), *CURRENT))
    p = gateways(t).select("gateway", "failure_probability")
    by_gateway = (F.ascii(F.substring("gateway", -1, 1)) - 64).cast("int")
    ids = F.when(F.col("sender_bank") == "MACHINERY", F.array(by_gateway, F.lit(6))).otherwise(F.array(by_gateway))
    tagged = rows.join(p, "gateway").withColumn("incident_id", F.explode(ids))
    effective = whatif.effective_probability(F.col("failure_probability"), F.lit(MULTIPLIER))
    draw = lane_uniform(digest(whatif.OUTCOME_DOMAIN, F.col("txn_id"), F.concat(F.lit("incident-"), F.col("incident_id").cast("string"))), 0)
    hit = (F.col("status") != "FAILED") & (draw < whatif.added_probability(F.col("failure_probability"), effective))
    rows = tagged.select(
        "incident_id", "txn_id", "amount", "gateway", F.col("status").alias("observed_status"),
        F.when(hit, "FAILED").otherwise(F.col("status")).alias("current_status"), effective.alias("p_current"),
        (F.col("incident_id") == 6).alias("degraded_elsewhere"), "latency_ms",
    )
    return stage(rows, "cohort")


def candidate_table(t):
    g = gateways(t)
    p = g.select(F.col("gateway").alias("target_gateway"), F.col("failure_probability").alias("p_target"))
    options = whatif.build_candidates(incidents(t), g)
    # A moved row's latency changes as the mean latencies of its old and new gateway do; a segment moves from all of them.
    # Every row of the window is in the cohort of its own gateway's incident, so the written cohort has them all.
    rows = cohort(t).where("NOT degraded_elsewhere").groupBy("gateway").agg(F.sum("latency_ms").alias("_s"), F.count("latency_ms").alias("_n"))
    means = materialize(rows.unionByName(rows.agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")).withColumn("gateway", F.lit("*"))).withColumn("_m", F.col("_s") / F.col("_n")))
    to = means.select(F.col("gateway").alias("target_gateway"), F.col("_m").alias("_to"))
    of = means.select(F.col("gateway").alias("_source"), F.col("_m").alias("_of"))
    options = options.join(p, "target_gateway", "left").join(to, "target_gateway", "left").withColumn("_from", F.coalesce("source_gateway", F.lit("*")))
    options = options.join(of, F.col("_from") == F.col("_source"), "left").withColumn("latency_factor", F.col("_to") / F.col("_of"))
    return options.drop("_to", "_of", "_from", "_source").withColumn("multiplier", F.lit(MULTIPLIER))


def swept(t):
    traffic = payments(t).where(metrics.in_window(F.col("ts"), *CURRENT)).groupBy("gateway").agg(F.count(F.lit(1)).alias("window_rows"))
    traffic = traffic.crossJoin(traffic.agg(F.sum("window_rows").alias("window_total")))  # one row
    return whatif.sweep(cohort(t), candidate_table(t), traffic)


def judged(t):
    """Swept candidates with target health and eligibility attached and a validity reason."""
    facts = gateways(t).select(F.col("gateway").alias("target_gateway"), "is_eligible", F.lit(True).alias("target_known"))
    state = target_health(t).withColumnRenamed("gateway", "target_gateway")
    return swept(t).join(facts, "target_gateway", "left").join(state, "target_gateway", "left").withColumn("invalid_reason", whatif.invalid_reason())


_P = "least(1.0::DOUBLE, failure_probability * 2.0::DOUBLE)"
SWEEP_SQL = f"""{GATEWAY_SQL},
incident AS (SELECT ascii(right(gateway, 1)) - 64 AS incident_id, gateway AS source_gateway FROM gw UNION ALL SELECT 6, NULL),
cohort AS MATERIALIZED (
  SELECT i.incident_id, f.txn_id, f.amount, f.gateway, f.latency_ms, f.status AS observed_status, {_P} AS p_current, i.incident_id = 6 AS elsewhere,
    CASE WHEN f.status <> 'FAILED' AND {lane_sql("sha256('outcome-draw-1|' || f.txn_id || '|incident-' || i.incident_id)", 0)}
      < ({_P} - failure_probability) / (1.0::DOUBLE - failure_probability) THEN 'FAILED' ELSE f.status END AS current_status,
    row_number() OVER (PARTITION BY i.incident_id ORDER BY sha256('reroute-selection-1|' || f.txn_id || '|' || i.incident_id), f.txn_id) AS pos,
    count(*) OVER (PARTITION BY i.incident_id) AS population
  FROM fact f JOIN gw USING (gateway) JOIN incident i ON i.source_gateway = f.gateway OR (i.incident_id = 6 AND f.sender_bank = 'MACHINERY')
  WHERE {NOW_SQL}
),
candidate AS (
  SELECT incident_id, source_gateway, 'NO_ACTION' AS action_type, NULL AS target_gateway, 0.0::DOUBLE AS pct, 'NO_ACTION' AS candidate_key, NULL::DOUBLE AS p_target FROM incident
  UNION ALL
  SELECT i.incident_id, i.source_gateway, 'REROUTE_TRAFFIC', g.gateway, p.pct, 'REROUTE_TRAFFIC:' || g.gateway || ':' || CAST(p.pct AS INTEGER), g.failure_probability
  FROM incident i CROSS JOIN (VALUES (10.0::DOUBLE), (20.0::DOUBLE), (30.0::DOUBLE)) p(pct) JOIN gw g ON g.is_eligible AND g.gateway IS DISTINCT FROM i.source_gateway
),
mean_latency AS (SELECT gateway, sum(latency_ms) / count(latency_ms) AS m FROM fact WHERE {NOW_SQL} GROUP BY 1 UNION ALL SELECT '*', sum(latency_ms) / count(latency_ms) FROM fact WHERE {NOW_SQL}),
moved_latency AS (SELECT c.incident_id, c.candidate_key, a.m / b.m AS factor FROM candidate c LEFT JOIN mean_latency a ON a.gateway = c.target_gateway LEFT JOIN mean_latency b ON b.gateway = coalesce(c.source_gateway, '*')),
paired AS (
  SELECT c.incident_id, c.candidate_key, r.amount,
    CASE WHEN c.action_type <> 'NO_ACTION' AND r.pos <= floor(r.population * c.pct / 100.0) THEN floor(r.latency_ms * coalesce(x.factor, 1.0)) ELSE r.latency_ms END AS latency_after, r.current_status, r.latency_ms,
    c.action_type <> 'NO_ACTION' AND r.pos <= floor(r.population * c.pct / 100.0) AS moved,
    1.0::DOUBLE - r.p_current AS p_now,
    CASE WHEN c.action_type <> 'NO_ACTION' AND r.pos <= floor(r.population * c.pct / 100.0) THEN
      CASE WHEN r.observed_status = 'FAILED' THEN 1.0::DOUBLE
        WHEN r.elsewhere THEN (least(1.0::DOUBLE, c.p_target * 2.0::DOUBLE) - c.p_target) / (1.0::DOUBLE - c.p_target) ELSE 0.0::DOUBLE END
      ELSE CASE WHEN r.current_status = 'FAILED' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS p_fails,
    1.0::DOUBLE - CASE WHEN r.elsewhere THEN least(1.0::DOUBLE, c.p_target * 2.0::DOUBLE) ELSE c.p_target END AS p_then
  FROM candidate c JOIN cohort r USING (incident_id) JOIN moved_latency x ON x.incident_id = c.incident_id AND x.candidate_key = c.candidate_key
),
traffic AS (SELECT gateway, count(*) AS rows, sum(count(*)) OVER ()::DOUBLE AS total, max(count(*)) OVER () AS largest FROM fact WHERE {NOW_SQL} GROUP BY 1),
impact AS MATERIALIZED (
  SELECT c.incident_id, c.candidate_key, any_value(c.action_type) AS action_type, any_value(c.source_gateway) AS source_gateway, any_value(c.target_gateway) AS target_gateway,
    any_value(c.pct) AS pct, count(*) AS population, count(*) FILTER (p.moved) AS rerouted,
    count(*) FILTER (p.current_status = 'FAILED') AS baseline_failures, sum(p.p_fails) AS projected_failures,
    CAST(sum(p.amount) AS DOUBLE) AS value_total, CAST(sum(p.amount) FILTER (p.current_status = 'FAILED') AS DOUBLE) AS baseline_at_risk,
    sum(p.amount::DOUBLE * p.p_fails) AS projected_at_risk,
    round(coalesce(sum(p.amount::DOUBLE * (p.p_then - p.p_now)) FILTER (p.moved), 0.0), 2) AS expected_retained,
    list_sort(list(p.latency_ms))[CAST(floor(0.5 * (count(*) - 1)) AS BIGINT) + 1] AS baseline_latency_p50, list_sort(list(p.latency_ms))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS baseline_latency_p95,
    list_sort(list(p.latency_after))[CAST(floor(0.5 * (count(*) - 1)) AS BIGINT) + 1] AS projected_latency_p50, list_sort(list(p.latency_after))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS projected_latency_p95
  FROM candidate c JOIN paired p USING (incident_id, candidate_key) GROUP BY 1, 2
),
option AS MATERIALIZED (
  SELECT i.*, (baseline_failures - projected_failures) / population::DOUBLE AS success_delta,
    CASE WHEN i.action_type = 'NO_ACTION' THEN (SELECT max(rows) / max(total) FROM traffic) ELSE (coalesce(t.rows, 0) + rerouted) / (SELECT max(total) FROM traffic) END AS concentration_after,
    h.target_health,
    CASE WHEN population < 100 THEN 'COHORT_BELOW_MIN_SIZE' WHEN i.action_type = 'NO_ACTION' THEN NULL
      WHEN i.source_gateway IS NULL THEN 'NO_SOURCE_GATEWAY' WHEN h.target_health = 'NO_HEALTH_RECORD' THEN 'TARGET_NO_HEALTH_RECORD'
      WHEN h.target_health <> 'HEALTHY' THEN 'TARGET_NOT_HEALTHY' END AS invalid_reason
  FROM impact i LEFT JOIN traffic t ON t.gateway = i.target_gateway LEFT JOIN target_health h ON h.gateway = i.target_gateway
)"""

@query("j09_candidate_generation", f"""WITH {SWEEP_SQL} SELECT incident_id, candidate_key, action_type, target_gateway, pct AS traffic_percentage FROM candidate""")
def _(t):
    return candidate_table(t).select("incident_id", "candidate_key", "action_type", "target_gateway", "traffic_percentage")


@query(
    "j07_health_over_span",
    f"""WITH {GATEWAY_SQL} SELECT gateway, target_health FROM target_health""",
)
def _(t):
    return target_health(t)


@query(
    "j08_health_at_instant",
    f"""WITH {GATEWAY_SQL}, pts AS (SELECT DISTINCT 'gateway_' || substr('ABCDE', CAST(l_suppkey % 5 + 1 AS INTEGER), 1) AS gateway, date_trunc('month', l_shipdate) AS moment FROM lineitem),
cov AS (SELECT p.gateway, p.moment, h.health_state, h.valid_from, h.valid_to, h.valid_from <= p.moment AND h.valid_to >= p.moment AS covers FROM pts p JOIN health h USING (gateway))
SELECT gateway, moment, coalesce(arg_min(health_state, (valid_from, valid_to)) FILTER (covers), arg_max(health_state, (valid_from, valid_to))) AS health_state FROM cov GROUP BY 1, 2""",
)
def _(t):
    points = t.lineitem.select(_letter(F.col("l_suppkey")).alias("gateway"), F.date_trunc("month", "l_shipdate").alias("moment")).distinct()
    return whatif.health_at(points, health(t), "gateway", "moment")


@query(
    "w11_nested_hash_sample",
    f"""WITH {SWEEP_SQL}, p(percent) AS (VALUES (10.0::DOUBLE), (20.0::DOUBLE), (30.0::DOUBLE))
SELECT incident_id, percent, CAST(floor(any_value(population) * percent / 100.0) AS BIGINT) AS take, any_value(population) AS population,
  count(*) FILTER (pos <= floor(population * percent / 100.0)) AS selected, max(txn_id) FILTER (pos = floor(population * percent / 100.0)) AS cut_id FROM cohort, p GROUP BY 1, 2""",
)
def _(t):
    rows = cohort(t).withColumn("d", whatif.selection_digest(F.col("txn_id"), F.col("incident_id").cast("string")))
    cuts = ranking.sample_cutoffs(rows, ["incident_id"], "d", "txn_id", whatif.TRAFFIC_PERCENTAGES)
    inside = rows.select("incident_id", "d").join(cuts.select("incident_id", "percent", "cut_digest"), "incident_id").where("d <= cut_digest")
    sizes = inside.groupBy("incident_id", "percent").agg(F.count(F.lit(1)).alias("selected"))
    return cuts.join(sizes, ["incident_id", "percent"]).select("incident_id", "percent", "take", "population", "selected", "cut_id")


@query(
    "c05_reroute_whatif",
    f"""WITH {SWEEP_SQL} SELECT incident_id, candidate_key, count(*) FILTER (moved) AS moved, round(coalesce(sum(1.0 - p_fails) FILTER (moved AND current_status = 'FAILED'), 0.0), 6) AS rescued,
  round(coalesce(sum(p_fails) FILTER (moved AND current_status = 'SUCCESS'), 0.0), 6) AS lost FROM paired WHERE candidate_key <> 'NO_ACTION' GROUP BY 1, 2""",
)
def _(t):
    """Failures a move avoids and causes, in expectation; nothing is drawn."""
    moved = whatif.moved_groups(cohort(t), candidate_table(t))
    failed, n, p = F.col("current_status") == "FAILED", F.col("n"), F.col("p_fails")
    return moved.groupBy("incident_id", "candidate_key").agg(
        F.sum("n").alias("moved"),
        F.round(F.coalesce(F.sum(F.when(failed, n * (1 - p))), F.lit(0.0)), 6).alias("rescued"),
        F.round(F.coalesce(F.sum(F.when(~failed, n * p)), F.lit(0.0)), 6).alias("lost"),
    )


@query(
    "c06_candidate_validity",
    f"""WITH {SWEEP_SQL}, ask AS (
  SELECT i.incident_id, i.source_gateway, g.gateway AS target_gateway, p.pct AS traffic_percentage, (SELECT count(*) FROM cohort c WHERE c.incident_id = i.incident_id) AS population
  FROM incident i CROSS JOIN (SELECT gateway FROM gw UNION ALL SELECT 'gateway_Z') g CROSS JOIN (VALUES (30.0::DOUBLE), (40.0::DOUBLE)) p(pct))
SELECT a.incident_id, a.target_gateway, a.traffic_percentage, CASE WHEN population = 0 THEN 'COHORT_EMPTY' WHEN population < 100 THEN 'COHORT_BELOW_MIN_SIZE'
  WHEN traffic_percentage > 30 THEN 'TRAFFIC_EXCEEDS_MAXIMUM' WHEN source_gateway IS NULL THEN 'NO_SOURCE_GATEWAY' WHEN source_gateway = target_gateway THEN 'SOURCE_EQUALS_TARGET'
  WHEN g.gateway IS NULL THEN 'TARGET_UNKNOWN' WHEN NOT g.is_eligible THEN 'TARGET_NOT_ELIGIBLE' WHEN h.target_health = 'NO_HEALTH_RECORD' THEN 'TARGET_NO_HEALTH_RECORD'
  WHEN h.target_health <> 'HEALTHY' THEN 'TARGET_NOT_HEALTHY' END AS invalid_reason
FROM ask a LEFT JOIN gw g ON g.gateway = a.target_gateway LEFT JOIN target_health h ON h.gateway = a.target_gateway""",
)
def _(t):
    known = gateways(t)
    names = known.groupBy("policy").agg(F.array_append(F.array_sort(F.collect_set("gateway")), F.lit("gateway_Z")).alias("names"))
    sizes = cohort(t).groupBy("incident_id").agg(F.count(F.lit(1)).alias("population"))
    asked = (
        incidents(t).join(names, "policy").withColumn("target_gateway", F.explode("names"))
        .withColumn("traffic_percentage", F.explode(F.array(F.lit(30.0), F.lit(40.0)))).withColumn("action_type", F.lit("REROUTE_TRAFFIC"))
        .join(sizes, "incident_id", "left")
        .join(known.select(F.col("gateway").alias("target_gateway"), "is_eligible", F.lit(True).alias("target_known")), "target_gateway", "left")
        .join(target_health(t).withColumnRenamed("gateway", "target_gateway"), "target_gateway", "left")
    )
    return asked.select("incident_id", "target_gateway", "traffic_percentage", whatif.invalid_reason().alias("invalid_reason"))


@query("c07_expected_value_retained", f"""WITH {SWEEP_SQL} SELECT incident_id, candidate_key, rerouted, expected_retained FROM impact""")
def _(t):
    return swept(t).select("incident_id", "candidate_key", "rerouted", "expected_retained")


def _paired(t):
    """Observed against stressed rows as a paired table with a latency penalty on the rows that changed."""
    changed = F.col("current_status") != F.col("observed_status")
    return cohort(t).select(
        "incident_id", "amount", changed.alias("rerouted"), F.col("current_status"), F.col("observed_status").alias("projected_status"),
        F.col("latency_ms").alias("current_latency_ms"), F.when(changed, F.floor(F.col("latency_ms") / 2).cast("double")).otherwise(F.col("latency_ms")).alias("projected_latency_ms"),
    )


@query(
    "c08_impact_of_pairs",
    f"""WITH {SWEEP_SQL}, pr AS (SELECT *, current_status <> observed_status AS ch, latency_ms AS a, CASE WHEN current_status <> observed_status THEN floor(latency_ms / 2) ELSE latency_ms END AS b FROM cohort),
ra AS (SELECT incident_id, a, row_number() OVER (PARTITION BY incident_id ORDER BY a) AS rn, count(*) OVER (PARTITION BY incident_id) AS n FROM pr),
rb AS (SELECT incident_id, b, row_number() OVER (PARTITION BY incident_id ORDER BY b) AS rn, count(*) OVER (PARTITION BY incident_id) AS n FROM pr),
la AS (SELECT incident_id, max(a) FILTER (rn = floor(0.5 * (n - 1)) + 1) AS p50, max(a) FILTER (rn = floor(0.95 * (n - 1)) + 1) AS p95 FROM ra GROUP BY 1),
lb AS (SELECT incident_id, max(b) FILTER (rn = floor(0.5 * (n - 1)) + 1) AS p50, max(b) FILTER (rn = floor(0.95 * (n - 1)) + 1) AS p95 FROM rb GROUP BY 1)
SELECT pr.incident_id, count(*) AS population, count(*) FILTER (ch) AS rerouted, count(*) FILTER (current_status = 'FAILED') AS baseline_failures,
  count(*) FILTER (observed_status = 'FAILED') AS projected_failures, CAST(sum(amount) AS DOUBLE) AS value_total,
  CAST(sum(amount) FILTER (current_status = 'FAILED') AS DOUBLE) AS baseline_at_risk, CAST(sum(amount) FILTER (observed_status = 'FAILED') AS DOUBLE) AS projected_at_risk,
  any_value(la.p50) AS baseline_latency_p50, any_value(la.p95) AS baseline_latency_p95, any_value(lb.p50) AS projected_latency_p50, any_value(lb.p95) AS projected_latency_p95,
  any_value(lb.p95) - any_value(la.p95) AS latency_delta_ms
FROM pr JOIN la USING (incident_id) JOIN lb USING (incident_id) GROUP BY 1""",
)
def _(t):
    table = whatif.impact_of_pairs(_paired(t), ["incident_id"]).drop("success_delta")
    return table.select(*[F.col(c).cast("double").alias(c) if c in ("value_total", "baseline_at_risk", "projected_at_risk") else F.col(c) for c in table.columns])


@query(
    "c10_candidate_sweep",
    f"""WITH {SWEEP_SQL} SELECT incident_id, candidate_key, population, rerouted, baseline_failures, round(projected_failures, 6) AS projected_failures, round(success_delta, 6) AS success_delta,
  value_total, baseline_at_risk, projected_at_risk, expected_retained, round(concentration_after, 6) AS concentration_after, invalid_reason,
  baseline_latency_p50, baseline_latency_p95, projected_latency_p50, projected_latency_p95, projected_latency_p95 - baseline_latency_p95 AS latency_delta_ms FROM option""",
)
def _(t):
    return judged(t).select(
        "incident_id", "candidate_key", "population", "rerouted", "baseline_failures", F.round("projected_failures", 6).alias("projected_failures"), F.round("success_delta", 6).alias("success_delta"),
        *[F.col(c).cast("double").alias(c) for c in ("value_total", "baseline_at_risk", "projected_at_risk")], "expected_retained",
        F.round("concentration_after", 6).alias("concentration_after"), "invalid_reason",
        "baseline_latency_p50", "baseline_latency_p95", "projected_latency_p50", "projected_latency_p95", "latency_delta_ms",
    )


@query(
    "c09_risk_components",
    f"""WITH {SWEEP_SQL}, r AS (SELECT incident_id, candidate_key, least(1.0, concentration_after / 0.40) AS concentration_risk,
  CASE WHEN action_type = 'NO_ACTION' OR target_health = 'HEALTHY' THEN 0.0 ELSE 1.0 END AS target_health_risk, 
  least(1.0, greatest(0.0, projected_latency_p95 - baseline_latency_p95) / 400.0) AS latency_risk,
  least(1.0, greatest(0.0, 1.0 - population / 400.0)) AS simulation_quality_risk, 
  CASE WHEN source_gateway IS NULL THEN 0.5 ELSE greatest(0.0, 1.0 - baseline_failures / (SELECT count(*) FROM cohort WHERE NOT elsewhere AND current_status = 'FAILED')) END AS evidence_uncertainty_risk,
  0.25::DOUBLE AS routing_uncertainty_risk FROM option)
SELECT round(CAST(latency_risk AS DOUBLE), 6) AS latency_risk, round(CAST(evidence_uncertainty_risk AS DOUBLE), 6) AS evidence_uncertainty_risk, incident_id, candidate_key, round(concentration_risk, 6) AS concentration_risk, CAST(target_health_risk AS DOUBLE) AS target_health_risk,
  round(CAST(simulation_quality_risk AS DOUBLE), 6) AS simulation_quality_risk,
  round((2 * concentration_risk + 2 * target_health_risk + latency_risk + simulation_quality_risk + evidence_uncertainty_risk + routing_uncertainty_risk)::DOUBLE / 8.0, 6) AS risk_score,
  'UNAVAILABLE' AS capacity_risk FROM r""",
)
def _(t):
    """Confidence in an incident's gateway is the share of all gateways' failures that it accounts for; a segment has named none."""
    failed = cohort(t).where("NOT degraded_elsewhere AND current_status = 'FAILED'").agg(F.count(F.lit(1)).alias("_failed"))
    table = judged(t).crossJoin(failed)  # one row
    table = table.withColumn("rca_confidence", F.when(F.col("source_gateway").isNotNull(), F.col("baseline_failures") / F.col("_failed")))
    return whatif.assess_risk(table).select(
        F.round("latency_risk", 6).alias("latency_risk"), F.round("evidence_uncertainty_risk", 6).alias("evidence_uncertainty_risk"), "incident_id", "candidate_key", F.round("concentration_risk", 6).alias("concentration_risk"), "target_health_risk",
        F.round("simulation_quality_risk", 6).alias("simulation_quality_risk"), F.round("risk_score", 6).alias("risk_score"), "capacity_risk",
    )


CHOICE_SQL = f"""{SWEEP_SQL},
opt_rank AS (
  SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY expected_retained DESC, round(success_delta, 9) DESC, pct, candidate_key) AS option_rank,
    max(expected_retained) OVER (PARTITION BY incident_id) AS best FROM option WHERE action_type <> 'NO_ACTION' AND invalid_reason IS NULL
),
pick AS (SELECT incident_id, candidate_key, expected_retained, best FROM opt_rank WHERE expected_retained >= best * 0.95
  QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY pct, expected_retained DESC, candidate_key) = 1),
choice AS (
  SELECT i.incident_id, CASE WHEN p.best >= 1000 THEN p.candidate_key ELSE 'NO_ACTION' END AS chosen, CASE WHEN p.best >= 1000 THEN p.expected_retained ELSE 0.0 END AS expected_retained,
    CASE WHEN p.candidate_key IS NULL THEN 'NO_ACTION: no candidate gave a valid comparison' WHEN p.best < 1000 THEN 'NO_ACTION: best candidate ' || b.candidate_key || ' is below the margin'
      WHEN p.candidate_key <> b.candidate_key THEN p.candidate_key || ': near-best at a smaller shift than ' || b.candidate_key ELSE p.candidate_key || ': highest expected value retained' END AS reason
  FROM incident i LEFT JOIN pick p USING (incident_id) LEFT JOIN (SELECT * FROM opt_rank WHERE option_rank = 1) b USING (incident_id)
)"""


@query("w06_candidate_ranking", f"""WITH {CHOICE_SQL} SELECT incident_id, candidate_key, expected_retained, CAST(option_rank AS INTEGER) AS option_rank FROM opt_rank""")
def _(t):
    return whatif.rank_options(judged(t)).select("incident_id", "candidate_key", "expected_retained", "option_rank")


@query("w07_least_intervention", f"""WITH {CHOICE_SQL} SELECT incident_id, chosen, CAST(expected_retained AS DOUBLE) AS expected_retained, reason FROM choice""")
def _(t):
    return whatif.choose(judged(t))


@query(
    "w08_rejected_alternatives",
    f"""WITH {CHOICE_SQL} SELECT o.incident_id, o.candidate_key, c.chosen, CASE WHEN o.invalid_reason IS NOT NULL THEN 'SIMULATION_INVALID: ' || o.invalid_reason
  ELSE 'retains ' || CAST(o.expected_retained AS DECIMAL(18,2)) || ' against ' || CAST(c.expected_retained AS DECIMAL(18,2)) END AS why_not
FROM option o JOIN choice c USING (incident_id) WHERE o.candidate_key <> c.chosen""",
)
def _(t):
    options = materialize(judged(t))
    return whatif.rejected_options(options, whatif.choose(options))


@query(
    "c12_gateway_health_comparison",
    f"""WITH {GATEWAY_SQL} SELECT g.gateway, round(failure_probability, 6) AS baseline_probability, g.gateway = 'gateway_C' AS is_affected,
  round(CASE WHEN g.gateway = 'gateway_C' THEN {_P} ELSE failure_probability END, 6) AS effective_probability,
  round(1 - CASE WHEN g.gateway = 'gateway_C' THEN {_P} ELSE failure_probability END, 6) AS effective_success, round(weight, 6) AS weight, 'UNAVAILABLE' AS capacity,
  (SELECT coalesce(arg_min(health_state, (valid_from, valid_to)) FILTER (valid_from <= TIMESTAMP '1997-01-01' AND valid_to >= TIMESTAMP '1997-01-01'), arg_max(health_state, (valid_from, valid_to)))
   FROM health h WHERE h.gateway = g.gateway) AS baseline_state FROM gw g""",
)
def _(t):
    g = gateways(t).withColumn("at", F.lit(WINDOWS.current_start))
    state = whatif.health_at(g.select("gateway", "at"), health(t), "gateway", "at")
    affected = F.col("gateway") == "gateway_C"
    p = F.col("failure_probability")
    effective = F.when(affected, whatif.effective_probability(p, F.lit(MULTIPLIER))).otherwise(p)
    return g.join(state, ["gateway", "at"], "left").select(
        "gateway", F.round(p, 6).alias("baseline_probability"), affected.alias("is_affected"), F.round(effective, 6).alias("effective_probability"),
        F.round(1 - effective, 6).alias("effective_success"), F.round("weight", 6).alias("weight"), F.lit("UNAVAILABLE").alias("capacity"),
        F.col("health_state").alias("baseline_state"),
    )


ROUTING_SQL = f"""{GATEWAY_SQL}, shares AS (SELECT gateway, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM fact WHERE {NOW_SQL} GROUP BY 1),
routing AS (SELECT gateway, share, is_eligible, target_health, failure_probability, gateway <> 'gateway_C' AND is_eligible AND target_health = 'HEALTHY' AS viable
  FROM gw JOIN target_health USING (gateway) LEFT JOIN shares USING (gateway))"""


def routing(t):
    counts = payments(t).where(metrics.in_window(F.col("ts"), *CURRENT)).groupBy("gateway").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all_n"))  # one row
    shares = counts.crossJoin(total).select("gateway", rate(F.col("n"), F.col("all_n")).alias("share"))
    viable = (F.col("gateway") != "gateway_C") & F.col("is_eligible") & (F.col("target_health") == "HEALTHY")
    return gateways(t).join(target_health(t), "gateway").join(shares, "gateway", "left").withColumn("viable", viable)


@query("j15_routing_options", f"""WITH {ROUTING_SQL} SELECT gateway, round(share, 6) AS share, is_eligible, target_health, viable FROM routing""")
def _(t):
    return routing(t).select("gateway", F.round("share", 6).alias("share"), "is_eligible", "target_health", "viable")


@query("j16_viable_target_ranking", f"""WITH {ROUTING_SQL} SELECT gateway, CAST(row_number() OVER (ORDER BY failure_probability, gateway) AS INTEGER) AS position FROM routing WHERE viable""")
def _(t):
    order = Window.partitionBy("policy").orderBy("failure_probability", "gateway")
    return routing(t).where("viable").withColumn("position", F.row_number().over(order)).select("gateway", "position")


# ------------------------------------------------------------------------------------------------------- hashing
@query(
    "x06_hash_lane_uniform",
    f"""SELECT o_orderkey, {', '.join(f"{lane_sql('sha256(o_orderkey || chr(124) || o_orderpriority)', i)} AS u{i}" for i in range(4))} FROM orders""",
)
def _(t):
    d = digest(F.col("o_orderkey").cast("string"), F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", *[lane_uniform(d, i).alias(f"u{i}") for i in range(4)])


@query(
    "x07_weighted_choice",
    f"""SELECT choice, count(*) AS rows FROM (SELECT CASE WHEN {lane_sql("sha256(o_orderkey || '|pick')", 0)} < 0.2 THEN 'a' WHEN {lane_sql("sha256(o_orderkey || '|pick')", 0)} < 0.2 + 0.5 THEN 'b' ELSE 'c' END AS choice FROM orders) GROUP BY 1""",
)
def _(t):
    draw = lane_uniform(digest(F.col("o_orderkey").cast("string"), "pick"), 0)
    pick = weighted_choice(draw, [("a", F.lit(0.2)), ("b", F.lit(0.5)), ("c", F.lit(0.3))])
    return t.orders.groupBy(pick.alias("choice")).agg(F.count(F.lit(1)).alias("rows"))
