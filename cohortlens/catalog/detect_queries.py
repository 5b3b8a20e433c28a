"""Detection on a planted cause: suppression, ranking, residual verdicts, roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import incident
from ..spec import DetectionConfig
from .tables import (
    PAIRS_SQL, PLANTED_FACT, SUPPRESS_SQL, WINDOWS, planted, planted_metrics_sql, query, residual_sql, shared,
)

CONFIG = DetectionConfig()
DETECT_SQL = f"{planted_metrics_sql()},{SUPPRESS_SQL}"


@shared
def _found(t):
    return incident.detect_incident(planted(t), PLANTED_FACT, WINDOWS, CONFIG)


@query(
    "d07_suppressed_candidates",
    f"""{DETECT_SQL} SELECT cohort_key, depth, round(sigma, 6) AS sigma, suppressed, suppressed_by FROM ranked""",
)
def _(t):
    return _found(t).ranked.select("cohort_key", "depth", F.round("sigma", 6).alias("sigma"), "suppressed", "suppressed_by")


@query(
    "w01_ranked_anomalies",
    f"""{DETECT_SQL} SELECT CAST(rank AS INTEGER) AS rank, cohort_key, severity, round(score, 6) AS score, suppressed FROM ranked""",
)
def _(t):
    return _found(t).ranked.select("rank", "cohort_key", "severity", F.round("score", 6).alias("score"), "suppressed")


@query(
    "d08_residual_verdicts",
    f"""{DETECT_SQL},{PAIRS_SQL},{residual_sql('pairs')}
SELECT cohort_key, confounder_key, rb_volume, rb_failures, rc_volume, rc_failures,
  round(independence, 6) AS independence, still_anomalous FROM residual""",
)
def _(t):
    found = _found(t)
    return found.verdicts.select(
        "cohort_key", "confounder_key", "rb_volume", "rb_failures", "rc_volume", "rc_failures",
        F.round("independence", 6).alias("independence"), "still_anomalous",
    )


WALK_SQL = """
edges AS (
  SELECT r.cohort_key, p.confounder_key, p.rank, p.conf_rank, r.independence, r.still_anomalous
  FROM residual r JOIN pairs p USING (cohort_key, confounder_key)
),
walk(r, primaries, cohort_key, derived_from) AS (
  SELECT 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR
  UNION ALL
  SELECT w.r + 1,
    CASE WHEN c.depth = 1 AND e.stopper IS NULL THEN list_append(w.primaries, c.cohort_key) ELSE w.primaries END,
    c.cohort_key, e.stopper
  FROM walk w JOIN reported c ON c.rank = w.r + 1
  LEFT JOIN LATERAL (
    SELECT arg_min(x.confounder_key, x.conf_rank) AS stopper FROM edges x
    WHERE x.cohort_key = c.cohort_key AND NOT x.still_anomalous AND list_contains(w.primaries, x.confounder_key)
  ) e ON true
),
roles AS (
  SELECT c.cohort_key, c.rank, w.derived_from, CASE WHEN w.derived_from IS NULL THEN 'PRIMARY' ELSE 'DERIVATIVE' END AS alert_role
  FROM walk w JOIN reported c ON c.cohort_key = w.cohort_key
),
classified AS (
  SELECT r.rank, r.cohort_key, r.alert_role, r.derived_from,
    min(CASE WHEN e.independence IS NULL AND l.cohort_key IS NOT NULL THEN 1.0 ELSE e.independence END) AS independence
  FROM roles r
  LEFT JOIN roles s ON s.cohort_key = r.derived_from
  LEFT JOIN (SELECT o.* FROM roles o JOIN reported d ON d.cohort_key = o.cohort_key AND d.depth = 1 WHERE o.alert_role = 'PRIMARY') l
    ON l.rank < r.rank AND l.rank <= coalesce(s.rank, r.rank)
  LEFT JOIN edges e ON e.cohort_key = r.cohort_key AND e.confounder_key = l.cohort_key
  GROUP BY ALL
)"""
ROLES_SQL = f"{DETECT_SQL},{PAIRS_SQL},{residual_sql('pairs')},{WALK_SQL}".replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "d09_alert_roles",
    f"""{ROLES_SQL} SELECT CAST(rank AS INTEGER) AS rank, cohort_key, alert_role, derived_from, round(independence, 6) AS independence
FROM classified""",
)
def _(t):
    found = _found(t)
    return found.classified.select(
        "rank", "cohort_key", "alert_role", "derived_from", F.round("independence", 6).alias("independence")
    )


@query(
    "d10_detection_summary",
    f"""{ROLES_SQL} SELECT (SELECT count(*) FROM scored) AS cohorts_scanned, (SELECT count(*) FROM ranked) AS candidates,
  (SELECT count(*) FROM reported) AS reported, count(*) FILTER (alert_role = 'PRIMARY') AS primary_alerts,
  count(*) FILTER (alert_role = 'DERIVATIVE') AS derivative_alerts, max(CASE WHEN rank = 1 THEN cohort_key END) AS top FROM classified""",
)
def _(t):
    found = _found(t)
    tall = (
        found.scored.select(F.lit("scanned").alias("kind"), "cohort_key")
        .unionByName(found.ranked.select(F.lit("candidate").alias("kind"), "cohort_key"))
        .unionByName(found.classified.select(F.col("alert_role").alias("kind"), "cohort_key"))
        .unionByName(found.top.select(F.lit("top").alias("kind"), "cohort_key"))
    )
    kind = F.col("kind")
    return tall.agg(
        F.count_if(kind == "scanned").alias("cohorts_scanned"),
        F.count_if(kind == "candidate").alias("candidates"),
        F.count_if(kind.isin("PRIMARY", "DERIVATIVE")).alias("reported"),
        F.count_if(kind == "PRIMARY").alias("primary_alerts"),
        F.count_if(kind == "DERIVATIVE").alias("derivative_alerts"),
        F.max(F.when(kind == "top", F.col("cohort_key"))).alias("top"),
    )

