"""Filters, joins onto the outcome surface, cohort metrics and their derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.hashing import cohort_key
from ..operators import detect, metrics, ranking, whatif
from ..session import materialize
from .tables import (
    FACT, FACT_SQL, IN_CURRENT, OVERLAY_SQL, PLANTED_FACT, PRIOR_START, WINDOWS, lane_sql, metrics_sql, payments, planted, planted_sql,
    query, scored_sql, shared, windowed_sql, z_sql, stored_overlay,
)

BASE_SQL = f"WITH {FACT_SQL},{windowed_sql()},{metrics_sql()}"
CURRENT = (WINDOWS.current_start, WINDOWS.current_end)
NOW_SQL = "ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01'"
MEASURES = [
    "volume", "failures", "CAST(value_total AS DOUBLE) AS value_total", "CAST(value_at_risk AS DOUBLE) AS value_at_risk",
    "round(latency_p50, 6) AS latency_p50", "round(latency_p95, 6) AS latency_p95", "round(latency_p99, 6) AS latency_p99",
    "timeouts", "infrastructure_side", "simulated_rows",
]
SHOWN = ", ".join(MEASURES)


@shared
def cohort_table(t):
    return materialize(fresh_table(t))


def fresh_table(t):
    return metrics.measure(payments(t), FACT, WINDOWS)[1]


# ------------------------------------------------------------------------------------------------------- filters
@query(
    "f01_half_open_window",
    """SELECT l_returnflag, count(*) AS rows, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS amount FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1""",
)
def _(t):
    rows = t.lineitem.where(metrics.in_window(F.col("l_shipdate"), *CURRENT))
    return rows.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double").alias("amount")
    )


@query(
    "f02_exclusion_filter",
    """SELECT o_orderpriority, count(*) AS rows FROM (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS st FROM orders)
WHERE st <> 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1""",
)
def _(t):
    rows = t.orders.withColumn("st", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")))
    return metrics.excluding(rows, {"st": "F", "o_orderpriority": "5-LOW"}).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("rows"))


COHORT_DEFS = "(VALUES ('all', NULL, NULL), ('urgent', NULL, '1-URGENT'), ('finished urgent', 'F', '1-URGENT'), ('finished', 'F', NULL))"


@query(
    "f03_cohort_membership",
    f"""SELECT d.name AS cohort, count(*) AS rows FROM orders JOIN {COHORT_DEFS} d(name, st, pr)
ON (st IS NULL OR o_orderstatus = st) AND (pr IS NULL OR o_orderpriority = pr) GROUP BY 1""",
)
def _(t):
    row = F.create_map(F.lit("o_orderstatus"), F.col("o_orderstatus"), F.lit("o_orderpriority"), F.col("o_orderpriority"))
    s, p = F.lit("o_orderstatus"), F.lit("o_orderpriority")
    empty = F.create_map().cast("map<string,string>")
    definitions = F.array(
        F.struct(F.lit("all").alias("name"), empty.alias("d")),
        F.struct(F.lit("urgent").alias("name"), F.create_map(p, F.lit("1-URGENT")).alias("d")),
        F.struct(F.lit("finished urgent").alias("name"), F.create_map(s, F.lit("F"), p, F.lit("1-URGENT")).alias("d")),
        F.struct(F.lit("finished").alias("name"), F.create_map(s, F.lit("F")).alias("d")),
    )
    mine = F.filter(definitions, lambda x: metrics.member_of_map(F.col("row"), x["d"]))
    tagged = t.orders.select(row.alias("row")).select(F.explode(F.transform(mine, lambda x: x["name"])).alias("cohort"))
    return tagged.groupBy("cohort").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "f04_cohort_key",
    """SELECT 'o_orderpriority=' || o_orderpriority || '|o_orderstatus=' || o_orderstatus AS cohort_key, count(*) AS rows FROM orders GROUP BY 1
UNION ALL SELECT 'ALL', count(*) FROM orders""",
)
def _(t):
    keys = F.array(cohort_key(["o_orderstatus", "o_orderpriority"]), cohort_key([]))
    return t.orders.select(F.explode(keys).alias("cohort_key")).groupBy("cohort_key").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "f05_window_derivation",
    f"""SELECT w.name AS "window", CASE WHEN w.name = 'baseline' THEN (SELECT min(l_shipdate) FROM lineitem) ELSE w.lo END AS window_start, w.hi AS window_end,
  (SELECT count(*) FROM lineitem WHERE l_shipdate >= w.lo AND l_shipdate < w.hi) AS rows
FROM (VALUES ('baseline', TIMESTAMP '1900-01-01 00:00:00', TIMESTAMP '1997-01-01 00:00:00'), ('prior', TIMESTAMP '{PRIOR_START}', TIMESTAMP '1997-01-01 00:00:00'),
  ('current', TIMESTAMP '1997-01-01 00:00:00', TIMESTAMP '1998-01-01 00:00:00')) w(name, lo, hi)""",
)
def _(t):
    named = F.array(
        F.struct(F.lit("baseline").alias("w"), F.lit(None).cast("timestamp").alias("lo"), F.lit(WINDOWS.current_start).alias("hi")),
        F.struct(F.lit("prior").alias("w"), F.lit(WINDOWS.prior_start).alias("lo"), F.lit(WINDOWS.current_start).alias("hi")),
        F.struct(F.lit("current").alias("w"), F.lit(WINDOWS.current_start).alias("lo"), F.lit(WINDOWS.current_end).alias("hi")),
    )
    ts = F.col("l_shipdate")
    inside = F.filter(named, lambda x: (x["lo"].isNull() | (ts >= x["lo"])) & (ts < x["hi"]))
    rows = t.lineitem.where(ts < F.lit(WINDOWS.current_end)).select("l_shipdate", F.explode(inside).alias("x"))
    return rows.groupBy("x").agg(F.min("l_shipdate").alias("first"), F.count(F.lit(1)).alias("rows")).select(
        F.col("x.w").alias("window"), F.coalesce("x.lo", "first").alias("window_start"), F.col("x.hi").alias("window_end"), "rows"
    )


@query(
    "f06_traffic_span",
    f"""SELECT coalesce(min(l_shipdate), TIMESTAMP '1997-01-01') AS span_start, coalesce(max(l_shipdate), TIMESTAMP '1998-01-01') AS span_end
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'""",
)
def _(t):
    return metrics.traffic_span(payments(t), FACT, *CURRENT)


# --------------------------------------------------------------------------------------------------------- joins
OPTIONS = (("route_1", 0.30, 0.25), ("route_2", 0.45, 0.33), ("route_3", 0.25, 0.41))


def _choice_sql(failed: str, draw: str) -> str:
    weights = [f"CASE WHEN {failed} THEN {w}::DOUBLE * {p}::DOUBLE ELSE {w}::DOUBLE * (1.0::DOUBLE - {p}::DOUBLE) END" for _, w, p in OPTIONS]
    total = " + ".join(f"({w})" for w in weights)
    return (
        f"CASE WHEN {draw} * ({total}) < ({weights[0]}) THEN 'route_1' "
        f"WHEN {draw} * ({total}) < ({weights[0]}) + ({weights[1]}) THEN 'route_2' ELSE 'route_3' END"
    )


ASSIGNED_SQL = f"""assigned AS (
  SELECT txn_id, status, amount, {_choice_sql("status = 'FAILED'", lane_sql("sha256(txn_id || '|routing-1')", 0))} AS route FROM fact)"""


def assigned(t):
    return whatif.assign_dimension(payments(t), FACT, OPTIONS, "routing-1", "route")


@query(
    "j01_fact_assignment_join",
    f"""WITH {FACT_SQL},{ASSIGNED_SQL} SELECT a.route, count(*) AS rows, count(*) FILTER (f.status = 'FAILED') AS failures
FROM fact f JOIN assigned a USING (txn_id) WHERE f.{NOW_SQL.replace('AND ts', 'AND f.ts')} GROUP BY 1""",
)
def _(t):
    # Both sides keep the window, so only the window's rows meet in the shuffle.
    fact = payments(t).where(metrics.in_window(F.col("ts"), *CURRENT))
    run = whatif.assign_dimension(fact, FACT, OPTIONS, "routing-1", "route").select("txn_id", "route", F.lit(1).alias("run_id"))
    joined = fact.withColumn("run_id", F.lit(1)).join(run, ["txn_id", "run_id"])
    return joined.groupBy("route").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "FAILED").alias("failures"))


@query(
    "j02_effective_outcomes",
    f"""WITH {FACT_SQL},{OVERLAY_SQL}
SELECT o.txn_id IS NOT NULL AS overlaid, CASE WHEN o.txn_id IS NOT NULL THEN 'SIMULATED' ELSE 'OBSERVED' END AS source_layer,
  coalesce(o.status, f.status) AS status, coalesce(o.response_code, f.response_code) AS response_code, count(*) AS rows FROM fact f LEFT JOIN overlay o USING (txn_id) GROUP BY ALL""",
)
def _(t):
    return metrics.effective_outcomes(payments(t), stored_overlay(t), FACT).groupBy("overlaid", "source_layer", "status", "response_code").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query(
    "j03_dimension_left_join",
    """SELECT coalesce(s.s_name, '(unmapped)') AS legal_name, count(*) AS rows FROM lineitem l
LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) s ON s.s_suppkey = l.l_suppkey GROUP BY 1""",
)
def _(t):
    known = t.supplier.where("s_suppkey % 3 <> 0")
    counts = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(known, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return joined.groupBy(F.coalesce("s_name", F.lit("(unmapped)")).alias("legal_name")).agg(F.sum("n").alias("rows"))


@query("j04_orphan_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def _(t):
    placed = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(placed, "c_custkey", "left_anti").select("c_custkey")


@query(
    "j05_baseline_current_join",
    f"""{BASE_SQL},{scored_sql()} SELECT dim_set, count(*) AS scanned, CAST(sum(b_volume) AS BIGINT) AS b_volume, CAST(sum(c_volume) AS BIGINT) AS c_volume FROM scored GROUP BY 1""",
)
def _(t):
    return detect.compare_windows(cohort_table(t), FACT).groupBy("dim_set").agg(
        F.count(F.lit(1)).alias("scanned"), F.sum("b_volume").alias("b_volume"), F.sum("c_volume").alias("c_volume")
    )


@query(
    "j12_cohort_rows_current_outcome",
    f"""WITH {FACT_SQL},{OVERLAY_SQL}
SELECT f.txn_id, CAST(f.amount AS DOUBLE) AS amount, f.status AS observed_status, o.status AS current_status
FROM fact f JOIN overlay o USING (txn_id) WHERE f.ts >= TIMESTAMP '1997-01-01' AND f.ts < TIMESTAMP '1998-01-01' AND o.in_affected_cohort""",
)
def _(t):
    fact = payments(t).where(metrics.in_window(F.col("ts"), *CURRENT))
    side = stored_overlay(t).where("in_affected_cohort").select("txn_id", F.col("status").alias("current_status"))
    return fact.join(side, "txn_id").select(
        "txn_id", F.col("amount").cast("double").alias("amount"), F.col("status").alias("observed_status"), "current_status"
    )


@query("a01_cohort_metric_block", f"""{BASE_SQL} SELECT "window", dim_set, cohort_key, {SHOWN} FROM metrics""")
def _(t):
    return fresh_table(t).selectExpr("window", "dim_set", "cohort_key", *MEASURES)


@query("a02_single_set_and_all", f"""{BASE_SQL} SELECT "window", cohort_key, {SHOWN} FROM metrics WHERE dim_set IN ('region', 'ALL')""")
def _(t):
    return metrics.measure(payments(t), FACT, WINDOWS, sets=[("region",)])[1].selectExpr("window", "cohort_key", *MEASURES)


@query("a03_nine_sets_two_windows", f"""{BASE_SQL} SELECT dim_set, "window", count(*) AS cohorts, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(failures) AS BIGINT) AS failures FROM metrics GROUP BY 1, 2""")
def _(t):
    return cohort_table(t).groupBy("dim_set", "window").agg(
        F.count(F.lit(1)).alias("cohorts"), F.sum("volume").alias("volume"), F.sum("failures").alias("failures")
    )


@query(
    "a04_residual_metrics",
    f"""WITH {FACT_SQL},{windowed_sql()} SELECT "window", region, count(*) AS volume, count(*) FILTER (status = 'FAILED') AS failures,
  quantile_cont(latency_ms, 0.95) AS latency_p95 FROM windowed WHERE gateway <> 'gateway_C' GROUP BY 1, 2""",
)
def _(t):
    rest = metrics.excluding(payments(t), {"gateway": "gateway_C"})
    _, table = metrics.measure(rest, FACT, WINDOWS, sets=[("region",)], population=False)
    return table.select("window", "region", "volume", "failures", "latency_p95")


@query(
    "a05_population_metrics",
    f"""WITH {FACT_SQL} SELECT part, count(f.txn_id) AS volume, count(*) FILTER (f.status = 'FAILED') AS failures,
  CAST(coalesce(sum(f.amount), 0) AS DOUBLE) AS value_total, coalesce(quantile_cont(f.latency_ms, 0.95), 0.0) AS latency_p95
FROM (VALUES ('window'), ('empty')) p(part) LEFT JOIN fact f ON part = 'window' AND {NOW_SQL} GROUP BY 1""",
)
def _(t):
    fact = payments(t)
    inside = fact.where(metrics.in_window(F.col("ts"), *CURRENT))
    parts = [("window", inside), ("empty", inside.where(F.col("ts") < F.lit(WINDOWS.current_start)))]
    rows = [metrics.population_metrics(df, FACT).withColumn("part", F.lit(name)) for name, df in parts]
    return rows[0].unionByName(rows[1]).select(
        "part", "volume", "failures", F.col("value_total").cast("double").alias("value_total"), "latency_p95"
    )


@query(
    "a06_derived_rates",
    f"""{BASE_SQL} SELECT "window", cohort_key, round(failure_rate, 6) AS failure_rate, round(timeout_rate, 6) AS timeout_rate,
  round(infrastructure_rate, 6) AS infrastructure_rate, source_layer FROM metrics""",
)
def _(t):
    return cohort_table(t).select(
        "window", "cohort_key", *[F.round(c, 6).alias(c) for c in ("failure_rate", "timeout_rate", "infrastructure_rate")], "source_layer"
    )


@query(
    "a07_sibling_control",
    f"""{BASE_SQL} SELECT s."window", s.cohort_key, CAST(sum(o.volume) AS BIGINT) AS control_volume, CAST(sum(o.failures) AS BIGINT) AS control_failures,
  round(sum(o.failures) / sum(o.volume)::DOUBLE, 6) AS control_failure_rate, count(*) AS siblings
FROM metrics s JOIN metrics o ON o."window" = s."window" AND o.dim_set = s.dim_set AND o.cohort_key <> s.cohort_key WHERE s.depth = 1 GROUP BY 1, 2""",
)
def _(t):
    single = cohort_table(t).where("depth = 1")
    return metrics.sibling_aggregate(single).where("siblings > 0").select(
        "window", "cohort_key", "control_volume", "control_failures", "control_failure_rate", "siblings"
    )


@query("a08_largest_group", f"""WITH {FACT_SQL} SELECT sender_bank, count(*) AS rows FROM fact WHERE {NOW_SQL} GROUP BY 1 ORDER BY rows DESC, sender_bank LIMIT 1""")
def _(t):
    return metrics.largest_group(payments(t).where(metrics.in_window(F.col("ts"), *CURRENT)), "sender_bank")


@query(
    "a09_top_cohort_volumes",
    f"""WITH {FACT_SQL} SELECT gateway, sender_bank, payment_method, count(*) AS volume, round(100.0 * count(*) FILTER (status = 'FAILED') / count(*), 3) AS failure_pct
FROM fact GROUP BY 1, 2, 3 ORDER BY volume DESC, gateway, sender_bank, payment_method LIMIT 15""",
)
def _(t):
    grouped = payments(t).groupBy("gateway", "sender_bank", "payment_method").agg(
        F.count(F.lit(1)).alias("volume"), F.count_if(F.col("status") == "FAILED").alias("failed")
    )
    top = grouped.orderBy(F.desc("volume"), "gateway", "sender_bank", "payment_method").limit(15)
    return top.select("gateway", "sender_bank", "payment_method", "volume", F.round(100.0 * F.col("failed") / F.col("volume"), 3).alias("failure_pct"))


@query(
    "a10_distribution_report",
    f"""WITH {FACT_SQL} SELECT 'response_code' AS kind, response_code AS value, count(*) AS rows, NULL::DOUBLE AS failure_pct, NULL::DOUBLE AS latency_min,
  NULL::DOUBLE AS latency_mean, NULL::DOUBLE AS latency_max FROM fact GROUP BY 2
UNION ALL SELECT 'gateway', gateway, count(*), round(100.0 * count(*) FILTER (status = 'FAILED') / count(*), 4), NULL, NULL, NULL FROM fact GROUP BY 2
UNION ALL SELECT 'latency', 'all', count(*), NULL, min(latency_ms), round(sum(CAST(latency_ms AS BIGINT))::DOUBLE / count(*), 4), max(latency_ms) FROM fact""",
)
def _(t):
    grouped = payments(t).groupingSets([["response_code"], ["gateway"], []], "response_code", "gateway").agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.min("latency_ms").alias("lo"),
        F.sum(F.col("latency_ms").cast("long")).alias("total"),
        F.max("latency_ms").alias("hi"),
    )
    by_gateway, whole = F.col("gid") == 2, F.col("gid") == 3
    return grouped.select(
        F.when(by_gateway, "gateway").when(whole, "latency").otherwise("response_code").alias("kind"),
        F.when(whole, "all").otherwise(F.coalesce("response_code", "gateway")).alias("value"),
        "rows",
        F.when(by_gateway, F.round(100.0 * F.col("failed") / F.col("rows"), 4)).cast("double").alias("failure_pct"),
        F.when(whole, F.col("lo")).alias("latency_min"),
        F.when(whole, F.round(F.col("total") / F.col("rows"), 4)).alias("latency_mean"),
        F.when(whole, F.col("hi")).alias("latency_max"),
    )


@query(
    "a11_dataset_context",
    """SELECT count(*) AS rows, count(DISTINCT year(l_shipdate) // 10000) AS runs, round(count(*) FILTER (l_returnflag = 'R') / count(*)::DOUBLE, 6) AS failure_rate,
  min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts, count(DISTINCT year(l_shipdate) // 10000) = 1 AS usable FROM lineitem""",
)
def _(t):
    run = F.floor(F.year("l_shipdate") / 10000)
    return t.lineitem.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(run).alias("runs"),
        F.round(stats.rate(F.count_if(F.col("l_returnflag") == "R"), F.count(F.lit(1))), 6).alias("failure_rate"),
        F.min("l_shipdate").alias("first_ts"),
        F.max("l_shipdate").alias("last_ts"),
        (F.count_distinct(run) == 1).alias("usable"),
    )


@query(
    "a12_nearest_rank_low",
    f"""WITH {FACT_SQL}, r AS (SELECT gateway, latency_ms, row_number() OVER (PARTITION BY gateway ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY gateway) AS n FROM fact)
SELECT gateway, max(latency_ms) FILTER (rn = floor(0.95 * (n - 1)) + 1) AS p95, max(latency_ms) FILTER (rn = floor(0.5 * (n - 1)) + 1) AS p50 FROM r GROUP BY 1""",
)
def _(t):
    return ranking.nearest_rank_low(payments(t), ["gateway"], "latency_ms", {"p95": 0.95, "p50": 0.5})


@query(
    "a13_traffic_distribution",
    f"""WITH {FACT_SQL}, moved AS (SELECT gateway, count(*) AS before, count(*) FILTER (gateway = 'gateway_C' AND {lane_sql("sha256('move|' || txn_id)", 0)} < 0.2) AS m FROM fact WHERE {NOW_SQL} GROUP BY 1),
tot AS (SELECT sum(before) AS n, sum(m) AS m FROM moved)
SELECT gateway, before, CAST(before + CASE gateway WHEN 'gateway_C' THEN -tot.m WHEN 'gateway_A' THEN tot.m ELSE 0 END AS BIGINT) AS after,
  round(before / tot.n::DOUBLE, 6) AS share_before,
  round((before + CASE gateway WHEN 'gateway_C' THEN -tot.m WHEN 'gateway_A' THEN tot.m ELSE 0 END)::DOUBLE / tot.n::DOUBLE, 6) AS share_after FROM moved, tot""",
)
def _(t):
    from ..functions.hashing import digest, lane_uniform

    fact = payments(t).where(metrics.in_window(F.col("ts"), *CURRENT))
    moved = (F.col("gateway") == "gateway_C") & (lane_uniform(digest("move", F.col("txn_id")), 0) < 0.2)
    table = whatif.traffic_distribution(fact, "gateway", "gateway_C", "gateway_A", moved)
    return table.select("gateway", "before", "after", F.round("share_before", 6).alias("share_before"), F.round("share_after", 6).alias("share_after"))


@query(
    "a15_status_counts",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open,
  count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1""",
)
def _(t):
    wide = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("o_orderpriority", *[F.coalesce(s, F.lit(0)).alias(n) for s, n in (("F", "finished"), ("O", "open"), ("P", "pending"))])


# ----------------------------------------------------------------------------------------------------- statistics
def _stat_query(name, columns, sql_columns):
    @query(name, f"{BASE_SQL},{scored_sql()} SELECT cohort_key, {sql_columns} FROM scored")
    def _(t):
        return detect.score_cohorts(cohort_table(t), FACT).select("cohort_key", *columns())


_stat_query(
    "d01_two_proportion_z",
    lambda: [F.round(stats.two_proportion_z(F.col("b_failures"), F.col("b_volume"), F.col("c_failures"), F.col("c_volume")), 6).alias("z"),
     stats.two_proportion_z(F.lit(0), F.col("b_volume"), F.lit(0), F.col("c_volume")).alias("z_degenerate")],
    f"round({z_sql('b_failures', 'b_volume', 'c_failures', 'c_volume')}, 6) AS z, 0.0::DOUBLE AS z_degenerate",
)
_stat_query(
    "d02_effect_factor", lambda: [F.round(stats.effect_factor(F.col("absolute_delta")), 6).alias("effect")],
    "round(CASE WHEN absolute_delta > 0 THEN least(1.0, absolute_delta / 0.15) ELSE 0.0 END, 6) AS effect",
)
_stat_query("d03_anomaly_score", lambda: [F.round("score", 6).alias("score")], "round(score, 6) AS score")
_stat_query("d04_severity_bands", lambda: [stats.severity(F.abs(F.col("sigma")) * 4).alias("severity")],
            "CASE WHEN abs(sigma) * 4 >= 9 THEN 'CRITICAL' WHEN abs(sigma) * 4 >= 6 THEN 'HIGH' WHEN abs(sigma) * 4 >= 4 THEN 'MEDIUM' WHEN abs(sigma) * 4 >= 3 THEN 'LOW' ELSE 'NONE' END AS severity")
_stat_query("d05_relative_delta", lambda: [F.round("relative_delta", 6).alias("relative_delta"), stats.relative_delta(F.lit(0.0), F.col("c_failure_rate")).alias("on_zero")],
            "round(relative_delta, 6) AS relative_delta, 0.0::DOUBLE AS on_zero")


@query(
    "d06_scored_cohorts",
    f"""{BASE_SQL},{scored_sql()}
SELECT dim_set, cohort_key, b_volume, b_failures, c_volume, c_failures, round(absolute_delta, 6) AS absolute_delta,
  round(sigma, 6) AS sigma, round(score, 6) AS score, severity, verdict FROM scored""",
)
def _(t):
    scored = detect.score_cohorts(fresh_table(t), FACT)
    return scored.select(
        "dim_set", "cohort_key", "b_volume", "b_failures", "c_volume", "c_failures",
        *[F.round(c, 6).alias(c) for c in ("absolute_delta", "sigma", "score")], "severity", "verdict",
    )


@query("j06_generalisation_join", f"""WITH {planted_sql()},{windowed_sql('planted', IN_CURRENT)},{metrics_sql()},{scored_sql()}
SELECT n.cohort_key, b.cohort_key AS broader_key FROM scored n JOIN scored b ON n.verdict = 'ANOMALOUS' AND b.verdict = 'ANOMALOUS' AND b.depth < n.depth
 AND len(list_filter(string_split(b.cohort_key, '|'), lambda x: NOT list_contains(string_split(n.cohort_key, '|'), x))) = 0""")
def _(t):
    _, table = metrics.measure(planted(t), PLANTED_FACT, WINDOWS)
    found = detect.candidates(detect.score_cohorts(table, PLANTED_FACT))
    asked = found.where("depth > 1").select("cohort_key", F.explode(detect.broader_keys(PLANTED_FACT)).alias("broader_key"))
    return asked.join(found.select(F.col("cohort_key").alias("broader_key")), "broader_key").select("cohort_key", "broader_key")
