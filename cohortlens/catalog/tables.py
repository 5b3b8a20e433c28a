"""Roles the driver tables play, in Spark and as SQL text, plus the query registry."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import tune
from ..spec import FactSpec, Windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SHARED: list[dict] = []

FACT = FactSpec()
PLANTED_FACT = FactSpec(simulated="overlaid")
WINDOWS = Windows(datetime(1997, 1, 1), datetime(1998, 1, 1))
PRIOR_START = WINDOWS.prior_start.strftime("%Y-%m-%d %H:%M:%S")


class Tables:
    """Lazy readers for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query and the SQL that must return the same rows."""

    def add(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def shared(build):
    """Run an analysis once per session and folder, and let every query that reports on it read the same tables."""
    kept = {}

    def once(t: Tables):
        key = (t.spark.sparkContext.applicationId, t.folder)
        if key not in kept:
            kept[key] = build(t)
        return kept[key]

    _SHARED.append(kept)
    return once


def forget_shared() -> None:
    for kept in _SHARED:
        kept.clear()


# --------------------------------------------------------------------------------------------------------------
# The payment fact: line items with their order, customer and region.

FACT_SQL = """
fact AS MATERIALIZED (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS txn_id,
         l_shipdate AS ts,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
         CASE WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
         CAST(abs(date_diff('day', o_orderdate, l_shipdate)) AS DOUBLE) AS latency_ms,
         CASE WHEN l_returnflag <> 'R' THEN 'APPROVED'
              WHEN l_linenumber % 4 = 0 THEN 'TIMEOUT'
              WHEN l_linenumber % 4 = 1 THEN 'PROCESSING_ERROR'
              WHEN l_linenumber % 4 = 2 THEN 'ISSUER_DECLINED'
              ELSE 'INSUFFICIENT_FUNDS' END AS response_code,
         'gateway_' || substr('ABCDE', CAST(l_suppkey % 5 + 1 AS INTEGER), 1) AS gateway,
         c_mktsegment AS sender_bank,
         o_orderpriority AS payment_method,
         r_name AS region,
         'device_' || l_linestatus AS device,
         'network_' || CAST(l_partkey % 4 AS VARCHAR) AS network,
         l_orderkey AS order_id
  FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey
)"""


def payments(t: Tables) -> DataFrame:
    """The fact table. Dimension sides carry no broadcast hint: Catalyst broadcasts what it measures as small."""
    geo = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    buyer = t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "r_name")
    line = F.col("l_linenumber") % 4
    # Orders meet their customers first, so line items, the large side, move once.
    order = t.orders.join(buyer, F.col("o_custkey") == F.col("c_custkey")).drop("o_totalprice", "o_orderstatus")
    rows = t.lineitem.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    failed = F.col("l_returnflag") == "R"
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("txn_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"),
        F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"),
        F.abs(F.datediff("l_shipdate", "o_orderdate")).cast("double").alias("latency_ms"),
        F.when(~failed, "APPROVED")
        .when(line == 0, "TIMEOUT")
        .when(line == 1, "PROCESSING_ERROR")
        .when(line == 2, "ISSUER_DECLINED")
        .otherwise("INSUFFICIENT_FUNDS")
        .alias("response_code"),
        F.concat(F.lit("gateway_"), F.substring(F.lit("ABCDE"), (F.col("l_suppkey") % 5 + 1).cast("int"), F.lit(1))).alias(
            "gateway"
        ),
        F.col("c_mktsegment").alias("sender_bank"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("r_name").alias("region"),
        F.concat(F.lit("device_"), F.col("l_linestatus")).alias("device"),
        F.concat(F.lit("network_"), (F.col("l_partkey") % 4).cast("string")).alias("network"),
        F.col("l_orderkey").alias("order_id"),
    )


def windowed_sql(fact: str = "fact", simulated: str = "0") -> str:
    """SQL text that puts each fact row into every window it belongs to."""
    return f"""
windowed AS MATERIALIZED (
  SELECT w.name AS "window", f.*, {simulated} AS is_simulated
  FROM {fact} f JOIN (VALUES
    ('baseline', TIMESTAMP '1900-01-01 00:00:00', TIMESTAMP '1997-01-01 00:00:00'),
    ('prior', TIMESTAMP '{PRIOR_START}', TIMESTAMP '1997-01-01 00:00:00'),
    ('current', TIMESTAMP '1997-01-01 00:00:00', TIMESTAMP '1998-01-01 00:00:00')) w(name, lo, hi)
    ON f.ts >= w.lo AND f.ts < w.hi
)"""


def key_sql(dims) -> str:
    return " || '|' || ".join(f"'{d}=' || coalesce({d}, 'NULL')" for d in sorted(dims)) if dims else "'ALL'"


def metrics_sql(source: str = "windowed", name: str = "metrics") -> str:
    """SQL text of the metric block: one SELECT per dimension set, written the long way on purpose."""
    blocks = []
    for dims in (*FACT.dimension_sets, ()):
        cols = ", ".join(d if d in dims else f"CAST(NULL AS VARCHAR) AS {d}" for d in FACT.dims)
        group = ", ".join(['"window"', *dims])
        blocks.append(
            f"""SELECT "window", '{'+'.join(dims) or 'ALL'}' AS dim_set, {len(dims)} AS depth, {key_sql(dims)} AS cohort_key,
  {cols},
  count(*) AS volume, count(*) FILTER (status = 'FAILED') AS failures,
  sum(amount) AS value_total, coalesce(sum(amount) FILTER (status = 'FAILED'), 0) AS value_at_risk,
  quantile_cont(latency_ms, 0.5) AS latency_p50, quantile_cont(latency_ms, 0.95) AS latency_p95,
  quantile_cont(latency_ms, 0.99) AS latency_p99,
  count(*) FILTER (response_code = 'TIMEOUT') AS timeouts,
  count(*) FILTER (response_code IN ('PROCESSING_ERROR', 'TIMEOUT')) AS infrastructure_side,
  CAST(sum(is_simulated) AS BIGINT) AS simulated_rows,
  count(*) FILTER (status = 'FAILED') / count(*)::DOUBLE AS failure_rate,
  count(*) FILTER (response_code = 'TIMEOUT') / count(*)::DOUBLE AS timeout_rate,
  count(*) FILTER (response_code IN ('PROCESSING_ERROR', 'TIMEOUT')) / count(*)::DOUBLE AS infrastructure_rate,
  CASE WHEN sum(is_simulated) > 0 THEN 'SIMULATED' ELSE 'OBSERVED' END AS source_layer
  FROM {source} GROUP BY {group}"""
        )
    return f"{name} AS MATERIALIZED (\n" + "\nUNION ALL\n".join(blocks) + "\n)"


def z_sql(f0: str, n0: str, f1: str, n1: str) -> str:
    pooled = f"(({f0} + {f1})::DOUBLE / ({n0}::DOUBLE + {n1}::DOUBLE))"
    return (
        f"(CASE WHEN {n0} > 0 AND {n1} > 0 AND {f0} + {f1} > 0 AND {f0} + {f1} < {n0} + {n1} THEN "
        f"({f1}::DOUBLE / {n1}::DOUBLE - {f0}::DOUBLE / {n0}::DOUBLE) / "
        f"sqrt({pooled} * (1.0::DOUBLE - {pooled}) * (1.0::DOUBLE / {n0}::DOUBLE + 1.0::DOUBLE / {n1}::DOUBLE)) "
        f"ELSE 0.0 END)"
    )


def scored_sql(source: str = "metrics") -> str:
    """SQL text of the scored cohort table (baseline against current, inner join)."""
    z = z_sql("b.failures", "b.volume", "c.failures", "c.volume")
    return f"""
compared AS MATERIALIZED (
  SELECT c.dim_set, c.depth, c.cohort_key, {', '.join('c.' + d for d in FACT.dims)},
         b.volume AS b_volume, b.failures AS b_failures, b.failure_rate AS b_failure_rate, b.value_at_risk AS b_value_at_risk,
         b.latency_p95 AS b_latency_p95, b.infrastructure_side AS b_infra, b.infrastructure_rate AS b_infra_rate,
         c.volume AS c_volume, c.failures AS c_failures, c.failure_rate AS c_failure_rate, c.value_at_risk AS c_value_at_risk,
         c.latency_p95 AS c_latency_p95, c.infrastructure_side AS c_infra, c.infrastructure_rate AS c_infra_rate,
         c.source_layer AS c_source_layer, c.simulated_rows AS c_simulated_rows, c.value_total AS c_value_total,
         c.failure_rate - b.failure_rate AS absolute_delta,
         CASE WHEN b.failure_rate <> 0 THEN (c.failure_rate - b.failure_rate) / b.failure_rate ELSE 0.0 END AS relative_delta,
         {z} AS sigma
  FROM {source} c JOIN {source} b ON b.dim_set = c.dim_set AND b.cohort_key = c.cohort_key
  WHERE c."window" = 'current' AND b."window" = 'baseline' AND c.depth > 0
),
scored AS MATERIALIZED (
  SELECT *, CASE WHEN sigma > 0 AND absolute_delta > 0 THEN sigma * least(1.0, absolute_delta / 0.15) ELSE 0.0 END AS score,
         CASE WHEN sigma >= 9 THEN 'CRITICAL' WHEN sigma >= 6 THEN 'HIGH' WHEN sigma >= 4 THEN 'MEDIUM'
              WHEN sigma >= 3 THEN 'LOW' ELSE 'NONE' END AS severity,
         CASE WHEN c_volume < 100 THEN 'CURRENT_TOO_SMALL' WHEN b_volume < 300 THEN 'BASELINE_TOO_SMALL'
              WHEN absolute_delta < 0.02 THEN 'DELTA_TOO_SMALL' WHEN sigma < 3 THEN 'NOT_SIGNIFICANT'
              ELSE 'ANOMALOUS' END AS verdict
  FROM compared
)"""


# --------------------------------------------------------------------------------------------------------------
# A planted cause, the same on both sides: gateway_C degrades in the current window, and one issuer a little.

CAUSES = (("gateway", "gateway_C", 2.0, "incident-1"), ("sender_bank", "MACHINERY", 1.3, "incident-2"))
P_BASE = 0.33


def planted(t: Tables, causes=CAUSES) -> DataFrame:
    from ..operators.whatif import stress

    fact = payments(t).withColumn("overlaid", F.lit(False))
    for dim, value, multiplier, key in causes:
        fact = stress(
            fact, PLANTED_FACT, {dim: value}, F.lit(P_BASE), multiplier, key, WINDOWS.current_start, WINDOWS.current_end
        )
    return fact


def lane_sql(digest: str, lane: int) -> str:
    return f"(('0x' || substr({digest}, {16 * lane + 1}, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"


def planted_sql(causes=CAUSES) -> str:
    """SQL text: `fact` and then one CTE per cause; the last is `planted`."""
    text, source = FACT_SQL, "fact"
    for i, (dim, value, multiplier, key) in enumerate(causes):
        name = "planted" if i == len(causes) - 1 else f"planted_{i}"
        digest = f"sha256('outcome-draw-1|' || txn_id || '|{key}')"
        p_add = f"((least(1.0, {P_BASE}::DOUBLE * {multiplier}::DOUBLE) - {P_BASE}::DOUBLE) / (1.0::DOUBLE - {P_BASE}::DOUBLE))"
        hit = (
            f"(ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01' AND {dim} = '{value}' "
            f"AND status <> 'FAILED' AND {lane_sql(digest, 0)} < {p_add})"
        )
        text += f""",
{name} AS MATERIALIZED (
  SELECT * REPLACE (CASE WHEN {hit} THEN 'FAILED' ELSE status END AS status,
    CASE WHEN {hit} THEN CASE WHEN {lane_sql(digest, 1)} < 0.6 THEN 'PROCESSING_ERROR' ELSE 'TIMEOUT' END
    ELSE response_code END AS response_code)
  FROM {source}
)"""
        source = name
    return text


# --------------------------------------------------------------------------------------------------------------
# An overlay as stored by some earlier run: outcomes of the current window, every third order of gateway_C's failing. By rule, no draw.

OVERLAY_SQL = """overlay AS (
  SELECT txn_id, order_id, status AS observed_status, latency_ms, gateway = 'gateway_C' AS in_affected_cohort,
    gateway = 'gateway_C' AND status <> 'FAILED' AND order_id % 3 = 0 AS outcome_changed,
    CASE WHEN gateway = 'gateway_C' AND order_id % 3 = 0 THEN 'FAILED' ELSE status END AS status,
    CASE WHEN gateway = 'gateway_C' AND status <> 'FAILED' AND order_id % 3 = 0 THEN 'TIMEOUT' ELSE response_code END AS response_code
  FROM fact WHERE ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01'
)"""


def stored_overlay(t: Tables) -> DataFrame:
    from ..operators.metrics import in_window

    rows = payments(t).where(in_window(F.col("ts"), WINDOWS.current_start, WINDOWS.current_end))
    member = F.col("gateway") == "gateway_C"
    changed = member & (F.col("status") != "FAILED") & (F.col("order_id") % 3 == 0)
    return rows.select(
        "txn_id", "order_id", F.col("status").alias("observed_status"), "latency_ms", member.alias("in_affected_cohort"), changed.alias("outcome_changed"),
        F.when(changed, "FAILED").otherwise(F.col("status")).alias("status"), F.when(changed, "TIMEOUT").otherwise(F.col("response_code")).alias("response_code"),
    )


IN_CURRENT = "CASE WHEN f.ts >= TIMESTAMP '1997-01-01' AND f.ts < TIMESTAMP '1998-01-01' THEN 1 ELSE 0 END"


def planted_metrics_sql() -> str:
    """WITH clause up to `scored` on the planted fact; the small tables are materialised for later joins."""
    text = metrics_sql()
    return f"WITH {planted_sql()},{windowed_sql('planted', IN_CURRENT)},{text},{scored_sql()}"


SUPPRESS_SQL = """
cand AS MATERIALIZED (SELECT * EXCLUDE (verdict) FROM scored WHERE verdict = 'ANOMALOUS'),
contains AS MATERIALIZED (
  SELECT n.cohort_key, b.cohort_key AS p_key, b.depth AS p_depth, b.score AS p_score
  FROM cand n JOIN cand b ON b.depth < n.depth AND n.sigma <= b.sigma + 2.0
   AND len(list_filter(string_split(b.cohort_key, '|'), lambda x: NOT list_contains(string_split(n.cohort_key, '|'), x))) = 0
),
lost2 AS MATERIALIZED (SELECT DISTINCT c.cohort_key FROM contains c JOIN cand n USING (cohort_key) WHERE n.depth = 2),
parent AS MATERIALIZED (
  SELECT cohort_key, arg_min(p_key, (p_depth, -p_score, p_key)) AS suppressed_by
  FROM contains WHERE p_key NOT IN (SELECT cohort_key FROM lost2) GROUP BY cohort_key
),
ranked AS MATERIALIZED (
  SELECT cand.*, parent.suppressed_by, parent.suppressed_by IS NOT NULL AS suppressed,
    row_number() OVER (ORDER BY parent.suppressed_by IS NOT NULL, score DESC, sigma DESC, cand.cohort_key) AS rank
  FROM cand LEFT JOIN parent USING (cohort_key)
),
reported AS MATERIALIZED (SELECT * FROM ranked WHERE NOT suppressed)"""


def residual_sql(pairs: str, source: str = "planted") -> str:
    """SQL text: recompute each (subject, confounder) of `pairs` from the rows left after removing the confounder."""
    member = " AND ".join(f"(p.s_{d} IS NULL OR f.{d} = p.s_{d})" for d in FACT.dims)
    dim_of = " ".join(f"WHEN '{d}' THEN f.{d}" for d in FACT.dims)
    z = z_sql("rb_failures", "rb_volume", "rc_failures", "rc_volume")
    delta = "(rc_failures / rc_volume::DOUBLE - rb_failures / rb_volume::DOUBLE)"
    return f"""
residual_counts AS MATERIALIZED (
  SELECT p.cohort_key, p.confounder_key, any_value(p.absolute_delta) AS absolute_delta,
    count(*) FILTER (f.ts < TIMESTAMP '1997-01-01' AND other) AS rb_volume,
    count(*) FILTER (f.ts < TIMESTAMP '1997-01-01' AND other AND status = 'FAILED') AS rb_failures,
    count(*) FILTER (f.ts >= TIMESTAMP '1997-01-01' AND other) AS rc_volume,
    count(*) FILTER (f.ts >= TIMESTAMP '1997-01-01' AND other AND status = 'FAILED') AS rc_failures
  FROM {pairs} p JOIN {source} f ON f.ts < TIMESTAMP '1998-01-01' AND {member}
  CROSS JOIN LATERAL (SELECT (CASE p.conf_dim {dim_of} END) <> p.conf_value AS other) o
  GROUP BY p.cohort_key, p.confounder_key
),
residual AS MATERIALIZED (
  SELECT *, rb_volume = 0 OR rc_volume = 0 AS residual_missing,
    CASE WHEN rb_volume = 0 OR rc_volume = 0 THEN 0.0
         ELSE greatest(0.0, {delta} / absolute_delta) END AS independence,
    CASE WHEN rb_volume = 0 OR rc_volume = 0 THEN NULL ELSE {delta} END AS residual_delta,
    CASE WHEN rb_volume = 0 OR rc_volume = 0 THEN NULL ELSE {z} END AS residual_sigma,
    CASE WHEN rb_volume = 0 OR rc_volume = 0 THEN false
         WHEN rc_volume < 100 OR rb_volume < 300 THEN true
         WHEN {delta} < 0.02 THEN false ELSE {z} >= 3 END AS still_anomalous
  FROM residual_counts
)"""


PAIRS_SQL = f"""
pairs AS MATERIALIZED (
  SELECT c.cohort_key, {', '.join(f'c.{d} AS s_{d}' for d in FACT.dims)}, c.absolute_delta, c.rank AS rank, p.rank AS conf_rank,
    p.cohort_key AS confounder_key, p.dim_set AS conf_dim, string_split(p.cohort_key, '=')[2] AS conf_value
  FROM reported c JOIN reported p ON p.depth = 1 AND p.rank < c.rank
   AND (NOT contains('|' || c.cohort_key, '|' || p.dim_set || '=') OR list_contains(string_split(c.cohort_key, '|'), p.cohort_key))
)"""
