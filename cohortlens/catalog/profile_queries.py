"""Profiling and reconciliation over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import profile
from .quality_queries import INSTITUTION_SQL
from .tables import FACT, FACT_SQL, payments, query

_NOTE = (
    "CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 9 = 1 THEN 'N/A' WHEN c_custkey % 9 = 2 THEN '-' "
    "WHEN c_custkey % 9 = 3 THEN ' vip ' WHEN c_custkey % 9 = 4 THEN 'VIP' WHEN c_custkey % 9 = 5 THEN 'vip' ELSE c_mktsegment END"
)
_CODE = "CASE WHEN c_custkey % 37 = 0 THEN concat('x', c_custkey % 5) ELSE CAST(c_custkey % 50 AS {0}) END"


def customers(t):
    """Customers with a messy note and a code that is a number most of the time."""
    return t.customer.withColumn("note", F.expr(_NOTE)).withColumn("code", F.expr(_CODE.format("STRING")))


CUST_SQL = f"cust AS (SELECT *, {_NOTE} AS note, {_CODE.format('VARCHAR')} AS code FROM customer)"
TEXT_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "note", "code"]


def _tall(columns) -> str:
    return "tall AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM cust" for c in columns) + ")"


TALL_SQL = f"WITH {CUST_SQL},{_tall(TEXT_COLUMNS)}"


def counts(t):
    return profile.value_counts(customers(t), TEXT_COLUMNS)


@query(
    "p01_column_profile",
    f"""{TALL_SQL} SELECT "column", count(*) AS rows, count(*) - count(value) AS nulls, round(100.0 * (count(*) - count(value)) / count(*), 4) AS null_pct,
  count(DISTINCT value) AS distinct_values, round(100.0 * count(DISTINCT value) / count(value), 4) AS distinct_pct FROM tall GROUP BY 1""",
)
def _(t):
    return profile.column_profile(counts(t)).select("column", "rows", "nulls", "null_pct", "distinct_values", "distinct_pct")


NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "p02_numeric_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(CAST(sum(CAST({c} AS DECIMAL(18,4))) AS DOUBLE) / count({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
  {', '.join(f'round(quantile_cont({c}::DOUBLE, {p}), 6) AS p{int(p * 100)}' for p in profile.PERCENTS)}, count(*) FILTER ({c} < 0) AS negatives, count(*) FILTER ({c} = 0) AS zeros FROM lineitem"""
        for c in NUMERIC
    ),
)
def _(t):
    return profile.numeric_profile(t.lineitem, NUMERIC)


@query(
    "p03_text_that_looks_numeric",
    f"""{TALL_SQL}, look AS (SELECT "column" FROM tall GROUP BY 1 HAVING count(TRY_CAST(value AS DOUBLE)) > 0.9 * count(value))
SELECT "column", value, count(*) AS n FROM tall WHERE value IS NOT NULL AND TRY_CAST(value AS DOUBLE) IS NULL AND "column" IN (SELECT "column" FROM look) GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY value) <= 10""",
)
def _(t):
    return profile.numeric_offenders(counts(t))


@query(
    "p04_top_values_and_singletons",
    f"""{TALL_SQL}, c AS (SELECT "column", value, count(*) AS n FROM tall WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT "column", value, n, (SELECT count(*) FROM c s WHERE s."column" = c."column" AND s.n = 1) AS singletons FROM c QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) <= 15""",
)
def _(t):
    table = counts(t)
    single = profile.column_profile(table).select("column", "singletons")
    return profile.top_values(table).join(single, "column").select("column", "value", "n", "singletons")


@query(
    "p05_space_and_case",
    f"""{TALL_SQL} SELECT "column", count(DISTINCT trim(value)) AS distinct_trimmed, count(DISTINCT lower(trim(value))) AS distinct_lowered,
  count(DISTINCT lower(trim(value))) < count(DISTINCT trim(value)) AS collapses, bool_or(value <> trim(value)) AS has_outer_space FROM tall GROUP BY 1""",
)
def _(t):
    table = counts(t)
    space = profile.column_profile(table).select("column", "has_outer_space")
    return profile.case_collapse(table).join(space, "column")


@query("p06_placeholder_tokens", f"""{TALL_SQL} SELECT "column", count(*) FILTER (lower(trim(value)) IN ('na', 'n/a', 'null', 'none', 'unknown', '-', '--', 'nan', '')) AS placeholders FROM tall GROUP BY 1""")
def _(t):
    return profile.column_profile(counts(t)).select("column", "placeholders")


@query(
    "p07_date_like_columns",
    """WITH o AS (SELECT CASE WHEN o_orderkey % 20 = 0 THEN 'soon' WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS placed FROM orders),
p AS (SELECT coalesce(try_strptime(placed, '%Y-%m-%d'), try_strptime(placed, '%d/%m/%Y')) AS d FROM o)
SELECT 'placed' AS "column", round(100.0 * count(d) / count(*), 2) AS coverage_pct, min(d) AS first, max(d) AS last FROM p""",
)
def _(t):
    k = F.col("o_orderkey")
    placed = F.when(k % 20 == 0, "soon").when(k % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = t.orders.select(placed.alias("placed"), "o_orderstatus")
    return profile.date_like(rows, ["placed", "o_orderstatus"])


@query(
    "p08_duplicate_rows",
    """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates, round(100.0 * sum(n - 1) / sum(n), 4) AS duplicate_pct
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)""",
)
def _(t):
    return profile.duplicate_rows(t.lineitem)


@query("p09_candidate_keys", f"""{TALL_SQL} SELECT "column", round(100.0 * count(DISTINCT value) / count(value), 4) AS distinct_pct FROM tall GROUP BY 1 HAVING count(value) = count(*) AND 100.0 * count(DISTINCT value) / count(value) >= 99""")
def _(t):
    return profile.candidate_keys(profile.column_profile(counts(t)))


@query("p10_rows_per_key", "SELECT rows_per_key, count(*) AS keys FROM (SELECT count(*) AS rows_per_key FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def _(t):
    return profile.key_multiplicity(t.lineitem, "l_orderkey")


@query("p11_value_counts_with_nulls", f"""WITH {CUST_SQL},{_tall(['c_mktsegment', 'note'])} SELECT "column", value, count(*) AS n FROM tall GROUP BY 1, 2""")
def _(t):
    return profile.value_counts(customers(t), ["c_mktsegment", "note"])


_SEG = " UNION ALL ".join(f"SELECT '{d}' AS dim, {d} AS value, status FROM fact" for d in FACT.dims)


@query(
    "p12_segment_rate_spread",
    f"""WITH {FACT_SQL}, seg AS ({_SEG}), r AS (SELECT dim, value, count(*) FILTER (status = 'FAILED') / count(*)::DOUBLE AS rate FROM seg GROUP BY 1, 2)
SELECT dim, count(*) AS "values", round(min(rate), 6) AS lowest, round(max(rate), 6) AS highest, round(max(rate) - min(rate), 6) AS spread FROM r GROUP BY 1""",
)
def _(t):
    rates = profile.segment_rates(payments(t), list(FACT.dims), F.col("status") == "FAILED")
    return profile.rate_spread(rates).select("dim", "values", *[F.round(c, 6).alias(c) for c in ("lowest", "highest", "spread")])


@query("p13_crosstab", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def _(t):
    table = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return table.select("o_orderpriority", *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in ("F", "O", "P")])


@query(
    "p14_code_consistency",
    f"""WITH {FACT_SQL} SELECT count(*) FILTER (status = 'SUCCESS' AND response_code <> 'APPROVED') AS success_not_approved, count(*) FILTER (status = 'FAILED' AND response_code = 'APPROVED') AS failed_but_approved,
  count(*) FILTER (status = 'FAILED' AND response_code = 'TIMEOUT' AND latency_ms < 30) AS fast_timeouts FROM fact""",
)
def _(t):
    s, c = F.col("status"), F.col("response_code")
    return payments(t).agg(
        F.count_if((s == "SUCCESS") & (c != "APPROVED")).alias("success_not_approved"),
        F.count_if((s == "FAILED") & (c == "APPROVED")).alias("failed_but_approved"),
        F.count_if((s == "FAILED") & (c == "TIMEOUT") & (F.col("latency_ms") < 30)).alias("fast_timeouts"),
    )


def _buckets(name: str, unit: str, step: str) -> None:
    @query(
        name,
        f"""WITH c AS (SELECT date_trunc('{unit}', ts) AS b, count(*) AS n FROM events GROUP BY 1), cal AS (SELECT unnest(generate_series((SELECT min(b) FROM c)::TIMESTAMP, (SELECT max(b) FROM c)::TIMESTAMP, INTERVAL '{step}')) AS b),
f AS (SELECT coalesce(c.n, 0) AS n FROM cal LEFT JOIN c ON c.b = cal.b)
SELECT count(*) AS buckets, min(n) AS smallest, quantile_cont(n, 0.5)::DOUBLE AS median, max(n) AS largest, round(sum(n) / count(*)::DOUBLE, 6) AS mean,
  round(count(*) FILTER (n = 0) / count(*)::DOUBLE, 6) AS share_empty, round(count(*) FILTER (n < 5) / count(*)::DOUBLE, 6) AS share_below_5 FROM f""",
    )
    def _(t):
        return profile.bucket_summary(profile.bucket_counts(t.events, "ts", unit, step))


_buckets("p15_hour_buckets", "hour", "1 hour")
_buckets("p15_minute_buckets", "minute", "1 minute")
_buckets("p15_day_buckets", "day", "1 day")


@query("p16_shared_minutes", "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS sharing FROM (SELECT count(*) AS n FROM events GROUP BY date_trunc('minute', ts))")
def _(t):
    return profile.shared_minutes(t.events, "ts")


@query(
    "p17_cell_density",
    """WITH c AS (SELECT count(*) AS n FROM events GROUP BY user_id, event_type) SELECT count(*) AS cells, min(n) AS smallest, quantile_cont(n, 0.5)::DOUBLE AS median, max(n) AS largest,
  round(count(*) FILTER (n < 30) / count(*)::DOUBLE, 6) AS share_below_30, round(count(*) FILTER (n < 100) / count(*)::DOUBLE, 6) AS share_below_100 FROM c""",
)
def _(t):
    return profile.cell_density(t.events, "user_id", "event_type")


@query(
    "p18_group_metrics",
    f"""WITH {FACT_SQL} SELECT gateway, device, count(*) AS rows, round(100.0 * count(*) FILTER (status = 'FAILED') / count(*), 4) AS failure_pct, round(sum(CAST(latency_ms AS BIGINT))::DOUBLE / count(*), 4) AS latency_mean,
  round(quantile_cont(latency_ms, 0.5), 4) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 4) AS latency_p95, round(quantile_cont(latency_ms, 0.99), 4) AS latency_p99 FROM fact GROUP BY 1, 2""",
)
def _(t):
    return profile.group_latency(payments(t), ["gateway", "device"], "latency_ms", F.col("status") == "FAILED")


HOURLY_SQL = "hourly AS (SELECT user_id % 5 AS grp, date_trunc('hour', ts) AS hour, count(*) AS rows, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS rate FROM events GROUP BY 1, 2)"


def hourly(t):
    rows = t.events.withColumn("grp", F.col("user_id") % 5)
    return profile.hourly_rates(rows, "grp", "ts", F.col("event_type") == "error")


@query("p19_hourly_group_rates", f"WITH {HOURLY_SQL} SELECT grp, hour, rows, round(rate, 6) AS rate FROM hourly ORDER BY rate DESC, rows DESC, grp, hour LIMIT 10")
def _(t):
    top = hourly(t).orderBy(F.desc("rate"), F.desc("rows"), "grp", "hour").limit(10)
    return top.select("grp", "hour", "rows", F.round("rate", 6).alias("rate"))


@query("p20_spike_hours", f"WITH {HOURLY_SQL}, m AS (SELECT grp, quantile_cont(rate, 0.5) AS median_rate FROM hourly GROUP BY 1) SELECT grp, hour, round(rate, 6) AS rate, round(median_rate, 6) AS median_rate FROM hourly JOIN m USING (grp) WHERE rate > 3 * median_rate")
def _(t):
    return profile.spike_hours(hourly(t), "grp").select("grp", "hour", F.round("rate", 6).alias("rate"), F.round("median_rate", 6).alias("median_rate"))


@query("p21_worst_hour", f"WITH {HOURLY_SQL}, w AS (SELECT grp AS worst_for, arg_max(hour, (rate, hour)) AS hour FROM hourly GROUP BY 1) SELECT worst_for, hour, grp, rows, round(rate, 6) AS rate FROM w JOIN hourly USING (hour)")
def _(t):
    return profile.worst_hours(hourly(t), "grp").select("worst_for", "hour", "grp", "rows", F.round("rate", 6).alias("rate"))


@query(
    "p22_key_overlap",
    """SELECT 'ids' AS kind, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS left_keys, (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderstatus = 'F') AS right_keys,
  (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) AS shared_keys
UNION ALL SELECT 'dates', (SELECT count(DISTINCT l_shipdate::DATE) FROM lineitem), (SELECT count(DISTINCT o_orderdate::DATE) FROM orders),
  (SELECT count(DISTINCT l_shipdate::DATE) FROM lineitem WHERE l_shipdate::DATE IN (SELECT o_orderdate::DATE FROM orders))""",
)
def _(t):
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    ids = profile.key_overlap(t.lineitem.select(F.col("l_orderkey").alias("k")), done, "k").withColumn("kind", F.lit("ids"))
    dates = profile.key_overlap(t.lineitem.select(F.to_date("l_shipdate").alias("k")), t.orders.select(F.to_date("o_orderdate").alias("k")), "k")
    return ids.unionByName(dates.withColumn("kind", F.lit("dates")))


_LEFT = "SELECT p_name AS name, p_name AS normal FROM part"
_LN = INSTITUTION_SQL.format("CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ltd.' WHEN p_partkey % 3 = 1 THEN p_name || ' ' || p_brand ELSE p_name || 'x' END")
_RN = INSTITUTION_SQL.format("CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'The ' || p_name || ' Limited' END")


@query(
    "p23_name_matching",
    f"""WITH l AS (SELECT DISTINCT {_LN} AS name FROM part), r AS (SELECT DISTINCT {_RN} AS match FROM part WHERE p_size < 20),
x AS (SELECT l.name, min(r.match) FILTER (r.match = l.name) AS exact, min(r.match) FILTER (contains(r.match, l.name) OR contains(l.name, r.match)) AS sub FROM l LEFT JOIN r ON r.match = l.name OR contains(r.match, l.name) OR contains(l.name, r.match) GROUP BY 1)
SELECT name, coalesce(exact, sub) AS matched, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN sub IS NOT NULL THEN 'substring' ELSE 'unmatched' END AS kind FROM x""",
)
def _(t):
    r = F.col("p_partkey")
    written = F.when(r % 3 == 0, F.concat("p_name", F.lit(" ltd."))).when(r % 3 == 1, F.concat("p_name", F.lit(" "), "p_brand")).otherwise(F.concat("p_name", F.lit("x")))
    listed = F.when(r % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("The "), "p_name", F.lit(" Limited")))
    left = t.part.select(text.institution(written).alias("name")).distinct().withColumn("normal", F.col("name"))
    right = t.part.where("p_size < 20").select(text.institution(listed).alias("name")).distinct().withColumn("normal", F.col("name"))
    return profile.name_match(left, right, "name", "normal")


MONTHLY_SQL = """ordered AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS value, count(*) AS n FROM orders GROUP BY 1),
shipped AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS value, count(*) AS n FROM lineitem GROUP BY 1)"""


def monthly(df, time, amount):
    month = F.date_trunc("month", time).cast("date").alias("month")
    return df.groupBy(month).agg(F.sum(F.col(amount).cast("decimal(14,2)")).cast("double").alias("value"), F.count(F.lit(1)).alias("n"))


@query(
    "p24_series_reconciliation",
    f"""WITH {MONTHLY_SQL} SELECT count(*) AS periods, min(month) AS first, max(month) AS last, round(max(abs(o.value - s.value)), 2) AS max_difference, count(*) FILTER (abs(o.value - s.value) > 1000000) AS over_tolerance
FROM ordered o JOIN shipped s USING (month)""",
)
def _(t):
    left, right = monthly(t.orders, "o_orderdate", "o_totalprice"), monthly(t.lineitem, "l_shipdate", "l_extendedprice")
    return profile.series_reconciliation(left, right, "month", "value", 1_000_000.0).withColumn("max_difference", F.round("max_difference", 2))


@query(
    "p25_claims_check",
    """WITH h AS (SELECT hour(ts) AS h, count(*) AS n FROM events GROUP BY 1) SELECT (SELECT count(*) FROM events) AS rows, (SELECT CAST(sum(CAST(value AS DECIMAL(14,2))) AS DOUBLE) FROM events) AS total,
  (SELECT round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) FROM events) AS error_rate, (SELECT round(count(*) FILTER (hour(ts) BETWEEN 10 AND 17) / count(*)::DOUBLE, 6) FROM events) AS day_share,
  (SELECT arg_max(h, (n, -h)) FROM h) AS peak_hour, (SELECT arg_max(event_type, (n, event_type)) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)) AS modal_type""",
)
def _(t):
    hour = F.hour("ts")
    cells = t.events.groupBy(hour.alias("h"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(14,2)")).alias("v"))
    sets = cells.groupingSets([["h"], ["event_type"], []], "h", "event_type").agg(F.grouping_id().alias("g"), F.sum("n").alias("n"), F.sum("v").alias("v"))
    n, whole = F.col("n"), F.col("g") == 3
    total = F.max(F.when(whole, n))
    return sets.agg(
        total.alias("rows"),
        F.max(F.when(whole, F.col("v"))).cast("double").alias("total"),
        F.round(F.sum(F.when((F.col("g") == 2) & (F.col("event_type") == "error"), n)) / total, 6).alias("error_rate"),
        F.round(F.sum(F.when((F.col("g") == 1) & F.col("h").between(10, 17), n)) / total, 6).alias("day_share"),
        F.max_by("h", F.when(F.col("g") == 1, F.struct("n", -F.col("h")))).cast("long").alias("peak_hour"),
        F.max_by("event_type", F.when(F.col("g") == 2, F.struct("n", "event_type"))).alias("modal_type"),
    )


@query("p26_class_balance", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def _(t):
    return t.labels.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("p27_rollup_vs_series", f"WITH {MONTHLY_SQL} SELECT month, o.n AS ordered, s.n AS shipped, round(log10(s.value / o.value), 4) AS magnitude FROM ordered o JOIN shipped s USING (month)")
def _(t):
    left = monthly(t.orders, "o_orderdate", "o_totalprice").select("month", F.col("n").alias("ordered"), F.col("value").alias("a"))
    right = monthly(t.lineitem, "l_shipdate", "l_extendedprice").select("month", F.col("n").alias("shipped"), F.col("value").alias("b"))
    return left.join(right, "month").select("month", "ordered", "shipped", F.round(F.log10(F.col("b") / F.col("a")), 4).alias("magnitude"))


@query(
    "p28_period_changes",
    f"""WITH {MONTHLY_SQL} SELECT month, n, round(100.0 * (n - lag(n) OVER w) / lag(n) OVER w, 4) AS previous_pct, round(100.0 * (n - lag(n, 12) OVER w) / lag(n, 12) OVER w, 4) AS year_pct,
  round(avg(n) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean_3, round(avg(n) OVER (ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS mean_3_prior FROM ordered WINDOW w AS (ORDER BY month)""",
)
def _(t):
    return profile.period_changes(monthly(t.orders, "o_orderdate", "o_totalprice").select("month", "n"), "month", "n")
