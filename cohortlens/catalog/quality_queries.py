"""Normalisation, row rules, quarantine, drift and verification on source-like rows derived from line items."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ..functions import text, vocabulary as v
from ..operators import quality, verification
from ..plans import ingest
from ..session import occupy, stage
from .tables import FACT_SQL, OVERLAY_SQL, payments, query, shared, stored_overlay

NBSP = "\u00a0"


def _pick_sql(values, index: str) -> str:
    return "CASE " + " ".join(f"WHEN {index} = {i} THEN '{x}'" for i, x in enumerate(values)) + " END"


# One list of (source column, SQL text). The same text runs on both engines, so both start from equal strings.
RAW_COLUMNS = [
    ("transaction id", "CASE WHEN p % 211 = 0 THEN '  ' ELSE concat('T', k, '-', ln, '-', p) END"),
    (
        "timestamp",
        "CASE WHEN p % 199 = 1 THEN '2024-02-30 10:00:00' WHEN p % 197 = 2 THEN '2023-05-05 10:00:00' WHEN p % 223 = 5 THEN 'yesterday' "
        "WHEN ln = 3 THEN concat('2024-', mo, '-', dy, ' ', s % 24, ':', p % 60, ':', k % 60) "
        "ELSE concat(' 2024-', lpad(CAST(mo AS {text}), 2, '0'), '-', lpad(CAST(dy AS {text}), 2, '0'), ' ', lpad(CAST(s % 24 AS {text}), 2, '0'), ':', "
        "lpad(CAST(p % 60 AS {text}), 2, '0'), ':', lpad(CAST(k % 60 AS {text}), 2, '0'), '{nbsp}') END",
    ),
    ("transaction type", f"CASE WHEN p % 193 = 3 THEN 'Wallet' WHEN s % 13 = 0 THEN concat('{{nbsp}}', {_pick_sql(v.METHODS, 'p % 4')}, ' ') ELSE {_pick_sql(v.METHODS, 'p % 4')} END"),
    ("merchant_category", f"CASE WHEN p % 191 = 4 THEN '' WHEN p % 131 = 6 THEN 'Gadgets' ELSE {_pick_sql(v.CATEGORIES, 'k % 10')} END"),
    (
        "amount (INR)",
        "CASE WHEN k % 181 = 5 THEN 'NaN' WHEN k % 179 = 6 THEN '-5' WHEN k % 173 = 7 THEN '0' WHEN k % 167 = 8 THEN 'Infinity' "
        "ELSE concat(p * 7 % 45000 + 1, '.', lpad(CAST(k % 1000 AS {text}), 3, '0')) END",
    ),
    ("transaction_status", "CASE WHEN p % 163 = 9 THEN 'pending' WHEN f = 'R' THEN 'FAILED' WHEN f = 'A' THEN 'Success' ELSE ' success' END"),
    ("sender_age_group", "'26-35'"),
    ("receiver_age_group", "'36-45'"),
    ("sender_state", f"CASE WHEN k % 157 = 10 THEN 'Goa' ELSE {_pick_sql(v.REGIONS, 'k % 10')} END"),
    ("sender_bank", f"CASE WHEN k % 151 = 11 THEN 'Canara' ELSE {_pick_sql(v.BANKS, 's % 8')} END"),
    ("receiver_bank", f"CASE WHEN p % 149 = 12 THEN '   ' ELSE {_pick_sql(v.BANKS, 'p % 8')} END"),
    ("device_type", f"CASE WHEN k % 127 = 15 THEN 'Feature phone' ELSE {_pick_sql(v.DEVICES, 'k % 3')} END"),
    ("network_type", f"CASE WHEN p % 113 = 16 THEN '2G' ELSE {_pick_sql(v.NETWORKS, 's % 4')} END"),
    ("fraud_flag", f"CASE WHEN k % 139 = 13 THEN 'maybe' ELSE {_pick_sql(('0', '1', 'true', 'NO', 'Yes', 'f'), 'p % 6')} END"),
    ("hour_of_day", "CASE WHEN k % 137 = 14 THEN '99' ELSE CAST(s % 24 AS {text}) END"),
    ("day_of_week", "'Monday'"),
    ("is_weekend", "'0'"),
]


def _raw_exprs(kind: str):
    return [(n, e.format(text=kind, nbsp=NBSP)) for n, e in RAW_COLUMNS]


def raw_rows(t, dealt: bool = False):
    """Source-like string rows, one per line item, with every kind of dirt the rules must catch."""
    base = (occupy(t.lineitem) if dealt else t.lineitem).select(
        F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("ln"),
        F.col("l_returnflag").alias("f"), F.month("l_shipdate").alias("mo"), F.day("l_shipdate").alias("dy"),
    )
    index = (F.col("k") * 10 + F.col("ln")).cast("long").alias("source_row_index")
    return base.select(*[F.expr(e).alias(n) for n, e in _raw_exprs("STRING")], index)


_WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def clean_sql(c: str) -> str:
    return f"nullif(regexp_replace(regexp_replace({c}, '^{_WS}', ''), '{_WS}$', ''), '')"


def money_sql(c: str) -> str:
    """Half-even by integer arithmetic on thousandths."""
    m = f"CAST(TRY_CAST({clean_sql(c)} AS DECIMAL(38,10)) * 1000 AS BIGINT)"
    q = f"({m} // 10)"
    r = f"({m} % 10)"
    return f"CAST(({q} + CASE WHEN {r} > 5 OR ({r} = 5 AND {q} % 2 = 1) THEN 1 ELSE 0 END) AS DECIMAL(18,2)) / 100"


RAW_SQL = (
    "base AS (SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s, l_linenumber AS ln, l_returnflag AS f, month(l_shipdate) AS mo, day(l_shipdate) AS dy FROM lineitem),\n"
    "raw AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in _raw_exprs("VARCHAR")) + ", CAST(k * 10 + ln AS BIGINT) AS source_row_index FROM base)"
)
_FLAG = f"lower({clean_sql('fraud_flag')})"
NORM_SQL = f"""{RAW_SQL},
norm0 AS (
  SELECT {clean_sql('"transaction id"')} AS transaction_id,
    CASE WHEN regexp_full_match({clean_sql('"timestamp"')}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}} \\d{{1,2}}:\\d{{1,2}}:\\d{{1,2}}')
      THEN try_strptime({clean_sql('"timestamp"')}, '%Y-%m-%d %H:%M:%S') END - INTERVAL '5 hours 30 minutes' AS ts,
    CASE WHEN lower({clean_sql('"amount (INR)"')}) IN ('nan', 'infinity') THEN NULL ELSE CAST({money_sql('"amount (INR)"')} AS DOUBLE) END AS amount,
    upper({clean_sql('transaction_status')}) AS status, {clean_sql('"transaction type"')} AS payment_method,
    CASE WHEN {clean_sql('"transaction type"')} = 'P2P' THEN NULL ELSE {clean_sql('merchant_category')} END AS merchant_category,
    {clean_sql('sender_state')} AS region, {clean_sql('device_type')} AS device, {clean_sql('network_type')} AS network,
    {clean_sql('sender_bank')} AS sender_bank, {clean_sql('receiver_bank')} AS receiver_bank,
    CASE WHEN {_FLAG} IN ('1','true','t','yes','y') THEN true WHEN {_FLAG} IN ('0','false','f','no','n') THEN false END AS fraud_flag,
    source_row_index, "hour_of_day" AS stored_hour
  FROM raw
),
norm AS MATERIALIZED (
  SELECT *, CASE {' '.join(f"WHEN {c} IS NULL THEN '{n}'" for n, c in (('payment_method', 'payment_method'), ('transaction_id', 'transaction_id'), ('timestamp', 'ts'), ('amount', 'amount'), ('status', 'status'), ('region', 'region'), ('device', 'device'), ('network', 'network'), ('sender_bank', 'sender_bank'), ('receiver_bank', 'receiver_bank'), ('fraud_flag', 'fraud_flag')))} END AS normalization_error
  FROM norm0
)"""


def _in(values) -> str:
    return "(" + ", ".join(f"'{x}'" for x in values) + ")"


_TS_LO = "TIMESTAMP '2024-01-01 00:05:10' - INTERVAL '5 hours 30 minutes'"
_TS_HI = "TIMESTAMP '2024-12-30 23:55:40' - INTERVAL '5 hours 30 minutes'"
_MONEY_TEXT = "CAST(CAST(amount AS DECIMAL(12,2)) AS VARCHAR)"
RULE_SQL = [
    ("TIMESTAMP", f"NOT ts BETWEEN {_TS_LO} AND {_TS_HI}", "'timestamp outside the audited range'", ["timestamp"]),
    ("AMOUNT", "amount <= 0", f"'amount not positive: ' || {_MONEY_TEXT}", ["amount"]),
    ("AMOUNT", "amount > 0 AND NOT amount BETWEEN 10 AND 42099", f"'amount outside the audited range: ' || {_MONEY_TEXT}", ["amount"]),
    ("STATUS", f"status NOT IN {_in(v.STATUSES)}", "'unknown status: ' || status", ["status"]),
    *[
        ("PAYMENT_CONTEXT", f"{f} NOT IN {_in(a)}", f"'unknown {f}: ' || {f}", [f])
        for f, a in (("payment_method", v.METHODS), ("device", v.DEVICES), ("network", v.NETWORKS), ("region", v.REGIONS))
    ],
    *[("BANKING", f"{f} NOT IN {_in(v.BANKS)}", f"'unknown {f}: ' || {f}", [f]) for f in ("sender_bank", "receiver_bank")],
    ("MERCHANT", "payment_method = 'P2P' AND merchant_category IS NOT NULL", "'P2P row carries a category'", ["merchant_category", "payment_method"]),
    ("MERCHANT", "payment_method <> 'P2P' AND merchant_category IS NULL", "'row needs a category'", ["merchant_category", "payment_method"]),
    ("MERCHANT", f"payment_method <> 'P2P' AND merchant_category NOT IN {_in(v.CATEGORIES)}", "'unknown category: ' || merchant_category", ["merchant_category"]),
]


def _listed(pick) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test} THEN {pick(cat, msg, fields)} END" for cat, test, msg, fields in RULE_SQL) + "], lambda x: x IS NOT NULL)"


JUDGED_SQL = f"""{NORM_SQL},
judged0 AS (
  SELECT *, {_listed(lambda c, m, f: f"'{c}'")} AS cats, {_listed(lambda c, m, f: m)} AS msgs,
    {_listed(lambda c, m, f: "[" + ", ".join(f"'{x}'" for x in f) + "]")} AS flds
  FROM norm
),
judged1 AS (
  SELECT *, CASE WHEN normalization_error IS NOT NULL THEN 'NORMALIZATION' WHEN len(cats) > 0 THEN cats[1] END AS cat1,
    CASE WHEN normalization_error IS NOT NULL THEN 'cannot convert ' || normalization_error WHEN len(cats) > 0 THEN array_to_string(msgs, '; ') END AS msg1,
    CASE WHEN normalization_error IS NOT NULL THEN normalization_error WHEN len(cats) > 0 THEN array_to_string(list_sort(list_distinct(flatten(flds))), ',') END AS fld1
  FROM judged0
),
dup AS (SELECT transaction_id, count(*) AS n FROM judged1 WHERE cat1 IS NULL GROUP BY 1 HAVING count(*) > 1),
judged AS (
  SELECT j.*, CASE WHEN d.n IS NOT NULL AND cat1 IS NULL THEN 'DUPLICATE_ID' ELSE cat1 END AS error_category,
    CASE WHEN d.n IS NOT NULL AND cat1 IS NULL THEN 'transaction_id ' || j.transaction_id || ' appears ' || d.n || ' times' ELSE msg1 END AS validation_error,
    CASE WHEN d.n IS NOT NULL AND cat1 IS NULL THEN 'transaction_id' ELSE fld1 END AS offending_fields
  FROM judged1 j LEFT JOIN dup d ON d.transaction_id = j.transaction_id
)"""


def normalized(t):
    return quality.normalize_rows(raw_rows(t), "lineitem_2024")


@shared
def first_pass(t):
    """Source rows written once, as a source would be, then normalised, judged and written by verdict."""
    return ingest.judge_and_stage(stage(raw_rows(t, dealt=True), "source-rows"), "lineitem_2024")


@shared
def parted(t):
    return quality.part_duplicates(first_pass(t).passing)


def judged(t):
    unique, copies = parted(t)
    return unique.unionByName(copies).unionByName(first_pass(t).failing)


# ------------------------------------------------------------------------------------------------- normalisation
def _one(name: str, column: str, expr, sql: str, kind: str | None = None):
    @query(name, f"WITH {RAW_SQL} SELECT {sql} AS value, count(*) AS rows FROM raw GROUP BY 1")
    def _(t):
        value = expr(F.col(f"`{column}`"))
        return raw_rows(t).groupBy((value.cast(kind) if kind else value).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


_one("n01_trim_unicode_space", "transaction type", text.clean_text, clean_sql('"transaction type"'))
_one("n02_required_id", "transaction id", lambda c: text.clean_text(c).isNull(), f"""{clean_sql('"transaction id"')} IS NULL""")
_one(
    "n03_local_timestamp", "timestamp", text.local_time,
    f"""CASE WHEN regexp_full_match({clean_sql('"timestamp"')}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}} \\d{{1,2}}:\\d{{1,2}}:\\d{{1,2}}') THEN try_strptime({clean_sql('"timestamp"')}, '%Y-%m-%d %H:%M:%S') END - INTERVAL '5 hours 30 minutes'""",
)
_one(
    "n04_money_half_even", "amount (INR)", text.money,
    f"""CASE WHEN lower({clean_sql('"amount (INR)"')}) IN ('nan', 'infinity') THEN NULL ELSE CAST({money_sql('"amount (INR)"')} AS DOUBLE) END""", "double",
)
_one("n05_status_upper", "transaction_status", lambda c: F.upper(text.clean_text(c)), f"upper({clean_sql('transaction_status')})")
_one("n06_method_trim", "transaction type", lambda c: F.coalesce(text.clean_text(c), F.lit("(none)")), f"""coalesce({clean_sql('"transaction type"')}, '(none)')""")
_one("n08_boolean_words", "fraud_flag", text.flag, f"CASE WHEN {_FLAG} IN ('1','true','t','yes','y') THEN true WHEN {_FLAG} IN ('0','false','f','no','n') THEN false END")


@query("n07_conditional_category", f"WITH {NORM_SQL} SELECT payment_method, merchant_category, count(*) AS rows FROM norm GROUP BY 1, 2")
def _(t):
    return normalized(t).groupBy("payment_method", "merchant_category").agg(F.count(F.lit(1)).alias("rows"))


CANON_SQL = "transaction_id, ts AS event_time, amount, status, payment_method, merchant_category, region, device, network, sender_bank, receiver_bank, fraud_flag, source_row_index"


@query("n09_full_row_mapping", f"WITH {NORM_SQL} SELECT {CANON_SQL}, normalization_error FROM norm")
def _(t):
    names = [c.strip() for c in CANON_SQL.replace("ts AS event_time", "event_time").split(",")]
    rows = normalized(t).withColumnRenamed("timestamp", "event_time").withColumn("amount", F.col("amount").cast("double"))
    return rows.select(*names, "normalization_error")


@query("n10_generated_aliases", f"WITH {NORM_SQL} SELECT payment_method AS transaction_type, sender_bank AS issuer_bank, count(*) AS rows FROM norm GROUP BY 1, 2")
def _(t):
    return normalized(t).groupBy("transaction_type", "issuer_bank").agg(F.count(F.lit(1)).alias("rows"))


GROUPED_SQL = "CASE WHEN o_orderkey % 50 = 0 THEN 'NA' ELSE CAST(o_orderkey // 1000 AS VARCHAR) || ',' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || chr(160) END"


@query("n11_grouped_numbers", f"SELECT o_orderkey, TRY_CAST(replace(replace({GROUPED_SQL}, ',', ''), chr(160), '') AS DOUBLE) AS value FROM orders")
def _(t):
    k = F.col("o_orderkey")
    written = F.when(k % 50 == 0, "NA").otherwise(
        F.concat(F.floor(k / 1000).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(NBSP))
    )
    return t.orders.select("o_orderkey", text.grouped_number(written).alias("value"))


@query(
    "n12_short_month",
    """SELECT written, try_strptime('20' || written, '%Y-%b')::DATE AS month, count(*) AS rows FROM (
  SELECT CASE WHEN o_orderkey % 40 = 0 THEN 'total' ELSE strftime(o_orderdate, '%y-%b') END AS written FROM orders) GROUP BY 1""",
)
def _(t):
    written = F.when(F.col("o_orderkey") % 40 == 0, "total").otherwise(F.date_format("o_orderdate", "yy-MMM"))
    rows = t.orders.groupBy(written.alias("written")).agg(F.count(F.lit(1)).alias("rows"))
    return rows.select("written", text.short_month(F.col("written")).alias("month"), "rows")


_NAME_SQL = "CASE s_suppkey % 4 WHEN 0 THEN s_name || ' Bank Ltd.' WHEN 1 THEN lower(s_name) || '  BANK LIMITED' WHEN 2 THEN s_name || ', Co.' ELSE s_name END"
INSTITUTION_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(upper({0}), '\\bLTD\\.?\\b|\\bLIMITED\\b', '', 'g'), '[.,]', '', 'g'), '\\s+', ' ', 'g'))"


def named_suppliers(t):
    n, r = F.col("s_name"), F.col("s_suppkey") % 4
    written = (
        F.when(r == 0, F.concat(n, F.lit(" Bank Ltd."))).when(r == 1, F.concat(F.lower(n), F.lit("  BANK LIMITED"))).when(r == 2, F.concat(n, F.lit(", Co."))).otherwise(n)
    )
    return t.supplier.select("s_suppkey", written.alias("written"))


@query("n13_institution_name", f"SELECT written, {INSTITUTION_SQL.format('written')} AS name FROM (SELECT {_NAME_SQL} AS written FROM supplier)")
def _(t):
    return named_suppliers(t).select("written", text.institution(F.col("written")).alias("name"))


# --------------------------------------------------------------------------------------------------------- rules
_LIST = "[" + ", ".join(f"'{c}'" for c in v.SOURCE_COLUMNS) + "]"
_REQ = "[" + ", ".join(f"'{c}'" for c in v.REQUIRED_COLUMNS) + "]"
_OPT = "[" + ", ".join(f"'{c}'" for c in v.OPTIONAL_COLUMNS) + "]"


def _without(a: str, b: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter({a}, lambda x: NOT list_contains({b}, x)))), ',')"


@query(
    "q01_header_drift",
    f"""WITH h AS (SELECT c_custkey AS file, list_filter({_LIST}, lambda x: NOT ((c_custkey % 3 = 0 AND x = 'sender_bank') OR (c_custkey % 4 = 0 AND x = 'is_weekend')))
  || CASE WHEN c_custkey % 3 = 0 THEN ['issuer'] ELSE [] END || CASE WHEN c_custkey % 5 = 0 THEN ['timestamp'] ELSE [] END AS names FROM customer)
SELECT file, {_without(_REQ, 'names')} AS missing_required, {_without(_OPT, 'names')} AS missing_optional, {_without('names', _LIST)} AS unexpected,
  array_to_string(list_sort(list_distinct(list_filter(names, lambda x: len(list_filter(names, lambda y: y = x)) > 1))), ',') AS duplicated, c_custkey_fatal AS fatal
FROM (SELECT *, file % 3 = 0 OR file % 5 = 0 AS c_custkey_fatal FROM h)""",
)
def _(t):
    """One header per customer file, some with a renamed, missing or repeated column and padded names."""
    k = F.col("c_custkey")
    base = F.array(*[F.lit(f" {c} ") for c in v.SOURCE_COLUMNS])
    none = F.array().cast("array<string>")
    kept = F.filter(base, lambda x: ~(((k % 3 == 0) & (x == " sender_bank ")) | ((k % 4 == 0) & (x == " is_weekend "))))
    names = F.concat(kept, F.when(k % 3 == 0, F.array(F.lit("issuer"))).otherwise(none), F.when(k % 5 == 0, F.array(F.lit("timestamp"))).otherwise(none))
    table = quality.header_drift(t.customer.select(k.alias("file"), names.alias("names")))
    lists = ("missing_required", "missing_optional", "unexpected", "duplicated")
    return table.select("file", *[F.array_join(c, ",").alias(c) for c in lists], "fatal")


@query(
    "q02_type_drift",
    f"""WITH {RAW_SQL}, s AS (
  SELECT 'amount (INR)' AS col, "amount (INR)" AS value, {money_sql('"amount (INR)"')} IS NULL AS bad FROM raw
  UNION ALL SELECT 'timestamp', "timestamp", CASE WHEN regexp_full_match({clean_sql('"timestamp"')}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}} \\d{{1,2}}:\\d{{1,2}}:\\d{{1,2}}')
    THEN try_strptime({clean_sql('"timestamp"')}, '%Y-%m-%d %H:%M:%S') END IS NULL FROM raw)
SELECT col AS "column", count(*) AS sampled, round(avg(bad::INTEGER), 6) AS bad_share, avg(bad::INTEGER) > 0.5 AS changed,
  coalesce(array_to_string(list_sort(list_distinct(list(value) FILTER (bad AND value IS NOT NULL)))[1:5], '|'), '') AS examples FROM s GROUP BY 1""",
)
def _(t):
    checks = {"amount (INR)": text.money(F.col("`amount (INR)`")), "timestamp": text.local_time(F.col("timestamp"))}
    return quality.type_drift(raw_rows(t), checks).withColumn("examples", F.array_join("examples", "|"))


def _rule_query(name: str, category: str) -> None:
    """Rows failing one rule family (normalised rows only), by message."""
    rules = [(c, test, msg) for c, test, msg, _ in RULE_SQL if c == category]
    parts = " UNION ALL ".join(f"SELECT {msg} AS message, source_row_index, transaction_id FROM norm WHERE normalization_error IS NULL AND {test}" for _, test, msg in rules)

    @query(name, f"WITH {NORM_SQL} SELECT message, count(*) AS rows FROM ({parts}) GROUP BY 1")
    def _(t):
        mine = [r for r in quality.payment_rules() if r.category == category]
        return quality.count_messages(quality.collect_failures(normalized(t), mine))


for _name, _category in (
    ("q04_timestamp_bounds", "TIMESTAMP"), ("q05_amount_bounds", "AMOUNT"), ("q06_status_vocabulary", "STATUS"),
    ("q07_context_vocabularies", "PAYMENT_CONTEXT"), ("q08_bank_universe", "BANKING"), ("q09_category_rule", "MERCHANT"),
):
    _rule_query(_name, _category)


@query(
    "q03_identity_rule",
    f"WITH {NORM_SQL} SELECT count(*) FILTER (transaction_id IS NULL) AS missing_id, count(*) AS rows FROM norm",
)
def _(t):
    rule = [r for r in quality.payment_rules() if r.category == "IDENTITY"][0]
    return normalized(t).agg(F.count_if(rule.failing).alias("missing_id"), F.count(F.lit(1)).alias("rows"))


@query("q10_provenance_rule", f"WITH {RAW_SQL} SELECT 0::BIGINT AS missing_dataset, count(*) FILTER (source_row_index IS NULL) AS missing_index FROM raw")
def _(t):
    dataset, index = [r for r in quality.payment_rules() if r.category == "PROVENANCE"]
    return normalized(t).agg(F.count_if(dataset.failing).alias("missing_dataset"), F.count_if(index.failing).alias("missing_index"))


@query("q11_all_failures_per_row", f"WITH {JUDGED_SQL} SELECT source_row_index, transaction_id, cat1 AS error_category, msg1 AS validation_error, fld1 AS offending_fields FROM judged1 WHERE cat1 IS NOT NULL")
def _(t):
    return first_pass(t).failing.select("source_row_index", "transaction_id", "error_category", "validation_error", F.array_join("offending_fields", ",").alias("offending_fields"))


@query("q12_duplicate_quarantine", f"WITH {JUDGED_SQL} SELECT source_row_index, transaction_id, validation_error FROM judged WHERE error_category = 'DUPLICATE_ID'")
def _(t):
    return parted(t)[1].select("source_row_index", "transaction_id", "validation_error")


@query(
    "q13_split_valid_quarantine",
    f"""WITH {JUDGED_SQL} SELECT error_category IS NULL AS valid, count(*) AS rows, CAST(sum(amount) FILTER (error_category IS NULL) AS DOUBLE) AS amount FROM judged GROUP BY 1""",
)
def _(t):
    passed = F.col("error_category").isNull()
    return judged(t).groupBy(passed.alias("valid")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(passed, F.col("amount"))).cast("double").alias("amount"))


@query("q14_reject_summary", f"WITH {JUDGED_SQL} SELECT error_category, count(*) AS rows FROM judged WHERE error_category IS NOT NULL GROUP BY 1")
def _(t):
    rejected = first_pass(t).failing.unionByName(parted(t)[1])
    return rejected.groupBy("error_category").agg(F.count(F.lit(1)).alias("rows"))


# -------------------------------------------------------------------------------------------------- verification
@query(
    "q15_vocabulary_leftovers",
    f"WITH {NORM_SQL} SELECT DISTINCT value FROM (SELECT sender_bank AS value FROM norm UNION SELECT receiver_bank FROM norm) WHERE value NOT IN {_in(v.BANKS)}",
)
def _(t):
    return quality.vocabulary_leftovers(normalized(t), ["sender_bank", "receiver_bank"], v.BANKS)


@query(
    "q16_count_invariants",
    f"""WITH {NORM_SQL} SELECT 'p2p_with_category' AS "check", count(*) FILTER (payment_method = 'P2P' AND merchant_category IS NOT NULL) AS broken FROM norm
UNION ALL SELECT 'category_missing', count(*) FILTER (payment_method <> 'P2P' AND merchant_category IS NULL) FROM norm
UNION ALL SELECT 'alias_mismatch', count(*) FILTER (CASE WHEN source_row_index % 401 = 0 THEN upper(payment_method) ELSE payment_method END IS DISTINCT FROM payment_method) FROM norm
UNION ALL SELECT 'flagged', count(*) FILTER (fraud_flag) FROM norm
UNION ALL SELECT 'missing_lineage', count(*) FILTER (source_row_index % 601 = 0) FROM norm
UNION ALL SELECT 'wrong_dataset', count(*) FILTER (CASE WHEN source_row_index % 307 = 0 THEN 'other' WHEN source_row_index % 509 <> 0 THEN 'lineitem_2024' END IS DISTINCT FROM 'lineitem_2024') FROM norm""",
)
def _(t):
    """Over rows some of which were damaged after normalisation: an alias in capitals, another dataset or none, no position."""
    c, at = F.col, F.col("source_row_index")
    rows = normalized(t).withColumns({
        "transaction_type": F.when(at % 401 == 0, F.upper("transaction_type")).otherwise(c("transaction_type")),
        "source_dataset": F.when(at % 307 == 0, "other").when(at % 509 != 0, c("source_dataset")),
        "source_row_index": F.when(at % 601 != 0, at),
    })
    checks = {
        "p2p_with_category": (c("payment_method") == "P2P") & c("merchant_category").isNotNull(),
        "category_missing": (c("payment_method") != "P2P") & c("merchant_category").isNull(),
        "alias_mismatch": ~c("transaction_type").eqNullSafe(c("payment_method")) | ~c("issuer_bank").eqNullSafe(c("sender_bank")),
        "flagged": c("fraud_flag"),
        "missing_lineage": c("source_row_index").isNull(),
        "wrong_dataset": ~c("source_dataset").eqNullSafe(F.lit("lineitem_2024")),
    }
    return quality.check_rows(rows, checks).select("check", "broken")


@query(
    "q17_structural_checks",
    """SELECT 'amount_positive' AS "check", count(*) FILTER (NOT l_extendedprice > 0) AS broken, count(*) FILTER (NOT l_extendedprice > 0) = 0 AS passed FROM lineitem
UNION ALL SELECT 'discount_in_bounds', count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.05), count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.05) = 0 FROM lineitem
UNION ALL SELECT 'flag_vocabulary', count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')), count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) = 0 FROM lineitem
UNION ALL SELECT 'line_in_range', count(*) FILTER (NOT l_linenumber BETWEEN 1 AND 6), count(*) FILTER (NOT l_linenumber BETWEEN 1 AND 6) = 0 FROM lineitem""",
)
def _(t):
    c = F.col
    return quality.check_rows(t.lineitem, {
        "amount_positive": ~(c("l_extendedprice") > 0),
        "discount_in_bounds": ~c("l_discount").between(0, 0.05),
        "flag_vocabulary": ~c("l_returnflag").isin("A", "N", "R"),
        "line_in_range": ~c("l_linenumber").between(1, 6),
    })


@query(
    "q18_staging_count",
    f"WITH {JUDGED_SQL} SELECT count(*) AS staged_rows, count(DISTINCT transaction_id) AS distinct_ids, count(*) = count(DISTINCT transaction_id) AS passed FROM judged WHERE error_category IS NULL",
)
def _(t):
    from ..session import scratch_path
    from ..sources import publish

    valid, _ = quality.split_rows(judged(t))
    return publish.stage_and_verify(valid, scratch_path(t.spark, "staging"), valid.count(), "transaction_id")


@query("q19_distinct_ids", "SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS ids, count(*) = count(DISTINCT o_orderkey) AS passed FROM orders")
def _(t):
    per_id = t.orders.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("ids")).withColumn("passed", F.col("rows") == F.col("ids"))


@query("q20_foreign_key_orphans", f"WITH {NORM_SQL} SELECT count(*) AS orphans FROM norm WHERE sender_bank IS NULL OR receiver_bank IS NULL OR sender_bank NOT IN {_in(v.BANKS)} OR receiver_bank NOT IN {_in(v.BANKS)}")
def _(t):
    universe = t.spark.createDataFrame([(b,) for b in v.BANKS], "bank string")
    return quality.orphan_count(normalized(t), ["sender_bank", "receiver_bank"], universe, "bank")


@query("q21_duplicate_surplus", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate HAVING count(*) > 1)")
def _(t):
    return quality.duplicate_surplus(t.lineitem)


EXPECTED = "(VALUES ('F', 5000), ('O', 5000), ('P', 5000), ('X', 1))"


@query(
    "q22_distribution_check",
    f"""SELECT coalesce(o.value, e.value) AS value, o.observed, CAST(e.expected AS BIGINT) AS expected, o.observed IS NOT DISTINCT FROM e.expected AS passed
FROM (SELECT o_orderstatus AS value, count(*) AS observed FROM orders GROUP BY 1) o FULL OUTER JOIN {EXPECTED} e(value, expected) ON o.value = e.value""",
)
def _(t):
    expected = t.spark.createDataFrame([("F", 5000), ("O", 5000), ("P", 5000), ("X", 1)], "value string, expected bigint")
    return quality.count_distribution(t.orders, "o_orderstatus", expected)


@query("q23_min_max_check", "SELECT min(o_totalprice) AS lowest, max(o_totalprice) AS highest, min(o_totalprice) >= 0 AND max(o_totalprice) <= 600000 AS passed FROM orders")
def _(t):
    one = t.orders.agg(F.min("o_totalprice").alias("lowest"), F.max("o_totalprice").alias("highest"))
    return one.withColumn("passed", (F.col("lowest") >= 0) & (F.col("highest") <= 600000))


_Q24_ROWS = [
    # name, type, expected, actual (SQL aggregate or None where skipped), detail of a failure (SQL aggregate) or the reason of the skip
    ("keys_distinct", "integer", "'0'", "(count(*) - count(DISTINCT l_orderkey))", "''"),
    ("amount_positive", "integer", "'0'", "count(*) FILTER (NOT l_extendedprice > 0)", "''"),
    ("line_in_range", "integer", "'0'", "count(*) FILTER (NOT l_linenumber BETWEEN 1 AND 6)", "'for example ' || min(l_orderkey) FILTER (NOT l_linenumber BETWEEN 1 AND 6)"),
    ("flag_counts", "text", "'A=1,N=2,R=3,*=0'",
     "'A=' || count(*) FILTER (l_returnflag = 'A') || ',N=' || count(*) FILTER (l_returnflag = 'N') || ',R=' || count(*) FILTER (l_returnflag = 'R') || ',*=' || count(*) FILTER (coalesce(l_returnflag NOT IN ('A', 'N', 'R'), true))", "''"),
    ("line_bounds", "text", "'1..7'", "min(l_linenumber) || '..' || max(l_linenumber)", "''"),
    ("has_returns", "boolean", "'true'", "(count(*) FILTER (l_returnflag = 'R') > 0)", "''"),
    ("known_total", "decimal", "'0.00'", None, "'the content is not the audited file'"),
]


def _q24_sql() -> str:
    parts = []
    for i, (name, kind, expected, actual, detail) in enumerate(_Q24_ROWS):
        head = f"SELECT {i + 1} AS position, '{name}' AS name"
        if actual is None:
            parts.append(f"{head}, 'SKIPPED' AS state, '{kind}' AS value_type, {expected} AS expected, NULL::VARCHAR AS actual, {detail} AS detail")
            continue
        shown = f"CAST({actual} AS VARCHAR)"
        same = f"{shown} = {expected}"
        parts.append(
            f"{head}, CASE WHEN {same} THEN 'PASSED' ELSE 'FAILED' END AS state, '{kind}' AS value_type, {expected} AS expected, {shown} AS actual, "
            f"CASE WHEN {same} THEN '' ELSE coalesce({detail}, '') END AS detail FROM lineitem"
        )
    return "\nUNION ALL ".join(parts)


def line_item_checks():
    c = F.col
    return [
        verification.all_distinct("keys_distinct", "l_orderkey"),
        verification.none_of("amount_positive", ~(c("l_extendedprice") > 0)),
        verification.none_of("line_in_range", ~c("l_linenumber").between(1, 6), c("l_orderkey")),
        verification.value_counts("flag_counts", c("l_returnflag"), {"A": 1, "N": 2, "R": 3}),
        verification.bounds("line_bounds", c("l_linenumber"), 1, 7),
        verification.Check("has_returns", F.count_if(c("l_returnflag") == "R") > 0, True),
        verification.Check("known_total", F.sum(c("l_extendedprice").cast("decimal(14,2)")), Decimal("0.00"), skipped="the content is not the audited file"),
    ]


@query("q24_verification_report", _q24_sql())
def _(t):
    return verification.verify(t.lineitem, line_item_checks())


@query(
    "q24_verification_verdict",
    f"""WITH r AS ({_q24_sql()}) SELECT count(*) FILTER (state <> 'SKIPPED') AS checked, count(*) FILTER (state = 'FAILED') AS failed, count(*) FILTER (state = 'SKIPPED') AS skipped,
  count(*) FILTER (state = 'FAILED') = 0 AS passed, coalesce(string_agg(name, ', ' ORDER BY position) FILTER (state = 'FAILED'), '') AS failures FROM r""",
)
def _(t):
    return verification.overall(verification.verify(t.lineitem, line_item_checks()))


_Q25 = {
    "success_means_approved": "status = 'SUCCESS' AND response_code <> 'APPROVED'",
    "failure_not_approved": "status = 'FAILED' AND response_code = 'APPROVED'",
    "no_rescue": "observed_status = 'FAILED' AND status = 'SUCCESS'",
    "changed_means_different": "outcome_changed <> (status <> observed_status)",
    "only_members_change": "outcome_changed AND NOT in_affected_cohort",
    "observed_failures": "observed_status = 'FAILED'",
}


@query(
    "q25_overlay_coherence",
    f"""WITH {FACT_SQL},{OVERLAY_SQL}, damaged AS (SELECT * REPLACE (
  CASE WHEN order_id % 97 = 5 THEN 'APPROVED' ELSE response_code END AS response_code, CASE WHEN order_id % 89 = 7 THEN 'SUCCESS' ELSE status END AS status,
  outcome_changed OR order_id % 101 = 3 AS outcome_changed) FROM overlay)
"""
    + " UNION ALL ".join(f"""SELECT '{n}' AS "check", count(*) FILTER ({bad}) AS broken, count(*) FILTER ({bad}) = 0 AS passed FROM damaged""" for n, bad in _Q25.items()),
)
def _(t):
    """Over a stored overlay some of whose rows were damaged: an approval on a failure, a rescued failure, a change that is none."""
    at = F.col("order_id")
    overlay = stored_overlay(t).withColumns({
        "response_code": F.when(at % 97 == 5, "APPROVED").otherwise(F.col("response_code")),
        "status": F.when(at % 89 == 7, "SUCCESS").otherwise(F.col("status")),
        "outcome_changed": F.col("outcome_changed") | (at % 101 == 3),
    })
    return quality.check_rows(overlay, {n: F.expr(bad) for n, bad in _Q25.items()})


@query(
    "q26_coverage",
    """WITH src AS (SELECT o_orderkey AS k, o_orderkey % 3 AS lin, count(*) AS n FROM orders GROUP BY 1, 2),
d AS (SELECT l_orderkey AS k, l_orderkey % 3 AS lin, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2)
SELECT CAST(sum(d.n) AS BIGINT) AS derived_rows, count(d.k) AS derived_keys, count(*) FILTER (d.n > 1) AS repeated_keys, count(*) FILTER (d.k IS NULL) AS uncovered,
  count(*) FILTER (src.k IS NULL) AS orphans, count(*) FILTER (src.k IS NOT NULL AND d.k IS NOT NULL AND src.lin <> d.lin) AS lineage_mismatch FROM src FULL OUTER JOIN d ON src.k = d.k""",
)
def _(t):
    source = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 3).alias("run"))
    derived = t.lineitem.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("k"), (F.col("l_orderkey") % 3).alias("run"))
    return quality.coverage(source, derived, "k", "run")


@query(
    "q27_within_sampling_error",
    """WITH g AS (SELECT l_suppkey % 5 AS grp, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS f, sum(count(*)) OVER () AS total FROM lineitem GROUP BY 1)
SELECT grp, abs(n / total::DOUBLE - 0.2) <= 4 * sqrt(0.2 * 0.8 / total::DOUBLE) AS share_ok, abs(f / n::DOUBLE - 0.3333) <= 4 * sqrt(0.3333 * (1 - 0.3333) / n) AS rate_ok,
  abs(f / n::DOUBLE - 0.25) <= 4 * sqrt(0.25 * 0.75 / n) AS wrong_rate_ok FROM g""",
)
def _(t):
    g = t.lineitem.groupBy((F.col("l_suppkey") % 5).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("f"))
    g = g.crossJoin(g.agg(F.sum("n").alias("total")))  # one row
    ok = quality.within_sampling_error
    return g.select(
        "grp", ok(F.col("n"), F.col("total"), F.lit(0.2)).alias("share_ok"), ok(F.col("f"), F.col("n"), F.lit(0.3333)).alias("rate_ok"),
        ok(F.col("f"), F.col("n"), F.lit(0.25)).alias("wrong_rate_ok"),
    )


@query(
    "q28_staleness_state",
    """WITH d AS (SELECT o_orderpriority AS derived, max(o_orderkey) FILTER (o_orderstatus = 'F') AS generation_run, arg_max(o_orderkey % 4, o_orderkey) FILTER (o_orderstatus = 'F') AS built_from,
  count(*) FILTER (o_orderkey % 7 <> 0 OR o_orderpriority IN ('1-URGENT', '2-HIGH')) AS assigned, count(*) AS source_rows FROM orders GROUP BY 1)
SELECT derived, CASE WHEN generation_run IS NULL THEN 'ABSENT' WHEN built_from IS DISTINCT FROM CASE WHEN derived = '1-URGENT' THEN built_from WHEN derived = '2-HIGH' THEN built_from + 1 ELSE built_from END THEN 'STALE_INGESTION_MISMATCH'
  WHEN assigned <> source_rows THEN 'STALE_INCOMPLETE_COVERAGE' ELSE 'CURRENT' END AS state FROM d""",
)
def _(t):
    done = F.col("o_orderstatus") == "F"
    priority = F.col("o_orderpriority")
    run = t.orders.groupBy(priority.alias("derived")).agg(
        F.max(F.when(done, F.col("o_orderkey"))).alias("generation_run"),
        F.max_by(F.col("o_orderkey") % 4, F.when(done, F.col("o_orderkey"))).alias("built_from"),
        F.count_if((F.col("o_orderkey") % 7 != 0) | priority.isin("1-URGENT", "2-HIGH")).alias("assigned"),
        F.count(F.lit(1)).alias("source_rows"),
    )
    shifted = F.when(F.col("derived") == "2-HIGH", F.col("built_from") + 1).otherwise(F.col("built_from"))
    return quality.staleness(run.withColumn("current_run", shifted)).select("derived", "state")


@query(
    "q29_derived_column_redundancy",
    f"""WITH {NORM_SQL} SELECT count(*) FILTER (ts IS NOT NULL) AS compared, count(*) FILTER (ts IS NOT NULL AND CAST(hour(ts + INTERVAL '5 hours 30 minutes') AS VARCHAR) <> stored_hour) AS different FROM norm""",
)
def _(t):
    local = F.from_utc_timestamp("timestamp", v.LOCAL_ZONE)
    stored = F.col("raw_record")["hour_of_day"]
    known = F.col("timestamp").isNotNull()
    return normalized(t).agg(
        F.count_if(known).alias("compared"), F.count_if(known & (F.hour(local).cast("string") != stored)).alias("different")
    )
