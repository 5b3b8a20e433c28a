"""Sources and sinks, dataset publication, set operations, scalar functions and fingerprints.

File sources read files that Spark first writes from the driver tables, so their work grows with them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window, functions as F

from ..functions import hashing
from ..operators import fingerprint
from ..plans import ingest
from ..session import scratch_path, stage
from ..sources import files, publish, versions
from .quality_queries import JUDGED_SQL, first_pass, judged, parted, raw_rows
from .tables import FACT_SQL, payments, query, shared
from .metric_queries import ASSIGNED_SQL, assigned


def _written_csv(t, df, name: str, **options):
    path = scratch_path(t.spark, name)
    writer = df.write
    for k, v in {"header": True, **options}.items():
        writer = writer.option(k, v)
    writer.csv(path)
    return path


@query("s01_text_csv_scan", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_acctbal::VARCHAR AS c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS source_row_index FROM customer")
def _(t):
    rows = t.customer.select(F.col("c_custkey").alias(" c_custkey "), "c_name", "c_acctbal")
    path = _written_csv(t, rows.orderBy(" c_custkey "), "customer-csv")
    return files.read_text_csv(t.spark, path)


@query("s02_csv_encoding_fallback", "SELECT 'windows-1252' AS encoding, count(*) AS rows, count(*) FILTER (s_suppkey % 2 = 0) AS accented FROM supplier")
def _(t):
    odd = F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit(" café"))).otherwise(F.col("s_name"))
    path = _written_csv(t, t.supplier.select("s_suppkey", odd.alias("s_name")), "supplier-csv", encoding="ISO-8859-1")
    rows, used = files.read_csv_detecting_encoding(t.spark, path)
    return rows.agg(F.lit(used).alias("encoding"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("s_name").endswith("café")).alias("accented"))


@query("s03_parquet_scan", "SELECT count(*) AS rows, min(p_partkey) AS lowest, max(p_partkey) AS highest FROM part")
def _(t):
    return t.part.agg(F.count(F.lit(1)).alias("rows"), F.min("p_partkey").alias("lowest"), F.max("p_partkey").alias("highest"))


_TYPES = (
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
)


@query(
    "s04_parquet_structure",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{k}' AS type, min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value, count(*) - count({c}) AS nulls FROM orders""" for c, k in _TYPES
    ),
)
def _(t):
    return files.structure_report(t.orders).select("column", "type", "min_value", "max_value", "nulls")


@query(
    "s05_stacked_header_csv",
    """SELECT o_orderpriority AS "Segment", sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::VARCHAR AS "Closed_Volume", max(o_orderkey) FILTER (o_orderstatus = 'F')::VARCHAR AS "Closed_Latest",
  sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::VARCHAR AS "Open_Volume" FROM orders GROUP BY 1""",
)
def _(t):
    body = t.orders.groupBy("o_orderpriority").agg(
        F.count_if(F.col("o_orderstatus") == "F").cast("string").alias("a"),
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).cast("string").alias("b"),
        F.count_if(F.col("o_orderstatus") == "O").cast("string").alias("c"),
    )
    head = t.spark.createDataFrame([("Orders report", None, None, None), (None, "Closed", None, "Open"), ("Segment", "Volume", "Latest", "Volume")], "o_orderpriority string, a string, b string, c string")
    path = scratch_path(t.spark, "stacked-csv")
    head.coalesce(1).unionByName(body.coalesce(1)).coalesce(1).write.csv(path)
    return files.read_stacked_header_csv(t.spark, path)


@query("s06_json_sink", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "profile-json")
    files.write_json(t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), path)
    return t.spark.read.schema("o_orderstatus string, n bigint").json(path)


#: Pages are written as so many files, in order of their ids, a newline after each.
_PAGE_FILES = 16


@shared
def _page_files(t) -> str:
    path = scratch_path(t.spark, "page-files")
    dealt = t.pages.select((F.col("page_id") % _PAGE_FILES).alias("part"), "page_id", F.coalesce("html", F.lit("")).alias("value"))
    # One task holds a whole file, so each file has one part.
    ordered = dealt.repartition(_PAGE_FILES, "part").sortWithinPartitions("part", "page_id")
    ordered.drop("page_id").write.partitionBy("part").text(path)
    return path


@shared
def _fingerprints(t):
    found = files.file_fingerprints(t.spark, _page_files(t))
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("int")
    return stage(found.where(part.isNotNull() & ~F.col("name").startswith("_")).select(part.alias("part"), "length", "lines", "sha256", "state"), "fingerprints")


def _files_sql() -> str:
    levels, below = [], "l"
    for i, children in enumerate([files.LEAF_LINES] + [files.FAN] * (files.LEVELS - 1)):
        n = "count(*)" if i == 0 else "sum(n)"
        levels.append(
            f"t{i} AS (SELECT part, up AS place, CAST({n} AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY place)) AS d FROM (SELECT *, place // {children} AS up FROM {below}) GROUP BY part, up)"
        )
        below = f"t{i}"
    return f"""w AS (SELECT CAST(page_id % {_PAGE_FILES} AS INTEGER) AS part, string_agg(coalesce(html, '') || chr(10), '' ORDER BY page_id) AS content FROM pages GROUP BY 1),
l AS (SELECT part, u.pos - 1 AS place, sha256(u.line) AS d FROM w, LATERAL (SELECT unnest(string_split(left(content, length(content) - 1), chr(10))) AS line, generate_subscripts(string_split(left(content, length(content) - 1), chr(10)), 1) AS pos) u),
{", ".join(levels)},
files AS (SELECT w.part, CAST(octet_length(encode(w.content)) AS BIGINT) AS length, {below}.n AS lines,
  sha256(octet_length(encode(w.content)) || ':' || {below}.n || ':' || {below}.d) AS sha256, 'OK' AS state FROM w JOIN {below} ON {below}.part = w.part)"""


_FILES_SQL = _files_sql()
_REGISTRY_SQL = """registry AS (SELECT DISTINCT sha256, sha256 AS dataset, CASE WHEN substr(sha256, 1, 1) IN ('c', 'd') THEN '0.9.0' ELSE '1.0.0' END AS version
  FROM files WHERE substr(sha256, 1, 1) < 'e')"""


@query("s07_file_fingerprints", f"WITH {_FILES_SQL} SELECT part, length, lines, sha256, state FROM files")
def _(t):
    return _fingerprints(t)


def _registry(t):
    """Most contents are registered under their hash, some of those with an older schema version."""
    lead = F.substring("sha256", 1, 1)
    version = F.when(lead.isin("c", "d"), "0.9.0").otherwise("1.0.0")
    known = _fingerprints(t).where(lead < "e").select("sha256", F.col("sha256").alias("dataset_name"), version.alias("schema_version"))
    return known.distinct()


@query("s08_dataset_identity", f"""WITH {_FILES_SQL}, {_REGISTRY_SQL} SELECT part, dataset,
  CASE WHEN dataset IS NULL THEN 'UNKNOWN' WHEN version <> '1.0.0' THEN 'SCHEMA_MISMATCH' ELSE 'RESOLVED' END AS identity FROM files LEFT JOIN registry USING (sha256)""")
def _(t):
    return publish.resolve_identity(_fingerprints(t), _registry(t), "1.0.0").select("part", "dataset", "identity")


@query(
    "s09_registration_conflicts",
    """WITH reg AS (SELECT sha256(c_name) AS sha, c_name AS name FROM customer WHERE c_custkey % 2 = 0), req AS (SELECT c_custkey, sha256(CASE WHEN c_custkey % 5 = 0 THEN c_name || '!' ELSE c_name END) AS sha, CASE WHEN c_custkey % 3 = 0 THEN c_name || '?' ELSE c_name END AS name FROM customer)
SELECT CASE WHEN s.name IS NULL AND n.sha IS NULL THEN 'NEW' WHEN s.name = q.name THEN 'IDEMPOTENT' WHEN s.name IS NOT NULL THEN 'SHA_CONFLICT' ELSE 'NAME_CONFLICT' END AS registration, count(*) AS requests
FROM req q LEFT JOIN reg s ON s.sha = q.sha LEFT JOIN reg n ON n.name = q.name GROUP BY 1""",
)
def _(t):
    k, n = F.col("c_custkey"), F.col("c_name")
    registry = t.customer.where("c_custkey % 2 = 0").select(F.sha2("c_name", 256).alias("sha256"), n.alias("dataset_name"))
    requests = t.customer.select(
        F.sha2(F.when(k % 5 == 0, F.concat(n, F.lit("!"))).otherwise(n), 256).alias("sha256"),
        F.when(k % 3 == 0, F.concat(n, F.lit("?"))).otherwise(n).alias("dataset_name"),
    )
    return publish.registration_conflicts(requests, registry).groupBy("registration").agg(F.count(F.lit(1)).alias("requests"))


@query("s10_recent_runs", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 20")
def _(t):
    return publish.recent(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query(
    "s11_staged_before_publish",
    f"""WITH {JUDGED_SQL}, copies AS (SELECT 'as_read' AS copy, transaction_id FROM judged WHERE error_category IS NULL
  UNION ALL SELECT 'with_repeats', transaction_id FROM judged WHERE error_category IS NULL UNION ALL SELECT 'with_repeats', transaction_id FROM judged WHERE error_category IS NULL AND source_row_index % 7 = 0
  UNION ALL SELECT 'cut_short', transaction_id FROM judged WHERE error_category IS NULL AND source_row_index % 7 <> 0)
SELECT copy, count(*) AS staged_rows, count(DISTINCT transaction_id) AS distinct_ids,
  count(*) = (SELECT count(*) FROM judged WHERE error_category IS NULL) AND count(*) = count(DISTINCT transaction_id) AS passed FROM copies GROUP BY copy""",
)
def _(t):
    """The staged copy as it should be, one with rows twice, one with rows missing: only the first may be switched to."""
    valid = judged(t).where(F.col("error_category").isNull()).select("transaction_id", "source_row_index")
    seventh = F.col("source_row_index") % 7 == 0
    copies = {"as_read": valid, "with_repeats": valid.unionByName(valid.where(seventh)), "cut_short": valid.where(~seventh)}
    expected = first_pass(t).rows_read - first_pass(t).rows_failing - parted(t)[1].count()
    checked = [publish.stage_and_verify(df, scratch_path(t.spark, "staging"), expected, "transaction_id").withColumn("copy", F.lit(n)) for n, df in copies.items()]
    return reduce(lambda a, b: a.unionByName(b), checked)


@query(
    "s12_atomic_replace",
    """SELECT CASE m WHEN 3 THEN 'before' WHEN 4 THEN 'after' ELSE 'rolled_back' END AS moment, o_orderstatus AS source_dataset, count(*) AS rows, CAST(sum(CASE WHEN m = 4 AND o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS replaced
FROM orders, (VALUES (3), (4), (5)) v(m) WHERE m <> 4 OR o_orderstatus <> 'F' OR o_orderkey % 2 = 0 GROUP BY 1, 2""",
)
def _(t):
    """Three datasets, one of them replaced, and taken back: each manifest reads as one consistent state."""
    target = scratch_path(t.spark, "published")
    rows = t.orders.select("o_orderkey", F.lit(0).alias("version"), F.col("o_orderstatus").alias("source_dataset"))
    for name in ("F", "O", "P"):
        versions.publish(rows.where(F.col("source_dataset") == name), target, name)
    versions.publish(rows.where("source_dataset = 'F' AND o_orderkey % 2 = 0").withColumn("version", F.lit(1)), target, "F")
    versions.rollback(t.spark, target, 3)
    states = [versions.read(t.spark, target, n).withColumn("moment", F.lit(m)) for n, m in ((3, "before"), (4, "after"), (None, "rolled_back"))]
    stored = reduce(lambda a, b: a.unionByName(b), states)
    return stored.groupBy("moment", "source_dataset").agg(F.count(F.lit(1)).alias("rows"), F.sum("version").alias("replaced"))


@query(
    "s13_idempotent_skip",
    """WITH runs AS (SELECT o_custkey % 20 AS sha, o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' ELSE 'FAILED' END AS status FROM orders WHERE o_custkey % 20 < 15), req AS (SELECT DISTINCT o_custkey % 20 AS sha FROM orders)
SELECT req.sha::VARCHAR AS sha256, max(run_id) FILTER (status = 'SUCCEEDED') AS prior_run_id, count(*) FILTER (status = 'SUCCEEDED') > 0 AND req.sha % 4 <> 0 AS skip FROM req LEFT JOIN runs USING (sha) GROUP BY req.sha""",
)
def _(t):
    sha = (F.col("o_custkey") % 20).cast("string").alias("sha256")
    fixed = [F.lit("1.0.0").alias("schema_version"), F.lit("c1").alias("code_version")]
    runs = t.orders.where("o_custkey % 20 < 15").select(
        sha, *fixed, F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("FAILED").alias("status")
    )
    requests = t.orders.select(sha, *fixed).distinct()
    forced = F.col("sha256").cast("int") % 4 == 0
    return publish.prior_success(requests, runs, forced).select("sha256", "prior_run_id", "skip")


@query(
    "s14_run_record",
    f"""WITH {JUDGED_SQL}, c AS (SELECT count(*) AS rows_read, count(*) FILTER (error_category IS NULL) AS rows_valid, count(*) FILTER (error_category IS NOT NULL) AS rows_rejected FROM judged)
SELECT 7 AS run_id, *, rows_valid + rows_rejected = rows_read AS accounted FROM c""",
)
def _(t):
    return publish.run_record(judged(t), F.lit(7))


#: Rows of a CSV file, some 2 MB packed and 10 MB as text.
_CSV_ROWS = 75_000


@shared
def _source_csv(t) -> dict[str, str]:
    """The dirty rows as CSV files, once as they are and once without a required column.

    Text packs to a fraction of its size, and six runs read it while it lies there. A packed file is one task's, so files are bounded by rows.
    """
    rows = raw_rows(t).drop("source_row_index")
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "compression": "gzip", "maxRecordsPerFile": _CSV_ROWS}
    return {"whole": _written_csv(t, rows, "source", **keep), "cut": _written_csv(t, rows.drop("sender_bank"), "source-cut", **keep)}


@query(
    "s13_ingestion_runs",
    f"""WITH {JUDGED_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (error_category IS NULL) AS v FROM judged)
SELECT position, step, status, CASE WHEN loads THEN n ELSE rest END AS rows_read, CASE WHEN loads THEN v ELSE rest END AS rows_valid, CASE WHEN loads THEN n - v ELSE rest END AS rows_rejected,
  prior, CASE WHEN position = 1 THEN 0 ELSE v END AS published
FROM c, (VALUES (1, 'unregistered', 'REFUSED', false, NULL::BIGINT, NULL::INTEGER), (2, 'first', 'SUCCEEDED', true, NULL, NULL), (3, 'again', 'SKIPPED_IDEMPOTENT', false, 0, 2),
  (4, 'forced', 'SUCCEEDED', true, NULL, 2), (5, 'drifted', 'REFUSED', false, NULL, NULL), (6, 'again', 'SKIPPED_IDEMPOTENT', false, 0, 4)) s(position, step, status, loads, rest, prior)""",
)
def _(t):
    """The whole job over CSV files, six times: each run's ledger state, which earlier run it rests on, and the rows readers see after it."""
    spark, sources, house = t.spark, _source_csv(t), ingest.Warehouse(scratch_path(t.spark, "warehouse"))
    seen = []

    def attempt(step: str, source: str, **how):
        try:
            ingest.run_ingestion(spark, source, house, **how)
        except ingest.IngestionError:
            pass  # the ledger has it
        published = versions.manifest(spark, house.folder("facts")).datasets.get("payments")
        seen.append((len(seen) + 1, step, published.rows if published else 0))

    attempt("unregistered", sources["whole"])
    house.register(spark, sources["whole"], "payments")
    house.register(spark, sources["cut"], "payments_cut")
    for step, source, how in (("first", "whole", {}), ("again", "whole", {}), ("forced", "whole", {"force": True}), ("drifted", "cut", {}), ("again", "whole", {})):
        attempt(step, sources[source], **how)
    # Run ids sort by time, so a run's place among them is its position; a handful of runs.
    runs = house.ledger(spark).runs().drop("step").withColumn("position", F.row_number().over(Window.orderBy("run_id")))
    steps = spark.createDataFrame(seen, "position int, step string, published long")
    before = runs.select(F.col("run_id").alias("prior_run_id"), F.col("position").alias("prior"))
    return (
        runs.join(steps, "position").join(before, "prior_run_id", "left")
        .select("position", "step", "status", "rows_read", "rows_valid", "rows_rejected", F.when(F.col("step") != "drifted", F.col("prior")).alias("prior"), "published")
    )


@query("s15_event_log", "SELECT event_type, CAST(2 * count(*) AS BIGINT) AS rows FROM events GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "event-log")
    log = t.events.select("event_id", "event_type", "ts")
    publish.append_events(log, path)
    publish.append_events(log, path)
    return t.spark.read.schema("event_id bigint, event_type string, ts timestamp").parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "s16_canonical_view",
    f"WITH {FACT_SQL} SELECT CASE WHEN sender_bank = 'BUILDING' THEN NULL ELSE sender_bank || ' Bank Ltd' END AS legal_name, count(*) AS rows FROM fact GROUP BY 1",
)
def _(t):
    banks = t.customer.select(F.col("c_mktsegment").alias("bank")).distinct().where("bank <> 'BUILDING'").withColumn("legal_name", F.concat("bank", F.lit(" Bank Ltd")))
    fact = payments(t).withColumn("issuer_bank", F.col("sender_bank"))
    publish.canonical_view(fact, banks, "payments_canonical")
    return t.spark.table("payments_canonical").groupBy("legal_name").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "s17_labelled_view",
    f"""WITH {FACT_SQL},{ASSIGNED_SQL} SELECT observed_status, synthetic_route, 'OBSERVED' AS observed_layer, 'SYNTHETIC' AS synthetic_layer, count(*) AS rows
FROM (SELECT f.status AS observed_status, a.route AS synthetic_route FROM fact f JOIN assigned a USING (txn_id)) GROUP BY ALL""",
)
def _(t):
    made = assigned(t).select("txn_id", "route")
    return publish.labelled_view(payments(t).select("txn_id", "status"), made, "txn_id").groupBy("observed_status", "synthetic_route", "observed_layer", "synthetic_layer").agg(
        F.count(F.lit(1)).alias("rows")
    )


# -------------------------------------------------------------------------------------------------- set operations
@query("o01_union_distinct", "SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer")
def _(t):
    return t.supplier.select(F.col("s_nationkey").alias("nation")).union(t.customer.select("c_nationkey")).distinct()


@query("o02_set_difference", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    return t.orders.where("o_orderstatus = 'F'").select("o_custkey").subtract(t.orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("o03_set_intersection", "SELECT CAST(l_shipdate AS DATE) AS day FROM lineitem INTERSECT SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    left = t.lineitem.select(F.to_date("l_shipdate").alias("day"))
    return left.intersect(t.orders.where("o_orderstatus = 'F'").select(F.to_date("o_orderdate").alias("day")))


@query(
    "o04_set_equality",
    """SELECT (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus FROM orders EXCEPT SELECT * FROM (VALUES ('F'), ('O'), ('P')))) AS unexpected,
  (SELECT count(*) FROM (SELECT * FROM (VALUES ('F'), ('O'), ('P')) EXCEPT SELECT o_orderstatus FROM orders)) AS missing""",
)
def _(t):
    present = t.orders.select(F.col("o_orderstatus").alias("value")).distinct()
    expected = t.spark.createDataFrame([("F",), ("O",), ("P",)], "value string")
    sides = present.exceptAll(expected).select(F.lit("unexpected").alias("side")).unionByName(expected.exceptAll(present).select(F.lit("missing").alias("side")))
    return sides.agg(F.count_if(F.col("side") == "unexpected").alias("unexpected"), F.count_if(F.col("side") == "missing").alias("missing"))


# ------------------------------------------------------------------------------------------------------- functions
@query(
    "x01_string_functions",
    """SELECT s_suppkey, upper(trim('  ' || s_name || ' ')) AS up, lower(s_name) AS low, regexp_replace(s_name, '[0#]+', '-', 'g') AS replaced, concat_ws('/', s_name, s_nationkey) AS joined, contains(s_name, '7') AS has_seven FROM supplier""",
)
def _(t):
    n = F.col("s_name")
    return t.supplier.select(
        "s_suppkey", F.upper(F.trim(F.concat(F.lit("  "), n, F.lit(" ")))).alias("up"), F.lower(n).alias("low"), F.regexp_replace(n, "[0#]+", "-").alias("replaced"),
        F.concat_ws("/", n, F.col("s_nationkey").cast("string")).alias("joined"), n.contains("7").alias("has_seven"),
    )


@query(
    "x02_date_functions",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute_text, date_trunc('minute', ts) AS minute, hour(ts) AS h, month(ts) AS m, ts + INTERVAL '90' MINUTE AS later, ts + INTERVAL '5 hours 30 minutes' AS local_ts FROM events""",
)
def _(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id", F.date_format(ts, "yyyy-MM-dd HH:mm").alias("minute_text"), F.date_trunc("minute", ts).alias("minute"), F.hour(ts).cast("long").alias("h"), F.month(ts).cast("long").alias("m"),
        (ts + F.make_dt_interval(mins=F.lit(90))).alias("later"), F.from_utc_timestamp(ts, "Asia/Kolkata").alias("local_ts"),
    )


@query("x03_number_format", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS shown FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("shown"))


@query(
    "x04_math_functions",
    """SELECT o_orderkey, sqrt(o_totalprice) AS root, abs(o_totalprice - 250000) AS gap, least(1.0, greatest(0.0, o_totalprice / 400000)) AS clamped, CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands,
  round(o_totalprice, 0) AS rounded, sqrt(o_totalprice * 2) AS geometric FROM orders""",
)
def _(t):
    p = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", F.sqrt(p).alias("root"), F.abs(p - 250000).alias("gap"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p / 400000)).alias("clamped"),
        F.floor(p / 1000).alias("thousands"), F.round(p, 0).alias("rounded"), F.sqrt(p * 2).alias("geometric"),
    )


@query("x05_sha256", "SELECT o_orderkey, sha256(o_orderkey || '|' || o_orderstatus) AS digest FROM orders")
def _(t):
    return t.orders.select("o_orderkey", hashing.digest(F.col("o_orderkey").cast("string"), F.col("o_orderstatus")).alias("digest"))


@query(
    "x08_json_functions",
    """SELECT event_id, '{"a":"' || event_type || '","b":"' || user_id || '"}' AS canonical, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) IN (1, 2, 3) AS listed FROM events""",
)
def _(t):
    m = F.create_map(F.lit("b"), F.col("user_id").cast("string"), F.lit("a"), F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select(
        "event_id", hashing.canonical_map(m).alias("canonical"), k.alias("k"), F.array_contains(F.array(F.lit(1), F.lit(2), F.lit(3)), k.cast("int")).alias("listed")
    )


@query(
    "x09_null_handling",
    """WITH n AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders) SELECT coalesce(s, '(none)') AS status, count(*) AS rows, count(*) FILTER (s IS DISTINCT FROM 'F') AS not_f,
  coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) FILTER (s = 'F') AS DOUBLE), 0) AS f_value FROM n GROUP BY 1""",
)
def _(t):
    rows = t.orders.withColumn("s", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")))
    price = F.col("o_totalprice").cast("decimal(14,2)")
    return rows.groupBy(F.coalesce("s", F.lit("(none)")).alias("status")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("s").eqNullSafe("F")).alias("not_f"),
        F.coalesce(F.sum(F.when(F.col("s") == "F", price)).cast("double"), F.lit(0.0)).alias("f_value"),
    )


@query("x10_reason_text", "SELECT o_orderkey, format('order {} is {} at {}', o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR) AS reason FROM orders")
def _(t):
    return t.orders.select(
        "o_orderkey", F.format_string("order %d is %s at %s", "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("reason")
    )


# ----------------------------------------------------------------------------------------------------- fingerprints
def _tree_sql(source: str, line: str) -> str:
    """SQL text of the content fingerprint of `source`, ending in one row of t0."""
    size, words = fingerprint.WORD_DIGITS, range(fingerprint.WORDS)
    sums = ", ".join(f"sum(CAST('0x' || substr(d, {1 + size * i}, {size}) AS BIGINT)) AS w{i}" for i in words)
    shown = " || ':' || ".join(["leaf", "n", *(f"w{i}" for i in words)])
    return f"""leaves AS (SELECT substr(d, 1, {fingerprint.LEAF_DIGITS}) AS leaf, count(*) AS n, {sums} FROM (SELECT sha256({line}) AS d FROM {source}) GROUP BY 1),
t0 AS (SELECT coalesce(sum(n), 0) AS n, sha256(coalesce(string_agg({shown}, chr(10) ORDER BY {shown}), '')) AS digest FROM leaves)"""


FINGERPRINT_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "price", "placed")
_LINE = "concat_ws('|', o_orderkey, o_custkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'))"


def _rendered(t):
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("placed")
    )


@query("a19_content_fingerprint", f"WITH {_tree_sql('orders', _LINE)} SELECT CAST(n AS BIGINT) AS rows, digest AS fingerprint FROM t0")
def _(t):
    return fingerprint.content_fingerprint(_rendered(t))


def _print_of(source: str, line: str) -> str:
    return f"(WITH {_tree_sql(source, line)} SELECT digest FROM t0)"


_EDITED = "(SELECT * REPLACE (o_totalprice + CASE WHEN o_orderkey = 1 THEN 1 ELSE 0 END AS o_totalprice) FROM orders)"


@query(
    "a19_fingerprint_is_order_free",
    f"""SELECT version, (SELECT count(*) FROM orders) AS rows, fingerprint FROM (VALUES ('stored', {_print_of('orders', _LINE)}), ('shuffled', {_print_of('orders', _LINE)}),
  ('edited', {_print_of(_EDITED, _LINE)})) v(version, fingerprint)""",
)
def _(t):
    """Same content in another order and partitioning, and once with one value edited."""
    rows = _rendered(t)
    edited = rows.withColumn("price", F.when(F.col("o_orderkey") == 1, F.col("price") + 1).otherwise(F.col("price")).cast("decimal(18,2)"))
    versions = {"stored": rows, "shuffled": rows.repartition(7, "o_custkey"), "edited": edited}
    parts = [fingerprint.content_fingerprint(df).withColumn("version", F.lit(n)) for n, df in versions.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _digest_tree_sql(source: str, line: str) -> str:
    """SQL text of the digest tree over `source`, one scalar."""
    top, *below = fingerprint.LEVELS
    text_ = f"""d AS (SELECT sha256({line}) AS d, count(*) AS n FROM {source} GROUP BY 1),
t{top} AS (SELECT substr(d, 1, {top}) AS prefix, sum(n) AS n, sha256(string_agg(d || ':' || n, chr(10) ORDER BY d || ':' || n)) AS digest FROM d GROUP BY 1)"""
    for under, i in zip(fingerprint.LEVELS, below):
        child = "prefix || ':' || digest"
        if i:
            text_ += f""",
t{i} AS (SELECT substr(prefix, 1, {i}) AS prefix, sum(n) AS n, sha256(string_agg({child}, chr(10) ORDER BY {child})) AS digest FROM t{under} GROUP BY 1)"""
        else:
            text_ += f""",
t0 AS (SELECT sum(n) AS n, sha256(coalesce(string_agg({child}, chr(10) ORDER BY {child}), '')) AS digest FROM t{under})"""
    return f"(WITH {text_} SELECT digest FROM t0)"


@query(
    "c11_input_fingerprint",
    f"""SELECT sha256('orders=' || {_digest_tree_sql('orders', _LINE)} || '|supplier=' || {_digest_tree_sql('supplier', "concat_ws('|', s_suppkey, s_nationkey)")} || '|policy=policy-1|seed=incident-1') AS input_fingerprint""",
)
def _(t):
    parts = {"orders": _rendered(t), "supplier": t.supplier.select("s_suppkey", "s_nationkey")}
    return fingerprint.input_fingerprint(parts, {"policy": "policy-1", "seed": "incident-1"})

