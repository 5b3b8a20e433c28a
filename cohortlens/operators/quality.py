"""Row normalisation, quality rules, quarantine, schema drift and verification checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..functions import text, vocabulary as v
from ..functions.stats import binomial_error, rate
from ..session import FILE_ROWS, small_tasks, stage


# ---------------------------------------------------------------------------------------------- normalisation
def normalize_rows(raw: DataFrame, dataset: str) -> DataFrame:
    """Source strings to canonical columns: every string is cleaned once, then converted.

    `normalization_error` is NULL or the first field that cannot be converted, the payment method first and the
    rest in field order; the raw row travels along as a struct, whose columns are only read for what is quarantined.
    To look at normalised rows only, test `normalization_error` beside what is computed from the row: a filter is moved
    below this projection, and all conversions are then done twice.
    """
    c = F.col
    sources = {
        "transaction_id": "transaction id", "timestamp": "timestamp", "amount": "amount (INR)", "status": "transaction_status",
        "payment_method": "transaction type", "merchant_category": "merchant_category", "region": "sender_state", "device": "device_type",
        "network": "network_type", "sender_bank": "sender_bank", "receiver_bank": "receiver_bank",
    }
    cleaned = {n: text.clean_text(c(f"`{source}`")) for n, source in sources.items()} | {"fraud_flag": F.lower(text.clean_text(c("fraud_flag")))}
    raw_row = F.struct(*[c(f"`{n}`").alias(n) for n in v.SOURCE_COLUMNS if n in raw.columns])
    clean = raw.select(*[e.alias(n) for n, e in cleaned.items()], "source_row_index", raw_row.alias("raw_record"))
    fields = {
        "timestamp": text.local_time_of(c("timestamp"), v.LOCAL_ZONE),
        "amount": text.money_of(c("amount")),
        "status": F.upper("status"),
        "merchant_category": F.when(c("payment_method") == "P2P", F.lit(None).cast("string")).otherwise(c("merchant_category")),
        "fraud_flag": text.flag_of(c("fraud_flag")),
    }
    rows = clean.select(*[fields.get(n, c(n)).alias(n) for n in clean.columns])
    required = ["payment_method", "transaction_id", "timestamp", "amount", "status", "region", "device", "network",
                "sender_bank", "receiver_bank", "fraud_flag"]
    error = F.coalesce(*[F.when(c(n).isNull(), F.lit(n)) for n in required])
    return rows.select(
        "*",
        c("payment_method").alias("transaction_type"),
        c("sender_bank").alias("issuer_bank"),
        F.lit(dataset).alias("source_dataset"),
        error.alias("normalization_error"),
    )


# ------------------------------------------------------------------------------------------------------ rules
@dataclass(frozen=True)
class Rule:
    """One row rule: `failing` is true on rows that break it (never NULL for a broken row)."""

    category: str
    message: Column
    fields: tuple[str, ...]
    failing: Column


def _outside(field: str, allowed) -> Column:
    return F.coalesce(~F.col(field).isin(*allowed), F.lit(True))


def payment_rules() -> list[Rule]:
    """The payment fact's row rules in evaluation order; each field has its own failure."""
    c, lit, cat = F.col, F.lit, F.concat

    def shown(name):
        return F.coalesce(c(name).cast("string"), lit("NULL"))

    def bound(value):
        return F.to_utc_timestamp(lit(value).cast("timestamp"), v.LOCAL_ZONE)

    ts, amount, method, category = c("timestamp"), c("amount"), c("payment_method"), c("merchant_category")
    rules = [
        Rule("IDENTITY", lit("transaction_id is missing"), ("transaction_id",), c("transaction_id").isNull()),
        Rule("TIMESTAMP", lit("timestamp is missing"), ("timestamp",), ts.isNull()),
        Rule("TIMESTAMP", lit("timestamp outside the audited range"), ("timestamp",),
             F.coalesce(~ts.between(bound(v.TIME_MIN), bound(v.TIME_MAX)), lit(False))),
        Rule("AMOUNT", lit("amount is missing"), ("amount",), amount.isNull()),
        Rule("AMOUNT", cat(lit("amount not positive: "), shown("amount")), ("amount",), F.coalesce(amount <= 0, lit(False))),
        Rule("AMOUNT", cat(lit("amount outside the audited range: "), shown("amount")), ("amount",),
             F.coalesce((amount > 0) & ~amount.between(v.AMOUNT_MIN, v.AMOUNT_MAX), lit(False))),
        Rule("STATUS", cat(lit("unknown status: "), shown("status")), ("status",), _outside("status", v.STATUSES)),
    ]
    for field, allowed in (("payment_method", v.METHODS), ("device", v.DEVICES), ("network", v.NETWORKS), ("region", v.REGIONS)):
        rules.append(Rule("PAYMENT_CONTEXT", cat(lit(f"unknown {field}: "), shown(field)), (field,), _outside(field, allowed)))
    for field in ("sender_bank", "receiver_bank"):
        rules.append(Rule("BANKING", cat(lit(f"unknown {field}: "), shown(field)), (field,), _outside(field, v.BANKS)))
    p2p = F.coalesce(method == "P2P", lit(False))
    both = ("merchant_category", "payment_method")
    return rules + [
        Rule("MERCHANT", lit("P2P row carries a category"), both, p2p & category.isNotNull()),
        Rule("MERCHANT", lit("row needs a category"), both, ~p2p & category.isNull()),
        Rule("MERCHANT", cat(lit("unknown category: "), shown("merchant_category")), ("merchant_category",),
             F.coalesce(~p2p & ~category.isin(*v.CATEGORIES), lit(False))),
        Rule("PROVENANCE", lit("row names no dataset"), ("source_dataset",), F.coalesce(c("source_dataset") == "", lit(True))),
        Rule("PROVENANCE", lit("row has no position in its source"), ("source_row_index",), c("source_row_index").isNull()),
    ]


def collect_failures(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """All failures of every row, in rule order, as an array of (category, message, fields)."""
    found = F.array(
        *[
            F.when(
                r.failing,
                F.struct(F.lit(r.category).alias("category"), r.message.alias("message"), F.array(*[F.lit(f) for f in r.fields]).alias("fields")),
            )
            for r in rules
        ]
    )
    return rows.withColumn("failures", F.filter(found, lambda x: x.isNotNull()))


def count_messages(checked: DataFrame) -> DataFrame:
    """(message, rows) of collect_failures' rows that could be normalised.

    Rows are counted by their list of messages before the lists are taken apart, so one aggregation over the facts computes every list
    once. The generator is an outer one: a plain one filters empty lists ahead of it, and such a filter is moved below the aggregation and
    computes the lists a second time.
    """
    normal = F.when(F.col("normalization_error").isNull(), F.col("failures")["message"])
    lists = checked.groupBy(normal.alias("messages")).agg(F.count(F.lit(1)).alias("n"))
    each = lists.select(F.explode_outer("messages").alias("message"), "n").where(F.col("message").isNotNull())
    return each.groupBy("message").agg(F.sum("n").alias("rows"))


def judge_rows(normalized: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Attach category, message and offending fields; NULL category means the row passed.

    Category is the first failure's, messages keep rule order, fields are sorted and distinct. Plain CASE and
    concat_ws expressions, which compile, rather than a filtered array of structs, and none of them for a row that broke no rule.
    A row that could not be normalised is not validated further.
    """
    rules = rules or payment_rules()
    flags = [f"_r{i}" for i in range(len(rules))]
    checked = normalized.select("*", *[r.failing.alias(n) for n, r in zip(flags, rules)])
    stuck = F.col("normalization_error").isNotNull()
    broken = reduce(lambda a, b: a | b, [F.col(n) for n in flags])

    def first(of):
        return F.coalesce(*[F.when(F.col(n), of(r)) for n, r in zip(flags, rules)])

    def joined(separator, of):
        return F.nullif(F.concat_ws(separator, *[F.when(F.col(n), of(r)) for n, r in zip(flags, rules)]), F.lit(""))

    category = F.when(stuck, "NORMALIZATION").when(broken, first(lambda r: F.lit(r.category)))
    message = F.when(stuck, F.concat(F.lit("cannot convert "), F.col("normalization_error"))).when(broken, joined("; ", lambda r: r.message))
    several = F.sort_array(F.array_distinct(F.split(joined(",", lambda r: F.lit(",".join(r.fields))), ",")))
    fields = F.when(stuck, F.array("normalization_error")).when(broken, several)
    return checked.select(
        *normalized.columns,
        category.alias("error_category"),
        message.alias("validation_error"),
        fields.alias("offending_fields"),
    )


@dataclass(frozen=True)
class Judged:
    """One judged write: rows that passed the row rules and rows that failed them, as two folders, and the write's own counts."""

    passing: DataFrame
    failing: DataFrame
    rows_read: int
    rows_failing: int


def write_judged(judged: DataFrame, path: str) -> Judged:
    """Write judged rows once, to a folder by verdict. The write counts what it writes, so no pass is made for counters.

    Each row is held as read and as normalised, two copies of nearly the same text, which zstandard packs closer than the session's codec.
    """
    seen = Observation()
    failing = F.col("error_category").isNotNull()
    counted = judged.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(failing).alias("failing"))
    writer = counted.withColumn("verdict", F.when(failing, "failing").otherwise("passing")).write.option("maxRecordsPerFile", FILE_ROWS)
    writer.partitionBy("verdict").parquet(path, compression="zstd")
    spark, counts = judged.sparkSession, seen.get
    stored = spark.read.schema(f"{_ddl(judged)}, verdict string").parquet(path)
    sides = [stored.where(F.col("verdict") == x).drop("verdict") for x in ("passing", "failing")]
    return Judged(*sides, counts["rows"], counts["failing"])


def _ddl(df: DataFrame) -> str:
    return df.schema.toDDL()


def repeated_ids(passing: DataFrame, id_: str) -> DataFrame:
    """(id, _copies) of ids on more than one row, from a partial aggregation over the id column alone."""
    counted = passing.where(F.col(id_).isNotNull()).groupBy(id_).agg(F.count(F.lit(1)).alias("_copies"))
    with small_tasks(passing.sparkSession):
        return stage(counted.where("_copies > 1"), "repeated-ids")


def part_duplicates(passing: DataFrame, id_: str = "transaction_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose id is theirs alone, every copy of a repeated id marked with the count in the message).

    Repeated ids are few or many, but one row each: Catalyst broadcasts them where their written size is small, and adaptive execution
    splits a hot id otherwise. Rows without an id can't be copies.
    """
    repeated = repeated_ids(passing, id_)
    text_ = F.format_string("transaction_id %s appears %d times", F.col(id_), F.col("_copies"))
    marks = {
        "error_category": F.lit("DUPLICATE_ID"),
        "validation_error": text_,
        "offending_fields": F.array(F.lit(id_)),
    }
    copies = passing.join(repeated, id_).select(*[marks.get(c, F.col(c)).alias(c) for c in passing.columns])
    return passing.join(repeated, id_, "left_anti"), copies


def quarantine_duplicates(judged: DataFrame, id_: str = "transaction_id") -> DataFrame:
    """Mark every copy of an id that more than one passing row carries, with the count in the message."""
    valid = F.col("error_category").isNull()
    unique, copies = part_duplicates(judged.where(valid), id_)
    return unique.unionByName(copies).unionByName(judged.where(~valid))


CANONICAL = (
    "transaction_id", "timestamp", "amount", "status", "payment_method", "transaction_type", "merchant_category", "region", "device",
    "network", "sender_bank", "receiver_bank", "issuer_bank", "fraud_flag", "source_dataset", "source_row_index",
)


def quarantine_rows(failing: DataFrame) -> DataFrame:
    """The quarantine's columns, with the raw row as a map: built here, for rows that failed, and nowhere else."""
    names = failing.schema["raw_record"].dataType.names
    payload = F.create_map(*[x for n in names for x in (F.lit(n), F.col("raw_record")[n])])
    return failing.select(
        "source_row_index", "transaction_id", "validation_error", "error_category", "offending_fields", payload.alias("raw_record")
    )


def split_rows(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid canonical rows, and the quarantine with its full raw payload."""
    valid = judged.where(F.col("error_category").isNull()).select(*CANONICAL)
    return valid, quarantine_rows(judged.where(F.col("error_category").isNotNull()))


# ------------------------------------------------------------------------------------------------ schema drift
def header_drift(headers: DataFrame) -> DataFrame:
    """Compare the header of every file (`file`, `names` array) with the expected one.

    Missing required, missing optional, unexpected and duplicated names, each sorted. A missing required name or a
    duplicate is fatal; a renamed column shows as missing plus unexpected, never as a guess.
    """

    def listed(names):
        return F.array(*[F.lit(n) for n in names])

    seen = F.transform("names", lambda n: F.trim(n))
    rows = headers.select("file", seen.alias("_seen"))
    once = F.array_distinct("_seen")
    twice = F.filter(once, lambda n: F.size(F.filter("_seen", lambda m: m == n)) > 1)
    judged = rows.select(
        "file",
        F.array_sort(F.array_except(listed(v.REQUIRED_COLUMNS), "_seen")).alias("missing_required"),
        F.array_sort(F.array_except(listed(v.OPTIONAL_COLUMNS), "_seen")).alias("missing_optional"),
        F.array_sort(F.array_except("_seen", listed(v.SOURCE_COLUMNS))).alias("unexpected"),
        F.array_sort(twice).alias("duplicated"),
    )
    return judged.withColumn("fatal", (F.size("missing_required") > 0) | (F.size("duplicated") > 0))


def type_drift(raw: DataFrame, checks: dict[str, Column], threshold: float = 0.5) -> DataFrame:
    """Share of all rows that no longer parse, per critical column, with the first five such values as examples.

    Values are counted before anything else, so neither a common value nor a column full of different ones is gathered.
    """
    parts = F.array(
        *[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("value"), parsed.isNull().alias("bad")) for n, parsed in checks.items()]
    )
    tall = raw.select(F.explode(parts).alias("p")).select("p.*")
    values = stage(tall.groupBy("column", "bad", F.when(F.col("bad"), F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n")), "drift")
    rows = F.sum("n")
    share = F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)) / rows
    shares = values.groupBy("column").agg(rows.alias("sampled"), F.round(share, 6).alias("bad_share"), (share > threshold).alias("changed"))
    first = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    few = values.where(F.col("bad") & F.col("value").isNotNull()).withColumn("_at", first).where("_at <= 5")
    few = few.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("examples"))
    none = F.array().cast("array<string>")
    return shares.join(few, "column", "left").withColumn("examples", F.coalesce("examples", none))


# ----------------------------------------------------------------------------------------------- verification
def check_rows(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Zero-row constraints as one aggregation: each check counts the rows that break it."""
    one = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"c{i}") for i, bad in enumerate(checks.values())])
    items = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("broken")) for i, n in enumerate(checks)])
    return one.select(F.explode(items).alias("x")).select("x.check", "x.broken", (F.col("x.broken") == 0).alias("passed"))


def vocabulary_leftovers(df: DataFrame, columns: list[str], allowed) -> DataFrame:
    """Values present in any of the columns but not allowed."""
    values = F.array(*[F.col(c) for c in columns])
    present = df.select(F.explode(values).alias("value")).where(F.col("value").isNotNull()).distinct()
    return present.where(~F.col("value").isin(*allowed))


def count_distribution(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """Observed counts against an expected (value, expected) table; either side may lack a value."""
    observed = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("observed"))
    joined = observed.join(expected, observed["value"].eqNullSafe(expected["value"]), "full_outer")
    return joined.select(
        F.coalesce(observed["value"], expected["value"]).alias("value"),
        "observed",
        "expected",
        F.col("observed").eqNullSafe(F.col("expected")).alias("passed"),
    )


def duplicate_surplus(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy of every fully identical row."""
    counted = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return counted.where("_n > 1").agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("surplus"))


def orphan_count(df: DataFrame, columns: list[str], dimension: DataFrame, key: str) -> DataFrame:
    """Rows whose value in any of the columns is missing from a dimension, each row counted once.

    Facts are first reduced to distinct value combinations, so the joins touch few rows.
    """
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    known = dimension.select(F.col(key).alias("_k")).distinct()
    bad = F.lit(False)
    for i, column in enumerate(columns):
        side = known.select(F.col("_k").alias(f"_k{i}"))
        counted = counted.join(side, F.col(column) == F.col(f"_k{i}"), "left")
        bad = bad | F.col(f"_k{i}").isNull()
    return counted.where(bad).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("orphans"))


def coverage(source: DataFrame, derived: DataFrame, key: str, lineage: str) -> DataFrame:
    """One row per key? Every key covered? Orphans? Lineage agreeing? Counts per key make it one join."""
    left = source.groupBy(key, F.col(lineage).alias("_sl")).agg(F.count(F.lit(1)).alias("_s"))
    right = derived.groupBy(F.col(key).alias("_key"), F.col(lineage).alias("_dl")).agg(F.count(F.lit(1)).alias("_d"))
    joined = left.join(right, F.col(key) == F.col("_key"), "full_outer")
    return joined.agg(
        F.coalesce(F.sum("_d"), F.lit(0)).alias("derived_rows"),
        F.count("_key").alias("derived_keys"),
        F.count_if(F.col("_d") > 1).alias("repeated_keys"),
        F.count_if(F.col("_key").isNull()).alias("uncovered"),
        F.count_if(F.col(key).isNull()).alias("orphans"),
        F.count_if(F.col(key).isNotNull() & F.col("_key").isNotNull() & ~F.col("_sl").eqNullSafe(F.col("_dl"))).alias("lineage_mismatch"),
    )


def within_sampling_error(hits: Column, total: Column, expected: Column, k: float = 4.0) -> Column:
    """Whether a proportion lies within k binomial standard errors of its configured value."""
    return F.abs(rate(hits, total) - expected) <= F.lit(k) * binomial_error(expected, total)


def staleness(run: DataFrame) -> DataFrame:
    """State of a derived table against its source. `run` is one row: generation_run, built_from, current_run, assigned, source_rows."""
    state = (
        F.when(F.col("generation_run").isNull(), "ABSENT")
        .when(~F.col("built_from").eqNullSafe(F.col("current_run")), "STALE_INGESTION_MISMATCH")
        .when(F.col("assigned") != F.col("source_rows"), "STALE_INCOMPLETE_COVERAGE")
        .otherwise("CURRENT")
    )
    return run.withColumn("state", state)
