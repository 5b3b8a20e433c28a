"""Column and dataset profiling, and reconciliation of independent sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.stats import rate
from ..functions.text import is_placeholder
from .ranking import exact_percentiles

# Reported percentiles, length of a value list, formats a date may have.
PERCENTS = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)
TOP_VALUES = 15
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "dd-MMM-yyyy")


# ------------------------------------------------------------------------------------------------------- columns
def unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) pairs as text, NULLs kept."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.explode(items).alias("x")).select("x.*")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per (column, value), NULL included: the one shuffle every text profile below is computed from.

    Partial aggregation collapses repeats before the shuffle; a constant column travels as a row per task.
    """
    return unpivot(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def column_profile(counts: DataFrame) -> DataFrame:
    """Nulls, distinct values, placeholder tokens, white space, case collapse and numeric look, per column."""
    value, n = F.col("value"), F.col("n")
    some = value.isNotNull()
    trimmed = F.trim(value)
    total = F.sum("n")
    filled = F.sum(F.when(some, n).otherwise(0))
    numeric = F.sum(F.when(value.try_cast("double").isNotNull(), n).otherwise(0))
    return counts.groupBy("column").agg(
        total.alias("rows"),
        F.sum(F.when(some, 0).otherwise(n)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        F.count_if(some & (n == 1)).alias("singletons"),
        F.coalesce(F.sum(F.when(is_placeholder(value), n)), F.lit(0)).alias("placeholders"),
        F.coalesce(F.bool_or(value != trimmed), F.lit(False)).alias("has_outer_space"),
        numeric.alias("numeric_rows"),
        filled.alias("filled"),
    ).select(
        "column",
        "rows",
        "nulls",
        F.round(100.0 * F.col("nulls") / F.col("rows"), 4).alias("null_pct"),
        "distinct_values",
        F.round(F.when(F.col("filled") > 0, 100.0 * F.col("distinct_values") / F.col("filled")), 4).alias("distinct_pct"),
        "singletons",
        "placeholders",
        "has_outer_space",
        F.coalesce(F.col("numeric_rows") > 0.9 * F.col("filled"), F.lit(False)).alias("looks_numeric"),
        "numeric_rows",
    )


def case_collapse(counts: DataFrame) -> DataFrame:
    """Distinct trimmed values before and after lower-casing, two aggregations deep instead of COUNT DISTINCT."""
    trimmed = counts.where(F.col("value").isNotNull()).select("column", F.trim("value").alias("value")).distinct()
    lowered = trimmed.groupBy("column", F.lower("value").alias("low")).agg(F.count(F.lit(1)).alias("k"))
    return lowered.groupBy("column").agg(
        F.sum("k").alias("distinct_trimmed"), F.count(F.lit(1)).alias("distinct_lowered"), F.bool_or(F.col("k") > 1).alias("collapses")
    )


def top_values(counts: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """The k most frequent values of every column, ties by value (the rank limit is applied before the shuffle)."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    ranked = counts.where(F.col("value").isNotNull()).withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= k)


def numeric_offenders(counts: DataFrame, k: int = 10) -> DataFrame:
    """For columns that look numeric, up to k of the values that are not."""
    wanted = column_profile(counts).where("looks_numeric").select("column")
    odd = counts.where(F.col("value").isNotNull() & F.col("value").try_cast("double").isNull()).join(wanted, "column", "left_semi")
    order = Window.partitionBy("column").orderBy("value")
    return odd.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).select("column", "value", "n")


def candidate_keys(profile: DataFrame, least: float = 99.0) -> DataFrame:
    return profile.where((F.col("nulls") == 0) & (F.col("distinct_pct") >= least)).select("column", "distinct_pct")


def numeric_profile(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Count, mean, std, extremes, percentiles, negatives and zeros of numeric columns.

    Percentiles are exact, located by rank over value counts, so a column of all-distinct values is never buffered.
    """
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    counts = df.select(F.explode(items).alias("x")).groupBy("x.column", "x.v").agg(F.count(F.lit(1)).alias("n"))
    v, n = F.col("v"), F.col("n")
    some = counts.where(v.isNotNull())
    out = some.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.sum((v * n).cast("decimal(38,8)")).alias("_s"),
        F.sum((v * v * n).cast("decimal(38,8)")).alias("_q"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.sum(F.when(v < 0, n).otherwise(0)).alias("negatives"),
        F.sum(F.when(v == 0, n).otherwise(0)).alias("zeros"),
    )
    names = {f"p{int(p * 100)}": p for p in PERCENTS}
    out = out.join(exact_percentiles(some, ["column"], "v", "n", names), "column")
    mean = F.col("_s").cast("double") / F.col("count")
    spread = (F.col("_q").cast("double") - F.col("count") * mean * mean) / (F.col("count") - 1)
    return out.select(
        "column",
        "count",
        F.round(mean, digits).alias("mean"),
        F.round(F.when(F.col("count") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))), digits).alias("std"),
        "min",
        "max",
        *[F.round(p, digits).alias(p) for p in names],
        "negatives",
        "zeros",
    )


def date_like(df: DataFrame, columns: list[str], formats=DATE_FORMATS, threshold: float = 0.8) -> DataFrame:
    """Text columns most of whose values parse under one of the listed formats, with their range."""
    text = F.col("value")
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    counts = value_counts(df, columns).withColumn("t", parsed)
    share = F.sum(F.when(F.col("t").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")
    found = counts.groupBy("column").agg(share.alias("_share"), F.min("t").alias("first"), F.max("t").alias("last"))
    return found.where(F.col("_share") > threshold).select("column", F.round(100 * F.col("_share"), 2).alias("coverage_pct"), "first", "last")


def duplicate_rows(df: DataFrame) -> DataFrame:
    per_row = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    out = per_row.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
    return out.withColumn("duplicate_pct", F.round(100.0 * rate(F.col("duplicates"), F.col("rows")), 4))


def key_multiplicity(df: DataFrame, key: str) -> DataFrame:
    """How many keys occur once, twice, ...: two levels of counting."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows_per_key"))
    return per_key.groupBy("rows_per_key").agg(F.count(F.lit(1)).alias("keys"))


# ------------------------------------------------------------------------------------------------------ segments
def segment_rates(df: DataFrame, dims: list[str], failed: Column) -> DataFrame:
    """Outcome rate and size per value of every dimension."""
    items = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    tall = df.select(F.explode(items).alias("x"), failed.alias("_f"))
    grouped = tall.groupBy("x.dim", "x.value").agg(F.count(F.lit(1)).alias("rows"), F.count_if("_f").alias("hits"))
    return grouped.withColumn("rate", rate(F.col("hits"), F.col("rows")))


def rate_spread(rates: DataFrame) -> DataFrame:
    """Per dimension, the gap between its highest and lowest rate."""
    return rates.groupBy("dim").agg(
        F.count(F.lit(1)).alias("values"), F.min("rate").alias("lowest"), F.max("rate").alias("highest"), (F.max("rate") - F.min("rate")).alias("spread")
    )


def cell_density(df: DataFrame, a: str, b: str) -> DataFrame:
    """How thin the cells of a two-way split are."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    share = F.avg
    return cells.agg(
        F.count(F.lit(1)).alias("cells"),
        F.min("n").alias("smallest"),
        F.percentile("n", 0.5).alias("median"),
        F.max("n").alias("largest"),
        F.round(share((F.col("n") < 30).cast("double")), 6).alias("share_below_30"),
        F.round(share((F.col("n") < 100).cast("double")), 6).alias("share_below_100"),
    )


def group_latency(df: DataFrame, keys: list[str], latency: str, failed: Column) -> DataFrame:
    """Volume, failure share and latency mean and percentiles per group, from a (group, latency) histogram."""
    counts = df.groupBy(*keys, F.col(latency).cast("double").alias("_l")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(failed).alias("_f"))
    out = counts.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.sum("_f").alias("failures"), F.sum((F.col("_l") * F.col("_n")).cast("decimal(38,6)")).alias("_s")
    )
    names = {"latency_p50": 0.5, "latency_p95": 0.95, "latency_p99": 0.99}
    return out.join(exact_percentiles(counts, keys, "_l", "_n", names), keys, "left").select(
        *keys,
        "rows",
        F.round(100.0 * rate(F.col("failures"), F.col("rows")), 4).alias("failure_pct"),
        F.round(F.col("_s").cast("double") / F.col("rows"), 4).alias("latency_mean"),
        *[F.round(n, 4).alias(n) for n in names],
    )


# ---------------------------------------------------------------------------------------------------- time buckets
def bucket_counts(df: DataFrame, time: str, unit: str, step: str) -> DataFrame:
    """Rows per time bucket with empty buckets as 0, over the table's own span.

    The calendar is built from one row holding the span, and grows with time, not with rows.
    """
    counts = df.groupBy(F.date_trunc(unit, time).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    calendar = span.select(F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias("bucket"))
    return calendar.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def bucket_summary(buckets: DataFrame) -> DataFrame:
    n = F.col("n")
    return buckets.agg(
        F.count(F.lit(1)).alias("buckets"),
        F.min(n).alias("smallest"),
        F.percentile(n, 0.5).alias("median"),
        F.max(n).alias("largest"),
        F.round(F.sum(n) / F.count(F.lit(1)), 6).alias("mean"),
        F.round(F.count_if(n == 0) / F.count(F.lit(1)), 6).alias("share_empty"),
        F.round(F.count_if(n < 5) / F.count(F.lit(1)), 6).alias("share_below_5"),
    )


def shared_minutes(df: DataFrame, time: str) -> DataFrame:
    """Rows that share their minute with an earlier row."""
    per = df.groupBy(F.date_trunc("minute", time).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("sharing"))


def hourly_rates(df: DataFrame, group: str, time: str, failed: Column) -> DataFrame:
    grouped = df.groupBy(group, F.date_trunc("hour", time).alias("hour")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(failed).alias("hits"))
    return grouped.withColumn("rate", rate(F.col("hits"), F.col("rows")))


def spike_hours(hourly: DataFrame, group: str, factor: float = 3.0) -> DataFrame:
    """Hours above `factor` times the group's own median hourly rate."""
    medians = hourly.groupBy(group).agg(F.percentile("rate", 0.5).alias("median_rate"))
    return hourly.join(medians, group).where(F.col("rate") > factor * F.col("median_rate"))


def worst_hours(hourly: DataFrame, group: str) -> DataFrame:
    """Each group's worst hour, and every group's rate in it."""
    worst = hourly.groupBy(group).agg(F.max_by("hour", F.struct("rate", F.col("hour"))).alias("hour"))
    return worst.withColumnRenamed(group, "worst_for").join(hourly, "hour").select("worst_for", "hour", group, "rows", "rate")


# ------------------------------------------------------------------------------------------------- reconciliation
def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys on each side and in both, from one union and two aggregations."""
    tagged = left.select(F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(F.col(key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = tagged.where(F.col("k").isNotNull()).groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per_key.agg(
        F.count_if(F.col("l") == 1).alias("left_keys"),
        F.count_if(F.col("r") == 1).alias("right_keys"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("shared_keys"),
    )


def _grams(c: Column) -> Column:
    """Distinct three-character pieces and single characters of a name."""

    def pieces(q):
        starts = F.sequence(F.lit(1), F.greatest(F.length(c) - q + 1, F.lit(1)))
        return F.filter(F.transform(starts, lambda i: F.substring(c, i, F.lit(q))), lambda g: F.length(g) == q)

    return F.array_distinct(F.concat(pieces(3), pieces(1)))


def name_match(left: DataFrame, right: DataFrame, name: str, normal: str) -> DataFrame:
    """Exact match on the normalised name, else containment either way, else unmatched; first match by name.

    Exact matches are an equi-join. For containment, the inner name's pieces all occur in the outer one: every name is
    indexed under its pieces and asked for under its rarest one, which is exact and avoids comparing all pairs.
    """
    known = right.select(F.col(name).alias("match"), F.col(normal).alias("match_normal")).distinct()
    exact = left.join(known, F.col(normal) == F.col("match_normal")).groupBy(name).agg(F.min("match").alias("matched"))
    exact = exact.withColumn("kind", F.lit("exact"))
    rest = left.join(exact.select(name), name, "left_anti")

    def rarest(pieces, keys, n):
        whole = F.length(F.col(n)) >= 3
        usable = pieces.where(~whole | (F.length("gram") == 3))
        return usable.join(weight, "gram").groupBy(*keys).agg(F.min_by("gram", F.struct("w", "gram")).alias("gram"))

    lefts = rest.select(name, normal, F.explode(_grams(F.col(normal))).alias("gram"))
    rights = known.select("match", "match_normal", F.explode(_grams(F.col("match_normal"))).alias("gram"))
    weight = lefts.select("gram").unionByName(rights.select("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("w"))
    inside = rarest(lefts, [name, normal], normal).join(rights, "gram").where(F.contains("match_normal", F.col(normal)))
    around = lefts.join(rarest(rights, ["match", "match_normal"], "match_normal"), "gram").where(
        F.contains(F.col(normal), F.col("match_normal"))
    )
    found = inside.select(name, "match").unionByName(around.select(name, "match")).groupBy(name).agg(F.min("match").alias("matched"))
    both = exact.unionByName(found.withColumn("kind", F.lit("substring")))
    return left.select(name).distinct().join(both, name, "left").select(name, "matched", F.coalesce("kind", F.lit("unmatched")).alias("kind"))


def series_reconciliation(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Two series joined on their period: overlap, largest difference, and periods over tolerance."""
    joined = left.select(key, F.col(value).alias("_a")).join(right.select(key, F.col(value).alias("_b")), key)
    gap = F.abs(F.col("_a") - F.col("_b"))
    return joined.agg(
        F.count(F.lit(1)).alias("periods"), F.min(key).alias("first"), F.max(key).alias("last"),
        F.max(gap).alias("max_difference"), F.count_if(gap > tolerance).alias("over_tolerance"),
    )


def period_changes(series: DataFrame, period: str, value: str) -> DataFrame:
    """Change on the previous period and on a year earlier in percent, and trailing three-period means.

    `series` has one row per month, so one ordered window over it is bounded by calendar time. `mean_3` includes the
    current month; `mean_3_prior` does not, for use as a predictor.
    """
    order = Window.orderBy(period)
    v = F.col(value)

    def change(lag):
        before = F.lag(value, lag).over(order)
        return F.round(F.when(before != 0, 100.0 * (v - before) / before), 4)

    return series.select(
        period,
        value,
        change(1).alias("previous_pct"),
        change(12).alias("year_pct"),
        F.round(F.avg(v).over(order.rowsBetween(-2, 0)), 4).alias("mean_3"),
        F.round(F.avg(v).over(order.rowsBetween(-3, -1)), 4).alias("mean_3_prior"),
    )
