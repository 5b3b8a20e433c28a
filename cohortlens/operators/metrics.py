"""Cohort metrics: the effective outcome surface, and every cohort over every window in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import cohort_key
from ..functions.stats import rate
from ..session import materialize
from ..spec import FactSpec, Windows
from . import ranking
from .ranking import exact_percentiles, holding_buckets, interpolated, open_buckets, percentile_ranks, settle_ranks

#: Latency buckets per doubling of the value. Few, so that the number of cells is soon bounded by the dimensions and no longer follows the facts.
CELL_STEPS = 8

PERCENTILES = (("latency_p50", 0.50), ("latency_p95", 0.95), ("latency_p99", 0.99))


def coarse_bucket(v: Column) -> Column:
    """The latency bucket of a cell."""
    return ranking.coarse_bucket(v, CELL_STEPS)


def in_window(time: Column, start, end) -> Column:
    """Half-open membership; on a bare scan column it reaches the Parquet reader."""
    return (time >= F.lit(start)) & (time < F.lit(end))


def excluding(df: DataFrame, exclude: dict[str, str]) -> DataFrame:
    """Drop a confounding population. `<>` semantics: a NULL dimension drops out too."""
    for name, value in sorted(exclude.items()):
        df = df.where(F.col(name) != F.lit(value))
    return df


def member_of(definition: dict[str, str]) -> Column:
    """Membership in a cohort given as {dimension: value}; the empty map is everyone."""
    test = F.lit(True)
    for name, value in definition.items():
        test = test & F.col(name).eqNullSafe(F.lit(value))
    return test


def member_of_map(row_map: Column, definition: Column) -> Column:
    """Table-driven membership: every pair of the definition map holds in the row map."""
    return F.forall(F.map_entries(definition), lambda e: row_map[e["key"]].eqNullSafe(e["value"]))


def effective_outcomes(fact: DataFrame, overlay: DataFrame | None, spec: FactSpec) -> DataFrame:
    """Fact rows with a sparse overlay's outcome where one exists, and the layer each row came from.

    The overlay carries the same id, outcome, latency and code columns; None means the observed surface.
    """
    if overlay is None:
        return fact.withColumn("overlaid", F.lit(False)).withColumn("source_layer", F.lit("OBSERVED"))
    replaced = [spec.outcome, spec.latency, spec.code]
    side = overlay.select(spec.id, *[F.col(c).alias(f"_new_{c}") for c in replaced], F.lit(True).alias("_hit"))
    joined = fact.join(side, spec.id, "left")
    columns = [
        F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in replaced else F.col(c) for c in fact.columns
    ]
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return joined.select(
        *columns, hit.alias("overlaid"), F.when(hit, "SIMULATED").otherwise("OBSERVED").alias("source_layer")
    )


def _slice(spec: FactSpec, windows: Windows) -> Column:
    """Disjoint time slices; windows overlap (prior is the tail of baseline), so rows are sliced, not duplicated."""
    time = F.col(spec.time)
    return (
        F.when(time >= F.lit(windows.current_start), "current")
        .when(time >= F.lit(windows.prior_start), "prior")
        .otherwise("early")
    )


def _scanned_rows(fact: DataFrame, spec: FactSpec, windows: Windows) -> DataFrame:
    time = F.col(spec.time)
    rows = fact.where(time < F.lit(windows.current_end))
    if windows.baseline_start is not None:
        rows = rows.where(time >= F.lit(windows.baseline_start))
    return rows.withColumn("slice", _slice(spec, windows))


def scanned_rows(fact: DataFrame, spec: FactSpec, windows: Windows) -> DataFrame:
    """The narrow rows `measure` reads: slice, dimensions, outcome, amount, latency, code."""
    columns = [*spec.dims, spec.outcome, spec.amount, spec.latency, spec.code, *([spec.simulated] if spec.simulated else [])]
    return _scanned_rows(fact, spec, windows).select("slice", *columns)


def bucket_cells(rows: DataFrame, spec: FactSpec) -> DataFrame:
    """Collapse scanned rows to one row per (slice, latency bucket, all dimensions); `_b` is NULL where there is no latency.

    Partial aggregation runs before the only shuffle, so a hot cohort travels as a few rows. Everything downstream (grouping
    sets, windows, residuals, the latency histogram) expands these rows, not facts. Their number is bounded by the dimensions' combinations
    and the buckets, and never exceeds the facts'.
    """
    failed = F.col(spec.outcome) == F.lit(spec.failed_value)
    amount = F.col(spec.amount).cast("decimal(12,2)")
    zero = F.lit(0).cast("decimal(12,2)")
    value = F.col(spec.latency).cast("double")
    simulated = F.count_if(F.col(spec.simulated)) if spec.simulated else F.lit(0).cast("long")
    bucketed = rows.withColumn("_v", value).withColumn("_b", F.when(F.col("_v").isNotNull(), coarse_bucket(F.col("_v"))))
    return bucketed.groupBy("slice", "_b", *spec.dims).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(failed).alias("n_failed"),
        F.sum(amount).alias("amount_total"),
        F.sum(F.when(failed, amount).otherwise(zero)).alias("amount_failed"),
        F.count_if(F.col(spec.code).isin(*spec.timeout_codes)).alias("n_timeout"),
        F.count_if(F.col(spec.code).isin(*spec.infrastructure_codes)).alias("n_infra"),
        simulated.alias("n_simulated"),
        F.min("_v").alias("_low"),
        F.max("_v").alias("_high"),
    )


def cohort_cells(buckets: DataFrame, spec: FactSpec) -> DataFrame:
    """One row per (slice, all dimensions): the cells of all buckets together."""
    counts = ("n", "n_failed", "amount_total", "amount_failed", "n_timeout", "n_infra", "n_simulated")
    return buckets.groupBy("slice", *spec.dims).agg(*[F.sum(c).alias(c) for c in counts])


def with_windows(cells: DataFrame, keep: tuple[str, ...] = ("baseline", "prior", "current")) -> DataFrame:
    """One row per (cell, window it belongs to)."""
    names = (
        F.when(F.col("slice") == "current", F.array(F.lit("current")))
        .when(F.col("slice") == "prior", F.array(F.lit("baseline"), F.lit("prior")))
        .otherwise(F.array(F.lit("baseline")))
    )
    wide = cells.withColumn("window", F.explode(names)).drop("slice")
    return wide if len(keep) == 3 else wide.where(F.col("window").isin(*keep))


def set_name(dims) -> str:
    return "+".join(dims) if dims else "ALL"


def _label(spec: FactSpec, sets, value_of) -> Column:
    """Pick a per-grouping-set expression by grouping id (a NULL dimension value is not a missing one)."""
    bits = len(spec.dims)
    chosen = None
    for dims in sets:
        gid = sum(1 << (bits - 1 - i) for i, d in enumerate(spec.dims) if d not in dims)
        test = F.col("gid") == F.lit(gid)
        chosen = F.when(test, value_of(dims)) if chosen is None else chosen.when(test, value_of(dims))
    return chosen


_LATENCY_KEYS = ["window", "gid", "cohort_key"]


def values_in_open_buckets(rows: DataFrame, wanted: DataFrame, spec: FactSpec, sets) -> DataFrame:
    """Counts per value (slice, gid, cohort_key, _b, _v, _w) of the facts that some set's open bucket may hold.

    wanted: window, gid, cohort_key, _b. Facts first meet the buckets open in their slice, a table bounded by slices and buckets, which names the
    sets; a fact is repeated for those sets only, and aggregated before it moves.
    """
    inside = (
        F.when(F.col("window") == "current", F.array(F.lit("current")))
        .when(F.col("window") == "prior", F.array(F.lit("prior")))
        .otherwise(F.array(F.lit("early"), F.lit("prior")))
    )
    places = wanted.select(F.explode(inside).alias("slice"), "_b", "gid").groupBy("slice", "_b").agg(F.collect_set("gid").alias("_gids"))
    value = F.col(spec.latency).cast("double")
    narrow = rows.where(value.isNotNull()).select("slice", *spec.dims, value.alias("_v"), coarse_bucket(value).alias("_b"))
    spread = narrow.join(places, ["slice", "_b"]).withColumn("gid", F.explode("_gids"))
    named = spread.select("slice", "gid", _label(spec, sets, cohort_key).alias("cohort_key"), "_b", "_v")
    return named.groupBy("slice", "gid", "cohort_key", "_b", "_v").agg(F.count(F.lit(1)).alias("_w"))


def cohort_latency(buckets: DataFrame, rows: DataFrame, spec: FactSpec, sets) -> DataFrame:
    """Exact interpolating latency percentiles per (window, cohort_key). buckets: bucket_cells(rows).

    A histogram over coarse buckets, for all dimension sets at once, says which bucket holds each rank. Buckets with one value are settled by
    it. Facts are read a second time only where a rank fell into a bucket with several values.
    """
    keys = _LATENCY_KEYS
    filled = buckets.where(F.col("_b").isNotNull())
    histogram = filled.groupingSets([["slice", "_b", *dims] for dims in sets], "slice", "_b", *spec.dims).agg(
        F.grouping_id().cast("long").alias("gid"), F.sum("n").alias("_c"), F.min("_low").alias("_low"), F.max("_high").alias("_high")
    )
    named = with_windows(histogram).withColumn("cohort_key", _label(spec, sets, cohort_key))
    totals = named.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    ranks = percentile_ranks(dict(PERCENTILES))
    holding = materialize(holding_buckets(totals, keys, ranks))
    if holding.where(F.col("_low") != F.col("_high")).isEmpty():
        edge = holding.select(*keys, "_b", F.col("_low").alias("_v"), F.lit(1).cast("long").alias("_w")).limit(0)
    else:
        wanted = materialize(open_buckets(holding, keys))
        edge = with_windows(values_in_open_buckets(rows, wanted, spec, sets)).join(wanted, [*keys, "_b"], "left_semi")
    found = settle_ranks(holding, edge, keys, [n for n, _ in ranks])
    return found.select("window", "cohort_key", *[interpolated(n, p) for n, p in PERCENTILES])


def cohort_metrics(cells: DataFrame, latency: DataFrame, spec: FactSpec, sets=None, population: bool = True) -> DataFrame:
    """The metric block for every cohort of every dimension set and window: one GROUPING SETS job over cells, and the latencies."""
    scanned = scanned_sets(spec, sets, population)
    grouped = with_windows(cells).groupingSets([["window", *dims] for dims in scanned], "window", *spec.dims).agg(
        F.grouping_id().alias("gid"),
        F.sum("n").alias("volume"),
        F.sum("n_failed").alias("failures"),
        F.sum("amount_total").alias("value_total"),
        F.sum("amount_failed").alias("value_at_risk"),
        F.sum("n_timeout").alias("timeouts"),
        F.sum("n_infra").alias("infrastructure_side"),
        F.sum("n_simulated").alias("simulated_rows"),
    )
    named = grouped.select(
        "*",
        _label(spec, scanned, lambda d: F.lit(set_name(d))).alias("dim_set"),
        _label(spec, scanned, lambda d: F.lit(len(d))).alias("depth"),
        _label(spec, scanned, cohort_key).alias("cohort_key"),
    )
    volume = F.col("volume")
    return named.join(latency, ["window", "cohort_key"], "left").select(
        "window",
        "dim_set",
        "depth",
        "cohort_key",
        *spec.dims,
        "volume",
        "failures",
        "value_total",
        "value_at_risk",
        *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n, _ in PERCENTILES],
        "timeouts",
        "infrastructure_side",
        "simulated_rows",
        rate(F.col("failures"), volume).alias("failure_rate"),
        rate(F.col("timeouts"), volume).alias("timeout_rate"),
        rate(F.col("infrastructure_side"), volume).alias("infrastructure_rate"),
        F.when(F.col("simulated_rows") > 0, "SIMULATED").otherwise("OBSERVED").alias("source_layer"),
    )


def scanned_sets(spec: FactSpec, sets=None, population: bool = True):
    sets = tuple(sets) if sets is not None else spec.dimension_sets
    for dims in sets:
        spec.check_dimensions(dims)
    return sets + (((),) if population else ())


def measure(fact: DataFrame, spec: FactSpec, windows: Windows, sets=None, population: bool = True) -> tuple[DataFrame, DataFrame]:
    """Cells (materialised) and the metric table.

    The fact, which may be a join, is computed once: its narrow rows are written, read into bucket cells, and read once more only for
    latencies that buckets can't settle.
    """
    rows = materialize(scanned_rows(fact, spec, windows))
    buckets = materialize(bucket_cells(rows, spec))
    cells = materialize(cohort_cells(buckets, spec))
    latency = cohort_latency(buckets, rows, spec, scanned_sets(spec, sets, population))
    return cells, cohort_metrics(cells, latency, spec, sets, population)


def population_metrics(fact: DataFrame, spec: FactSpec) -> DataFrame:
    """Whole-table metrics; an empty input still yields one row of zeros."""
    failed = F.col(spec.outcome) == F.lit(spec.failed_value)
    amount = F.col(spec.amount).cast("decimal(12,2)")
    histogram = fact.groupBy(F.col(spec.latency).cast("double").alias("latency_value")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(failed).alias("n_failed"),
        F.sum(amount).alias("amount_total"),
        F.sum(F.when(failed, amount)).alias("amount_failed"),
    )
    zero = F.lit(0).cast("decimal(32,2)")
    totals = histogram.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("volume"),
        F.coalesce(F.sum("n_failed"), F.lit(0)).alias("failures"),
        F.coalesce(F.sum("amount_total"), zero).alias("value_total"),
        F.coalesce(F.sum("amount_failed"), zero).alias("value_at_risk"),
    ).withColumn("failure_rate", rate(F.col("failures"), F.col("volume")))
    # An empty table has no percentile row; stacking the two one-row results keeps the zeros.
    p95 = exact_percentiles(histogram, [], "latency_value", "n", {"latency_p95": 0.95})
    both = totals.unionByName(p95, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in totals.columns], F.coalesce(F.max("latency_p95"), F.lit(0.0)).alias("latency_p95"))


def control_totals(metrics: DataFrame) -> DataFrame:
    """Sums per (window, dimension set): a cohort's siblings are these minus the cohort itself."""
    return metrics.groupBy("window", "dim_set").agg(
        F.sum("volume").alias("all_volume"),
        F.sum("failures").alias("all_failures"),
        F.sum("infrastructure_side").alias("all_infra"),
        F.sum(F.col("latency_p95") * F.col("volume")).alias("all_p95_weight"),
        F.count(F.lit(1)).alias("all_cohorts"),
    )


def sibling_aggregate(metrics: DataFrame) -> DataFrame:
    """For every cohort, its siblings pooled: exact sums, latency as a volume-weighted mean of their p95s."""
    joined = metrics.join(control_totals(metrics), ["window", "dim_set"])
    volume = F.col("all_volume") - F.col("volume")
    weight = F.col("all_p95_weight") - F.col("latency_p95") * F.col("volume")
    return joined.select(
        "window",
        "dim_set",
        "cohort_key",
        volume.alias("control_volume"),
        (F.col("all_failures") - F.col("failures")).alias("control_failures"),
        F.round(rate(F.col("all_failures") - F.col("failures"), volume), 6).alias("control_failure_rate"),
        F.round(rate(F.col("all_infra") - F.col("infrastructure_side"), volume), 6).alias("control_infra_rate"),
        F.round(F.when(volume > 0, weight / volume).otherwise(F.lit(0.0)), 2).alias("control_latency_p95"),
        (F.col("all_cohorts") - 1).alias("siblings"),
    )


def largest_group(fact: DataFrame, column: str) -> DataFrame:
    """The biggest group and its size, ties broken by name."""
    return fact.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), column).limit(1)


def traffic_span(fact: DataFrame, spec: FactSpec, start, end) -> DataFrame:
    """Where a window really carries traffic, else the declared window."""
    inside = fact.where(in_window(F.col(spec.time), start, end))
    return inside.agg(
        F.coalesce(F.min(spec.time), F.lit(start)).alias("span_start"),
        F.coalesce(F.max(spec.time), F.lit(end)).alias("span_end"),
    )

