"""Two-window anomaly detection: scoring, suppression, ranking, residuals and causal roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import pair
from ..functions.stats import anomaly_score, rate, relative_delta, severity, two_proportion_z
from ..session import materialize
from ..spec import DetectionConfig, FactSpec
from .metrics import set_name, with_windows
from .ranking import global_rank, running_total

COMPARED = (
    "volume",
    "failures",
    "failure_rate",
    "value_total",
    "value_at_risk",
    "latency_p95",
    "infrastructure_side",
    "infrastructure_rate",
    "source_layer",
)


def compare_windows(metrics: DataFrame, spec: FactSpec) -> DataFrame:
    """Baseline and current side by side, one row per cohort seen in both.

    A conditional aggregation over the small metric table instead of a self-join. A cohort absent from the
    baseline is novel, not degraded, and is not counted as scanned.
    """
    keys = ["dim_set", "depth", "cohort_key", *spec.dims]
    columns = []
    for window, tag in (("baseline", "b"), ("current", "c"), ("prior", "p")):
        here = F.col("window") == window
        columns += [F.max(F.when(here, F.col(c))).alias(f"{tag}_{c}") for c in COMPARED]
    wide = metrics.where(F.col("depth") > 0).groupBy(*keys).agg(*columns)
    return wide.where(F.col("b_volume").isNotNull() & F.col("c_volume").isNotNull())


def _verdict(config: DetectionConfig) -> Column:
    """The first threshold a cohort misses, or REPORTED."""
    return (
        F.when(F.col("c_volume") < config.min_cohort_size, "CURRENT_TOO_SMALL")
        .when(F.col("b_volume") < config.min_baseline_size, "BASELINE_TOO_SMALL")
        .when(F.col("absolute_delta") < config.min_absolute_delta, "DELTA_TOO_SMALL")
        .when(F.col("sigma") < config.min_sigma, "NOT_SIGNIFICANT")
        .otherwise("ANOMALOUS")
    )


def score_cohorts(metrics: DataFrame, spec: FactSpec, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Every scanned cohort with its delta, sigma, score, severity and threshold verdict."""
    sigma = two_proportion_z(F.col("b_failures"), F.col("b_volume"), F.col("c_failures"), F.col("c_volume"))
    return (
        compare_windows(metrics, spec)
        .withColumn("absolute_delta", F.col("c_failure_rate") - F.col("b_failure_rate"))
        .withColumn("relative_delta", relative_delta(F.col("b_failure_rate"), F.col("c_failure_rate")))
        .withColumn("sigma", sigma)
        .withColumn("score", anomaly_score(F.col("sigma"), F.col("absolute_delta")))
        .withColumn("severity", severity(F.col("sigma")))
        .withColumn("verdict", _verdict(config))
    )


def candidates(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("verdict") == "ANOMALOUS").drop("verdict")


def broader_keys(spec: FactSpec) -> Column:
    """Keys of every strict generalisation of a cohort that the scan also reports."""
    by_set = None
    for dims in spec.dimension_sets:
        parents = [d for d in spec.dimension_sets if set(d) < set(dims)]
        keys = F.array(*[F.concat_ws("|", *[pair(n, F.col(n)) for n in sorted(p)]) for p in parents])
        keys = keys if parents else F.array().cast("array<string>")
        test = F.col("dim_set") == set_name(dims)
        by_set = F.when(test, keys) if by_set is None else by_set.when(test, keys)
    return by_set


def suppress_redundant(found: DataFrame, spec: FactSpec, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Mark narrower candidates that an unsuppressed broader one explains within the sigma margin.

    Each candidate names its own generalisations, so finding parents is an equi-join on the cohort key, level by
    level (a suppressed parent cannot suppress). The recorded parent is the first by depth, then score.
    """
    depths = sorted({len(s) for s in spec.dimension_sets})
    unset = F.lit(None).cast("string")
    settled = found.where(F.col("depth") == depths[0]).withColumn("suppressed_by", unset)
    for depth in depths[1:]:
        level = found.where(F.col("depth") == depth)
        parents = settled.where(F.col("suppressed_by").isNull()).select(
            F.col("cohort_key").alias("p_key"),
            F.col("depth").alias("p_depth"),
            F.col("score").alias("p_score"),
            F.col("sigma").alias("p_sigma"),
        )
        asked = level.select("cohort_key", "sigma", F.explode(broader_keys(spec)).alias("p_key"))
        covering = asked.join(parents, "p_key").where(F.col("sigma") <= F.col("p_sigma") + config.suppression_margin)
        first = covering.groupBy("cohort_key").agg(
            F.min_by("p_key", F.struct("p_depth", -F.col("p_score"), "p_key")).alias("suppressed_by")
        )
        settled = settled.unionByName(level.join(first, "cohort_key", "left").select(*settled.columns))
    return settled.withColumn("suppressed", F.col("suppressed_by").isNotNull())


def rank_candidates(marked: DataFrame) -> DataFrame:
    """Reported first, then score, sigma and key; suppressed ones keep a rank after everything reported."""
    order = [F.col("suppressed").asc(), F.col("score").desc(), F.col("sigma").desc(), F.col("cohort_key").asc()]
    return global_rank(marked, order)


def _dimension_cells(cells: DataFrame, spec: FactSpec) -> DataFrame:
    """Cells with baseline and current counts side by side."""
    base, current = F.col("slice") != "current", F.col("slice") == "current"

    def part(test, column):
        return F.sum(F.when(test, F.col(column)).otherwise(F.lit(0)))

    return cells.groupBy(*spec.dims).agg(
        part(base, "n").alias("b_n"),
        part(base, "n_failed").alias("b_f"),
        part(current, "n").alias("c_n"),
        part(current, "n_failed").alias("c_f"),
        part(current, "n_simulated").alias("c_s"),
    )


def shared_traffic(cells: DataFrame, subjects: DataFrame, confounders: DataFrame, spec: FactSpec) -> DataFrame:
    """Counts each subject cohort shares with each single-dimension confounder, plus its NULL rows per dimension.

    One row per pair that does share traffic (`confounder_key`), and one per (subject, dimension) with NULLs
    (`confounder_key` NULL), because removing a value with `<>` removes NULL rows as well. Pairs without common
    rows are never produced: their residual is the subject itself.
    """
    keys = F.array(
        *[F.concat_ws("|", *[pair(n, F.col(n)) for n in sorted(dims)]) for dims in spec.dimension_sets], F.lit("ALL")
    )
    sums = ["b_n", "b_f", "c_n", "c_f", "c_s"]
    wanted = subjects.select("cohort_key").distinct()
    members = (
        _dimension_cells(cells, spec)
        .withColumn("cohort_key", F.explode(keys))
        .join(wanted, "cohort_key", "left_semi")
    )
    entries = F.array(
        *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in spec.dims]
    )
    parts = (
        members.withColumn("e", F.explode(entries))
        .groupBy("cohort_key", F.col("e.dim").alias("conf_dim"), F.col("e.value").alias("conf_value"))
        .agg(*[F.sum(c).alias(c) for c in sums])
        .withColumn("confounder_key", F.concat_ws("=", "conf_dim", "conf_value"))
    )
    nulls = parts.where(F.col("conf_value").isNull()).withColumn("confounder_key", F.lit(None).cast("string"))
    shared = parts.join(confounders.select(F.col("cohort_key").alias("confounder_key")), "confounder_key", "left_semi")
    shared = shared.where(F.col("conf_value").isNotNull() & (F.col("confounder_key") != F.col("cohort_key")))
    columns = ["cohort_key", "conf_dim", "confounder_key", *sums]
    return shared.select(*columns).unionByName(nulls.select(*columns))


def residuals(subjects: DataFrame, traffic: DataFrame, pairs: DataFrame, config: DetectionConfig) -> DataFrame:
    """Re-run the thresholds on each (subject, confounder) of `pairs` with the confounder's rows removed.

    residual = subject - shared - NULL rows of the confounder's dimension. `independence` is the share of the
    movement that survives; a residual too small to judge counts as surviving, an empty one as explained.
    """
    sums = ["b_n", "b_f", "c_n", "c_f", "c_s"]
    shared = traffic.where(F.col("confounder_key").isNotNull()).drop("conf_dim")
    nulls = traffic.where(F.col("confounder_key").isNull()).drop("confounder_key")
    nulls = nulls.select("cohort_key", "conf_dim", *[F.col(c).alias(f"null_{c}") for c in sums])
    own = subjects.select(
        "cohort_key", "absolute_delta", "b_volume", "b_failures", "c_volume", "c_failures", "c_simulated_rows"
    )
    joined = (
        pairs.select("cohort_key", "conf_dim", "confounder_key")
        .join(own, "cohort_key")
        .join(shared, ["cohort_key", "confounder_key"], "left")
        .join(nulls, ["cohort_key", "conf_dim"], "left")
    )

    def left_over(total, name):
        return F.col(total) - F.coalesce(F.col(name), F.lit(0)) - F.coalesce(F.col(f"null_{name}"), F.lit(0))

    left = joined.select(
        "cohort_key",
        "conf_dim",
        "confounder_key",
        "absolute_delta",
        left_over("b_volume", "b_n").alias("rb_volume"),
        left_over("b_failures", "b_f").alias("rb_failures"),
        left_over("c_volume", "c_n").alias("rc_volume"),
        left_over("c_failures", "c_f").alias("rc_failures"),
        left_over("c_simulated_rows", "c_s").alias("rc_simulated"),
    )
    missing = (F.col("rb_volume") == 0) | (F.col("rc_volume") == 0)
    delta = rate(F.col("rc_failures"), F.col("rc_volume")) - rate(F.col("rb_failures"), F.col("rb_volume"))
    kept = F.when(F.col("absolute_delta") > 0, F.greatest(F.lit(0.0), delta / F.col("absolute_delta"))).otherwise(0.0)
    sigma = two_proportion_z(F.col("rb_failures"), F.col("rb_volume"), F.col("rc_failures"), F.col("rc_volume"))
    thin = (F.col("rc_volume") < config.min_cohort_size) | (F.col("rb_volume") < config.min_baseline_size)
    return left.select(
        "*",
        missing.alias("residual_missing"),
        F.when(missing, F.lit(None).cast("double")).otherwise(delta).alias("residual_delta"),
        F.when(missing, F.lit(None).cast("double")).otherwise(sigma).alias("residual_sigma"),
        F.when(missing, 0.0).otherwise(kept).alias("independence"),
        F.when(missing, False)
        .when(thin, True)
        .when(delta < config.min_absolute_delta, False)
        .otherwise(sigma >= config.min_sigma)
        .alias("still_anomalous"),
    )


def pair_verdicts(cells: DataFrame, reported: DataFrame, spec: FactSpec, config: DetectionConfig) -> DataFrame:
    """Residual verdicts for every reported cohort and every earlier-ranked single-dimension one that can matter."""
    confounders = reported.where(F.col("depth") == 1).select(
        F.col("cohort_key").alias("confounder_key"), F.col("dim_set").alias("conf_dim"), F.col("rank").alias("conf_rank")
    )
    traffic = materialize(
        shared_traffic(cells, reported, confounders.withColumnRenamed("confounder_key", "cohort_key"), spec)
    )
    touching = traffic.where(F.col("confounder_key").isNotNull()).select("cohort_key", "confounder_key")
    holed = (
        traffic.where(F.col("confounder_key").isNull())
        .join(confounders, "conf_dim")
        .select("cohort_key", confounders["confounder_key"])
    )
    pairs = (
        touching.unionByName(holed)
        .distinct()
        .join(confounders, "confounder_key")
        .join(reported.select("cohort_key", "rank"), "cohort_key")
        .where(F.col("conf_rank") < F.col("rank"))
    )
    verdicts = residuals(reported, traffic, pairs, config)
    return verdicts.join(pairs.select("cohort_key", "confounder_key", "rank", "conf_rank"), ["cohort_key", "confounder_key"])


def settle_roles(keys: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """(cohort_key, alert_role) of every key, and the rounds it took. edges: cohort_key, to_key (an explainer of stronger rank).

    A cohort is DERIVATIVE if one of its explainers is PRIMARY, else PRIMARY. A cohort with one open explainer left points to it: its role is
    the opposite of that one's. Pointers are doubled, with their parity, so a chain of n takes log2(n) rounds and not n; cohorts with several open
    explainers lose those that turn out DERIVATIVE, until they are settled or point themselves. One written table a round.
    """
    out = edges.groupBy("cohort_key").agg(F.count(F.lit(1)).alias("_n"), F.min("to_key").alias("_to"))
    single = F.col("_n") == 1
    state = materialize(
        keys.select("cohort_key").join(out, "cohort_key", "left").select(
            "cohort_key",
            F.when(F.col("_n").isNull(), "PRIMARY").alias("alert_role"),
            F.when(single, F.col("_to")).alias("to_key"),
            F.when(single, True).alias("opposite"),
        )
    )
    rounds = 0
    while not state.where(F.col("alert_role").isNull()).isEmpty():
        rounds += 1
        seen = state.select(
            F.col("cohort_key").alias("to_key"), F.col("alert_role").alias("_role"), F.col("to_key").alias("_next"), F.col("opposite").alias("_turn")
        )
        several = state.where("alert_role IS NULL AND to_key IS NULL").select("cohort_key")
        left = edges.join(several, "cohort_key", "left_semi").join(seen, "to_key").groupBy("cohort_key").agg(
            F.count_if(F.col("_role") == "PRIMARY").alias("_primary"),
            F.count_if(F.col("_role").isNull()).alias("_open"),
            F.min(F.when(F.col("_role").isNull(), F.col("to_key"))).alias("_last"),
        )
        joined = state.join(seen, "to_key", "left").join(left, "cohort_key", "left")
        turned = F.when((F.col("_role") == "PRIMARY") != F.col("opposite"), "PRIMARY").otherwise("DERIVATIVE")
        role = (
            F.when(F.col("alert_role").isNotNull(), F.col("alert_role"))
            .when(F.col("_role").isNotNull(), turned)
            .when(F.col("_primary") > 0, "DERIVATIVE")
            .when(F.col("_open") == 0, "PRIMARY")
        )
        points = F.col("_open") == 1
        doubled = F.col("_next").isNotNull()
        target = F.when(points, F.col("_last")).when(doubled, F.col("_next")).otherwise(F.col("to_key"))
        parity = F.when(points, True).when(doubled, F.col("opposite") != F.col("_turn")).otherwise(F.col("opposite"))
        state = materialize(joined.select("cohort_key", role.alias("alert_role"), target.alias("to_key"), parity.alias("opposite")))
    return state.select("cohort_key", "alert_role"), rounds


def classify_roles(reported: DataFrame, verdicts: DataFrame) -> DataFrame:
    """PRIMARY or DERIVATIVE for every reported cohort, strongest first.

    A cohort is DERIVATIVE when an earlier single-dimension PRIMARY explains it: edges (cohort -> earlier explainer) always point to stronger
    ranks, so the graph has no cycle.
    """
    edges = materialize(verdicts.where(~F.col("still_anomalous")).select("cohort_key", F.col("confounder_key").alias("to_key")).distinct())
    roles, _ = settle_roles(reported, edges)

    known = roles.select(F.col("cohort_key").alias("confounder_key"), F.col("alert_role").alias("conf_role"))
    tested = verdicts.join(known, "confounder_key").where(F.col("conf_role") == "PRIMARY")
    explained = tested.where(~F.col("still_anomalous")).groupBy("cohort_key").agg(
        F.min_by("confounder_key", "conf_rank").alias("derived_from"), F.min("conf_rank").alias("_stop")
    )
    ranked = reported.join(roles, "cohort_key").join(explained, "cohort_key", "left")
    visited = tested.join(ranked.select("cohort_key", "_stop"), "cohort_key").where(
        F.col("_stop").isNull() | (F.col("conf_rank") <= F.col("_stop"))
    )
    lows = visited.groupBy("cohort_key").agg(F.min("independence").alias("_low"), F.count(F.lit(1)).alias("_pairs"))
    # Primaries visited without shared traffic leave a cohort untouched: their independence is exactly 1.
    leader = F.when((F.col("depth") == 1) & (F.col("alert_role") == "PRIMARY"), 1).otherwise(0)
    flagged = reported.join(roles, "cohort_key").select("cohort_key", "rank", leader.alias("_leader"))
    running = running_total(flagged, "rank", "_leader", "_passed")
    own = running.select("cohort_key", (F.col("_passed") - F.col("_leader")).alias("_before"))
    at_stop = running.select(F.col("rank").alias("_stop"), F.col("_passed").alias("_until"))
    joined = ranked.join(lows, "cohort_key", "left").join(own, "cohort_key").join(at_stop, "_stop", "left")
    steps = F.coalesce(F.col("_until"), F.col("_before"))
    clean = steps > F.coalesce(F.col("_pairs"), F.lit(0))
    independence = (
        F.when(steps == 0, F.lit(None).cast("double"))
        .when(F.col("_low").isNull(), F.lit(1.0))
        .when(clean, F.least(F.col("_low"), F.lit(1.0)))
        .otherwise(F.col("_low"))
    )
    keep = [c for c in ranked.columns if not c.startswith("_")]
    return joined.select(*keep, independence.alias("independence"))
