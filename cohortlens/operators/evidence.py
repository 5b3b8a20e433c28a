"""Typed evidence for the leading anomalies: what moved, against whom, when, and whether it moved on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.stats import rate, relative_delta, two_proportion_z
from ..session import materialize
from ..spec import DetectionConfig, FactSpec, Windows
from .detect import residuals, shared_traffic

SUBJECT_LIMIT = 5
COLLAPSE_THRESHOLD = 0.35

# Evidence types in report order.
EVIDENCE_TYPES = (
    "failure_rate",
    "latency",
    "response_mix",
    "control_comparison",
    "blast_radius",
    "temporal_alignment",
    "confounding_check",
    "gmv_impact",
)


def best_per_dimension(reported: DataFrame) -> DataFrame:
    """The strongest reported anomaly on each single dimension."""
    single = reported.where(F.col("depth") == 1)
    rest = [c for c in reported.columns if c != "dim_set"]
    best = single.groupBy("dim_set").agg(F.min_by(F.struct(*rest), "rank").alias("_b"))
    return best.select("dim_set", *[F.col("_b")[c].alias(c) for c in rest])


def subjects(reported: DataFrame, spec: FactSpec, limit: int = SUBJECT_LIMIT) -> DataFrame:
    """The top `limit` reported anomalies plus the best on each single dimension, in report order."""
    position = F.when(F.col("rank") <= limit, F.col("rank"))
    for i, d in enumerate(spec.dims):
        position = position.when(F.col("dim_set") == d, limit + 1 + i)
    best = best_per_dimension(reported).select("cohort_key", F.lit(True).alias("_best"))
    marked = reported.join(best, "cohort_key", "left").where((F.col("rank") <= limit) | F.col("_best"))
    return marked.drop("_best").withColumn("subject_order", position)


def leading_confounders(subjects_: DataFrame, reported: DataFrame, spec: FactSpec) -> DataFrame:
    """For each subject, the highest-ranked single-dimension anomaly on a different dimension set.

    Each subject names the dimensions it may be confounded on, so this is an equi-join with at most one row per
    dimension rather than a comparison of all pairs.
    """
    best = best_per_dimension(reported).select(
        F.col("dim_set").alias("conf_dim"), F.col("cohort_key").alias("confounder_key"), F.col("rank").alias("conf_rank")
    )
    asked = subjects_.select(
        "cohort_key", "dim_set", F.explode(F.array(*[F.lit(d) for d in spec.dims])).alias("conf_dim")
    ).where(F.col("conf_dim") != F.col("dim_set"))
    return (
        asked.join(best, "conf_dim")
        .groupBy("cohort_key")
        .agg(F.min_by(F.struct("conf_dim", "confounder_key"), "conf_rank").alias("_c"))
        .select("cohort_key", F.col("_c.conf_dim").alias("conf_dim"), F.col("_c.confounder_key").alias("confounder_key"))
    )


def subject_table(
    cells: DataFrame, metrics: DataFrame, scored: DataFrame, reported: DataFrame, spec: FactSpec, config: DetectionConfig
) -> DataFrame:
    """One wide row per subject: both windows, the prior one, pooled siblings, peers moved, and the residual."""
    subs = materialize(subjects(reported, spec))
    totals = metrics.where(F.col("depth") > 0).groupBy("dim_set").agg(
        *[
            F.sum(F.when(F.col("window") == w, F.col(c)).otherwise(0)).alias(f"{t}_all_{c}")
            for w, t in (("baseline", "b"), ("current", "c"))
            for c in ("volume", "failures")
        ]
    )
    moved = F.count_if(F.col("absolute_delta") >= config.min_absolute_delta)
    peers = scored.groupBy("dim_set").agg(moved.alias("_moved"), F.count_if(F.col("b_volume") > 0).alias("_comparable"))
    simulated = metrics.where(F.col("window") == "current").select(
        "cohort_key", F.col("simulated_rows").alias("c_simulated_rows")
    )
    leads = leading_confounders(subs, reported, spec)
    owned = subs.join(simulated, "cohort_key")
    confounders = leads.select(F.col("confounder_key").alias("cohort_key")).distinct()
    left = residuals(owned, materialize(shared_traffic(cells, subs, confounders, spec)), leads, config)
    residual = left.where(~F.col("residual_missing")).select(
        "cohort_key", "confounder_key", "independence", "residual_delta", "residual_sigma", "rb_volume", "rb_failures",
        "rc_volume", "rc_failures", "rc_simulated",
    ).withColumnRenamed("independence", "kept_share")

    def control(tag, column):
        return (F.col(f"{tag}_all_{column}") - F.col(f"{tag}_{column}")).alias(f"{tag}_ctl_{column}")

    return (
        owned.join(totals, "dim_set")
        .join(peers, "dim_set")
        .join(residual, "cohort_key", "left")
        .select(
            *owned.columns,
            control("b", "volume"), control("b", "failures"), control("c", "volume"), control("c", "failures"),
            (F.col("_moved") - 1).alias("peers_moved"),
            (F.col("_comparable") - 1).alias("peers_comparable"),
            *[c for c in residual.columns if c != "cohort_key"],
        )
    )


def _item(kind, metric, base, current, delta, relative, sigma, layer, start, end, text, present=None) -> Column:
    row = F.struct(
        F.lit(EVIDENCE_TYPES.index(kind)).alias("type_order"),
        F.lit(kind).alias("evidence_type"),
        (metric if isinstance(metric, Column) else F.lit(metric)).alias("metric_name"),
        *[(F.lit(None) if v is None else v).cast("double").alias(n) for n, v in
          (("baseline_value", base), ("current_value", current), ("delta", delta), ("relative_delta", relative), ("sigma", sigma))],
        layer.alias("source_layer"),
        F.lit(start).alias("window_start"),
        F.lit(end).alias("window_end"),
        text.alias("explanation"),
    )
    return row if present is None else F.when(present, row)


def _pct(c: Column) -> Column:
    return F.round(c * 100, 2)


def evidence_table(wide: DataFrame, windows: Windows) -> DataFrame:
    """Tall evidence: one row per subject and type that applies, numbered in report order.

    The eight items of a subject come from one explode of its wide row. There are at most five subjects plus one
    per dimension, so numbering needs no distributed sort.
    """
    c, span = F.col, (windows.current_start, windows.current_end)
    layer = c("c_source_layer")
    key, d = c("cohort_key"), c("absolute_delta")
    ctl_b = F.round(rate(c("b_ctl_failures"), c("b_ctl_volume")), 6)
    ctl_c = F.round(rate(c("c_ctl_failures"), c("c_ctl_volume")), 6)
    rb, rc = rate(c("rb_failures"), c("rb_volume")), rate(c("rc_failures"), c("rc_volume"))
    radius = (c("peers_moved") + 1) / (c("peers_comparable") + 1)
    slower = c("c_latency_p95") - c("b_latency_p95")
    riskier = (c("c_value_at_risk") - c("b_value_at_risk")).cast("double")
    say = F.format_string
    items = F.array(
        _item(
            "failure_rate", "failure_rate", c("b_failure_rate"), c("c_failure_rate"), d, c("relative_delta"), c("sigma"), layer, *span,
            say("%s failed %s%% of %d rows at baseline and %s%% of %d now (%s sigma)", key, _pct(c("b_failure_rate")), c("b_volume"),
                _pct(c("c_failure_rate")), c("c_volume"), F.round("sigma", 2)),
        ),
        _item(
            "latency", "latency_p95", c("b_latency_p95"), c("c_latency_p95"), slower,
            F.when(c("b_latency_p95") != 0, slower / c("b_latency_p95")).otherwise(0.0), None, layer, *span,
            say("p95 latency of %s went from %s to %s ms", key, F.round("b_latency_p95", 0), F.round("c_latency_p95", 0)),
        ),
        _item(
            "response_mix", "infrastructure_side_rate", c("b_infrastructure_rate"), c("c_infrastructure_rate"),
            c("c_infrastructure_rate") - c("b_infrastructure_rate"), relative_delta(c("b_infrastructure_rate"), c("c_infrastructure_rate")),
            two_proportion_z(c("b_infrastructure_side"), c("b_volume"), c("c_infrastructure_side"), c("c_volume")), layer, *span,
            say("infrastructure-side responses of %s went from %s%% to %s%%", key, _pct(c("b_infrastructure_rate")), _pct(c("c_infrastructure_rate"))),
        ),
        _item(
            "control_comparison", "control_failure_rate", ctl_b, ctl_c, ctl_c - ctl_b, relative_delta(ctl_b, ctl_c),
            two_proportion_z(c("b_ctl_failures"), c("b_ctl_volume"), c("c_ctl_failures"), c("c_ctl_volume")), layer, *span,
            say("siblings of %s went from %s%% to %s%% while it moved by %s points", key, _pct(ctl_b), _pct(ctl_c), _pct(d)),
        ),
        _item(
            "blast_radius", "blast_radius", None, radius, None, None, None, layer, *span,
            say("%d of %d peers of %s rose as well; with it, %s%% of the dimension", c("peers_moved"), c("peers_comparable"), key, _pct(radius)),
        ),
        _item(
            "temporal_alignment", "failure_rate_vs_preceding_window", c("p_failure_rate"), c("c_failure_rate"), c("c_failure_rate") - c("p_failure_rate"),
            relative_delta(c("p_failure_rate"), c("c_failure_rate")),
            two_proportion_z(c("p_failures"), c("p_volume"), c("c_failures"), c("c_volume")), layer, windows.prior_start, windows.current_start,
            say("in the equally long window just before, %s failed %s%% of %d rows", key, _pct(c("p_failure_rate")), c("p_volume")),
            present=F.coalesce(c("p_volume"), F.lit(0)) > 0,
        ),
        _item(
            "confounding_check", F.concat(F.lit("independence_from_"), c("confounder_key")), rb, rc, c("residual_delta"), c("kept_share"),
            c("residual_sigma"), F.when(c("rc_simulated") > 0, "SIMULATED").otherwise("OBSERVED"), *span,
            say("without %s, %s keeps %s%% of its movement", c("confounder_key"), key, _pct(c("kept_share"))),
            present=c("confounder_key").isNotNull(),
        ),
        _item(
            "gmv_impact", "gmv_at_risk", c("b_value_at_risk"), c("c_value_at_risk"), riskier,
            relative_delta(c("b_value_at_risk").cast("double"), c("c_value_at_risk").cast("double")), None, F.lit("OBSERVED"), *span,
            say("value on failing rows of %s is %s of %s", key, c("c_value_at_risk"), c("c_value_total")),
        ),
    )
    tall = wide.select("subject_order", "cohort_key", F.explode(F.filter(items, lambda e: e.isNotNull())).alias("e"))
    order = Window.orderBy("subject_order", "e.type_order")
    return tall.select(F.row_number().over(order).cast("long").alias("evidence_id"), "subject_order", "cohort_key", "e.*")
