"""Competing explanations and the root-cause conclusion drawn from evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.stats import anomaly_score, clamp, confidence, evidence_strength, rate, severity, two_proportion_z
from ..spec import DetectionConfig, FactSpec
from .detect import residuals, shared_traffic
from .evidence import COLLAPSE_THRESHOLD

# Component weights, saturation points and decision thresholds.
WEIGHT_SIGNAL = 0.30
WEIGHT_DIVERGENCE = 0.20
WEIGHT_LOCALISATION = 0.15
WEIGHT_TEMPORAL = 0.05
WEIGHT_INDEPENDENCE = 0.30
RESPONSE_TILT_WEIGHT = 0.15
RESPONSE_TILT_LIMIT = 0.10
SIGNAL_SATURATION = 12.0
SYSTEMIC_CEILING = 0.15
CONFIDENT = 0.60
UNCERTAIN = 0.35

# The explanations always considered, and the dimension each one is about.
HYPOTHESES = {
    "gateway_degradation": "gateway",
    "issuer_degradation": "sender_bank",
    "payment_method_degradation": "payment_method",
    "network_segment_degradation": "network",
}
SYSTEMIC = "systemic_degradation"
INFRASTRUCTURE_FLAVOURED = ("gateway_degradation", "network_segment_degradation")


def _cite(*rules) -> Column:
    """Evidence ids whose rule holds, in rule order."""
    return F.filter(F.array(*[F.when(test, F.col(f"id_{kind}")) for kind, test in rules]), lambda i: i.isNotNull())


def _localised(wide: DataFrame, evidence: DataFrame, reported: DataFrame) -> DataFrame:
    """Score the four single-dimension explanations; one without a candidate stays, at zero."""
    c = F.col
    frame = reported.sparkSession.range(1).select(
        F.explode(F.array(*[F.struct(F.lit(h).alias("hypothesis_type"), F.lit(d).alias("dim_set")) for h, d in HYPOTHESES.items()])).alias("h")
    ).select("h.*")
    ids = evidence.groupBy("cohort_key").agg(
        *[
            F.max(F.when(c("evidence_type") == k, c("evidence_id"))).alias(f"id_{k}")
            for k in ("failure_rate", "response_mix", "control_comparison", "blast_radius", "temporal_alignment", "confounding_check")
        ]
    )
    best = wide.where(c("depth") == 1).groupBy("dim_set").agg(F.min_by("cohort_key", "rank").alias("cohort_key"))
    subject = best.drop("dim_set").join(wide, "cohort_key").join(ids, "cohort_key")

    signal = clamp(c("sigma") / SIGNAL_SATURATION)
    control = F.round(rate(c("c_ctl_failures"), c("c_ctl_volume")), 6) - F.round(rate(c("b_ctl_failures"), c("b_ctl_volume")), 6)
    delta = c("absolute_delta")
    divergence = F.when(delta > 0, clamp((delta - control) / delta)).otherwise(0.0)
    radius = (c("peers_moved") + 1) / (c("peers_comparable") + 1)
    timed = F.coalesce(c("p_volume"), F.lit(0)) > 0
    then = F.coalesce(two_proportion_z(c("p_failures"), c("p_volume"), c("c_failures"), c("c_volume")), F.lit(0.0))
    tested = c("confounder_key").isNotNull()
    kept = F.when(tested, clamp(c("kept_share"))).otherwise(1.0)
    tilt = rate(c("c_infrastructure_side"), c("c_failures")) - rate(c("b_infrastructure_side"), c("b_failures"))
    parts = frame.join(subject, "dim_set", "left").select(
        "*",
        signal.alias("signal"),
        divergence.alias("divergence"),
        F.greatest(F.lit(0.0), 1.0 - radius).alias("localisation"),
        F.when(timed, clamp(then / SIGNAL_SATURATION)).otherwise(0.0).alias("temporal"),
        kept.alias("retained"),
        F.when(c("hypothesis_type").isin(*INFRASTRUCTURE_FLAVOURED), tilt).otherwise(-tilt).alias("alignment"),
        control.alias("control_delta"),
        radius.alias("radius"),
        then.alias("temporal_sigma"),
    )
    base = (
        WEIGHT_SIGNAL * c("signal")
        + WEIGHT_DIVERGENCE * c("divergence")
        + WEIGHT_LOCALISATION * c("localisation")
        + WEIGHT_TEMPORAL * c("temporal")
        + WEIGHT_INDEPENDENCE * c("retained")
    )
    modifier = RESPONSE_TILT_WEIGHT * clamp(c("alignment") / RESPONSE_TILT_LIMIT, -1.0, 1.0)
    has = c("cohort_key").isNotNull()
    steady = 0.02
    supporting = _cite(
        ("failure_rate", has),
        ("control_comparison", c("control_delta") < steady),
        ("blast_radius", c("radius") <= 0.5),
        ("temporal_alignment", c("temporal_sigma") >= 3.0),
        ("confounding_check", c("retained") >= COLLAPSE_THRESHOLD),
        ("response_mix", c("alignment") > 0.01),
    )
    contradicting = _cite(
        ("control_comparison", c("control_delta") >= steady),
        ("blast_radius", c("radius") > 0.5),
        ("temporal_alignment", c("temporal_sigma") < 3.0),
        ("confounding_check", c("retained") < COLLAPSE_THRESHOLD),
        ("response_mix", c("alignment") < -0.01),
    )
    none = F.array().cast("array<bigint>")
    return parts.select(
        "hypothesis_type",
        c("dim_set").alias("subject_dimension"),
        F.when(has, F.element_at(F.split("cohort_key", "="), -1)).alias("subject_value"),
        F.when(has, clamp(base + modifier)).otherwise(0.0).alias("hypothesis_score"),
        F.when(has, evidence_strength(c("score"))).otherwise(0.0).alias("strength"),
        F.coalesce("severity", F.lit("NONE")).alias("severity"),
        F.coalesce("sigma", F.lit(0.0)).alias("sigma"),
        F.when(has, supporting).otherwise(none).alias("supporting"),
        F.when(has, contradicting).otherwise(none).alias("contradicting"),
    )


def _systemic(
    cells: DataFrame, metrics: DataFrame, scored: DataFrame, reported: DataFrame, evidence: DataFrame, spec: FactSpec, config: DetectionConfig
) -> DataFrame:
    """Score "everything degraded": population signal and breadth, discounted by what the leading cohort explains.

    The few numbers it needs come from different tables; each contributes columns to one global aggregation.
    """
    c = F.col
    whole = metrics.where(c("dim_set") == "ALL")
    population = whole.select(
        *[
            F.when(c("window") == w, c(m)).alias(f"{t}_{m}")
            for w, t in (("baseline", "b"), ("current", "c"))
            for m in ("volume", "failures", "simulated_rows")
        ]
    )
    gateways = scored.where(c("dim_set") == spec.source_dim).select(
        F.lit(1).alias("comparable"), (c("absolute_delta") >= config.min_absolute_delta).cast("int").alias("moved")
    )
    leader = reported.where((c("rank") == 1) & (c("depth") == 1)).select(
        F.lit("ALL").alias("cohort_key"), c("dim_set").alias("conf_dim"), c("cohort_key").alias("confounder_key")
    )
    everyone = whole.groupBy("cohort_key").agg(
        *[
            F.max(F.when(c("window") == w, c(m))).alias(f"{t}_{m}")
            for w, t in (("baseline", "b"), ("current", "c"))
            for m in ("volume", "failures", "simulated_rows")
        ]
    ).withColumn("absolute_delta", rate(c("c_failures"), c("c_volume")) - rate(c("b_failures"), c("b_volume")))
    traffic = shared_traffic(cells, everyone, leader.select(c("confounder_key").alias("cohort_key")), spec)
    left = residuals(everyone, traffic, leader, config).where(~c("residual_missing")).select(c("residual_delta"))
    cited = evidence.where(c("evidence_type") == "blast_radius").select(
        F.when(c("current_value") >= 0.6, c("evidence_id")).alias("pro"),
        F.when(c("current_value") < 0.6, c("evidence_id")).alias("contra"),
    )
    facts = population
    for side in (gateways, left, cited):
        facts = facts.unionByName(side, allowMissingColumns=True)
    one = facts.agg(
        *[F.max(n).alias(n) for n in ("b_volume", "b_failures", "c_volume", "c_failures", "residual_delta")],
        F.coalesce(F.sum("comparable"), F.lit(0)).alias("comparable"),
        F.coalesce(F.sum("moved"), F.lit(0)).alias("moved"),
        F.array_sort(F.collect_list("pro")).alias("pro"),
        F.array_sort(F.collect_list("contra")).alias("contra"),
    )
    delta = rate(c("c_failures"), c("c_volume")) - rate(c("b_failures"), c("b_volume"))
    sigma = two_proportion_z(c("b_failures"), c("b_volume"), c("c_failures"), c("c_volume"))
    one = one.withColumn("delta", delta).withColumn("sigma", sigma)
    kept = F.when(c("residual_delta").isNotNull() & (c("delta") > 0), clamp(c("residual_delta") / c("delta"))).otherwise(1.0)
    score = clamp((0.5 * clamp(c("sigma") / SIGNAL_SATURATION) + 0.5 * rate(c("moved"), c("comparable"))) * kept)
    shown = F.round("sigma", 4)
    return one.select(
        F.lit(SYSTEMIC).alias("hypothesis_type"),
        F.lit(None).cast("string").alias("subject_dimension"),
        F.lit(None).cast("string").alias("subject_value"),
        F.when(c("delta") < config.min_absolute_delta, F.least(score, F.lit(SYSTEMIC_CEILING))).otherwise(score).alias("hypothesis_score"),
        evidence_strength(anomaly_score(shown, F.round("delta", 6))).alias("strength"),
        severity(shown).alias("severity"),
        shown.alias("sigma"),
        c("pro").alias("supporting"),
        c("contra").alias("contradicting"),
    )


def hypotheses(
    cells: DataFrame, metrics: DataFrame, scored: DataFrame, reported: DataFrame, wide: DataFrame, evidence: DataFrame,
    spec: FactSpec, config: DetectionConfig = DetectionConfig(),
) -> DataFrame:
    """The five competing explanations, ranked, with attribution and confidence. Always exactly five rows."""
    local = _localised(wide, evidence, reported)
    every = local.unionByName(_systemic(cells, metrics, scored, reported, evidence, spec, config))
    order = Window.orderBy(F.col("hypothesis_score").desc(), "hypothesis_type")
    ranked = every.withColumn("hypothesis_rank", F.row_number().over(order)).withColumn(
        "_next", F.lead("hypothesis_score").over(order)
    )
    top = (F.col("hypothesis_rank") == 1) & (F.col("hypothesis_score") > 0)
    margin = F.when(top, (F.col("hypothesis_score") - F.coalesce("_next", F.lit(0.0))) / F.col("hypothesis_score")).otherwise(0.0)
    attribution = F.when(top, clamp(F.col("hypothesis_score") * (0.5 + 0.5 * F.col("margin")))).otherwise(
        clamp(F.col("hypothesis_score") * 0.5)
    )
    return (
        ranked.withColumn("margin", margin)
        .withColumn("attribution", attribution)
        .withColumn("confidence", F.round(confidence(F.col("strength"), F.col("attribution")), 4))
        .drop("_next")
    )


def _statement() -> Column:
    subject = F.coalesce("subject_value", F.lit("(no candidate)"))
    return (
        F.when(F.col("hypothesis_type") == "gateway_degradation", F.concat(F.lit("Gateway "), subject, F.lit(" is degraded")))
        .when(F.col("hypothesis_type") == "issuer_degradation", F.concat(F.lit("Issuer "), subject, F.lit(" is failing transactions")))
        .when(F.col("hypothesis_type") == "payment_method_degradation", F.concat(F.lit("Payment method "), subject, F.lit(" is degraded")))
        .when(F.col("hypothesis_type") == "network_segment_degradation", F.concat(F.lit("Network "), subject, F.lit(" is degraded")))
        .otherwise("The whole system is degraded")
    )


def verdict(confidence_: Column, has_subject: Column) -> Column:
    return (
        F.when(~has_subject | (confidence_ < UNCERTAIN), "INSUFFICIENT_EVIDENCE")
        .when(confidence_ >= CONFIDENT, "CONFIDENT")
        .otherwise("UNCERTAIN")
    )


def conclusion(hyps: DataFrame, wide: DataFrame) -> DataFrame:
    """One row: verdict, cause, populations and the alternatives considered (four structs)."""
    c = F.col
    told = hyps.withColumn("statement", _statement())
    top = told.where(c("hypothesis_rank") == 1)
    others = told.where(c("hypothesis_rank") > 1).select(
        F.struct("hypothesis_rank", "hypothesis_type", "subject_value", "hypothesis_score", "confidence").alias("_alt")
    )
    leader = wide.where(c("rank") == 1).select(
        c("cohort_key").alias("affected_cohort"),
        c("c_volume").alias("affected_volume"),
        c("b_failure_rate").alias("affected_baseline_rate"),
        c("c_failure_rate").alias("affected_current_rate"),
        c("c_ctl_volume").alias("control_volume"),
        c("c_ctl_failures").alias("control_failures"),
    )
    joined = top.unionByName(leader, allowMissingColumns=True).unionByName(others, allowMissingColumns=True)
    plain = [n for n in (*top.columns, *leader.columns)]
    one = joined.agg(*[F.max(n).alias(n) for n in plain], F.array_sort(F.collect_list("_alt")).alias("alternatives"))
    has_subject = c("subject_value").isNotNull() | (c("hypothesis_type") == SYSTEMIC)
    judged = one.withColumn("verdict", verdict(c("confidence"), has_subject))
    named = c("verdict") != "INSUFFICIENT_EVIDENCE"
    return judged.select(
        "verdict",
        F.when(named, c("statement")).alias("root_cause"),
        F.when(named, c("hypothesis_type")).alias("predicted_type"),
        F.when(named & (c("subject_dimension") == "gateway"), c("subject_value")).alias("predicted_gateway"),
        F.when(named & (c("subject_dimension") != "gateway"), F.concat_ws("=", "subject_dimension", "subject_value")).alias("predicted_segment"),
        "confidence",
        "severity",
        F.round("sigma", 4).alias("sigma"),
        F.round("strength", 4).alias("strength"),
        "affected_cohort",
        F.coalesce("affected_volume", F.lit(0)).alias("affected_volume"),
        "affected_baseline_rate",
        "affected_current_rate",
        "control_volume",
        "control_failures",
        "supporting",
        "contradicting",
        "alternatives",
        F.when(named, F.format_string("%s. Confidence %s; %s sigma, severity %s.", "statement", F.col("confidence"), F.round("sigma", 2), F.col("severity")))
        .otherwise(F.format_string("Evidence is insufficient to name a cause (best: %s, confidence %s).", "statement", F.col("confidence")))
        .alias("summary"),
    )


def analysis_fingerprint(result: DataFrame, hyps: DataFrame, evidence: DataFrame) -> DataFrame:
    """SHA-256 over verdict, ranked explanations and evidence values; no surrogate ids, so a rebuild reproduces it.

    The input is the conclusion, five explanations and at most a few dozen evidence rows.
    """

    def six(c):
        return F.coalesce(F.col(c).cast("decimal(30,6)").cast("string"), F.lit("NULL"))

    lines = (
        result.select(F.lit("0").alias("k"), F.concat_ws("|", "verdict", F.coalesce("root_cause", F.lit("None")), six("confidence")).alias("line"))
        .unionByName(
            hyps.select(
                F.format_string("1%02d", "hypothesis_rank").alias("k"),
                F.concat_ws("|", "hypothesis_type", F.coalesce("subject_value", F.lit("None")), six("hypothesis_score")).alias("line"),
            )
        )
        .unionByName(
            evidence.select(
                F.concat_ws("|", F.lit("2"), "cohort_key", "evidence_type").alias("k"),
                F.concat_ws("|", "evidence_type", "metric_name", "cohort_key", six("baseline_value"), six("current_value"), six("delta"), six("sigma"), "source_layer").alias("line"),
            )
        )
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda s: s["line"]), "\n")
    return lines.agg(F.sha2(text, 256).alias("analysis_fingerprint"))


def evaluate(results: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Predicted cause against the recorded truth; NULL equals NULL (no gateway predicted, none at fault)."""
    joined = results.join(truth, key)
    gateway = F.col("predicted_gateway").eqNullSafe(F.col("true_gateway"))
    kind = F.col("predicted_type").eqNullSafe(F.col("true_type"))
    return joined.select(
        key, "predicted_type", "true_type", "predicted_gateway", "true_gateway",
        gateway.alias("gateway_correct"), kind.alias("type_correct"), (gateway & kind).alias("correct"),
    )

