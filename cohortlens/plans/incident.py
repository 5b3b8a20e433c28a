"""Incident analysis end to end: one pass over facts, then small tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import attribute, detect, evidence, metrics
from ..session import materialize
from ..spec import DetectionConfig, FactSpec, Windows


@dataclass(frozen=True)
class Detection:
    """Everything detection computed, as DataFrames; `cells` and `metrics` are materialised."""

    cells: DataFrame
    metrics: DataFrame
    scored: DataFrame
    ranked: DataFrame
    verdicts: DataFrame
    classified: DataFrame

    @property
    def reported(self) -> DataFrame:
        return self.ranked.where(~F.col("suppressed"))

    @property
    def primary(self) -> DataFrame:
        return self.classified.where(F.col("alert_role") == "PRIMARY")

    @property
    def derivative(self) -> DataFrame:
        return self.classified.where(F.col("alert_role") == "DERIVATIVE")

    @property
    def top(self) -> DataFrame:
        return self.reported.where(F.col("rank") == 1)


def scan(fact: DataFrame, spec: FactSpec, windows: Windows) -> tuple[DataFrame, DataFrame]:
    """Cells and metrics. Cells are the only intermediate whose size follows the data's dimensions; both are kept."""
    cells, table = metrics.measure(fact, spec, windows)
    return cells, materialize(table)


def rank(table: DataFrame, spec: FactSpec, config: DetectionConfig) -> tuple[DataFrame, DataFrame]:
    scored = materialize(detect.score_cohorts(table, spec, config))
    marked = materialize(detect.suppress_redundant(detect.candidates(scored), spec, config))
    return scored, materialize(detect.rank_candidates(marked))


def detect_incident(
    fact: DataFrame, spec: FactSpec, windows: Windows, config: DetectionConfig = DetectionConfig()
) -> Detection:
    cells, table = scan(fact, spec, windows)
    scored, ranked = rank(table, spec, config)
    simulated = table.where(F.col("window") == "current").select("cohort_key", F.col("simulated_rows").alias("c_simulated_rows"))
    reported = ranked.where(~F.col("suppressed"))
    verdicts = materialize(detect.pair_verdicts(cells, reported.join(simulated, "cohort_key"), spec, config))
    classified = detect.classify_roles(reported, verdicts)
    return Detection(cells, table, scored, ranked, verdicts, classified)


@dataclass(frozen=True)
class Analysis:
    detection: Detection
    subjects: DataFrame
    evidence: DataFrame
    hypotheses: DataFrame
    conclusion: DataFrame
    fingerprint: DataFrame


def analyse_incident(
    fact: DataFrame, spec: FactSpec, windows: Windows, config: DetectionConfig = DetectionConfig(), roles: bool = True
) -> Analysis:
    """Detection, evidence, explanations and conclusion. On a quiet window it reports nothing and says so."""
    if roles:
        found = detect_incident(fact, spec, windows, config)
    else:
        cells, table = scan(fact, spec, windows)
        scored, ranked = rank(table, spec, config)
        found = Detection(cells, table, scored, ranked, None, None)
    wide = materialize(
        evidence.subject_table(found.cells, found.metrics, found.scored, found.reported, spec, config)
    )
    tall = materialize(evidence.evidence_table(wide, windows))
    hyps = materialize(
        attribute.hypotheses(found.cells, found.metrics, found.scored, found.reported, wide, tall, spec, config)
    )
    result = attribute.conclusion(hyps, wide)
    return Analysis(found, wide, tall, hyps, result, attribute.analysis_fingerprint(result, hyps, tall))


def handoff(found: Detection, analysis: Analysis) -> DataFrame:
    """One row per reported cohort for the next stage: role, parent and its evidence (at most eight items), in order."""
    item = F.struct("evidence_id", "evidence_type", "metric_name", "baseline_value", "current_value", "delta", "sigma")
    cited = analysis.evidence.groupBy("cohort_key").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    rows = found.classified.select("cohort_key", "rank", "severity", "alert_role", "derived_from", "independence")
    none = F.array().cast(cited.schema["evidence"].dataType)
    return rows.join(cited, "cohort_key", "left").withColumn("evidence", F.coalesce("evidence", none))
