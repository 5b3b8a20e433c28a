"""Calibration, hash-weighted assignment, stress overlays, and bounded reroute what-ifs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import digest, lane_uniform, weighted_choice
from ..functions.stats import clamp, rate
from ..session import stage
from ..spec import FactSpec
from . import asof
from .metrics import in_window, member_of
from .ranking import nearest_rank_low, sample_cutoffs

# Bounds of the candidate sweep.
TRAFFIC_PERCENTAGES = (10.0, 20.0, 30.0)
MAX_TRAFFIC_PERCENTAGE = 30.0
MIN_COHORT_SIZE = 100
NO_ACTION_MARGIN = 1000.0
NEAR_BEST_FRACTION = 0.95
CONCENTRATION_SATURATION = 0.40
LATENCY_SATURATION_MS = 400.0
COHORT_CONFIDENCE_SIZE = 400
ROUTING_UNCERTAINTY = 0.25
SPREAD_DAMPING = 0.6
RISK_WEIGHTS = {
    "concentration_risk": 2.0,
    "target_health_risk": 2.0,
    "latency_risk": 1.0,
    "simulation_quality_risk": 1.0,
    "evidence_uncertainty_risk": 1.0,
    "routing_uncertainty_risk": 1.0,
}
OUTCOME_DOMAIN = "outcome-draw-1"
SELECTION_DOMAIN = "reroute-selection-1"


# ------------------------------------------------------------------------------------------------ probabilities
def effective_probability(p: Column, multiplier: Column) -> Column:
    return clamp(p * multiplier)


def added_probability(p: Column, effective: Column) -> Column:
    """Chance that a row which would have succeeded at rate p now fails."""
    return F.when(p < 1.0, F.greatest(F.lit(0.0), (effective - p) / (F.lit(1.0) - p))).otherwise(F.lit(0.0))


def calibrate_rates(groups: DataFrame, group: str, damping: float = SPREAD_DAMPING) -> DataFrame:
    """Damped relative failure rates per group, rescaled so their weighted mean is the observed rate.

    `groups` has one row per group with `weight`, `reference_rate` and the dataset's `observed_rate`. Both sums come from one
    aggregation without a key: the mean of the relative rates follows from them, since they are linear in the reference rates.
    """
    sums = groups.agg(F.sum("weight").alias("_w"), F.sum(F.col("reference_rate") * F.col("weight")).alias("_rw"))
    mean = F.col("_rw") / F.col("_w")
    relative = F.lit(1.0) + F.lit(damping) * (F.col("reference_rate") / mean - F.lit(1.0))
    # Weighted, the bracket sums to zero, so the relative rates have the mean 1.
    placed = groups.crossJoin(sums).withColumn("relative", relative)  # one row
    return placed.withColumn("failure_probability", F.col("relative") * F.col("observed_rate")).drop("_w", "_rw")


def split_weights(failed: Column, options) -> list[tuple[str, Column]]:
    """Posterior weights of each option given the observed outcome: w*p when it failed, w*(1-p) when it did not."""
    return [
        (name, F.when(failed, F.lit(w) * F.lit(p)).otherwise(F.lit(w) * (F.lit(1.0) - F.lit(p))))
        for name, w, p in options
    ]


def assign_dimension(fact: DataFrame, spec: FactSpec, options, seed: str, name: str) -> DataFrame:
    """Attach a new dimension to every row by a deterministic posterior-weighted draw: a projection, no shuffle."""
    draw = lane_uniform(digest(F.col(spec.id), seed), 0)
    failed = F.col(spec.outcome) == F.lit(spec.failed_value)
    return fact.withColumn(name, weighted_choice(draw, split_weights(failed, options)))


# ------------------------------------------------------------------------------------------------------ overlay
def _stress_columns(spec: FactSpec, definition: dict[str, str], p_base: Column, multiplier: float, key: str):
    member = member_of(definition)
    drawn = digest(OUTCOME_DOMAIN, F.col(spec.id), key)
    p_added = added_probability(p_base, effective_probability(p_base, F.lit(float(multiplier))))
    ok = F.col(spec.outcome) != F.lit(spec.failed_value)
    changed = member & ok & (lane_uniform(drawn, 0) < p_added)
    code = weighted_choice(lane_uniform(drawn, 1), [("PROCESSING_ERROR", F.lit(0.6)), ("TIMEOUT", F.lit(0.4))])
    return member, changed, p_added, code


def expected_failures(fact: DataFrame, spec: FactSpec, definition: dict[str, str], p_base: Column, multiplier: float, start, end) -> DataFrame:
    """Rows of one window slice by membership and outcome, and how many of them fail in expectation under the stress."""
    member = member_of(definition)
    p_added = added_probability(p_base, effective_probability(p_base, F.lit(float(multiplier))))
    p_fails = F.when(F.col(spec.outcome) == F.lit(spec.failed_value), 1.0).when(member, p_added).otherwise(0.0)
    rows = fact.where(in_window(F.col(spec.time), start, end))
    return rows.groupBy(member.alias("in_affected_cohort"), F.col(spec.outcome).alias("observed_status")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(p_fails).alias("expected_failures")
    )


def stress(
    fact: DataFrame, spec: FactSpec, definition: dict[str, str], p_base: Column, multiplier: float, key: str, start, end
) -> DataFrame:
    """The stressed outcome surface as a projection: same rows as joining the overlay, without the join."""
    inside = in_window(F.col(spec.time), start, end)
    _, changed, _, code = _stress_columns(spec, definition, p_base, multiplier, key)
    hit = inside & changed
    replaced = {
        spec.outcome: F.when(hit, spec.failed_value).otherwise(F.col(spec.outcome)),
        spec.code: F.when(hit, code).otherwise(F.col(spec.code)),
        "overlaid": inside | (F.col("overlaid") if "overlaid" in fact.columns else F.lit(False)),
    }
    kept = [replaced.get(c, F.col(c)).alias(c) for c in fact.columns if c != "overlaid"]
    return fact.select(*kept, replaced["overlaid"].alias("overlaid"))


# ---------------------------------------------------------------------------------------------- target validity
def health_over_span(targets: DataFrame, health: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Whether each target is healthy over its whole span: `HEALTHY`, `NOT_HEALTHY` or `NO_HEALTH_RECORD`.

    Some interval must cover the span; no unhealthy one may touch it. Intervals are matched on the target key, so
    the range tests are ordinary filters on an equi-join, reduced by a partial aggregation.
    """
    spans = targets.select(key, start, end).distinct()
    covers = (F.col("valid_from") <= F.col(start)) & (F.col("valid_to") >= F.col(end))
    overlaps = (F.col("valid_from") < F.col(end)) & (F.col("valid_to") > F.col(start))
    sick = F.col("health_state") != "HEALTHY"
    judged = (
        spans.join(health, key, "left")
        .groupBy(key, start, end)
        .agg(F.count_if(covers).alias("_covering"), F.count_if((covers | overlaps) & sick).alias("_sick"))
    )
    return judged.select(
        key,
        start,
        end,
        F.when(F.col("_covering") == 0, "NO_HEALTH_RECORD")
        .when(F.col("_sick") > 0, "NOT_HEALTHY")
        .otherwise("HEALTHY")
        .alias("target_health"),
    )


#: Time bucket of the as-of join below: a month holds few points and intervals of a target.
HEALTH_BUCKET_SECONDS = 30 * 86_400


def health_at(points: DataFrame, health: DataFrame, key: str, at: str, bucket=None) -> DataFrame:
    """Health state at an instant, the key's last window where none covers it, `none` for a key without any."""
    wanted = points.select(key, at).distinct()
    numeric = dict(points.dtypes)[at] not in ("timestamp", "timestamp_ntz", "date")
    own = bucket or (asof.numbers(1000) if numeric else asof.seconds(HEALTH_BUCKET_SECONDS))
    found = asof.state_as_of(wanted, health, key, at, "valid_from", "valid_to", "health_state", own, "health_state")
    return found.withColumn("health_state", F.coalesce("health_state", F.lit("none")))


def build_candidates(incidents: DataFrame, gateways: DataFrame) -> DataFrame:
    """NO_ACTION plus every eligible gateway other than the source, at each bounded percentage.

    `gateways` is one row per gateway. Targets arrive as one array per policy (joined by key), not as a product.
    """
    targets = gateways.where("is_eligible").groupBy("policy").agg(F.array_sort(F.collect_set("gateway")).alias("_targets"))
    moves = (
        incidents.join(targets, "policy")
        .withColumn("target_gateway", F.explode("_targets"))
        .where(~F.col("target_gateway").eqNullSafe(F.col("source_gateway")))
        .withColumn("traffic_percentage", F.explode(F.array(*[F.lit(p) for p in TRAFFIC_PERCENTAGES])))
        .withColumn("action_type", F.lit("REROUTE_TRAFFIC"))
        .withColumn(
            "candidate_key",
            F.concat_ws(":", F.lit("REROUTE_TRAFFIC"), "target_gateway", F.col("traffic_percentage").cast("int").cast("string")),
        )
        .drop("_targets")
    )
    idle = (
        incidents.withColumn("target_gateway", F.lit(None).cast("string"))
        .withColumn("traffic_percentage", F.lit(0.0))
        .withColumn("action_type", F.lit("NO_ACTION"))
        .withColumn("candidate_key", F.lit("NO_ACTION"))
    )
    return moves.unionByName(idle)


def invalid_reason() -> Column:
    """First reason a controlled comparison cannot be built; NULL when it can. Codes and their order are fixed values.

    Reads population, action_type, traffic_percentage, source_gateway, target_gateway, target_known, is_eligible
    and target_health.
    """
    moving = F.col("action_type") != "NO_ACTION"
    return (
        F.when(F.coalesce(F.col("population"), F.lit(0)) == 0, "COHORT_EMPTY")
        .when(F.col("population") < MIN_COHORT_SIZE, "COHORT_BELOW_MIN_SIZE")
        .when(moving & (F.col("traffic_percentage") > MAX_TRAFFIC_PERCENTAGE), "TRAFFIC_EXCEEDS_MAXIMUM")
        .when(moving & F.col("source_gateway").isNull(), "NO_SOURCE_GATEWAY")
        .when(moving & (F.col("source_gateway") == F.col("target_gateway")), "SOURCE_EQUALS_TARGET")
        .when(moving & ~F.coalesce(F.col("target_known"), F.lit(False)), "TARGET_UNKNOWN")
        .when(moving & ~F.coalesce(F.col("is_eligible"), F.lit(False)), "TARGET_NOT_ELIGIBLE")
        .when(moving & (F.coalesce(F.col("target_health"), F.lit("NO_HEALTH_RECORD")) == "NO_HEALTH_RECORD"), "TARGET_NO_HEALTH_RECORD")
        .when(moving & (F.col("target_health") != "HEALTHY"), "TARGET_NOT_HEALTHY")
    )


# ------------------------------------------------------------------------------------------------------- reroute
def selection_digest(id_: Column, incident: Column) -> Column:
    """Ordering that decides who moves; its domain differs from every hash that decides an outcome."""
    return digest(SELECTION_DOMAIN, id_, incident)


#: Tier of rows that no candidate moves.
NEVER = 101.0


def tier_groups(cohort: DataFrame) -> DataFrame:
    """Cohort rows as counts: incident, tier (the smallest percentage that moves them, NEVER for the rest), outcome, probability, latency.

    `cohort` has incident_id, txn_id, amount, observed_status, current_status, p_current, degraded_elsewhere and maybe latency_ms. Samples
    nest, so a tier says which candidates move a row. All figures of a candidate come from these counts; no row is expanded by candidate.
    """
    keyed = cohort.withColumn("_digest", selection_digest(F.col("txn_id"), F.col("incident_id").cast("string")))
    cuts = sample_cutoffs(keyed, ["incident_id"], "_digest", "txn_id", TRAFFIC_PERCENTAGES)
    wide = cuts.groupBy("incident_id").agg(
        *[F.max(F.when(F.col("percent") == p, F.col("cut_digest"))).alias(f"_cut{int(p)}") for p in TRAFFIC_PERCENTAGES]
    )
    tier = None
    for p in TRAFFIC_PERCENTAGES:
        inside = F.col("_digest") <= F.col(f"_cut{int(p)}")
        tier = F.when(inside, F.lit(p)) if tier is None else tier.when(inside, F.lit(p))
    latency = F.col("latency_ms") if "latency_ms" in cohort.columns else F.lit(None)
    # One row per incident: written, so that its size is known and the cohort isn't shuffled on so few keys.
    tiers = keyed.join(stage(wide, "cut-offs"), "incident_id", "left").withColumn("_tier", tier.otherwise(F.lit(NEVER)))
    return tiers.groupBy(
        "incident_id", "_tier", "observed_status", "current_status", "p_current", "degraded_elsewhere", latency.cast("double").alias("latency_ms")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


def moved_groups(cohort: DataFrame, candidates: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    """What each candidate moves, as groups of equal rows: n, amount, p_fails (expected failure of a moved row), gain.

    `candidates` also carries p_target and multiplier. Outcomes are expected values; nothing is drawn. `tiers` is tier_groups(cohort), if at hand.
    """
    tiers = tier_groups(cohort) if tiers is None else tiers
    groups = tiers.where(F.col("_tier") < NEVER).groupBy("incident_id", "_tier", "observed_status", "current_status", "p_current", "degraded_elsewhere").agg(
        F.sum("n").alias("n"), F.sum("amount").alias("amount")
    )
    moves = candidates.where(F.col("action_type") != "NO_ACTION").select(
        "incident_id", "candidate_key", "traffic_percentage", "p_target", "multiplier"
    )
    paired = groups.join(moves, "incident_id").where(F.col("traffic_percentage") >= F.col("_tier"))
    # Membership is asked again with the new gateway: a segment incident follows the row, a gateway one does not.
    effective = effective_probability(F.col("p_target"), F.col("multiplier"))
    p_target = F.when(F.col("degraded_elsewhere"), effective).otherwise(F.col("p_target"))
    fails = F.when(F.col("observed_status") == "FAILED", 1.0).otherwise(added_probability(F.col("p_target"), p_target))
    return paired.select(
        "incident_id", "candidate_key", "current_status", "n", "amount", fails.alias("p_fails"), (F.col("p_current") - p_target).alias("gain")
    )


#: Percentiles of the latencies before and after, nearest rank.
LATENCY_RANKS = {"p50": 0.50, "p95": 0.95}


def latency_impact(tiers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Latency percentiles of each candidate's cohort before and after: every row is paired with itself, moved or not.

    A moved row takes floor(latency * latency_factor) of its candidate, a row that stays keeps its own. Both sides are counts per value, so
    what a candidate multiplies is the incident's different latencies (by tier), and percentiles are located by rank.
    """
    counts = stage(tiers.groupBy("incident_id", "_tier", "latency_ms").agg(F.sum("n").alias("n")), "latency-counts")
    before = nearest_rank_low(counts, ["incident_id"], "latency_ms", {f"baseline_latency_{n}": f for n, f in LATENCY_RANKS.items()}, F.col("n"))
    factor = F.col("latency_factor") if "latency_factor" in candidates.columns else F.lit(1.0)
    options = candidates.select("incident_id", "candidate_key", "traffic_percentage", F.coalesce(factor, F.lit(1.0)).alias("_factor"))
    moved = F.col("_tier") <= F.col("traffic_percentage")
    paired = counts.join(options, "incident_id").withColumn(
        "_after", F.when(moved, F.floor(F.col("latency_ms") * F.col("_factor")).cast("double")).otherwise(F.col("latency_ms"))
    )
    keys = ["incident_id", "candidate_key"]
    after = nearest_rank_low(paired, keys, "_after", {f"projected_latency_{n}": f for n, f in LATENCY_RANKS.items()}, F.col("n"))
    return after.join(before, "incident_id").withColumn("latency_delta_ms", F.col("projected_latency_p95") - F.col("baseline_latency_p95"))


def sweep(cohort: DataFrame, candidates: DataFrame, window_traffic: DataFrame) -> DataFrame:
    """Every candidate of every incident in one job: shared totals once, plus what the moved rows change in expectation.

    `window_traffic` has one row per gateway (all in-window traffic, `window_rows` and the same `window_total`).
    """
    failed = F.col("current_status") == "FAILED"
    base = cohort.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("population"),
        F.count_if(failed).alias("baseline_failures"),
        F.sum("amount").alias("value_total"),
        F.coalesce(F.sum(F.when(failed, F.col("amount"))), F.lit(0).cast("decimal(22,2)")).alias("baseline_at_risk"),
    )
    flip = F.col("p_fails") - (F.col("current_status") == "FAILED").cast("double")
    amount = F.col("amount").cast("double")
    tiers = stage(tier_groups(cohort), "tier-groups")
    change = (
        moved_groups(cohort, candidates, tiers)
        .groupBy("incident_id", "candidate_key")
        .agg(
            F.sum("n").alias("rerouted"),
            F.sum(F.col("n") * flip).alias("_flips"),
            F.sum(amount * flip).alias("_risk"),
            F.sum(amount * F.col("gain")).alias("_retained"),
        )
    )
    zero = F.lit(0)
    joined = candidates.join(base, "incident_id", "left").join(change, ["incident_id", "candidate_key"], "left")
    joined = joined.join(latency_impact(tiers, candidates), ["incident_id", "candidate_key"], "left")
    target = window_traffic.select(F.col("gateway").alias("target_gateway"), F.col("window_rows").alias("_target_rows"))
    joined = joined.join(target, "target_gateway", "left")
    joined = joined.crossJoin(window_traffic.agg(F.max("window_rows").alias("_largest"), F.max("window_total").alias("window_total")))  # one row
    rerouted = F.coalesce(F.col("rerouted"), zero)
    failures = F.col("baseline_failures") + F.coalesce(F.col("_flips"), zero)
    idle = F.col("action_type") == "NO_ACTION"
    after = F.when(idle, rate(F.col("_largest"), F.col("window_total"))).otherwise(
        rate(F.coalesce(F.col("_target_rows"), zero) + rerouted, F.col("window_total"))
    )
    return joined.select(
        *candidates.columns,
        "population",
        rerouted.alias("rerouted"),
        "baseline_failures",
        failures.alias("projected_failures"),
        rate(F.col("population") - F.col("baseline_failures"), F.col("population")).alias("baseline_success_rate"),
        rate(F.col("population") - failures, F.col("population")).alias("projected_success_rate"),
        rate(-F.coalesce(F.col("_flips"), zero), F.col("population")).alias("success_delta"),
        "value_total",
        "baseline_at_risk",
        (F.col("baseline_at_risk") + F.coalesce(F.col("_risk"), zero)).alias("projected_at_risk"),
        F.round(F.coalesce(F.col("_retained"), F.lit(0.0)), 2).alias("expected_retained"),
        after.alias("concentration_after"),
        F.when(idle, after)
        .otherwise(rate(F.coalesce(F.col("_target_rows"), zero), F.col("window_total")))
        .alias("concentration_before"),
        rate(F.col("population"), F.col("window_total")).alias("blast_radius"),
        *[f"{side}_latency_{n}" for side in ("baseline", "projected") for n in LATENCY_RANKS],
        "latency_delta_ms",
    )


def impact_of_pairs(paired: DataFrame, keys: list[str]) -> DataFrame:
    """Business impact of any paired current / projected table, with nearest-rank-low latencies."""
    now, then = F.col("current_status") == "FAILED", F.col("projected_status") == "FAILED"
    none = F.lit(0).cast("decimal(22,2)")
    totals = paired.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("population"),
        F.count_if("rerouted").alias("rerouted"),
        F.count_if(now).alias("baseline_failures"),
        F.count_if(then).alias("projected_failures"),
        F.sum("amount").alias("value_total"),
        F.coalesce(F.sum(F.when(now, F.col("amount"))), none).alias("baseline_at_risk"),
        F.coalesce(F.sum(F.when(then, F.col("amount"))), none).alias("projected_at_risk"),
    )
    for column, tag in (("current_latency_ms", "baseline"), ("projected_latency_ms", "projected")):
        found = nearest_rank_low(paired, keys, column, {f"{tag}_latency_p50": 0.50, f"{tag}_latency_p95": 0.95})
        totals = totals.join(found, keys, "left")
    return totals.withColumn("latency_delta_ms", F.col("projected_latency_p95") - F.col("baseline_latency_p95")).withColumn(
        "success_delta", rate(F.col("baseline_failures") - F.col("projected_failures"), F.col("population"))
    )


def traffic_distribution(fact: DataFrame, column: str, source: str, target: str, moved: Column) -> DataFrame:
    """Counts and shares per value before and after moving rows from source to target."""
    counts = fact.groupBy(column).agg(F.count(F.lit(1)).alias("before"), F.count_if(moved).alias("_moved"))
    totals = counts.agg(
        F.sum("before").alias("_total"), F.coalesce(F.sum(F.when(F.col(column) == source, F.col("_moved"))), F.lit(0)).alias("_shift")
    )
    counts = counts.crossJoin(totals)  # one row
    shift, total = F.col("_shift"), F.col("_total")
    after = (
        F.when(F.col(column) == source, F.col("before") - shift)
        .when(F.col(column) == target, F.col("before") + shift)
        .otherwise(F.col("before"))
    )
    return counts.select(
        column,
        "before",
        after.alias("after"),
        rate(F.col("before"), total).alias("share_before"),
        rate(after, total).alias("share_after"),
    )


# ---------------------------------------------------------------------------------------------- risk and choice
def assess_risk(impact: DataFrame) -> DataFrame:
    """Six measurable risk components and their weighted mean; capacity is reported unavailable, never zero.

    Reads action_type, target_health, concentration_after, latency_delta_ms, population, rca_confidence (nullable).
    """
    idle = F.col("action_type") == "NO_ACTION"
    parts = {
        "concentration_risk": clamp(F.col("concentration_after") / CONCENTRATION_SATURATION),
        "target_health_risk": F.when(idle | (F.coalesce(F.col("target_health"), F.lit("")) == "HEALTHY"), 0.0).otherwise(1.0),
        "latency_risk": clamp(F.greatest(F.col("latency_delta_ms"), F.lit(0.0)) / LATENCY_SATURATION_MS),
        "simulation_quality_risk": clamp(F.lit(1.0) - F.col("population") / COHORT_CONFIDENCE_SIZE),
        "evidence_uncertainty_risk": F.when(F.col("rca_confidence").isNull(), 0.5).otherwise(clamp(F.lit(1.0) - F.col("rca_confidence"))),
        "routing_uncertainty_risk": F.lit(ROUTING_UNCERTAINTY),
    }
    assessed = impact.select("*", *[c.alias(n) for n, c in parts.items()])
    total = sum(F.col(n) * F.lit(w) for n, w in RISK_WEIGHTS.items())
    return assessed.withColumn("risk_score", total / sum(RISK_WEIGHTS.values())).withColumn("capacity_risk", F.lit("UNAVAILABLE"))


def rank_options(options: DataFrame) -> DataFrame:
    """Valid interventions per incident by benefit, success delta, smaller shift and key.

    Windows run per incident over its candidates, a set bounded by eligible targets x percentages.
    """
    order = [F.col("expected_retained").desc(), F.round("success_delta", 9).desc(), F.col("traffic_percentage"), F.col("candidate_key")]
    usable = options.where((F.col("action_type") != "NO_ACTION") & F.col("invalid_reason").isNull())
    return usable.withColumn("option_rank", F.row_number().over(Window.partitionBy("incident_id").orderBy(*order)))


def choose(options: DataFrame, margin: float = NO_ACTION_MARGIN) -> DataFrame:
    """Least intervention that keeps most of the benefit, or NO_ACTION; one row per incident with the reason."""
    ranked = rank_options(options)
    mine = Window.partitionBy("incident_id")
    best = ranked.withColumn("_best", F.max("expected_retained").over(mine)).withColumn(
        "_best_key", F.min_by("candidate_key", "option_rank").over(mine)
    )
    near = best.where(F.col("expected_retained") >= F.col("_best") * NEAR_BEST_FRACTION)
    pick = near.groupBy("incident_id").agg(
        F.min_by(
            F.struct("candidate_key", "expected_retained", "traffic_percentage", "_best", "_best_key"),
            F.struct("traffic_percentage", -F.col("expected_retained"), "candidate_key"),
        ).alias("p")
    )
    joined = options.select("incident_id").distinct().join(pick, "incident_id", "left")
    p = F.col("p")
    acts = p.isNotNull() & (p["_best"] >= margin)
    reason = (
        F.when(p.isNull(), "NO_ACTION: no candidate gave a valid comparison")
        .when(~acts, F.format_string("NO_ACTION: best candidate %s is below the margin", p["_best_key"]))
        .when(p["candidate_key"] != p["_best_key"], F.format_string("%s: near-best at a smaller shift than %s", p["candidate_key"], p["_best_key"]))
        .otherwise(F.format_string("%s: highest expected value retained", p["candidate_key"]))
    )
    return joined.select(
        "incident_id",
        F.when(acts, p["candidate_key"]).otherwise("NO_ACTION").alias("chosen"),
        F.when(acts, p["expected_retained"]).otherwise(0.0).alias("expected_retained"),
        reason.alias("reason"),
    )


def rejected_options(options: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every option not chosen, with why."""
    side = chosen.select("incident_id", "chosen", F.col("expected_retained").alias("_kept"))
    rest = options.join(side, "incident_id").where(F.col("candidate_key") != F.col("chosen"))
    why = F.when(F.col("invalid_reason").isNotNull(), F.concat(F.lit("SIMULATION_INVALID: "), F.col("invalid_reason"))).otherwise(
        F.concat(
            F.lit("retains "),
            F.col("expected_retained").cast("decimal(18,2)").cast("string"),
            F.lit(" against "),
            F.col("_kept").cast("decimal(18,2)").cast("string"),
        )
    )
    return rest.select("incident_id", "candidate_key", "chosen", why.alias("why_not"))
