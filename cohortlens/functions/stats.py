"""Statistics used for scoring, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Severity bands (name, lowest sigma), highest first.
SEVERITY_BANDS = (("CRITICAL", 9.0), ("HIGH", 6.0), ("MEDIUM", 4.0), ("LOW", 3.0))
EFFECT_SATURATION = 0.15
STRENGTH_SATURATION = 12.0


def rate(part: Column, whole: Column) -> Column:
    """A share with the zero-denominator guard every derived rate uses."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def two_proportion_z(base_hits: Column, base_n: Column, hits: Column, n: Column) -> Column:
    """Pooled two-proportion z statistic; 0 for an empty sample or a pooled rate of exactly 0 or 1."""
    n0, n1 = base_n.cast("double"), n.cast("double")
    pooled = (base_hits + hits).cast("double") / (n0 + n1)
    error = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / n0 + F.lit(1.0) / n1))
    z = (hits.cast("double") / n1 - base_hits.cast("double") / n0) / error
    usable = (base_n > 0) & (n > 0)
    mixed = (base_hits + hits > 0) & (base_hits + hits < base_n + n)
    return F.when(usable & mixed, z).otherwise(F.lit(0.0))


def effect_factor(delta: Column) -> Column:
    return F.when(delta > 0, F.least(F.lit(1.0), delta / F.lit(EFFECT_SATURATION))).otherwise(F.lit(0.0))


def anomaly_score(sigma: Column, delta: Column) -> Column:
    return F.when(sigma > 0, sigma * effect_factor(delta)).otherwise(F.lit(0.0))


def severity(sigma: Column) -> Column:
    bands = F.when(sigma >= SEVERITY_BANDS[0][1], SEVERITY_BANDS[0][0])
    for name, low in SEVERITY_BANDS[1:]:
        bands = bands.when(sigma >= low, name)
    return bands.otherwise("NONE")


def relative_delta(base: Column, current: Column) -> Column:
    return F.when(base != 0, (current - base) / base).otherwise(F.lit(0.0))


def evidence_strength(score: Column) -> Column:
    return clamp(score / F.lit(STRENGTH_SATURATION))


def confidence(strength: Column, attribution: Column) -> Column:
    """Geometric mean, so neither factor can stand in for the other."""
    return F.sqrt(clamp(strength) * clamp(attribution))


def binomial_error(p: Column, n: Column) -> Column:
    q = clamp(p)
    return F.when(n > 0, F.sqrt(q * (F.lit(1.0) - q) / n.cast("double"))).otherwise(F.lit(0.0))
