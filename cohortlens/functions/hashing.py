"""Deterministic draws, digests and canonical renderings built on SHA-256."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NULL_MARK = "\\N"
_TWO_64 = 18446744073709551616.0


def digest(*parts) -> Column:
    """Hex SHA-256 of the parts joined by `|`."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws("|", *columns), 256)


def lane_uniform(hex_digest: Column, lane: int = 0) -> Column:
    """The lane-th 64-bit big-endian word of a digest as a double in [0, 1)."""
    word = F.conv(F.substring(hex_digest, 16 * lane + 1, 16), 16, 10).cast("decimal(20,0)")
    return word.cast("double") / F.lit(_TWO_64)


def weighted_choice(draw: Column, options) -> Column:
    """Pick an option name by cumulative weight, in the given order; the last one guards against rounding.

    `options` is an ordered list of (name, weight Column).
    """
    total = options[0][1]
    for _, weight in options[1:]:
        total = total + weight
    target = draw * total
    running, choice = None, None
    for name, weight in options[:-1]:
        running = weight if running is None else running + weight
        choice = F.when(target < running, name) if choice is None else choice.when(target < running, name)
    last = F.lit(options[-1][0])
    return last if choice is None else choice.otherwise(last)


def row_digest(columns) -> Column:
    """Digest of one rendered row; NULL is kept apart from the empty string."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit(NULL_MARK)) for c in columns]), 256)


def canonical_map(m: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def pair(name: str, value: Column) -> Column:
    """`name=value`, the unit cohort keys are made of."""
    return F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("NULL")))


def cohort_key(dims) -> Column:
    """Sorted `k=v` pairs joined by `|`; `ALL` for the empty set."""
    if not dims:
        return F.lit("ALL")
    return F.concat_ws("|", *[pair(d, F.col(d)) for d in sorted(dims)])
