"""Ranks, lags and samples that stay distributed however large or skewed the input is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Dense 1..n position over the whole table, by any ordering, at any size. Input should be a materialised table.

    Rows are range-partitioned on the full ordering, so ties of the leading key don't meet in one task; each partition is numbered
    on its own, and shifted by the sizes of the partitions before it. Only those sizes, one row per partition, are put in one order.
    The numbered partitions are written, because partition numbers would change if the ranges were drawn a second time.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = stage(ranged.withColumn("_pos", inside), "ranked")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    return placed.join(shifts, "_part").withColumn(name, (F.col("_pos") + F.col("_shift")).cast("int")).drop("_part", "_pos", "_shift")


def running_total(df: DataFrame, position: str, value: str, name: str, block: int = 100_000) -> DataFrame:
    """Running sum along a dense position column, block by block, so no task holds more than one block."""
    blocked = df.withColumn("_block", F.floor(F.col(position) / block))
    sums = blocked.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_block").orderBy(position)
    return (
        blocked.withColumn(name, F.sum(value).over(inside))
        .join(shifts, "_block")
        .withColumn(name, F.col(name) + F.col("_shift"))
        .drop("_block", "_shift")
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by `order`, as one aggregation: a hot key is reduced before it travels."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key by `order`."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def claim_winners(requests: DataFrame, key: str, time: str, id_: str) -> DataFrame:
    """First request per idempotency key wins; every other one is marked suppressed.

    The winner is found by a partial aggregation and joined back, so a key with a third of all requests is
    never sorted in one task (adaptive skew join splits its probe side). A request without a key claims nothing that another
    could claim: it stands for itself.
    """
    winner = requests.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(time, id_)).alias("_win"))
    keyless = requests.where(F.col(key).isNull()).withColumn("_win", F.struct(time, id_))
    marked = requests.join(winner, key).select(*requests.columns, "_win").unionByName(keyless)
    won = F.col(id_) == F.col("_win")[id_]
    return marked.select(
        *[F.col(c) for c in requests.columns],
        F.col("_win")[id_].alias("claimed_by"),
        F.when(won, "CLAIMED").otherwise("DUPLICATE_EXECUTION").alias("claim"),
    )


def bucketed_lag(df: DataFrame, key: str, order: list[str], value: str, bucket: Column, name: str) -> DataFrame:
    """Previous value per key, computed inside time buckets so that no key is sorted whole.

    The first row of a bucket takes the last value of the key's previous non-empty bucket, from a summary with
    one row per (key, bucket). `bucket` must grow with the ordering.
    """
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    summary = rows.groupBy(key, "_bucket").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    across = Window.partitionBy(key).orderBy("_bucket")
    carried = summary.select(key, "_bucket", F.lag("_last").over(across)["v"].alias("_carry"))
    first = F.row_number().over(inside) == 1
    return (
        rows.withColumn("_prev", F.lag(value).over(inside))
        .withColumn("_first", first)
        .join(carried, [key, "_bucket"])
        .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")))
        .drop("_bucket", "_prev", "_first", "_carry")
    )


def sample_cutoffs(rows: DataFrame, group: list[str], digest: str, id_: str, percents) -> DataFrame:
    """For each group and percentage, the last (digest, id) inside the first floor(n * pct / 100) rows by digest.

    Digests are uniform, so counts by their first four hex digits (at most 65,536 per group) locate the bucket
    that holds the cut; only that bucket is ranked. Nothing sorts a whole group, and samples nest by design.
    """
    bucket = F.substring(digest, 1, 4)
    keyed = rows.select(*group, F.col(digest).alias("_d"), F.col(id_).alias("_i"), bucket.alias("_b"))
    counts = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    running = Window.partitionBy(*group).orderBy("_b")
    whole = Window.partitionBy(*group)
    placed = counts.withColumn("_end", F.sum("_c").over(running)).withColumn("population", F.sum("_c").over(whole))
    wanted = placed.withColumn("percent", F.explode(F.array(*[F.lit(float(p)) for p in percents]))).withColumn(
        "take", F.floor(F.col("population") * F.col("percent") / 100.0).cast("long")
    )
    start = F.col("_end") - F.col("_c")
    holding = wanted.where((F.col("take") > start) & (F.col("take") <= F.col("_end"))).select(
        *group, "_b", "percent", "take", "population", (F.col("take") - start).alias("_offset")
    )
    edge = keyed.join(holding.select(*group, "_b").distinct(), [*group, "_b"], "left_semi")
    ranked = edge.withColumn("_pos", F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_d", "_i")))
    hit = ranked.join(holding, [*group, "_b"]).where(F.col("_pos") == F.col("_offset"))
    return hit.select(*group, "percent", "take", "population", F.col("_d").alias("cut_digest"), F.col("_i").alias("cut_id"))


def coarse_bucket(v: Column, steps: int = 256) -> Column:
    """A bucket number that never decreases as the value grows: so many per doubling, both signs, infinities and NaN at the ends."""
    offset, end = steps * 1100, steps * 2200
    size = F.floor(F.log2(F.abs(v)) * steps) + offset
    infinite = F.lit(float("inf"))
    return (
        F.when(F.isnan(v), end + 1)
        .when(v == infinite, end)
        .when(v == -infinite, -end)
        .when(v > 0, size)
        .when(v < 0, -size)
        .otherwise(F.lit(0))
        .cast("long")
    )


def holding_buckets(buckets: DataFrame, keys: list[str], ranks) -> DataFrame:
    """The bucket that holds each asked rank: keys, _b, _low, _high, _n, _name, _off (rank inside the bucket).

    buckets: keys, _b, _c (rows), _low and _high (least and greatest value). `ranks` is a list of (name, n -> 0-based rank). The
    number of buckets per key is bounded by the float range.
    """
    by = keys or [F.lit(1)]
    running, whole = Window.partitionBy(*by).orderBy("_b"), Window.partitionBy(*by)
    placed = buckets.withColumn("_end", F.sum("_c").over(running)).withColumn("_n", F.sum("_c").over(whole))
    asks = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("long").alias("rank")) for name, rank in ranks])
    start = F.col("_end") - F.col("_c")
    asked = placed.withColumn("_ask", F.explode(asks)).where((F.col("_ask.rank") >= start) & (F.col("_ask.rank") < F.col("_end")))
    return asked.select(*keys, "_b", "_low", "_high", "_n", F.col("_ask.name").alias("_name"), (F.col("_ask.rank") - start).alias("_off"))


def open_buckets(holding: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets that hold a rank and more than one value: the only ones whose values have to be looked at."""
    return holding.where(F.col("_low") != F.col("_high")).select(*keys, "_b").distinct()


def settle_ranks(holding: DataFrame, values: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row per key: _n and the value at each rank. values: keys, _b, _v, _w of the open buckets."""
    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    upto = values.groupBy(*keys, "_b", "_v").agg(F.sum("_w").alias("_w")).withColumn("_cum", F.sum("_w").over(inside))
    several = holding.where(F.col("_low") != F.col("_high"))
    hit = upto.join(several, [*keys, "_b"]).where((F.col("_off") < F.col("_cum")) & (F.col("_off") >= F.col("_cum") - F.col("_w")))
    single = holding.where(F.col("_low") == F.col("_high"))
    both = hit.select(*keys, "_n", "_name", "_v").unionByName(single.select(*keys, "_n", "_name", F.col("_low").alias("_v")))
    return both.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in names])


def values_at(counts: DataFrame, keys: list[str], value: str, weight: str, ranks) -> DataFrame:
    """Values at exact 0-based ranks per key, from (key, value, weight) counts; one row per key, `_n` and one column per rank.

    Bucket totals locate the coarse bucket that holds each rank, and only those buckets are sorted. A key with a third of all rows and
    as many distinct values is therefore never sorted or buffered whole. The counts are written once, since they are read twice.
    """
    k = F.struct(*[F.col(c) for c in keys]).alias("_k") if keys else F.struct(F.lit(1).alias("one")).alias("_k")
    rows = counts.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(
        k, F.col(value).cast("double").alias("_v"), F.col(weight).alias("_w")
    )
    rows = stage(rows.withColumn("_b", coarse_bucket(F.col("_v"))), "counts")
    buckets = rows.groupBy("_k", "_b").agg(F.sum("_w").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    holding = holding_buckets(buckets, ["_k"], ranks)
    edge = rows.join(open_buckets(holding, ["_k"]), ["_k", "_b"], "left_semi")
    out = settle_ranks(holding, edge, ["_k"], [name for name, _ in ranks])
    return out.select(*[F.col("_k")[c].alias(c) for c in keys], "_n", *[name for name, _ in ranks])


def nearest_rank_low(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], weight: Column | None = None) -> DataFrame:
    """`sorted[int(f * (n - 1))]` per key for each named fraction: always a value that occurs, never an average of two."""
    amount = F.sum(weight) if weight is not None else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(amount.alias("_c"))

    def at(fraction):
        return lambda n: F.floor(F.lit(float(fraction)) * (n - 1))

    return values_at(counts, keys, value, "_c", [(name, at(f)) for name, f in fractions.items()]).drop("_n")


def percentile_ranks(fractions: dict[str, float]):
    """The two ranks each interpolating percentile lies between."""

    def at(fraction, side):
        return lambda n: side(F.lit(float(fraction)) * (n - 1))

    return [(f"{n}_{t}", at(f, side)) for n, f in fractions.items() for t, side in (("lo", F.floor), ("hi", F.ceil))]


def interpolated(name: str, fraction: float) -> Column:
    """The percentile from its two ranks and the row count `_n`."""
    position = F.lit(float(fraction)) * (F.col("_n") - 1)
    low, high = F.floor(position), F.ceil(position)
    lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
    return F.when(low == high, lo).otherwise((high - position) * lo + (position - low) * hi).alias(name)


def exact_percentiles(counts: DataFrame, keys: list[str], value: str, weight: str, fractions: dict[str, float]) -> DataFrame:
    """Interpolating percentiles per key, equal to a buffered exact percentile but without holding a key's values."""
    found = values_at(counts, keys, value, weight, percentile_ranks(fractions))
    return found.select(*keys, *[interpolated(n, f) for n, f in fractions.items()])
