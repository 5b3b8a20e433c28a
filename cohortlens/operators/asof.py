"""As-of join: the interval in force at each instant, from one ordered stream per key and time bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def records(intervals: DataFrame, key: str, start: str, end: str, bucket) -> DataFrame:
    """The intervals that are in force at some instant, where the earliest one that covers an instant is.

    In order of (start, end), an interval is in force after all earlier ones have ended, so exactly those count whose end lies beyond
    the ends of all earlier ones. The running maximum of ends is taken inside time buckets of the starts and carried over their borders by a
    table with one row per (key, bucket), so a key with many intervals isn't sorted in one task.
    """
    rows = intervals.where(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_b", bucket(F.col(start)))
    upto = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(key, "_b").agg(F.max(end).alias("_most")).select(key, "_b", F.max("_most").over(upto).alias("_before"))
    inside = Window.partitionBy(key, "_b").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_here", F.max(end).over(inside)).join(carried, [key, "_b"])
    highest = F.greatest("_here", "_before")  # ignores NULLs
    return seen.where(highest.isNull() | (F.col(end) > highest)).drop("_b", "_here", "_before")


def state_as_of(
    points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, value: str, bucket, name: str = "state"
) -> DataFrame:
    """Every row of points with the value of the interval in force at its instant (both ends count).

    Where several cover it, the one that starts (then ends) first; where none does, the key's last interval by (start, end); NULL for
    a key without any. `bucket` maps a time column to a number that never decreases with it.

    Records' starts and ends both ascend, so the only one that can cover an instant is the first whose end isn't before it. Points and ends of
    records are merged into one stream per (key, bucket), in which that end is the next one after the point; past the last end of a
    bucket it is the first of the key's next bucket that has one, from a table with one row per (key, bucket). No point meets an
    interval by a join, so work and output follow points plus intervals.
    """
    pack = F.struct(F.col(end).alias("end"), F.col(start).alias("start"), F.col(value).alias("value"))
    ends = records(intervals, key, start, end, bucket).select(F.col(key).alias("_key"), F.col(end).alias("_time"), pack.alias("_record"))
    rows = points.select(F.col(key).alias("_key"), F.col(at).alias("_time"), F.struct(*[F.col(c) for c in points.columns]).alias("_point"))
    stream = rows.unionByName(ends, allowMissingColumns=True).withColumn("_b", bucket(F.col("_time")))
    # Points before ends of the same instant: an interval still counts at its end.
    following = Window.partitionBy("_key", "_b").orderBy("_time", F.col("_record").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    merged = stream.withColumn("_next", F.first("_record", ignorenulls=True).over(following)).where("_point IS NOT NULL")

    last = intervals.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(value), F.struct(start, end)).alias("_last"))
    beyond = Window.partitionBy("_key").orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    buckets = stream.groupBy("_key", "_b").agg(F.min("_record").alias("_first"))
    carried = buckets.select("_key", "_b", F.first("_first", ignorenulls=True).over(beyond).alias("_later")).join(last, "_key", "left")
    joined = merged.join(
        carried.withColumnsRenamed({"_key": "_k", "_b": "_c"}), F.col("_key").eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_c")), "left"
    )
    found = F.coalesce("_next", "_later")
    covering = F.when(found["start"] <= F.col("_time"), F.struct(found["value"].alias(value)))
    state = F.coalesce(covering, F.col("_last"))[value]
    return joined.select("_point.*", state.alias(name))


def seconds(width: float):
    """Buckets of `width` seconds, for timestamps."""
    return lambda time: F.floor(F.unix_micros(time.cast("timestamp")) / F.lit(width * 1e6))


def numbers(width: float):
    """Buckets of `width`, for numeric instants."""
    return lambda time: F.floor(time.cast("double") / F.lit(float(width)))
