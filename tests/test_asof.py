"""As-of join against brute force; role propagation by pointer jumping; latencies of what-if candidates from counts."""

import math
import random

import pytest
from pyspark.sql import functions as F, types as T

from cohortlens.operators import asof, detect, whatif

POINTS = T.StructType([T.StructField("g", T.StringType()), T.StructField("t", T.IntegerType()), T.StructField("state", T.StringType())])
INTERVALS = T.StructType(
    [T.StructField("g", T.StringType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("v", T.StringType())]
)


def brute(points, intervals):
    out = []
    for g, t, x in points:
        own = [i for i in intervals if i[0] == g and g is not None]
        cover = [i for i in own if t is not None and i[1] is not None and i[2] is not None and i[1] <= t <= i[2]]
        low = lambda v: (v is not None, v or 0)
        last = max(own, key=lambda i: (low(i[1]), low(i[2]))) if own else None
        chosen = min(cover, key=lambda i: (i[1], i[2])) if cover else last
        out.append((g, t, x, chosen[3] if chosen else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_as_of_equals_brute_force(spark, seed, width):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["b", "c", "only points"]
    points = [(rng.choice(keys), rng.randrange(-50, 400), str(i)) for i in range(150)] + [(None, 5, "x"), ("hot", None, "y"), ("hot", 7, "z"), ("hot", 7, "z")]
    intervals = []
    for i in range(60):
        a = rng.randrange(0, 300)
        intervals.append((rng.choice(["hot", "hot", "b", "c", "only intervals"]), a, a + rng.choice([0, 1, 5, 40, 150]), f"s{a}"))
    # Equal (start, end) carry equal values, so ties don't matter.
    intervals += [(None, 0, 500, "nobody"), ("c", None, 9, "open"), ("b", 350, None, "endless")]
    got = asof.state_as_of(
        spark.createDataFrame(points, POINTS), spark.createDataFrame(intervals, INTERVALS), "g", "t", "a", "b", "v", asof.numbers(width), "found"
    )
    assert sorted(map(tuple, got.collect()), key=repr) == brute(points, intervals)
    assert got.columns == ["g", "t", "state", "found"]


def test_points_meet_no_interval_by_a_join(spark):
    """Both sides large for one key: rows through every join are points, intervals or buckets."""
    points = spark.range(20_000).select(F.lit("hot").alias("g"), F.col("id").cast("int").alias("t"), F.lit("").alias("state"))
    intervals = spark.range(20_000).select(F.lit("hot").alias("g"), F.col("id").cast("int").alias("a"), (F.col("id") + 30).cast("int").alias("b"), F.col("id").cast("string").alias("v"))
    got = asof.state_as_of(points, intervals, "g", "t", "a", "b", "v", asof.numbers(100), "found")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (g" not in plan and "Cross" not in plan
    assert got.where(F.col("found") != F.greatest(F.lit(0), F.col("t") - 30).cast("string")).count() == 0 and got.count() == 20_000
    assert asof.state_as_of(points.limit(0), intervals, "g", "t", "a", "b", "v", asof.numbers(100), "found").count() == 0
    assert asof.state_as_of(points.limit(3), intervals.limit(0), "g", "t", "a", "b", "v", asof.numbers(100), "found").where("found IS NULL").count() == 3


def test_timestamps_in_buckets(spark):
    moments = spark.sql("SELECT 'x' AS g, timestamp'2024-01-05 00:00:00' AS t UNION ALL SELECT 'x', timestamp'2024-03-05 12:00:00' UNION ALL SELECT 'x', timestamp'2024-09-01 00:00:00'")
    spans = spark.sql("SELECT 'x' AS g, timestamp'2024-01-01' AS valid_from, timestamp'2024-01-05' AS valid_to, 'A' AS health_state UNION ALL SELECT 'x', timestamp'2024-03-01', timestamp'2024-06-01', 'B'")
    got = {str(r["t"])[:10]: r["health_state"] for r in whatif.health_at(moments, spans, "g", "t").collect()}
    assert got == {"2024-01-05": "A", "2024-03-05": "B", "2024-09-01": "B"}


# ------------------------------------------------------------------------------------------------------------- roles
def roles_of(spark, n, edges):
    keys = spark.createDataFrame([(f"k{i:03d}",) for i in range(n)], "cohort_key string")
    table = spark.createDataFrame([(f"k{a:03d}", f"k{b:03d}") for a, b in edges], "cohort_key string, to_key string")
    found, rounds = detect.settle_roles(keys, table)
    return {int(r["cohort_key"][1:]): r["alert_role"] for r in found.collect()}, rounds


def walked(n, edges):
    role = {}
    for i in range(n):
        role[i] = "DERIVATIVE" if any(a == i and role[b] == "PRIMARY" for a, b in edges) else "PRIMARY"
    return role


def test_a_chain_takes_logarithmic_rounds(spark):
    edges = [(i, i - 1) for i in range(1, 64)]
    got, rounds = roles_of(spark, 64, edges)
    assert got == walked(64, edges) and rounds <= 7


@pytest.mark.parametrize("seed", range(2))
def test_roles_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(i, rng.randrange(i)) for i in range(1, 30) for _ in range(rng.choice([0, 1, 1, 2, 4]))})
    got, _ = roles_of(spark, 30, edges)
    assert got == walked(30, edges)


def test_no_edges_take_no_round(spark):
    assert roles_of(spark, 2, []) == ({0: "PRIMARY", 1: "PRIMARY"}, 0)
    assert roles_of(spark, 2, [(1, 0)]) == ({0: "PRIMARY", 1: "DERIVATIVE"}, 1)


# ----------------------------------------------------------------------------------------------------------- latency
def test_latency_before_and_after_equals_pairing_every_row(spark):
    import hashlib

    rng = random.Random(3)
    rows = [(1, f"T{i}", 10.0, "SUCCESS", "SUCCESS", 0.3, False, float(rng.choice([5, 80, 120, 121, 900, rng.randrange(2000)]))) for i in range(400)]
    cohort = spark.createDataFrame(
        rows, "incident_id int, txn_id string, amount double, observed_status string, current_status string, p_current double, degraded_elsewhere boolean, latency_ms double"
    ).withColumn("amount", F.col("amount").cast("decimal(12,2)"))
    options = spark.createDataFrame(
        [(1, "NO_ACTION", 0.0, None), (1, "A:10", 10.0, 1.7), (1, "A:30", 30.0, 1.7), (1, "B:30", 30.0, 0.4)], "incident_id int, candidate_key string, traffic_percentage double, latency_factor double"
    )
    got = {r["candidate_key"]: r for r in whatif.latency_impact(whatif.tier_groups(cohort), options).collect()}
    order = sorted(rows, key=lambda r: hashlib.sha256(f"{whatif.SELECTION_DOMAIN}|{r[1]}|1".encode()).hexdigest())
    at = lambda values, f: sorted(values)[int(f * (len(values) - 1))]
    own = [r[7] for r in rows]
    for key, pct, factor in (("NO_ACTION", 0, 1.0), ("A:10", 10, 1.7), ("A:30", 30, 1.7), ("B:30", 30, 0.4)):
        n = len(rows) * pct // 100
        after = [float(math.floor(r[7] * factor)) for r in order[:n]] + [r[7] for r in order[n:]]
        r = got[key]
        assert (r["baseline_latency_p50"], r["baseline_latency_p95"]) == (at(own, 0.5), at(own, 0.95))
        assert (r["projected_latency_p50"], r["projected_latency_p95"]) == (at(after, 0.5), at(after, 0.95)), key
        assert r["latency_delta_ms"] == at(after, 0.95) - at(own, 0.95)
