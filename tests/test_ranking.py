"""Distributed ranks, lags and samples against brute force, with every scale path forced."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import fingerprint, ranking


def test_global_rank_with_ties_of_the_leading_key(spark):
    random.seed(1)
    values = [(i, random.choice([0.0, 1.5, 1.5, 1.5, 2.0, random.random()])) for i in range(500)]
    df = spark.createDataFrame(values, "id int, score double").repartition(7)
    got = ranking.global_rank(df, [F.desc("score"), F.asc("id")])
    want = {i: r for r, (i, _) in enumerate(sorted(values, key=lambda x: (-x[1], x[0])), start=1)}
    assert {r["id"]: r["rank"] for r in got.collect()} == want
    assert ranking.global_rank(df.where("id < 0"), [F.asc("id")]).count() == 0


def test_percentiles_equal_the_buffered_ones_with_nan_and_infinity(spark):
    odd = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e-320, -1e300, 1e300]
    random.seed(5)
    groups = {
        "nan": [1.0, 3.0, 5.0, 7.0, 2.0, 9.0, 4.0, 8.0, 6.0] + [float("nan")] * 4,
        "inf": odd + [random.uniform(-50, 50) for _ in range(60)],
        "dense": [random.uniform(100, 101) for _ in range(400)],
        "one": [3.5],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    fractions = {"p50": 0.5, "p84": 0.84, "p95": 0.95}
    counts = df.groupBy("k", "v").agg(F.count("*").alias("w"))
    got = {r["k"]: r for r in ranking.exact_percentiles(counts, ["k"], "v", "w", fractions).collect()}
    want = {r["k"]: r for r in df.groupBy("k").agg(*[F.percentile("v", f).alias(n) for n, f in fractions.items()]).collect()}
    for k in groups:
        for n in fractions:
            assert got[k][n] == pytest.approx(want[k][n], rel=1e-12, nan_ok=True), (k, n)


def test_running_total_over_blocks(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(1, 101)], "pos int, v int")
    got = {r["pos"]: r["t"] for r in ranking.running_total(df, "pos", "v", "t", block=7).collect()}
    total = 0
    for i in range(1, 101):
        total += i % 3
        assert got[i] == total


def test_lag_across_buckets(spark):
    random.seed(2)
    rows = [(k, t, f"s{random.randint(0, 9)}") for k in ("hot", "cold") for t in sorted(random.sample(range(1000), 300 if k == "hot" else 5))]
    df = spark.createDataFrame(rows, "k string, t int, s string")
    got = ranking.bucketed_lag(df, "k", ["t"], "s", F.floor(F.col("t") / 10), "prev").collect()
    for key in ("hot", "cold"):
        mine = sorted(r for r in rows if r[0] == key)
        want = {t: (mine[i - 1][2] if i else None) for i, (_, t, _) in enumerate(mine)}
        assert {r["t"]: r["prev"] for r in got if r["k"] == key} == want


@pytest.mark.parametrize("n", [3, 264, 1000])
def test_sample_cutoffs(spark, n):
    ids = [f"T{i}" for i in range(n)]
    digest = {i: hashlib.sha256(i.encode()).hexdigest() for i in ids}
    df = spark.createDataFrame([(1, i, digest[i]) for i in ids], "g int, id string, d string")
    cuts = {r["percent"]: r for r in ranking.sample_cutoffs(df, ["g"], "d", "id", (10.0, 20.0, 30.0)).collect()}
    order = sorted(ids, key=lambda i: (digest[i], i))
    previous = set()
    for percent in (10.0, 20.0, 30.0):
        take = int(n * percent / 100)
        if take == 0:
            assert percent not in cuts
            continue
        assert cuts[percent]["take"] == take
        chosen = {i for i in ids if (digest[i], i) <= (cuts[percent]["cut_digest"], cuts[percent]["cut_id"])}
        assert chosen == set(order[:take]) and previous <= chosen
        previous = chosen
    if n == 264:
        assert cuts[30.0]["take"] == 79


def test_nearest_rank_low(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)] + [("b", float(i)) for i in range(1, 12)], "k string, v double")
    got = {r["k"]: (r["p95"], r["p0"]) for r in ranking.nearest_rank_low(df, ["k"], "v", {"p95": 0.95, "p0": 0.0}).collect()}
    assert got == {"a": (1.0, 1.0), "b": (10.0, 1.0)}


def test_claims_and_latest(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "c"), ("k", 1, "a"), ("m", 5, "z"), (None, 1, "n"), (None, 2, "o")], "key string, at int, id string")
    got = {r["id"]: r["claim"] for r in ranking.claim_winners(df, "key", "at", "id").collect()}
    assert got == {"a": "CLAIMED", "b": "DUPLICATE_EXECUTION", "c": "DUPLICATE_EXECUTION", "z": "CLAIMED", "n": "CLAIMED", "o": "CLAIMED"}
    last = {r["key"]: r["id"] for r in ranking.latest_per_key(df.where("key IS NOT NULL"), ["key"], ["at", "id"]).collect()}
    assert last == {"k": "b", "m": "z"}


def test_fingerprint_ignores_order_and_sees_content(spark):
    rows = [(i % 50, f"v{i % 7}") for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b string")
    base = fingerprint.content_fingerprint(df).first()
    shuffled = spark.createDataFrame(list(reversed(rows)), "a int, b string").repartition(5, "b")
    assert fingerprint.content_fingerprint(shuffled).first() == base and base["rows"] == 2000
    assert fingerprint.content_fingerprint(spark.createDataFrame(rows[:-1] + [(1, "x")], "a int, b string")).first()["fingerprint"] != base["fingerprint"]
    assert fingerprint.content_fingerprint(spark.createDataFrame(rows[:-1], "a int, b string")).first()["fingerprint"] != base["fingerprint"]


def test_fingerprint_counts_repeats_and_takes_empty_tables(spark):
    of = lambda rows: fingerprint.content_fingerprint(spark.createDataFrame(rows, "a int, b string"), None).first()
    once, twice, other = of([(1, "x")]), of([(1, "x")] * 2), of([(1, None)])
    assert len({r["fingerprint"] for r in (once, twice, other, of([]))}) == 4
    assert of([])["rows"] == 0 and twice["rows"] == 2


def test_input_fingerprint_is_a_digest_tree_over_every_row(spark):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def tree(lines):
        nodes = {}
        for d in map(sha, lines):
            nodes[d] = nodes.get(d, 0) + 1
        nodes = [(d, str(n)) for d, n in nodes.items()]
        for digits in (6, 3, 0):
            groups = {}
            for key, rest in nodes:
                groups.setdefault(key[:digits], []).append(f"{key}:{rest}")
            nodes = [(k, sha("\n".join(sorted(v)))) for k, v in groups.items()]
        return nodes[0][1] if nodes else sha("")

    rows = [(i % 50, f"v{i % 7}") for i in range(400)] + [(1, "v1")] * 3
    some, none = spark.createDataFrame(rows, "a int, b string"), spark.createDataFrame([], "a int")
    got = fingerprint.input_fingerprint({"some": some.repartition(3), "none": none}, {"seed": "s"}).first()["input_fingerprint"]
    assert got == sha(f"none={tree([])}|some={tree([f'{a}|{b}' for a, b in rows])}|seed=s")
