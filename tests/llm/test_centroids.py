import hashlib
import math
import random

import numpy as np
from pyspark.sql import types as T

from cohortlens.llm.centroids import FAR, Tables, cluster

ROWS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("cluster", T.StringType()),
        T.StructField("v", T.LongType()),
    ]
)


def brute(rows, dims=64, n=16, rounds=3):
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            kept.append((vec_id, tuple(max(-FAR, min(FAR, math.floor(64.0 * float(np.float32(x))))) for x in e)))
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in start[:n]]
    if not centres:
        return []
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(centres)), key=lambda k: (far(v, centres[k]), k))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v), []).append(v)
        centres = [tuple(sum(x) // len(groups[k]) for x in zip(*groups[k])) if k in groups else c for k, c in enumerate(centres)]
    done = [(i, near(v), far(v, centres[near(v)])) for i, v in kept]
    own = {}
    for _, k, d in done:
        own[k] = own.get(k, 0) + d
    name = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return sorted(((i, k, d, own[k], sum(own.values()), name(centres[k])) for i, k, d in done), key=repr)


def found(spark, rows, parts=3, **how):
    return sorted((tuple(r) for r in cluster(spark.createDataFrame(rows, ROWS).repartition(parts), **how).collect()), key=repr)


def vectors(n, dims=64, seed=1, spread=0.3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(dims)], None, 5) for i in range(n)]


def test_equals_brute_force_with_odd_rows(spark):
    rows = vectors(120) + [(200 + i, [0.25] * 64, "x", None) for i in range(60)]
    rows += [
        (1, None, None, None),
        (2, [0.1] * 63, None, None),
        (3, [0.1] * 65, None, None),
        (4, [0.1] * 63 + [None], None, None),
        (5, [float("nan")] + [0.1] * 63, None, None),
        (6, [float("-inf")] + [0.1] * 63, None, None),
        (7, [], None, None),
        (None, [0.5] * 64, None, None),
        (8, [0.5] * 64, None, None),
        (8, [0.5] * 64, None, None),
        (8, [-0.5] * 64, None, None),
    ]
    wanted = brute([r[:2] for r in rows])
    assert len(wanted) == 184
    assert found(spark, rows) == wanted
    assert found(spark, rows, parts=1) == wanted


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 3)] * 2, None, None) for i in range(12)]
    assert found(spark, rows, dims=2, n_centroids=5) == brute([r[:2] for r in rows], dims=2, n=5)


def test_wide_values_few_vectors_and_none(spark):
    rows = [(i, [float(i * 7919 % 1009) * 900, -(2.0**i)], None, None) for i in range(30)]
    assert found(spark, rows, dims=2, n_centroids=4) == brute([r[:2] for r in rows], dims=2, n=4)
    huge = [(1, [3e38] * 64, None, None), (2, [-3e38] * 64, None, None)]
    assert [r[2] for r in found(spark, huge)] == [0, 0]
    assert found(spark, []) == []
    assert found(spark, [(None, [1.0] * 64, None, None)]) == []


def test_tables_hold_only_values_of_the_block():
    centres = np.array([[0, 5], [10, -5]])
    block = np.array([[3, 100_000_0], [7, -9]])
    assert Tables(centres).distances(block).tolist() == ((block[:, None] - centres) ** 2).sum(axis=2).tolist()
    assert Tables(centres).table(0, np.array([3, 7])).tolist() == [[9, 49], [49, 9]]
