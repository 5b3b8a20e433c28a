import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from cohortlens.llm import quality_trees
from cohortlens.llm.queries import op13_quality_classifier
from cohortlens.llm.quality_trees import N, STATISTICS, Settings, classify, document_statistics, fit, learn, statistics

LABELS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType()), T.StructField("text", T.StringType())]
)


def walk(trees, row):
    """One document, one tree after another."""
    total = trees.base
    for s, t, leaf in zip(trees.statistic, trees.threshold, trees.leaf):
        node = 0
        while node < len(s):
            node = 2 * node + 1 + bool(row[s[node]] > t[node])
        total += leaf[node - len(s)]
    return 1 / (1 + math.exp(-total))


def corpus(n, seed=1):
    """Every fourth text shouts."""
    rng = random.Random(seed)
    words = ["lamp", "river", "of", "the", "stone", "winter", "and", "a", "quiet", "house"]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 80))) + "."
        bad = i % 4 == 0
        docs.append((i, text.upper().replace(" ", "!! ") if bad else text.capitalize()))
        labels.append((i, int(not bad), None, "x"))
    return docs, labels


def test_flat_arrays_equal_a_walk_through_each_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, N)).astype(np.float32)
    x[:, 3] = np.round(x[:, 3])
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    trees = fit(x, y, Settings(trees=20))
    assert np.allclose(trees.scores(x[:100]), [walk(trees, r) for r in x[:100]], atol=1e-12)
    assert ((trees.scores(x) >= 0.5) == y).mean() > 0.97


def first_split(x, y, how):
    """Best first split by trying every threshold on every statistic."""
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = (0, None)
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= t
            if h[left].sum() < how.least_weight or h[~left].sum() < how.least_weight:
                continue
            part = lambda m: g[m].sum() ** 2 / (h[m].sum() + how.ridge)
            gain = part(left) + part(~left) - part(left | True)
            if gain > best[0] + 1e-9:
                best = (gain, (j, float(t)))
    return best[1]


def test_histogram_finds_the_best_split():
    rng = np.random.default_rng(2)
    for _ in range(10):
        x = rng.integers(0, 12, (200, N)).astype(np.float32)
        y = (x[:, rng.integers(N)] + rng.normal(0, 2, 200) > 6).astype(float)
        how = Settings(trees=1)
        trees = fit(x, y, how)
        assert (trees.statistic[0, 0], float(trees.threshold[0, 0])) == first_split(x, y, how)


def test_one_class_few_rows_and_none():
    x = np.zeros((3, N), np.float32)
    assert (fit(x, np.ones(3)).scores(x) > 0.5).all() and (fit(x, np.zeros(3)).scores(x) < 0.5).all()
    assert fit(x[:0], np.ones(0)).scores(x).tolist() == [0.5] * 3


def test_statistics_of_odd_texts():
    for text in ("", " \n\t", "x", "\n\nx", "\x00", "é", "a " * 5, "word\n" * 3, "!!", "😀 " * 3, "a" * 1_000_000, "the end. " * 200_000):
        found = statistics(text.encode())
        assert len(found) == len(STATISTICS) == N and np.isfinite(found).all(), text[:9]
    assert statistics(b"") == [0.0] * N
    shout = dict(zip(STATISTICS, statistics("GO!! NOW!!\nGO!! NOW!!\n".encode())))
    assert shout["words_all_upper"] == 1 and shout["words_shout_end"] == 1 and shout["lines_repeated"] == 0.5


def test_learns_whatever_the_partitions_and_scores_every_row(spark, make, odd):
    docs, labels = corpus(240)
    docs += odd + [(3, docs[3][1])]
    frame = spark.createDataFrame(labels + [(None, 1, 0, None), (2, None, 0, None), (1, 7, 0, None), (999, 0, 0, None)], LABELS)
    rows = {p: sorted(map(tuple, classify(make(docs, p), frame.repartition(p)).collect()), key=repr) for p in (1, 5)}
    assert rows[1] == rows[5]
    assert len(rows[1]) == len(docs)
    truth = {i: q for i, q, *_ in labels}
    for doc_id, held_out, score, predicted in rows[1]:
        assert held_out == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1)
        assert 0 <= score <= 1 and predicted == int(score >= 0.5)
        if held_out and doc_id in truth and doc_id not in (7, 8, 9, 10, 11):
            assert predicted == truth[doc_id]


def test_held_out_labels_are_not_learned(spark, make):
    docs, labels = corpus(120)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t, x) for i, q, t, x in labels]
    one, two = (sorted(map(tuple, classify(make(docs), spark.createDataFrame(x, LABELS)).collect())) for x in (labels, turned))
    assert one == two


def test_empty_tables(spark, make):
    nothing = spark.createDataFrame([], LABELS)
    assert classify(make([]), nothing).count() == 0
    assert [r["score"] for r in classify(make([(1, "a b")]), nothing).collect()] == [0.5]


def test_bound_on_learned_rows(spark, make):
    docs, labels = corpus(300)
    found, frame = document_statistics(make(docs)), spark.createDataFrame(labels, LABELS)
    trees = learn(found, frame, Settings(most_rows=50))
    again = learn(found.repartition(7), frame, Settings(most_rows=50))
    assert trees.base == again.base and (trees.leaf == again.leaf).all()
    # About 50 rows: base is the log odds of their labels.
    odds = {math.log((p + 1) / (n - p + 1)) for n in range(25, 90) for p in range(n + 1)}
    assert any(math.isclose(trees.base, o) for o in odds)


@pytest.mark.parametrize("sf", ["0.01"])
def test_held_out_accuracy(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    done = op13_quality_classifier(spark, folder)
    assert done.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = done.join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    right = sum(r["quality"] == r["predicted"] for r in held) / len(held)
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    area = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert right >= 0.97 and area >= 0.99
    assert quality_trees.N == len(done.sparkSession.createDataFrame([(1, "a")], "doc_id long, text string").transform(document_statistics).first()["x"])
    assert done.where(F.col("score").isNull()).count() == 0
