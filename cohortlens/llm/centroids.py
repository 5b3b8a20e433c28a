"""Centroid clustering by scalar lookup tables: integer components, exact rounds, distances summed from table entries.

A vector is kept if it has exactly `DIMS` components, none null, NaN or infinite. Component x becomes the integer floor(64 * x). Each
round sends the centroids (`CENTROIDS` times `DIMS` integers, whatever the input) to the tasks. A task takes its vectors in blocks and
tabulates, for each dimension, the squared difference between every integer value that occurs there and every centroid; a distance
is the sum of one table entry a dimension, gathered and added by numpy. Tables hold values of one block, so their size is bounded by `BLOCK`
and not by the spread of the values. Tasks send sums and counts of each centroid, a few kilobytes, and the next centroids are their
exact floors.

Defined results: null, short, long and non-finite vectors are left out. Repeated rows are vectors of their own. Rows without an id are
clustered but never start a centroid. With fewer than `CENTROIDS` different starts there are fewer centroids, and without a kept
vector that has an id there is no row. Vectors that share an id start one centroid each, the smaller vector first. Equal distances go to the smaller
centroid number. Values beyond 2^26 in size, for which a squared distance could leave 64 bits, are taken as 2^26; an inertia beyond 64 bits is null.
Columns other than the id and the vector are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_rows, stage

DIMS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
#: Rows whose occurring values are tabulated together.
BLOCK = 4096
#: Bound of an integer component.
FAR = 1 << 26


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS) -> DataFrame:
    """(vec_id long, v array<int>): the kept vectors with integer components."""
    v = vectors[vector_col]
    fit = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    whole = lambda x: F.floor(F.greatest(F.lit(-float(FAR)), F.least(F.lit(float(FAR)), SCALE * x.cast("double")))).cast("int")
    # The list is looked at only where it has the right length, so no task meets a vector of another size.
    return (
        vectors.where((F.size(v) == dims) & F.forall(v, fit))
        .select(vectors[id_col].cast("long").alias("vec_id"), F.transform(v, whole).alias("v"))
    )


def first_centroids(kept: DataFrame, n: int = CENTROIDS) -> np.ndarray:
    """The kept vectors with the smallest digests of `1:<vec_id>`, in ascending order of the digests."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = kept.where("vec_id IS NOT NULL").orderBy(order, "v").limit(n).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


class Tables:
    """Squared differences of one block of vectors to all centroids, a table for each dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids

    def table(self, d: int, values: np.ndarray) -> np.ndarray:
        return (values[:, None] - self.centroids[None, :, d]) ** 2

    def distances(self, block: np.ndarray) -> np.ndarray:
        """Squared distance of each row to each centroid."""
        total = np.zeros((len(block), len(self.centroids)), np.int64)
        for d in range(block.shape[1]):
            column = np.ascontiguousarray(block[:, d])
            low, high = int(column.min()), int(column.max())
            if high - low < 2 * len(block):
                # All integers in between are tabulated, which spares sorting the block's values.
                values, at = np.arange(low, high + 1), column - low
            else:
                values, at = np.unique(column, return_inverse=True)
            total += self.table(d, values)[at]
        return total


def _blocks(batches, dims: int):
    """(ids, integer vectors) of consecutive rows, up to BLOCK at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
            yield part.column("vec_id"), flat.reshape(part.num_rows, dims).astype(np.int64)


def move(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: assign all vectors, then put each centroid that has some at the exact floor of their mean."""
    dims = centroids.shape[1]
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def add(batches):
        tables = Tables(shared.value)
        n = len(tables.centroids)
        sums, counts = np.zeros((n, dims), np.int64), np.zeros(n, np.int64)
        for _, block in _blocks(batches, dims):
            nearest = tables.distances(block).argmin(axis=1)
            counts += np.bincount(nearest, minlength=n)
            # Sums of each cluster: rows in cluster order, added run by run.
            order = np.argsort(nearest, kind="stable")
            runs, starts = np.unique(nearest[order], return_index=True)
            sums[runs] += np.add.reduceat(block[order], starts, axis=0)
        at = np.flatnonzero(counts)
        # The count travels as one more component.
        full = np.concatenate([sums[at], counts[at, None]], axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(at, dims + 1), pa.int64()), pa.array(np.tile(np.arange(dims + 1), len(at)), pa.int64()), pa.array(full.reshape(-1), pa.int64())],
            ["cluster", "d", "part"],
        )

    parts = map_rows(kept.select("vec_id", "v"), add, "cluster long, d long, part long")
    totals = parts.groupBy("cluster", "d").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    of = {(r["cluster"], r["d"]): int(r["total"]) for r in totals}
    shared.unpersist()
    moved = centroids.copy()
    for c in {c for c, _ in of}:
        moved[c] = [of[c, d] // of[c, dims] for d in range(dims)]
    return moved


def assign(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster int, distance long) of every kept vector."""
    dims = centroids.shape[1]
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        tables = Tables(shared.value)
        for ids, block in _blocks(batches, dims):
            found = tables.distances(block)
            nearest = found.argmin(axis=1)
            least = found[np.arange(len(found)), nearest]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(nearest, pa.int32()), pa.array(least, pa.int64())], ["vec_id", "cluster", "distance"]
            )

    return map_rows(kept.select("vec_id", "v"), run, "vec_id long, cluster int, distance long")


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = DIMS,
    n_centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): each kept vector's nearest final centroid.

    The integer vectors are written once, so a round reads small integers and a lost executor costs a re-read.
    """
    spark = vectors.sparkSession
    kept = stage(integer_vectors(vectors, id_col, vector_col, dims), "integer-vectors")
    centroids = first_centroids(kept, n_centroids)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = move(kept, centroids)
    done = stage(assign(kept, centroids), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    # One row a cluster, so at most n_centroids entries, written into the plan as constants.
    own = F.create_map(*[F.lit(x) for c, s in sorted(sums.items()) for x in (c, fits(s))]) if sums else None
    names = F.create_map(*[F.lit(x) for c in sorted(sums) for x in (c, digest(centroids[c].tolist()))]) if sums else None
    return done.select(
        "vec_id",
        "cluster",
        "distance",
        own[F.col("cluster")].cast("long").alias("cluster_inertia"),
        F.lit(fits(sum(sums.values()))).cast("long").alias("inertia"),
        names[F.col("cluster")].alias("centroid_sha256"),
    )
