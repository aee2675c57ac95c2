"""Exact k-means on integers with Hamerly's bounds.

Vectors are scaled to integers, so distances, sums and centroids are exact and
reruns agree. A vector's row carries its cluster, an upper bound of the
distance to its own centroid and a lower bound of that to its second nearest.
When centroids move, the upper bound grows by its own centroid's drift and the
lower one shrinks by the largest drift of the others; while they don't meet,
the vector stays where it is without a look at any centroid. Where they meet,
the own distance is computed, and where they still do, all distances.
(Hamerly: Making k-means even faster, 2010.)
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spanmill.llm.common import discard, durable, small_batches

#: Larger components have squared distances beyond 64 bits.
MOST = 1 << 27
#: Vectors whose distances to all centroids are in memory at once.
SCAN_ROWS = 2048
#: Bounds are doubles; they are loosened by this share for what rounding may have lost.
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12


def usable(vector_col: str, size: int) -> Column:
    """Vectors of ``size`` components, none of them null, NaN or infinite."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == size) & finite, F.lit(False))


def drifts(before: list[list[int]], after: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid moved, and the farthest that any other one did."""
    own = np.array([math.dist(a, b) for a, b in zip(before, after, strict=True)]) * _UP
    others = np.array([max((d for j, d in enumerate(own) if j != k), default=0.0) for k in range(len(own))])
    return own, others


def half_gaps(centroids: list[list[int]]) -> np.ndarray:
    """Half the distance of each centroid to the nearest other one: whatever is closer than that is nearest to it."""
    return np.array([min((math.dist(c, d) for j, d in enumerate(centroids) if j != k), default=math.inf) for k, c in enumerate(centroids)]) * _DOWN / 2


def reassign(x, cluster, upper, lower, at, own, others, half):
    """Clusters and bounds of integer vectors ``x`` among centroids ``at`` after drifts ``own`` and ``others``; a new vector has cluster -1."""
    new = cluster < 0
    home = np.where(new, 0, cluster)
    upper = np.where(new, np.inf, (upper + own[home]) * _UP)
    lower = np.where(new, -np.inf, (lower - others[home]) * _DOWN)
    lower = np.where(lower < 0, 0.0, lower)
    safe = np.maximum(lower, half[home])
    doubtful = np.flatnonzero(new | (upper >= safe))
    known = doubtful[~new[doubtful]]
    gap = x[known] - at[home[known]]
    upper[known] = np.sqrt((gap * gap).sum(axis=1)) * _UP
    doubtful = doubtful[new[doubtful] | (upper[doubtful] >= safe[doubtful])]
    cluster = home.copy()
    for lo in range(0, len(doubtful), SCAN_ROWS):
        rows = doubtful[lo : lo + SCAN_ROWS]
        gap = x[rows][:, None] - at[None]
        square = (gap * gap).sum(axis=2)
        cluster[rows] = square.argmin(axis=1)  # the first of equal ones
        nearest = np.sort(square, axis=1)
        upper[rows] = np.sqrt(nearest[:, 0]) * _UP
        lower[rows] = np.sqrt(nearest[:, 1]) * _DOWN if len(at) > 1 else np.inf
    return cluster, upper, lower


_STATE = "v array<int>, cluster int, upper double, lower double, distance long, moved array<long>, members long"


def assign(table: DataFrame, centroids: list[list[int]], before: list[list[int]] | None, last: bool) -> DataFrame:
    """One pass over the vectors: their new state, and for each task and cluster what moved in and out.

    Rows of either kind share a table: a vector has ``v``, a task's sums have
    ``moved`` and ``members``. Only the last pass computes every distance.
    """
    kind = table.schema["id"].dataType.simpleString()
    k, size = len(centroids), len(centroids[0])
    own, others = drifts(before, centroids) if before else (np.zeros(k), np.zeros(k))
    half = half_gaps(centroids)
    at = np.array(centroids, np.int64)

    def scan(batches):
        moved, members = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        names = ["id", *(c.split()[0] for c in _STATE.split(", "))]
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            vectors = batch.column(1)
            x = np.asarray(vectors.flatten()).reshape(-1, size).astype(np.int64)
            was = np.asarray(batch.column(2))
            cluster, upper, lower = reassign(x, was, np.asarray(batch.column(3)), np.asarray(batch.column(4)), at, own, others, half)
            changed = np.flatnonzero(cluster != was)
            np.add.at(moved, cluster[changed], x[changed])
            np.add.at(members, cluster[changed], 1)
            left = changed[was[changed] >= 0]
            np.subtract.at(moved, was[left], x[left])
            np.subtract.at(members, was[left], 1)
            none = pa.nulls(len(x), pa.int64())
            distance = none
            if last:
                gap = x - at[cluster]
                distance = pa.array((gap * gap).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), vectors, pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), distance, pa.nulls(len(x), pa.list_(pa.int64())), none], names
            )
        some = np.flatnonzero(members.astype(bool) | moved.any(axis=1))
        if len(some):
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(n, id_type), pa.nulls(n, pa.list_(pa.int32())), pa.array(some.astype(np.int32)), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64()),
                    pa.array(moved[some].tolist(), pa.list_(pa.int64())), pa.array(members[some]),
                ],
                names,
            )

    return table.select("id", "v", "cluster", "upper", "lower").mapInArrow(scan, f"id {kind}, {_STATE}")


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3"
) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid)`` for each vector that is kept.

    Kept are vectors of ``size`` components, none null, NaN or infinite; a
    component x counts as floor(scale * x). The first centroids are the ``k``
    kept vectors of smallest hex SHA-256 of ``seed:id``, in that order. In each
    of ``rounds`` every vector goes to the nearest centroid, of equally near
    ones to that of smaller number, and a centroid that has vectors becomes the floor of
    their mean, exactly; then vectors go to the nearest once more. ``distance``
    is squared, the inertias sum it over the cluster and over all.

    Rows that share an id are vectors of their own, and of equal hashes the
    smaller vector comes first; rows with a null id come last among starting
    centroids; with fewer than ``k`` vectors there are fewer centroids; an empty
    table gives an empty result; other columns aren't read. Components beyond
    ``MOST`` once scaled are refused with an error, as distances wouldn't fit a
    long; an inertia that doesn't fit is null.

    A round is one pass without a shuffle: it writes each vector's state and
    each task's sums, at most ``k`` rows a task, to a new table. Only sums are
    added up; the driver holds ``k`` centroids and sums. Once nothing moves, the
    remaining rounds would change nothing and are left out.
    """
    usable_rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x")).where(usable("x", size))
    scaled = usable_rows.select("id", F.transform("x", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    seen = Observation()
    scaled = scaled.withColumn("large", F.exists("v", lambda x: ~x.between(-MOST, MOST))).observe(seen, F.count_if("large").alias("large"))
    kept = scaled.select("id", F.transform("v", lambda x: F.when(x.between(-MOST, MOST), x).cast("int")).alias("v"), F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    table = durable(kept.transform(small_batches), "vectors")
    if seen.get["large"]:
        raise ValueError(f"{seen.get['large']} vectors have components beyond {MOST} once scaled by {scale}")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    centroids = [list(r.v) for r in table.select(name.alias("name"), "v").orderBy(F.col("name").asc_nulls_last(), "v").limit(k).collect()]
    found = f"id {table.schema['id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<int>"
    if not centroids:
        discard(table)
        return table.sparkSession.createDataFrame([], found)
    sums, members = [[0] * size for _ in centroids], [0] * len(centroids)
    before, settled = None, False
    for turn in range(rounds + 1):
        last = turn == rounds or settled
        state = durable(assign(table, centroids, before, last), "clusters")
        discard(table)
        table = state.where("v is not null")
        table.durable_path = state.durable_path
        if last:
            break
        parts = state.where("members is not null").select("cluster", "members", F.posexplode("moved").alias("at", "moved"))
        exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        moves = parts.groupBy("cluster", "at").agg(exact("moved"), exact("members")).collect()  # k * size rows
        for r in moves:
            sums[r.cluster][r.at] += int(r.moved)
            if r.at == 0:
                members[r.cluster] += int(r.members)
        before = centroids
        centroids = [[s // n for s in own] if n else c for own, n, c in zip(sums, members, centroids, strict=True)]
        settled = centroids == before
    return _result(table, centroids, found)


def _result(table: DataFrame, centroids: list[list[int]], schema: str) -> DataFrame:
    per = {r.cluster: int(r.inertia) for r in table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    rows = [(c, fits(n), fits(sum(per.values())), centroids[c]) for c, n in sorted(per.items())]
    about = table.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<int>")
    return table.join(F.broadcast(about), "cluster").select(*(c.split()[0] for c in schema.split(", ")))
