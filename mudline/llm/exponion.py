"""Centroid clustering by exponion search (operator 11): Lloyd's rounds in whole numbers, exact to the last tie.

Every vector keeps its centroid, an upper bound of its distance to it and a lower
bound of its distance to all others.  A round goes:

1. Bounds follow the centroids: the upper one grows by its centroid's move, the
   lower one shrinks by the largest move of another.
2. A vector whose upper bound is *strictly* under its lower bound, or under half
   the way from its centroid to the next one, has a nearest centroid without a
   tie: nothing is measured.  Else the upper bound is made exact and asked again.
3. What is left scans a ball: with u the distance to its centroid a, and s(a)
   from a to the nearest other centroid, the nearest and the second nearest lie
   within 2u + s(a) of a.  Each centroid has its list of the others sorted by
   distance, so the ball is a prefix of a's list; its radius is *inclusive*, so a
   centroid that ties is always measured.  Decisions are on exact squared
   distances in 64-bit whole numbers, ties to the smaller number.

Bounds are doubles, widened by more than their rounding, so they only ever prune
what exact arithmetic would.  Rounds carry the rows with their bounds through
tables in the shared folder, so a lost executor repeats its own part of one round; a task
sums its vectors by centroid before anything is shuffled, and the driver holds
the centroids and their sums alone.  Rows are never joined, moved or told apart
by id.

Defined results: vectors that are null, of another length, or with null or
non-finite components take no part; a row with null id is clustered but seeds
nothing; rows that repeat an id or a vector each count, and of equal seeding
hashes the smaller vector comes first; fewer rows than ``k`` seed fewer
centroids; other columns are ignored, whatever their names; an empty table gives
an empty one.  Components of 2**19 and more are an error, as their distances
would not fit the result's type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mudline.llm.int_vectors import EPS, above, all_squared, below, integer_rows, matrix, means, squared
from mudline.llm.shared import discard, new_dir, written_at

STATE = "v array<int>, cluster int, upper double, lower double, measured long"


class Balls:
    """Centroids with their sorted lists of each other, and how far the last round moved them."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.c, self.k = centroids, len(centroids)
        apart = all_squared(centroids, centroids)
        np.fill_diagonal(apart, -1)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        sides = np.sqrt(np.take_along_axis(apart, self.order, axis=1).astype(np.float64))
        self.sides = sides
        self.near = sides[:, 0] if self.k > 1 else np.full(self.k, np.inf)
        move = above(squared(centroids, before)) if before is not None else np.zeros(self.k)
        self.move = move
        # the largest move of any other centroid
        top = np.argsort(-move)[:2]
        self.others = np.where(np.arange(self.k) == top[0], move[top[1]] if self.k > 1 else 0.0, move[top[0]]) if self.k else move

    def shifted(self, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grown, shrunk = self.move[cluster], self.others[cluster]
        with np.errstate(invalid="ignore"):
            low = np.where(np.isinf(lower), lower, lower - shrunk - EPS * (lower + shrunk))
        return (upper + grown) * (1 + EPS), low

    def everywhere(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster and bounds of vectors that have none yet."""
        d = all_squared(x, self.c)
        cluster = d.argmin(1)
        own = d[np.arange(len(x)), cluster]
        if self.k == 1:
            return cluster, above(own), np.full(len(x), np.inf)
        d[np.arange(len(x)), cluster] = np.iinfo(np.int64).max
        return cluster, above(own), below(d.min(1))

    def step(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """One round over vectors with shifted bounds, all changed in place; returns how many centroids each measured."""
        measured = np.zeros(len(x), np.int64)
        safe = np.maximum(lower, self.near[cluster] * ((1 - EPS) / 2))
        left = np.flatnonzero(~(upper < safe))
        if self.k == 1 or not left.size:
            return measured
        exact = squared(x[left], self.c[cluster[left]])
        measured[left] += 1
        upper[left] = above(exact)
        still = ~(upper[left] < safe[left])
        left, exact = left[still], exact[still]
        began = cluster[left]
        for a in np.unique(began):
            group = began == a
            self.scan(int(a), x, left[group], exact[group], cluster, upper, lower, measured)
        return measured

    def scan(self, a: int, x: np.ndarray, rows: np.ndarray, exact: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, measured: np.ndarray) -> None:
        """The ball around centroid ``a`` for its vectors ``rows``, widest balls first, so that each place of a's list is one block."""
        radius = (2 * upper[rows] + self.near[a]) * (1 + 4 * EPS)
        wide = np.searchsorted(self.sides[a], radius, side="right")
        first = np.argsort(-wide, kind="stable")
        rows, best, wide = rows[first], exact[first], wide[first]
        points, number, second = x[rows], np.full(len(rows), a), np.full(len(rows), np.iinfo(np.int64).max)
        for place in range(int(wide[0])):
            n = int(np.searchsorted(-wide, -place, side="left"))  # vectors whose ball holds this place
            j = int(self.order[a, place])
            d = squared(points[:n], self.c[j])
            wins = (d < best[:n]) | ((d == best[:n]) & (j < number[:n]))
            second[:n] = np.where(wins, best[:n], np.minimum(second[:n], d))
            best[:n] = np.where(wins, d, best[:n])
            number[:n] = np.where(wins, j, number[:n])
        cluster[rows], upper[rows], lower[rows] = number, above(best), below(second)
        measured[rows] += wide


def assigned(state: DataFrame, balls: Balls, first: bool) -> DataFrame:
    """One round's assignment; ``first``: rows carry no bounds yet."""
    row_type = state.schema["row"].dataType.simpleString()
    dim = balls.c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), dim)
            if first:
                cluster, upper, lower = balls.everywhere(x)
                measured = np.full(len(x), balls.k, np.int64)
            else:
                cluster, upper, lower, measured = (np.array(b.column(c)) for c in ("cluster", "upper", "lower", "measured"))
                upper, lower = balls.shifted(cluster, upper, lower)
                measured = measured + balls.step(x, cluster, upper, lower)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("v"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(measured)], ["row", "v", "cluster", "upper", "lower", "measured"])

    return state.mapInArrow(run, f"row {row_type}, {STATE}")


def summed(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and counts of the vectors of each cluster; a task sends a row a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x, cluster = matrix(b.column("v"), dim), np.array(b.column("cluster"))
            order = np.argsort(cluster, kind="stable")
            there, begin = np.unique(cluster[order], return_index=True)
            if len(there):
                total[there] += np.add.reduceat(x[order], begin, axis=0)
            count += np.bincount(cluster, minlength=k)
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(count[there]), pa.array(total[there].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = state.select("cluster", "v").mapInArrow(run, "cluster int, n long, total array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dim)]).alias("total")).collect()
    total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    for r in rows:
        total[r.cluster], count[r.cluster] = r.total, r.n
    return total, count


def hashed_seeds(vectors: DataFrame, id_name: str, k: int, seed: int) -> np.ndarray:
    """The vectors of the ``k`` smallest lowercase-hex sha256 of ``seed:id``, in ascending order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"row.`{id_name}`").cast("string")), 256)
    first = vectors.filter(F.col(f"row.`{id_name}`").isNotNull()).select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def lloyd(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """``rounds`` rounds and a last assignment of ``vectors`` (``row``, ``v``): the rows with their bounds, and the final centroids."""
    spark, before, state, old = vectors.sparkSession, None, vectors, None
    for n in range(rounds + 1):
        path = new_dir(spark, "exponion")
        state = written_at(assigned(state, Balls(centroids, before), n == 0), path)
        if old:
            discard(spark, old)
        old = path
        if n < rounds:
            before = centroids
            centroids = means(*summed(state, *centroids.shape), before)
    return state, centroids


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2, keep: tuple[str, ...] = ()) -> tuple[DataFrame, np.ndarray]:
    """``rows`` clustered: ``row`` (``id_col`` and the columns ``keep``), ``cluster``, ``distance`` (squared) and ``measured``, and the final centroids."""
    vectors = integer_rows(rows, list(dict.fromkeys([id_col, *keep])), vector_col, dim)
    centroids = hashed_seeds(vectors, id_col, k, seed)
    if not len(centroids):
        return vectors.limit(0).select("row", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("measured")), np.zeros((0, dim), np.int64)
    state, centroids = lloyd(vectors, centroids, rounds)
    return state.select("row", "cluster", own_distance(centroids).alias("distance"), "measured"), centroids


def own_distance(centroids: np.ndarray) -> Column:
    """The exact squared distance of ``v`` to the centroid of its ``cluster``."""
    own = F.element_at(F.lit(centroids.tolist()), F.col("cluster") + 1)
    gap = F.zip_with("v", own, lambda a, b: (a.cast("long") - b) * (a.cast("long") - b))
    return F.aggregate(gap, F.lit(0).cast("long"), lambda a, b: a + b)


def by_cluster(found: DataFrame, centroids: np.ndarray) -> tuple[list[int], list[str]]:
    """Inertia and the sha256 of the components of each centroid, by number."""
    inertia = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    return [inertia.get(j, 0) for j in range(len(centroids))], [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
