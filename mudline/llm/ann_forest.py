"""Approximate nearest neighbours with a hash-prefix forest (operator 9).

Index rows are dealt into shards.  For every tree a row gets a long hash string
(``BITS`` signs of random projections); a tree is the sorted array of these
strings.  A query descends in all trees to its longest-prefix matches, and from
there ascends in all trees together:

1. Bit by bit, until the rows under the common prefix length number ``FIRST``.
   They are measured exactly, which gives the angle of the k-th nearest so far.
2. To the prefix length at which a row within that angle is missed by all trees
   with a chance of ``MISS`` at most: rows at angle a share a bit with chance
   1 - a / pi.  The rows under it are measured, and the best k stay.

So clustered vectors take short ascents, and vectors of no structure take long
ones, up to the whole shard; there is no cap and no switch by size.

Shards and blocks of queries are packed rows, and each task takes pairs of them:
the query set against all rows, in blocks, without the driver.  A query meets
its best k of each shard in the end.  Equal vectors of a shard are one entry with
its smallest ids, so a large group of copies is measured once.

Defined results: vectors that are null, zero, of another length than most or
with null or non-finite components take no part; a repeated vec_id counts once,
with its best score, and asks once, with its smallest vector; ties go to the
smaller vec_id; fewer candidates than ``k`` give fewer rows; other columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mudline.llm.batches import gather_spans
from mudline.llm.shared import written

TREES = 96
BITS = 24
FIRST = 512
MISS = 0.1
SHARD = 16384
BLOCK = 1024
SEED = 20240607


def planes(dim: int, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((trees * bits, dim)).astype(np.float32)


def strings(unit: np.ndarray, normals: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """Hash strings of rows, one column per tree, as integers (first sign highest)."""
    out = np.zeros((len(unit), trees), np.int32)
    weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int32)
    for t in range(trees):
        out[:, t] = ((unit @ normals[t * bits : (t + 1) * bits].T) > 0) @ weights
    return out


class Forest:
    """The sorted arrays of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, normals: np.ndarray, k: int, trees: int = TREES, bits: int = BITS):
        raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, where, inverse = np.unique(raw, return_index=True, return_inverse=True)
        order = np.lexsort((ids, inverse))
        # repeats of a row count once, so that they take no other id's place
        order = order[np.append(True, (np.diff(ids[order]) != 0) | (np.diff(inverse[order]) != 0))]
        rank = np.arange(len(order)) - np.searchsorted(inverse[order], inverse[order], side="left")
        few = order[rank <= k]  # one more than asked for: a query's own id may be among them
        self.owner, self.ids = inverse[few], ids[few]
        self.first = np.searchsorted(self.owner, np.arange(len(where) + 1))
        self.vectors = vectors[where].astype(np.float64)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.unit = (self.vectors / self.norms[:, None]).astype(np.float32)
        codes = strings(self.unit, normals, trees, bits)
        self.order = np.argsort(codes, axis=0).astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order, axis=0).T.copy()
        self.order = self.order.T.copy()
        self.bits, self.k, self.trees = bits, k, trees

    def ranges(self, codes: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and tree the range under its prefix of ``depth`` bits."""
        shift = (self.bits - depth).astype(np.int32)[:, None]
        prefix = codes >> shift
        low, high = (np.empty(codes.shape, np.int64) for _ in range(2))
        for t in range(self.trees):
            low[:, t] = np.searchsorted(self.sorted[t], (prefix[:, t] << shift[:, 0]).astype(np.int32))
            high[:, t] = np.searchsorted(self.sorted[t], ((prefix[:, t] + 1) << shift[:, 0]).astype(np.int32))
        return low, high

    def descend(self, codes: np.ndarray) -> np.ndarray:
        """The longest prefix length at which a query's trees hold ``FIRST`` rows together."""
        depth, todo = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for d in range(self.bits, 0, -1):
            low, high = self.ranges(codes[todo], np.full(len(todo), d))
            enough = (high - low).sum(1) >= FIRST
            depth[todo[enough]] = d
            todo = todo[~enough]
            if not todo.size:
                break
        return depth

    def enough_bits(self, cosine: np.ndarray) -> np.ndarray:
        """The longest prefix length that misses a row of this cosine in all trees with a chance of ``MISS`` at most."""
        share = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
        with np.errstate(divide="ignore"):
            bits = np.log(1 - MISS ** (1 / self.trees)) / np.minimum(np.log(share), -1e-12)
        return np.clip(np.floor(bits), 0, self.bits).astype(np.int64)

    def under(self, codes: np.ndarray, depth: np.ndarray) -> Iterator[np.ndarray]:
        """Each query's entries under its prefixes of ``depth`` bits in any tree."""
        low, high = self.ranges(codes, depth)
        for i in range(len(codes)):
            if depth[i] == 0:
                yield np.arange(len(self.unit))
                continue
            hit = np.zeros(len(self.unit), bool)
            for t, (a, z) in enumerate(zip(low[i].tolist(), high[i].tolist(), strict=True)):
                if a < z:
                    hit[self.order[t, a:z]] = True
            yield np.flatnonzero(hit)

    def members(self, entries: np.ndarray) -> np.ndarray:
        """Places in ``ids`` of the ids of ``entries``."""
        return gather_spans(self.first[entries], self.first[entries + 1] - self.first[entries])

    def best(self, near: np.ndarray, rough: np.ndarray) -> tuple[np.ndarray, float]:
        """Entries that hold the best k + 1 *different* ids (the query's own may be one), and the least cosine among them; -1 where there are no more.

        An id with many near vectors has an entry for each, so the cut widens until
        enough ids are there.
        """
        n = self.k + 1
        while n < len(near):
            least = float(np.partition(rough, -n)[-n])
            there = near[rough >= least - 1e-5]
            if len(np.unique(self.ids[self.members(there)])) > self.k:
                return there, least
            n *= 2
        return near, -1.0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, codes: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """The best ids and scores of each query, best first, ties to the smaller id; and the number of entries measured."""
        norms = np.sqrt((queries * queries).sum(1))
        depth = self.descend(codes)
        kth = np.full(len(queries), -1.0)
        for i, near in enumerate(self.under(codes, depth)):
            kth[i] = self.best(near, self.unit[near] @ (queries[i] / norms[i]).astype(np.float32))[1]
        out, measured = [], 0
        for i, near in enumerate(self.under(codes, np.minimum(depth, self.enough_bits(kth)))):
            measured += len(near)
            near, _ = self.best(near, self.unit[near] @ (queries[i] / norms[i]).astype(np.float32))
            exact = (self.vectors[near] * queries[i]).sum(1) / (self.norms[near] * norms[i])
            members = self.members(near)
            scores = np.repeat(exact, self.first[near + 1] - self.first[near])
            ids = self.ids[members]
            other = ids != query_ids[i]
            ids, scores = ids[other], scores[other]
            # a row's id counts once within the shard
            best = np.lexsort((ids, -scores))
            _, at = np.unique(ids[best], return_index=True)
            best = best[np.sort(at)][: self.k]
            out.append((ids[best], scores[best]))
        return out, measured


def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (id, vector) as packed rows of ``size`` at most: two columns of little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([t["id"].to_numpy().astype("<i8").tobytes()]), pa.array([t["vector"].combine_chunks().flatten().to_numpy().astype("<f8").tobytes()])], [f"{name}_ids", f"{name}_vectors"])

        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, size - sum(h.num_rows for h in held))
                held.append(part)
                at += part.num_rows
                if sum(h.num_rows for h in held) >= size:
                    yield flush()
        if held:
            yield flush()

    return rows.select("id", "vector").mapInArrow(run, f"{name}_ids binary, {name}_vectors binary")


def search(index: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col``, ``score`` (cosine) and ``measured`` (entries measured for the query) for the rows of ``index`` that ``is_query`` picks."""
    spark = index.sparkSession
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vector_col}`").isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = index.filter(sound).select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("vector"), is_query.alias("asks"))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double, measured long")
    dim = lengths[0].n
    rows = rows.filter(F.size("vector") == dim)
    asked = rows.filter("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    # numbered once, in the written table: two shards that begin alike stay two
    shards = written(packed(rows, shard, "index").select(F.monotonically_increasing_id().alias("shard"), "*"), "shards")
    several = -(-asked.count() // block)
    blocks = written(packed(asked.repartition(max(several, 1)), block, "query"), "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals, forest, of = planes(dim), None, None
        for b in batches:
            for number, shard_ids, shard_vectors, query_ids, query_vectors in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of != number:
                    of = number
                    forest = Forest(np.frombuffer(shard_ids, "<i8"), np.frombuffer(shard_vectors, "<f8").reshape(-1, dim), normals, k)
                ids, queries = np.frombuffer(query_ids, "<i8"), np.frombuffer(query_vectors, "<f8").reshape(-1, dim)
                codes = strings((queries / np.sqrt((queries * queries).sum(1))[:, None]).astype(np.float32), normals)
                found, measured = forest.search(ids, queries, codes)
                sizes = [len(x) for x, _ in found]
                columns = [np.repeat(ids, sizes), np.concatenate([x for x, _ in found]), np.concatenate([s for _, s in found]), np.full(sum(sizes), measured // max(len(ids), 1))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "id", "score", "measured"])

    # pairs of a shard and a block: the stated query set against all rows
    pairs = shards.crossJoin(blocks.hint("shuffle_replicate_nl"))
    found = pairs.mapInArrow(run, "query_id long, id long, score double, measured long")
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.max("measured").alias("measured"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score", "measured")
