"""Clusters and codes against plain rounds over all centroids, ties and odd rows included; bounds that only prune."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mudline.llm import elkan_codes, exponion, queries
from mudline.llm.int_vectors import above, all_squared, below, means, squared

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, row string, v string, n string"


def lloyd(x, c, rounds):
    """Assignments of each round and the last centroids, with argmin's ties to the smaller number."""
    seen = []
    for n in range(rounds + 1):
        a = all_squared(x, c).argmin(1)
        seen.append(a)
        if n < rounds:
            c = np.array([x[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    return seen, c


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 9), st.integers(1, 4), st.integers(1, 30))
def test_exponion_equals_plain_rounds_with_many_ties(seed, k, dim, spread):
    r = np.random.default_rng(seed)
    x = r.integers(-spread, spread + 1, (200, dim)).astype(np.int64)
    start = x[:k].copy()  # repeated centroids too
    want, last = lloyd(x, start, 4)
    c, before, cluster, upper, lower = start, None, None, None, None
    for n in range(5):
        balls = exponion.Balls(c, before)
        if n == 0:
            cluster, upper, lower = balls.everywhere(x)
        else:
            upper, lower = balls.shifted(cluster, upper, lower)
            balls.step(x, cluster, upper, lower)
        assert (cluster == want[n]).all()
        d = np.sqrt(all_squared(x, c).astype(float))
        assert (upper >= d[np.arange(len(x)), cluster]).all()
        d[np.arange(len(x)), cluster] = np.inf
        assert (lower <= d.min(1)).all()
        if n < 4:
            total = np.zeros_like(c)
            np.add.at(total, cluster, x)
            c, before = means(total, np.bincount(cluster, minlength=k), c), c
    assert (c == last).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 9), st.integers(1, 4), st.integers(1, 30))
def test_elkan_equals_plain_rounds_with_many_ties(seed, k, dim, spread):
    r = np.random.default_rng(seed)
    x = r.integers(-spread, spread + 1, (200, dim)).astype(np.int64)
    start = x[:k].copy()
    want, last = lloyd(x, start, 4)
    c, before = start, None
    for n in range(5):
        book = elkan_codes.Codebook(c, before)
        if n == 0:
            code, upper, lower = book.everywhere(x)
        else:
            # bounds as they are stored between rounds
            upper, lower = elkan_codes.rounded_up(upper).astype(float), elkan_codes.rounded_down(lower).astype(float)
            book.step(x, code, upper, lower)
        assert (code == want[n]).all()
        d = np.sqrt(all_squared(x, c).astype(float))
        assert (upper >= d[np.arange(len(x)), code]).all() and (lower <= d).all()
        if n < 4:
            total = np.zeros_like(c)
            np.add.at(total, code, x)
            c, before = means(total, np.bincount(code, minlength=k), c), c
    assert (c == last).all()


def test_bounds_prune_far_groups():
    """Well-parted groups measure next to nothing after the first round."""
    r = np.random.default_rng(1)
    centres = r.integers(-100_000, 100_000, (40, 16))
    x = (centres[r.integers(0, 40, 4000)] + r.integers(-50, 51, (4000, 16))).astype(np.int64)
    c = centres.astype(np.int64) + 7
    cluster, upper, lower = exponion.Balls(c).everywhere(x)
    moved = c + r.integers(-5, 6, c.shape)
    balls = exponion.Balls(moved, c)
    upper, lower = balls.shifted(cluster, upper, lower)
    assert balls.step(x, cluster, upper, lower).mean() < 0.1
    book, after = elkan_codes.Codebook(c), elkan_codes.Codebook(moved, c)
    code, upper, lower = book.everywhere(x)
    assert after.step(x, code, upper, lower).mean() < 0.1 and (code == cluster).all()


def test_roots_are_widened_outwards_and_stored_so():
    exact = np.array([0, 1, 2, 3, 10**6 + 1, 2**53 + 1, 2**61 + 12345])
    for e, high, low in zip(exact.tolist(), above(exact), below(exact), strict=True):
        assert math.isqrt(e) <= high and low * low <= e
    values = np.abs(np.random.default_rng(2).standard_normal(10_000)) * np.logspace(-9, 6, 10_000)
    assert (elkan_codes.rounded_up(values).astype(float) >= values).all() and (elkan_codes.rounded_down(values).astype(float) <= values).all()
    assert (elkan_codes.rounded_down(np.array([1e9, 70000.0])) <= 65504).all()
    assert (squared(np.array([[3, 4]]), np.array([0, 0])) == [25]).all()


def odd_rows(seed=3, n=300, dim=64):
    r = np.random.default_rng(seed)
    rows = [(i, [float(f) for f in np.round(r.standard_normal(dim) * 3) / 4], i % 3 if i % 7 else None) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [(5, rows[5][1], 9), (6, rows[7][1], 9), (None, rows[8][1], None), (1000, None, 1), (1001, [0.0] * (dim - 1) + [None], 1), (1002, [nan] * dim, 1), (1003, [0.0] * (dim - 1) + [inf], 1), (1004, [1.0] * (dim - 1), 1), (1005, [], 1), (1006, [0.0] * dim, 1), (1007, [-0.001] * dim, None)]
    return [(*r_, "x", "y", "z", "w") for r_ in rows]


def sound(rows, dim=64):
    return [(i, np.floor(256 * np.array(v, float)).astype(np.int64), lab) for i, v, lab, *_ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]


def key(*parts):
    return tuple((p is None, p if p is not None else 0) for p in parts)


def test_clusters_of_odd_rows(spark):
    rows = odd_rows()
    kept = sound(rows)
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v.tolist()) for i, v, _ in kept if i is not None)[:40]
    x = np.array([v for _, v, _ in kept])
    want, c = lloyd(x, np.array([v for _, v in seeds]), 5)
    found, centroids = exponion.cluster(spark.createDataFrame(rows, SCHEMA), keep=("cluster", "n"))
    assert (centroids == c).all()
    got = sorted(((r.row.vec_id, r.cluster, r.distance) for r in found.collect()), key=lambda r: key(*r))
    d = all_squared(x, c)[np.arange(len(x)), want[-1]]
    assert got == sorted(((i, int(a), int(q)) for (i, _, _), a, q in zip(kept, want[-1], d, strict=True)), key=lambda r: key(*r))
    assert {(r.row.cluster, r.row.n) for r in found.collect()} == {("x", "w")}


def test_codes_of_odd_rows(spark):
    rows = odd_rows()
    kept = sound(rows)
    seeds = [v for _, v in sorted((i, v.tolist()) for i, v, _ in kept if i is not None)[:64]]
    parts = np.array([v for _, v, _ in kept]).reshape(-1, 16, 4)
    books = np.array(seeds).reshape(64, 16, 4)
    found, got_books = elkan_codes.compress(spark.createDataFrame(rows, SCHEMA), keep=("label", "v"))
    codes, error = [], np.zeros(len(parts), np.int64)
    for p in range(16):
        seen, c = lloyd(parts[:, p], books[:, p], 2)
        assert (got_books[p] == c).all()
        codes.append(seen[-1])
        error += squared(parts[:, p], c[seen[-1]])
    want = sorted(((i, bytes(int(c[n]) for c in codes), int(error[n])) for n, (i, _, _) in enumerate(kept)), key=lambda r: key(*r))
    assert sorted(((r.row.vec_id, bytes(r.codes), r.error) for r in found.collect()), key=lambda r: key(*r)) == want
    back = found.select("row.vec_id", elkan_codes.restored(found.codes, got_books).alias("vector")).filter("vec_id = 1006").first()
    assert max(abs(x) for x in back.vector) < 1


def test_few_and_no_rows_and_large_components(spark):
    rows = spark.createDataFrame([(1, [0.5] * 64, 1, "", "", "", ""), (2, [0.5] * 64, 1, "", "", "", ""), (None, [0.5] * 64, 1, "", "", "", "")], SCHEMA)
    found, centroids = exponion.cluster(rows)
    assert len(centroids) == 2 and {r.cluster for r in found.collect()} == {0}  # ties go to the smaller number
    found, books = elkan_codes.compress(rows)
    assert books.shape == (16, 2, 4) and {bytes(r.codes) for r in found.collect()} == {bytes(16)}
    for none in (rows.limit(0), rows.filter("vec_id IS NULL")):
        assert exponion.cluster(none)[0].count() == 0 and elkan_codes.compress(none)[0].count() == 0
    large = spark.createDataFrame([(1, [1e9] * 64, 1, "", "", "", "")], SCHEMA)
    with pytest.raises(Exception, match="would not fit 64 bits"):
        exponion.cluster(large)


def test_queries_on_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame(odd_rows(n=80), SCHEMA)
    rows.write.parquet(f"{tmp_path}/some/embeddings.parquet")
    rows.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    for name in ("op11_exponion_clusters", "op12_elkan_codes"):
        some, none = (queries.QUERIES[name](spark, f"{tmp_path}/{d}") for d in ("some", "none"))
        assert none.count() == 0 and none.dtypes == some.dtypes
    sums = {r.label_error for r in queries.op12_elkan_codes(spark, f"{tmp_path}/some").collect()}
    assert len(sums) == 5  # labels 0, 1, 2, 9 and null


def test_query_has_the_columns_of_its_sql(spark, tmp_path):
    spark.createDataFrame(odd_rows(n=80), SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op11_exponion_clusters", "op12_elkan_codes"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        theirs = [r[0] for r in con.execute(f"DESCRIBE {queries.ORACLES[name]}").fetchall()]
        assert queries.QUERIES[name](spark, str(tmp_path)).columns == theirs
