"""Scans of chunks against plain windows and loops: wells of one chunk, many, gaps, ties, nulls, resets."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mudline.operators import scan

SCHEMA = "well_id long, ts long, seq long, v double, w double, active boolean, resets boolean"


def table(spark, n=900, seed=1):
    rng = random.Random(seed)
    rows = []
    for well, count in ((1, n), (2, 40), (3, 1)):
        ts = 1000
        for i in range(count):
            ts += rng.choice([0, 1, 1, 2, 500]) if well == 1 else 1
            v = rng.choice([None, 0.0, -1.0]) if rng.random() < 0.2 else 1e6 + rng.random()
            rows.append((well, ts, i, v, rng.random() * 100, rng.random() < 0.3, rng.random() < 0.02))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


@pytest.mark.parametrize("span", [1, 60, 10**9])
def test_scans_equal_plain_windows(spark, span):
    df, _ = table(spark)
    plain = Window.partitionBy("well_id").orderBy("ts", "seq")
    upto, before = plain.rowsBetween(Window.unboundedPreceding, 0), plain.rowsBetween(Window.unboundedPreceding, -1)
    got = (
        scan.Scan(span=span).last("was", F.struct("v", "w"), where=F.col("active")).last("now", F.col("v"), before=False).total("s", F.col("w")).count("n", F.col("active"), before=True)
        .moments("m", F.col("v")).moments("p", F.col("v"), before=True).over(df)
    )
    spread = lambda w: F.struct(F.count("v").over(w).alias("n"), F.avg("v").over(w).alias("mean"), (F.coalesce(F.var_pop("v").over(w), F.lit(0.0)) * F.count("v").over(w)).alias("m2"))
    want = df.withColumns({
        "was": F.last(F.when(F.col("active"), F.struct("v", "w")), ignorenulls=True).over(before), "now": F.last("v", ignorenulls=True).over(upto), "s": F.sum("w").over(upto),
        "n": F.coalesce(F.sum(F.col("active").cast("long")).over(before), F.lit(0)), "m": spread(upto), "p": spread(before),
    })
    a, b = ({(r.well_id, r.seq): r for r in x.collect()} for x in (got, want))
    assert set(a) == set(b) and got.columns == want.columns
    for k, y in b.items():
        x = a[k]
        assert (x.was, x.now, x.n) == (y.was, y.now, y.n) and x.s == pytest.approx(y.s)
        for p, q in ((x.m, y.m), (x.p, y.p)):
            assert p.n == q.n and p.mean == (pytest.approx(q["mean"], rel=1e-12) if q["mean"] is not None else None) and p.m2 == pytest.approx(q.m2, rel=1e-6, abs=1e-6)


def test_prefix_of_maps():
    r = np.random.default_rng(0)
    a, b = r.random(1000), r.standard_normal(1000)
    b[r.random(1000) < 0.1], x, want = 0, 3.0, []
    for p, q in zip(a, b, strict=True):
        x = p * x + q
        want.append(x)
    p, q = scan.prefix(a, b)
    assert np.allclose(p * 3.0 + q, want)


@pytest.mark.parametrize("span", [1, 60, 10**9])
@pytest.mark.parametrize("resets", [False, True])
def test_moving_mean_equals_a_loop(spark, span, resets):
    df, rows = table(spark, seed=2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r.well_id, r.seq): r.ema for r in scan.moving_mean(df, "v", resets=F.col("resets") if resets else None, span=span).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    state = {}
    for well, _, seq, v, _, _, again in sorted(rows, key=lambda r: r[:3]):
        n, ema = state.get(well, (0, 0.0))
        if v is not None and v > 0:
            ema = v if ema == 0 else ema + (0.5 if n < 10 else 0.1) * (v - ema)
        assert got[well, seq] == pytest.approx(ema, rel=1e-9), (well, seq)
        state[well] = (0, 0.0) if resets and again else (n + 1, ema)


def test_one_well_is_dealt_to_many_tasks(spark):
    df = spark.range(0, 20_000, numPartitions=3).selectExpr("0L AS well_id", "id AS ts", "id AS seq", "CAST(id % 7 AS DOUBLE) AS v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (scan.Scan(span=500).total("s", F.col("v")).last("was", F.col("v")).over(df), scan.moving_mean(df, "v", "s", span=500).withColumn("was", F.col("s"))):
            sizes = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("s").alias("n"), F.max("was")).collect()]
            assert len(sizes) == 4 and max(sizes) < 9_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
