"""Selected medians against the built-in ones: ties, negative and huge values, nulls, even and odd groups, heavy duplicates."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from mudline.operators import selection


@pytest.mark.parametrize("few", [0, 3, 50, 10_000])
def test_equal_the_plain_medians(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "BINS", 8)
    rng, rows = random.Random(3), []
    for g, n in (("a", 501), ("b", 500), ("c", 1), ("d", 2), ("e", 200)):
        for _ in range(n):
            v = {"a": rng.gauss(0, 1), "b": rng.choice([1.0, 1.0, 1.0, 2.0]), "e": rng.choice([1e308, -1e308, 0.0, 5e-324, 1e-300])}.get(g, rng.random())
            rows.append((g, v, None if g == "d" or rng.random() < 0.3 else float(rng.randint(-9, 9)), 7.0))
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(4)
    got = {r.g: r for r in selection.medians(df, ["g"], ["x", "y", "z"], few).collect()}
    assert set(got) == set("abcde")
    for g in got:
        for i, c in enumerate("xyz", 1):
            values = sorted(r[i] for r in rows if r[0] == g and r[i] is not None)
            low, high = (values[(len(values) - 1) // 2], values[len(values) // 2]) if values else (None, None)
            want = low if low == high else low / 2 + high / 2
            assert got[g][c] == want or got[g][c] == pytest.approx(want, rel=1e-15), (g, c, few)
    assert got["a"].x == statistics.median(r[1] for r in rows if r[0] == "a")


def test_a_large_group_sends_only_counts(spark):
    df = spark.range(0, 300_000).select(F.lit(1).alias("g"), (F.pmod(F.hash("id"), F.lit(100_003)) / 7).alias("x"))
    want = df.agg(F.median("x")).first()[0]
    assert selection.medians(df, ["g"], ["x"], few=100).first().x == want
