from __future__ import annotations

import math
import random

import duckdb
from pyspark.sql import functions as F

from mudline.functions import digits
from mudline.functions.frames import ordered
from mudline.operators import windows
from mudline.plans import kernel_queries, window_queries


def test_fused_rounds_once(spark):
    r = random.Random(7)
    rows = [tuple(r.uniform(-1, 1) * 10.0 ** r.randrange(-3, 7) for _ in range(3)) for _ in range(3000)]
    rows += [(a, b, -(a * b)) for a, b, _ in rows[:500]]
    df = spark.createDataFrame(rows, "x double, y double, z double").select("*", digits.fused(F.col("x"), F.col("y"), F.col("z")).alias("f"))
    got = df.collect()
    assert sum(v.x * v.y + v.z != v.f for v in got) > 500
    assert [v for v in got if v.f != math.fma(v.x, v.y, v.z)] == []
    odd = spark.createDataFrame([(float("inf"), 0.5, 1.0), (1e300, 0.5, 1.0)], "x double, y double, z double")
    assert [v.f for v in odd.select(digits.fused(F.col("x"), F.col("y"), F.col("z")).alias("f")).collect()] == [float("inf"), 5e299]


def test_quantiles_are_those_of_sql(spark):
    """To the last bit, over frames of every length from none, with nulls and repeated values."""
    r = random.Random(11)
    rows = [(w, i, i, None if i % 17 == 5 else round(2000 + r.randrange(8000) * 0.11, 2) if w % 2 else r.randrange(40) * 0.03) for w in range(30) for i in range(120)]
    df = spark.createDataFrame(rows, "well_id long, ts long, seq long, x double")
    wanted = {"a": ("x", 0.1), "b": ("x", 0.9), "c": ("x", 0.05), "d": ("x", 0.95), "e": ("x", 0.5)}
    got = windows.quantiles(df, wanted, ordered().rowsBetween(-50, -1)).select("well_id", "seq", *wanted).orderBy("well_id", "seq").collect()
    c = duckdb.connect()
    c.execute("CREATE TABLE t (well_id BIGINT, ts BIGINT, seq BIGINT, x DOUBLE)")
    c.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    sql = ", ".join(f"quantile_cont(x, {p}) OVER w AS {n}" for n, (_, p) in wanted.items())
    want = c.execute(f"SELECT well_id, seq, {sql} FROM t WINDOW w AS (PARTITION BY well_id ORDER BY ts, seq ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) ORDER BY 1, 2").fetchall()
    assert [(tuple(a), b) for a, b in zip(got, want, strict=True) if tuple(a) != b] == []


def planted(spark, tmp_path):
    """Wells of 51 packets whose last value equals a quantile of the 50 before it, up to the last bit; a well a user of ten."""
    r = random.Random(3)
    rows = []
    for w in range(400):
        low = r.randrange(500) / 100
        # tenths apart, so that quantiles fall on hundredths
        values = [round(low + 0.1 * i, 2) for i in range(50)]
        last = round(low + 0.1 * (r.choice((4.9, 44.1)) if w % 2 else r.choice((2.45, 46.55))), 3)
        r.shuffle(values)
        rows += [(w * 51 + i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", w * 10, v, '{"k": 5}') for i, v in enumerate([*values, last])]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double, props string")
    df.select("event_id", F.to_timestamp("ts").alias("ts"), "user_id", F.lit("view").alias("event_type"), "value", "props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def held_against_sql(query, d, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{d}/events.parquet/*.parquet')")
    from mudline import registry

    df = query
    names = sorted(df.columns)
    cur = c.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLES[name]}) a")
    return sorted(tuple(v[n] for n in names) for v in df.collect()), sorted(cur.fetchall())


def test_alert_zones_at_the_quantile(spark, tmp_path):
    d = planted(spark, tmp_path)
    got, want = held_against_sql(window_queries.alert_zones(spark, d), d, "alert_zones")
    assert got == want and got


def test_quantile_intervals_at_the_quantile(spark, tmp_path):
    d = planted(spark, tmp_path)
    got, want = held_against_sql(kernel_queries.quantile_intervals(spark, d), d, "quantile_intervals")
    assert got == want and got
