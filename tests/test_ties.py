from __future__ import annotations

import random

import duckdb

from mudline import registry
from mudline.operators import hourly, joins
from mudline.plans import hourly_queries, report_queries, window_queries


def test_asof_breaks_ties(spark):
    rows = [("a", 10 * u, 6 * u + i) for u in range(40) for i in range(6)]
    random.Random(5).shuffle(rows)
    left, right = spark.createDataFrame([("a", 10 * u + d) for u in range(1, 39) for d in (-3, 0, 3)], "k string, t long"), spark.createDataFrame(rows, "k string, u long, row long")
    ahead = joins.asof(left, right, ["k"], "t", "u", ["row"], forward=True, ties="row").collect()
    back = joins.asof(left, right, ["k"], "t", "u", ["row"], ties="row").collect()
    assert all(r.row == 6 * -(-r.t // 10) for r in ahead) and len(ahead) == 114
    assert all(r.row == 6 * (r.t // 10) + 5 for r in back) and len(back) == 114


def test_segments_begin_at_the_first_packet_of_a_second(spark):
    """Six packets a second: a transition's boundary is the first of them, whatever the order in which they arrive."""
    rows = [(1, 0, i // 6, i, 1.0) for i in range(600)]
    random.Random(6).shuffle(rows)
    df = spark.createDataFrame(rows, "well_id long, part int, ts long, seq long, d_exponent double")
    asked = spark.createDataFrame([(1, 20), (1, 51)], "well_id long, at long")
    assert sorted((r.began, r.ended) for r in hourly.segments(df, asked).collect()) == [(0, 120), (120, 306), (306, 600)]


def test_hourly_analysis_where_packets_share_seconds(spark, tmp_path):
    """Six copies of each packet of three wells, in the same second; the best segments are those of the SQL."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT event_id + i * 100000 AS event_id, ts, user_id, event_type, value, props FROM '/root/testdata/sf0.1/events.parquet', (SELECT unnest(range(6)) AS i) WHERE user_id // 10 IN (1, 2, 8)) TO '{tmp_path}/events.parquet'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = hourly_queries.hourly_analysis(spark, str(tmp_path))
    names = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(c.execute(f"SELECT {names} FROM ({registry.ORACLES['hourly_analysis']}) a").fetchall())


def test_oscillation_where_a_value_is_the_mean(spark, tmp_path):
    """Wells whose mean is their first value in decimals, rows in no order: which side it falls to follows from the packets' order, as in the SQL."""
    r, rows = random.Random(7), []
    for well in range(400):
        n = r.randint(20, 60)
        cents = [r.randint(0, 600) for _ in range(n - 1)]
        cents.append(cents[0] * n - sum(cents))
        if 0 <= cents[-1] <= 660:
            rows += [(well * 100 + i, well * 10, i * 60, v / 100) for i, v in enumerate(cents)]
    r.shuffle(rows)
    c = duckdb.connect()
    c.execute("CREATE TABLE e (event_id BIGINT, user_id BIGINT, s BIGINT, value DOUBLE)")
    c.executemany("INSERT INTO e VALUES (?, ?, ?, ?)", rows)
    c.execute(f"""COPY (SELECT event_id, TIMESTAMP '2024-01-01' + to_seconds(s) AS ts, user_id, 'x' AS event_type, value, '{{"k": 5}}' AS props FROM e) TO '{tmp_path}/events.parquet'""")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = window_queries.oscillation(spark, str(tmp_path))
    names = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(c.execute(f"SELECT {names} FROM ({registry.ORACLES['oscillation']}) a").fetchall())


def test_hourly_analysis_of_wells_with_few_valid_rows(spark, tmp_path):
    """Nine packets whose weight rises while the rate stands: each is judged, as in the SQL; by its own default the operator lets so few pass."""
    c = duckdb.connect()
    c.execute(f"""COPY (SELECT i * 40 AS event_id, TIMESTAMP '2024-01-01' + to_minutes(i) AS ts, CAST(40 AS BIGINT) AS user_id, 'x' AS event_type, 5.0::DOUBLE AS value, '{{"k": 5}}' AS props FROM range(9) t(i)) TO '{tmp_path}/events.parquet'""")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for f in (hourly_queries.hourly_analysis, report_queries.dysfunction_breakdown):
        df = f(spark, str(tmp_path))
        names = ", ".join(df.columns)
        assert sorted(map(tuple, df.collect())) == sorted(c.execute(f"SELECT {names} FROM ({registry.ORACLES[f.__name__]}) a").fetchall())
    metrics = hourly_queries.calm_metrics(spark, str(tmp_path))
    assert hourly.stable_rows(metrics).filter("reason IS NULL").count() == 9 > hourly.stable_rows(metrics, 0).filter("reason IS NULL").count() > 0
