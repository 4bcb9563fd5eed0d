"""Texts, votes' triggers, axis joins and updates on small cases by hand."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mudline.functions import digits, texts
from mudline.operators import advisories, baseline, joins, kernels, reading

VOTE = "array<struct<specialist: string, vote: string, weight: double, reasoning: string>>"


def test_trigger_of_votes(spark):
    rows = [
        ([("WellControl", "Critical", 0.3, "Flow imbalance -15.2 gpm")], 1.0, 40.0), ([("WellControl", "Critical", 0.3, "pit rising"), ("MSE", "Critical", 0.2, "slow")], 1.0, 40.0),
        ([("MSE", "High", 0.2, "slow")], -12.0, 40.0), ([], 3.0, 40.0), (None, 3.0, 40.0),
    ]
    df = spark.createDataFrame(rows, f"votes {VOTE}, flow double, eff double")
    got = [tuple(r.t) for r in df.select(texts.trigger_of_votes(F.col("votes"), F.col("flow"), F.col("eff")).alias("t")).collect()]
    assert got == [("Flow Balance", -15.2, 10.0), ("MSE Efficiency", 40.0, 70.0), ("Flow Balance", -12.0, 10.0), ("Unknown", 0.0, 0.0), ("Unknown", 0.0, 0.0)]


def test_sentences(spark):
    df = spark.createDataFrame([([("WOB", 4, 0.61), ("RPM", 9, -0.5)], [("rpm", 100.0, 110.0, 0.2), ("wob", 20.0, 25.0, 0.7)])], "leads array<struct<parameter: string, lag: int, r: double>>, recs array<struct<parameter: string, current: double, recommended: double, impact: double>>")
    steps = texts.parameter_steps(F.lit(5.0), F.lit(-3.0), F.lit(-20.0))
    row = df.select(
        texts.causal_block(F.col("leads")), texts.causal_block(F.slice("leads", 1, 0)), texts.optimization_text(F.lit("Chalk"), F.col("recs"), F.lit(0.72)), texts.look_ahead_text(F.lit("Chalk"), F.lit(12.4), F.lit(31.6), steps), texts.parameter_steps(F.lit(0.5), F.lit(1.0), F.lit(2.0)),
    ).first()
    assert tuple(row) == (
        " Causal leads: WOB rising precedes MSE rise by 4s (r=+0.61); RPM falling precedes MSE rise by 9s (r=-0.50).", "", "Chalk: wob 20.0 -> 25.0; rpm 100.0 -> 110.0 (confidence 72%)", "Chalk in 12 min (32 ft): WOB +5 klbs, Flow -20 gpm", "no parameter change",
    )


def test_router_rating_and_jitter(spark):
    df = spark.createDataFrame([("why a kick",), ("ECD is low",), (None,)], "q string")
    assert [r[0] for r in df.select(texts.query_category(F.col("q"))).collect()] == ["WellControl", "Hydraulics", "None"]
    h = 0
    for c in b"rig-7":
        h = (h * 31 + c) % 2147483647
    assert df.limit(1).select(texts.jitter_hash(F.lit("rig-7"))).first()[0] == h
    assert [r[0] for r in spark.createDataFrame([(0.8,), (0.75,), (0.5,), (0.1,)], "s double").select(texts.composite_rating(F.col("s"))).collect()][1] == "GOOD efficiency"


def test_first_interval_keeps_repeated_points(spark):
    points = spark.createDataFrame([(1, 105.0), (1, 105.0), (2, 95.0), (3, 500.0), (4, 250.0)], "id long, d double")
    spans = spark.createDataFrame([("a", 90.0, 120.0), ("b", 100.0, 330.0), ("c", 80.0, 100.0)], "name string, top double, base double")
    got = sorted((r.id, r.name or "") for r in joins.first_interval(points, spans, "d", "top", "base").collect())
    assert got == [(1, "a"), (1, "a"), (2, "c"), (3, ""), (4, "b")]


def test_neighbours_across_cells_and_beyond_the_ends(spark):
    points = spark.createDataFrame([(d,) for d in (5.0, 10.0, 99.0, 450.0, 1000.0, 2000.0)], "d double")
    marks = spark.createDataFrame([(10.0, "a"), (10.0, "b"), (20.0, "c"), (1000.0, "z")], "m double, n string")
    got = {r.d: (r.last_name, r.next_name) for r in joins.neighbours_on_axis(points, marks, "d", "m", "n").collect()}
    assert got == {5.0: (None, "a"), 10.0: ("a", "c"), 99.0: ("c", "z"), 450.0: ("c", "z"), 1000.0: ("z", None), 2000.0: ("z", None)}
    assert joins.neighbours_on_axis(points, marks.limit(0), "d", "m", "n").filter("next_name IS NOT NULL OR last_name IS NOT NULL").count() == 0


def test_outcomes_off_the_list_change_nothing(spark):
    events = spark.createDataFrame([(1, "Pending", 5), (2, "Pending", 5)], "id long, outcome string, last_modified long")
    updates = spark.createDataFrame([(1, "Resolved"), (2, "Nonsense")], "id long, new_outcome string")
    assert sorted(tuple(r) for r in reading.update_outcomes(events, updates, "id", 9).select("id", "outcome", "last_modified").collect()) == [(1, "Resolved", 9), (2, "Pending", 5)]


def test_order_of_sources_and_forced_locks(spark):
    df = spark.createDataFrame([(False, True, True), (None, None, True), (False, False, False)], "t boolean, p boolean, l boolean")
    got = [r[0] for r in df.select(advisories.advisory_source({"look_ahead": F.col("l"), "ticket": F.col("t"), "periodic": F.col("p")})).collect()]
    assert got == ["periodic", "look_ahead", None]
    base = spark.createDataFrame([(1, "spp", 50, "learning"), (1, "rop", 1, "learning")], "well_id long, sensor string, n long, status string")
    assert {r.sensor: r.status for r in baseline.forced(base).collect()} == {"spp": "locked", "rop": "learning"}


def test_oscillation_drops_unsound_values(spark):
    series = [10.0, 20.0] * 15 + [float("nan"), -5.0, 0.0]
    df = spark.createDataFrame([(series,), ([10.0] * 30,), ([1.0],), ([],)], "v array<double>")
    got = [r[0] for r in df.select(advisories.oscillation(F.col("v"))).collect()]
    assert got[0].cv == pytest.approx(1 / 3) and got[0].hz == pytest.approx(29 / 58) and got[0].amplitude == pytest.approx(2 / 3) and got[0].kind == "StickSlip"
    assert got[1:] == [None, None, None]


def test_digits_of_halves(spark):
    """6.55 is a little less than its decimal, 45.75 and 28.5 are exact halves, and 1.005 times 100 rounds to a half on the way or not as doubles have it."""
    values = [6.55, 6.45, 45.75, 45.25, 28.5, 27.5, 0.05, 1.005, -6.55, -0.04, 17.571875, 1e15, 0.0, 999.95, 2.675, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    v = F.col("v")
    got = df.select(digits.printf("%.0f|%.1f|%+.2f %d%% %s %.3f", v, v, "v", F.lit(7), F.lit("x"), v).alias("t"), digits.rounded(v, 5).alias("five"), digits.rounded(v, 2).alias("two")).collect()
    assert [r.t for r in got[:-1]] == ["%.0f|%.1f|%+.2f %d%% %s %.3f" % (x, x, x, 7, "x", x) for x in values[:-1]]
    con = duckdb.connect()
    assert [(r.five, r.two) for r in got] == [con.execute("SELECT round(?::DOUBLE, 5), round(?::DOUBLE, 2)", [x, x]).fetchone() for x in values]


def test_slopes_equal_those_of_the_sql():
    """To the last bit, as a slope of 0.1 is asked for."""
    values = [((i * 7919) % 12000 - (i * 104729) % 12000) / 100 for i in range(400)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (e DOUBLE, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    want = [r[0] for r in con.execute("SELECT regr_slope(v, e) OVER (ORDER BY e ROWS 9 PRECEDING) FROM t ORDER BY e").fetchall()]
    assert [kernels.slope(values[max(i - 9, 0) : i + 1]) for i in range(1, 400)] == want[1:] and kernels.slope([3.0]) == 0.0


def test_oscillations_of_streams_equal_those_of_lists(spark):
    """Unsound values, short wells and wells that end in a batch; a batch is smaller than a window."""
    odd = {5: None, 9: float("nan"), 40: -3.0, 41: 0.0, 77: float("inf")}
    rows = [(w, 0, i, odd.get(i, 10.0 + (i * 7 + w) % 13 * (i % 50 > 20))) for w, n in ((1, 150), (2, 15), (3, 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "well_id long, ts long, seq long, torque double")
    last = Window.partitionBy("well_id").orderBy("ts", "seq").rowsBetween(-59, 0)
    listed = df.select("well_id", "seq", advisories.oscillation(F.collect_list("torque").over(last)).alias("o")).filter("o IS NOT NULL")
    want = sorted((r.well_id, r.seq, *r.o) for r in listed.collect())
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", held):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = advisories.oscillations(df, "torque", keep=("well_id", "seq"))
            assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100
            assert "_value" in got._jdf.queryExecution().toString() and "collect_list" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_many_marks_are_not_broadcast(spark, monkeypatch):
    """Marks beyond the limit reach no driver, and neighbours stay the same."""
    points = spark.range(40).select((F.col("id") * 37.0).alias("d"))
    marks = spark.range(30).select((F.col("id") * 50.0).alias("m"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("n"))
    few = joins.neighbours_on_axis(points, marks, "d", "m", "n")
    monkeypatch.setattr(joins, "SMALL_ROWS", 10)
    many = joins.neighbours_on_axis(points, marks, "d", "m", "n")
    plan = many._jdf.queryExecution().executedPlan().toString()  # before it runs
    assert plan.count("BroadcastExchange") == 1 and "SortMergeJoin" in plan  # the axis' two ends alone
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
