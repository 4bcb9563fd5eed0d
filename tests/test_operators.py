"""Operators that SQL cannot express, against plain loops; joins, stores and configuration on small cases."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mudline import config
from mudline.functions import physics, reports
from mudline.operators import joins, kernels, lockstep, ml, modes, quality, stores, windows
from mudline.operators.intervals import Intervals, Together
from mudline.operators.nets import Clusters, Nets, TacticalNets, Transitions


def packets(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def test_mse_by_hand(spark):
    row = packets(spark, [(15.0, 120.0, 8.5, 50.0, 25.0), (15.0, 120.0, 0.0, 50.0, 25.0), (15.0, 120.0, 8.5, 0.0, 25.0)], "t double, n double, d double, r double, w double")
    got = [x[0] for x in row.select(physics.mse(*[F.col(c) for c in "tndrw"])).collect()]
    assert got[0] == pytest.approx(480 * 15 * 1000 * 120 / (8.5**2 * 50) + 4 * 25 * 1000 / (math.pi * 8.5**2))
    assert got[1:] == [0.0, 0.0]


def test_depth_continuity_keeps_the_last_accepted_depth(spark):
    rows = [(1, 1, 0, 1000.0, "Drilling"), (1, 2, 3600, 2000.0, "Drilling"), (1, 3, 3660, 1005.0, "Drilling"), (1, 4, 3661, 940.0, "Drilling"), (1, 5, 3662, 0.0, "Idle")]
    df = packets(spark, rows, "well_id long, seq long, ts long, bit_depth double, state string")
    got = [r.verdict for r in kernels.apply(df, kernels.DepthContinuity()).orderBy("seq").collect()]
    assert got == ["ok", "jump", "ok", "reversal", "ok"]


def test_conformal_matches_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    values = [*rng.normal(100, 5, 260), 180.0]
    df = packets(spark, [(1, i, i, float(v)) for i, v in enumerate(values)], "well_id long, seq long, ts long, spp double")
    got = kernels.apply(df, kernels.Conformal("spp")).orderBy("seq").collect()
    alpha, seen, residuals = 0.1, [], []
    for v, r in zip(values, got, strict=True):
        mid = float(np.median(seen)) if seen else 0.0
        ordered = sorted(residuals)
        radius = ordered[min(math.ceil(len(ordered) * min(max(1 - alpha, 0.01), 0.999)), len(ordered) - 1)] if ordered else 0.0
        res = abs(v - mid)
        alpha = min(max(alpha + 0.005 * (0.1 - (res > radius)), 0.001), 0.5)
        seen, residuals = [*seen, v][-200:], [*residuals, res][-200:]
        ordered = sorted(residuals)
        radius = ordered[min(math.ceil(len(ordered) * min(max(1 - alpha, 0.01), 0.999)), len(ordered) - 1)]
        assert r.upper - r.lower == pytest.approx(2 * radius)
    assert got[-1].is_outlier


def test_gate_scenario(spark):
    base = {"state": "Drilling", "rule": "torque", "category": "Mechanical", "severity": "High", "outlier": True, "net_ok": True, "learning": False}
    steps = [({"learning": True}, "learning"), ({"bit_depth": 0.0}, "no_depth"), ({"state": "Idle"}, "state"), ({"category": "None", "rule": "none"}, "normal"), ({"outlier": False}, "no_interval"), ({"net_ok": None}, "no_net"), ({"outlier": None}, "ticket"), ({}, "cooldown"), ({"bit_depth": 1100.0}, "ticket"), ({"rule": "founder", "bit_depth": 1300.0}, "debounce"), ({"category": "WellControl", "rule": "kick", "outlier": False, "net_ok": False}, "ticket")]
    gate, state = kernels.TicketGate(), kernels.TicketGate().start()
    got = [gate.step(state, {"ts": i, "bit_depth": 1000.0} | base | change)[0] for i, (change, _) in enumerate(steps)]
    assert got == [w for _, w in steps]
    # after a restart the first anomalies pass the interval rule
    gate, state = kernels.TicketGate(bypass=1), kernels.TicketGate(bypass=1).start()
    assert [gate.step(state, {"ts": 1000 * i, "bit_depth": 1000.0 * (i + 1)} | base | {"outlier": False})[0] for i in range(2)] == ["ticket", "no_interval"]


def test_kernels_restart_for_each_well_and_null_rows_survive(spark):
    df = packets(spark, [(w, i, i, v) for w in (1, 2) for i, v in enumerate(["a", "b", "b", "b", None])], "well_id long, seq long, ts long, state string")
    got = [(r.well_id, r.steady) for r in windows.debounced(df, "state").orderBy("well_id", "seq").collect()]
    assert got == [(w, s) for w in (1, 2) for s in ("a", "a", "a", "b", "b")]
    counted = kernels.apply(df.selectExpr("well_id", "seq", "ts", "CAST(seq AS DOUBLE) AS v"), kernels.RateLimiter("v")).orderBy("well_id", "seq").collect()
    assert [r.allowed for r in counted] == [True, True, True, True, True] * 2
    assert kernels.apply(df.limit(0).selectExpr("well_id", "seq", "ts", "1.0D AS v"), kernels.RateLimiter("v")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(w, i, i, float(v)) for w in range(3) for i, v in enumerate(rng.normal(50, 5, 120))]
    df = packets(spark, rows, "well_id long, seq long, ts long, wob double")
    for part in range(3):
        df.filter((F.col("seq") >= part * 40) & (F.col("seq") < part * 40 + 40)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kernel = kernels.RateLimiter("wob")
    stream = kernels.apply_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), kernel)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.well_id, r.seq): r.allowed for r in spark.table("limited").collect()}
    want = {(r.well_id, r.seq): r.allowed for r in kernels.apply(df, kernel).collect()}
    assert got == want


def test_range_join_small_and_binned_agree(spark, monkeypatch):
    points = spark.range(0, 500).select(F.col("id").cast("double").alias("d"))
    spans = packets(spark, [("a", 0.0, 120.0), ("b", 100.0, 130.0), ("c", 300.0, 301.0)], "name string, top double, base double")
    small = {tuple(r) for r in joins.range_join(points, spans, "d", "top", "base").select("d", "name").collect()}
    monkeypatch.setattr(joins, "SMALL_ROWS", 1)
    assert small == {tuple(r) for r in joins.range_join(points, spans, "d", "top", "base").select("d", "name").collect()}
    assert ("b" in {n for d, n in small if d == 110}) and (499.0, None) in small


def test_asof_both_ways(spark):
    left = packets(spark, [(1, 5.0), (1, 10.0), (1, 1.0), (2, 7.0)], "k long, t double")
    right = packets(spark, [(1, 5.0, "x"), (1, 9.0, "y")], "k long, u double, v string")
    back = {(r.k, r.t): r.v for r in joins.asof(left, right, ["k"], "t", "u", ["v"]).collect()}
    ahead = {(r.k, r.t): r.v for r in joins.asof(left, right, ["k"], "t", "u", ["v"], forward=True).collect()}
    assert back == {(1, 5.0): "x", (1, 10.0): "y", (1, 1.0): None, (2, 7.0): None}
    assert ahead == {(1, 5.0): "x", (1, 10.0): None, (1, 1.0): "x", (2, 7.0): None}


def test_keep_latest_ties(spark):
    rows = packets(spark, [("a", 1, 1, "old"), ("a", 2, 1, "low"), ("a", 2, 2, "high")], "k string, v long, id long, x string")
    assert [r.x for r in stores.keep_latest(rows, ["k"], "v", "id").collect()] == ["high"]


def test_sanitise_nulls_and_nans(spark):
    t = packets(spark, [(1.0, float("nan"), -1.0), (None, 50.0, 5.0), (0.0, 0.0, 0.0)], "bit_depth double, rop double, wob double")
    full = t.withColumns({c: F.lit(0.0) for c in ("hole_depth", "rpm", "torque", "spp", "flow_in", "flow_out", "hook_load", "ecd", "mud_weight_in", "h2s")}).withColumn("ts", F.lit(1))
    got = quality.sanitize(full).select("bit_depth", "rop", "wob").collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0, 0.0), (0.0, 50.0, 5.0)]


def test_p_values_against_integration():
    for r, n in ((0.3, 40), (-0.1, 30), (0.8, 100), (0.0, 50)):
        df = n - 2
        t = abs(r) * math.sqrt(df / (1 - r * r))
        grid = np.linspace(0, t, 200_001)
        pdf = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + grid**2 / df) ** (-(df + 1) / 2)
        area = float(((pdf[1:] + pdf[:-1]) / 2 * np.diff(grid)).sum())
        assert ml.p_value(r, n) == pytest.approx(1 - 2 * area, abs=1e-8)


def test_gradients_against_differences_and_learning():
    net = Nets("fast", 5)
    net.decay = 1.0
    rng = np.random.default_rng(0)
    xs, target = rng.normal(size=(3, 2, 16)), rng.normal(size=(2, 16))

    def loss(flat):
        state = net.start(2)
        state["w"] = flat.copy()
        for x in xs:
            net.forward(state, x, 0.7)
        return net.gradients(state, target)

    first = net.start(2)["w"] + rng.normal(0, 0.1, (2, net.n_params)) * net.mask
    _, grads = loss(first)
    for name in ("in", 1, 2, 3, "out"):
        a, z, _, _ = net.places[name]
        for at in rng.choice(np.flatnonzero(net.mask[0, a:z]) + a, 12):
            moved = [first.copy(), first.copy()]
            moved[0][1, at] += 1e-6
            moved[1][1, at] -= 1e-6
            assert grads[1, at] == pytest.approx((loss(moved[0])[0][1] - loss(moved[1])[0][1]) / 2e-6, rel=1e-4, abs=1e-8), (name, at)
    assert (grads[:, net.mask[0] == 0] == 0).all()
    state, losses = net.start(), []
    for i in range(1500):
        net.observe(state, np.sin(i / 7 + np.arange(16))[None])
        losses.append(state["rmse"][0])
    assert np.mean(losses[-100:]) < 0.6 * np.mean(losses[1:101])


def columns_of(kernel, rng, wells):
    return {c: (rng.random(wells) < 0.1 if c in ("advised", "locks") else rng.choice(["Mechanical", "Hydraulics", "None"], wells) if c == "category" else rng.normal(50, 5, wells)) for c in kernel.reads}


def test_wells_in_step_are_wells_alone():
    """Wells of other lengths, one of which forgets in between, give what each gives alone; a state that went through JSON goes on alike."""
    kernel, rng = Together(Intervals(), TacticalNets()), np.random.default_rng(1)
    ahead = kernel.kernels[1].ahead
    lengths = [340, 330, 330, 20]
    steps = [columns_of(kernel, rng, sum(n > i for n in lengths)) for i in range(max(lengths))]
    state, together = kernel.start(len(lengths)), []
    for i, x in enumerate(steps):
        together.append(kernel.step(state, x))
        if i == 100:
            ahead.forget(state["TacticalNets"]["ahead"], np.array([1]))
    for well, n in enumerate(lengths):
        alone = kernel.start()
        for i in range(n):
            out = kernel.step(alone, {c: v[well : well + 1] for c, v in steps[i].items()})
            if i == 100 and well == 1:
                ahead.forget(alone["TacticalNets"]["ahead"], np.array([0]))
            if i == 200:
                alone = kernels.restored(json.loads(json.dumps(kernels.plain(alone))))
            for name, values in out.items():
                assert np.array_equal(np.asarray(values[0], object), np.asarray(together[i][name][well], object)) or np.allclose(values[0], together[i][name][well], rtol=1e-9, atol=1e-12), (well, i, name)
    last = together[320]
    assert last["net_calibrated"].all() and (last["net_score"] > 0).all() and not together[250]["net_calibrated"].any()


def test_intervals_equal_one_metric_after_the_other():
    kernel, rng = Intervals(window=40), np.random.default_rng(2)
    state = kernel.start(3)
    plain = [{m: (c := kernels.Conformal(m, 40, least=least)) and (c, c.start()) for m, least in kernel.LEAST.items()} for _ in range(3)]
    for i in range(120):
        x = {m: np.round(rng.normal(10, 3, 3)) for m in kernel.METRICS} | {"category": ["Mechanical", "None", "Hydraulics"], "locks": np.array([i == 70, False, False])}
        got = kernel.step(state, x)
        for w in range(3):
            if i == 70 and w == 0:
                plain[w] = {m: (c, c.start()) for m, (c, _) in plain[w].items()}
            out = {m: c.step(s, {m: x[m][w]})[2] for m, (c, s) in plain[w].items()}
            steady = len(plain[w]["mse"][1]["values"]) >= 20
            assert got["outliers"][w] == sum(out.values()) and got["steady"][w] == steady
            names = kernel.TRIGGERS.get(x["category"][w])
            assert got["outlier"][w] == (any(out[m] for m in names) if steady and names else None)


def test_regimes_need_four_distinct_points():
    """The published cases: three points and a repeat do not suffice, the fourth gives its own place, near points join and pull."""
    clusters = Clusters()
    s = clusters.start()
    for i in (0, 1, 2, 2, 0):
        assert clusters.assign(s, np.eye(8)[i][None]).tolist() == [0]
    assert clusters.assign(s, np.eye(8)[3][None]).tolist() == [3]
    near = np.eye(8)[1][None] * 0.9
    assert clusters.assign(s, near).tolist() == [1] and s["centres"][0, 1, 1] == pytest.approx(1 - 0.01 * 0.1)


def test_transitions_fire_after_five_and_reset():
    """The published cases: two features never fire, three for five packets do once, an advisory holds back, a calm packet begins anew."""
    t = Transitions()
    sigmas = lambda n: np.array([[3.0] * n + [0.5] * (16 - n)])
    run = lambda s, n, times, advised=False: [bool(t.check(s, sigmas(n), np.array([advised]), np.array([True]))[0]) for _ in range(times)]
    assert not any(run(t.start(), 2, 10))
    s = t.start()
    assert run(s, 3, 10) == [False] * 4 + [True] + [False] * 4 + [True]
    s = t.start()
    assert not any(run(s, 4, 10, advised=True)) and run(s, 4, 1) == [True]
    s = t.start()
    assert not any(run(s, 5, 4) + run(s, 0, 1) + run(s, 5, 4))


def test_a_transition_makes_the_depth_ahead_net_forget():
    kernel, rng = TacticalNets(), np.random.default_rng(6)
    state, fired = kernel.start(2), []
    for i in range(420):
        x = {c: (np.zeros(2, bool) if c == "advised" else rng.normal(50, 1, 2)) for c in kernel.reads}
        if 400 <= i < 412:
            x = {c: v + np.array([0.0, 60.0 * (i - 399)]) if c != "advised" else v for c, v in x.items()}
        before = state["ahead"]["kept"].copy()
        out = kernel.step(state, x)
        fired.append(out["transition"].tolist())
        for w in (0, 1):
            assert state["ahead"]["kept"][w] == (0 if out["transition"][w] else min(before[w] + 1, 6))
    assert any(f[1] for f in fired[400:]) and not any(f[0] for f in fired)


def test_one_pass_equals_the_parts(spark):
    """Lock step over tasks and batches gives what each well gives alone, idle packets in between included."""
    rng, kernel = np.random.default_rng(4), Together(Intervals(), TacticalNets())
    names = sorted(set(kernel.reads) - {"category", "locks", "advised"})
    lengths = {1: 400, 2: 400, 3: 30, 4: 1, 5: 333}
    rows = [(w, i, i, "Drilling" if rng.random() < 0.8 else "Idle", "Mechanical", False, False, *rng.normal(50, 5, len(names)).tolist()) for w, n in lengths.items() for i in range(n)] + [(6, 0, 0, "Idle", "None", False, False, *[0.0] * len(names))]
    df = packets(spark, rows, "well_id long, seq long, ts long, state string, category string, locks boolean, advised boolean, " + ", ".join(f"{n} double" for n in names))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = lockstep.apply(df.repartition(3), kernel, F.col("state") == "Drilling", keep=("state",)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r.well_id, r.seq): r for r in found}
    assert len(found) == len(rows)
    for w in (*lengths, 6):
        state = kernel.start()
        for r in df.filter(F.col("well_id") == w).orderBy("seq").collect():
            if r.state != "Drilling":
                assert got[w, r.seq].net_score is None and got[w, r.seq].outliers is None
                continue
            x = kernel.step(state, {c: np.array([r[c]]) for c in kernel.reads})
            assert got[w, r.seq].outliers == x["outliers"][0] and got[w, r.seq].regime == x["regime"][0]
            assert got[w, r.seq].net_score == pytest.approx(x["net_score"][0], rel=1e-9)


def test_modes_lock_at_the_hundredth_clean_packet(spark):
    """A first block with too many strays in every sensor locks nothing; packets that do not drill teach nothing; own thresholds hold from the lock on."""
    rng = np.random.default_rng(7)
    rows, n = [], 0
    for i in range(420):
        state = "Idle" if i % 4 == 3 else "Drilling"
        n += state == "Drilling"
        dirty = n <= 100 and n > 20 and n % 10 == 0
        rows.append((1, i, i, state, *[float(rng.normal(100, 1) + (1e4 * n if dirty else 0)) for _ in modes.SENSORS], float("nan") if i == 300 else 1.0))
    rows += [(2, i, i, "Drilling", *[100.0 + i % 3 for _ in modes.SENSORS], 1.0) for i in range(99)]
    df = packets(spark, rows, "well_id long, ts long, seq long, state string, " + ", ".join(f"{s} double" for s in modes.SENSORS) + ", odd double")
    got = {r.sensor: r for r in modes.learned(df).collect()}
    assert set(got) == set(modes.SENSORS) and {r.well_id for r in got.values()} == {1} and {r.locked_after for r in got.values()} == {200}
    want = [r[4] for r in rows if r[0] == 1 and r[3] == "Drilling"][100:200]
    assert got["mse"].mean == pytest.approx(np.mean(want)) and got["mse"]["std"] == pytest.approx(np.std(want, ddof=1))



def test_report_parsing(spark):
    df = packets(spark, [("<think>a\nb</think>Health score: 7.5\nSeverity: HIGH\nAction: stop",), ("nothing",), (None,)], "t string")
    t = reports.without_thoughts(F.col("t"))
    got = df.select(reports.health_score(t), reports.severity_word(t), reports.section(t, "action")).collect()
    assert tuple(got[0]) == (75.0, "High", "stop") and got[1][0] is None and got[2][0] is None


def test_configuration():
    assert config.overlay({"mse": {"efficiency_warning_percent": 80.0}}).mse.efficiency_warning_percent == 80.0
    with pytest.raises(ValueError, match="did you mean mse.efficiency_warning_percent"):
        config.overlay({"mse": {"efficiency_warning_percnt": 80.0}})
    with pytest.raises(ValueError, match="gas_units_warning"):
        config.overlay({"well_control": {"gas_units_warning": 900.0}})
    assert config.changes(config.DEFAULT, config.overlay({"trip": {"yield_point": 11.0}})) == [("trip.yield_point", 10.0, 11.0)]
