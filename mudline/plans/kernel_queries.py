"""Sequential operators per well; recursive SQL walks the same packets one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mudline.functions import anomalies, states, tickets
from mudline.functions.frames import last_rows
from mudline.operators import joins, kernels, lockstep, modes, rig_events, windows
from mudline.operators.intervals import Intervals, Together
from mudline.operators.metrics import METRICS_SQL, OVERRIDES, STATE_SQL, drilling_metrics, with_state
from mudline.operators.nets import TacticalNets
from mudline.plans.join_queries import FORMATION_SQL, formations, minutes_to, with_neighbours
from mudline.plans.physics_queries import MET, PARTS, REC, REC_MET, TEL, r
from mudline.registry import query
from mudline.streaming import processor
from mudline.telemetry import RUNS_SQL, runs, telemetry

#: Packets of ``tel`` or ``met`` numbered in order, to walk along.
WALK = ", ix AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY ts, seq) AS i FROM {0})"
RUN_REC = f"WITH RECURSIVE {RUNS_SQL} "
NEXT = "JOIN ix x ON x.well_id = s.well_id AND x.i = s.i + 1"

JUMPY = f""", jm AS (SELECT seq, well_id, ts, {STATE_SQL} AS state, bit_depth + CASE k WHEN 5 THEN 400 WHEN 6 THEN -80 ELSE 0 END AS d FROM tel)""" + WALK.format("jm")


@query(REC + JUMPY + f""", st AS (SELECT well_id, i, seq, 'ok' AS verdict, CASE WHEN d > 0 THEN d END AS depth, CASE WHEN d > 0 THEN ts END AS since FROM ix WHERE i = 1
  UNION ALL SELECT well_id, i, seq, verdict, CASE WHEN verdict = 'ok' AND d > 0 THEN d ELSE depth END, CASE WHEN verdict = 'ok' AND d > 0 THEN ts ELSE since END FROM (
    SELECT x.well_id, x.i, x.seq, x.d, x.ts, s.depth, s.since, CASE WHEN x.d <= 0 OR s.depth IS NULL THEN 'ok' WHEN abs(x.d - s.depth) > 500 * greatest(x.ts - s.since, 1) / 3600.0 AND 500 * greatest(x.ts - s.since, 1) / 3600.0 > 1 THEN 'jump' WHEN x.d - s.depth < -50 AND x.state = 'Drilling' THEN 'reversal' ELSE 'ok' END AS verdict FROM st s {NEXT}) a)
  SELECT seq, well_id, verdict FROM st""")
def depth_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = with_state(telemetry(spark, sf_dir)).withColumn("bit_depth", F.col("bit_depth") + F.when(F.col("k") == 5, 400.0).when(F.col("k") == 6, -80.0).otherwise(0.0))
    return kernels.apply(t, kernels.DepthContinuity()).select("seq", "well_id", "verdict")


@query(TEL + """, pa AS (SELECT a.well_id, a.seq, a.ts, a.wob, a.rpm, row_number() OVER (PARTITION BY a.well_id ORDER BY a.ts, a.seq) AS i, count(b.seq) AS n, avg(b.wob) AS mw, avg(b.rpm) AS mr FROM tel a LEFT JOIN tel b ON a.well_id = b.well_id AND b.ts BETWEEN a.ts - 30 AND a.ts AND (b.ts < a.ts OR b.seq < a.seq) GROUP BY 1, 2, 3, 4, 5),
  ch AS (SELECT *, CASE WHEN i = 1 OR (n > 0 AND (abs(wob - mw) > 2 OR abs(rpm - mr) > 10)) THEN ts END AS c FROM pa)
  SELECT seq, ts - last_value(c IGNORE NULLS) OVER (PARTITION BY well_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS since_change FROM ch""")
def parameter_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.parameter_changes(telemetry(spark, sf_dir)).select("seq", "since_change")


GAS_SQL = """, gs AS (SELECT *, state IN ('Drilling', 'Reaming') AS cutting FROM sta), gp AS (SELECT *, coalesce(lag(cutting) OVER w, true) AS was, row_number() OVER w AS i FROM gs WINDOW w AS (PARTITION BY well_id ORDER BY ts, seq)),
  gr AS (SELECT *, sum((NOT cutting AND was)::INT) OVER (PARTITION BY well_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS pause FROM gp)"""


@query(REC + f", sta AS (SELECT *, {STATE_SQL} AS state FROM tel)" + GAS_SQL + """, pk AS (SELECT well_id, pause, max(gas_units) AS peak FROM gr WHERE NOT cutting GROUP BY 1, 2),
  ba AS (SELECT well_id, i, CASE WHEN cutting THEN gas_units END AS b FROM gr WHERE i = 1 UNION ALL SELECT x.well_id, x.i, CASE WHEN NOT x.cutting OR NOT x.was THEN s.b WHEN s.b IS NULL THEN x.gas_units ELSE 0.95 * s.b + 0.05 * x.gas_units END FROM ba s JOIN gr x ON x.well_id = s.well_id AND x.i = s.i + 1),
  en AS (SELECT g.*, p.peak, b.b, coalesce(l.gas_units, 0) AS pre FROM gr g JOIN pk p ON p.well_id = g.well_id AND p.pause = g.pause JOIN ba b ON b.well_id = g.well_id AND b.i = g.i LEFT JOIN (SELECT well_id, pause + 1 AS pause, arg_max(gas_units, i) AS gas_units FROM gr WHERE cutting GROUP BY 1, 2) l ON l.well_id = g.well_id AND l.pause = g.pause WHERE g.cutting AND NOT g.was),
  de AS (SELECT *, CAST(row_number() OVER (PARTITION BY well_id ORDER BY i) AS DOUBLE) AS e FROM en)
  SELECT seq, well_id, round(pre, 6) AS pre_gas, round(peak, 6) AS peak_gas, round(gas_units, 6) AS post_gas, round(greatest(peak - coalesce(b, 0), 0), 6) AS above_background, round(CASE WHEN count(*) OVER w < 2 THEN 0 ELSE regr_slope(peak - pre, e) OVER w END, 6) AS gas_trend,
    count(*) OVER w >= 5 AND regr_slope(peak - pre, e) OVER w > 0.1 AS trending FROM de WINDOW w AS (PARTITION BY well_id ORDER BY i ROWS 9 PRECEDING)""")
def connection_gas(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = with_state(telemetry(spark, sf_dir))
    gas = kernels.apply(t, kernels.ConnectionGas()).filter("peak_gas IS NOT NULL")
    return gas.select("seq", "well_id", *[r(F.col(c), c) for c in ("pre_gas", "peak_gas", "post_gas", "above_background", "gas_trend")], "trending")


@query(REC_MET + WALK.format("(SELECT *, floor(bit_depth / 270) AS fm FROM met)") + f""", st AS (SELECT well_id, i, seq, fm, CASE WHEN mse > 0 AND bit_depth > 0 THEN bit_depth END AS top, hardness AS hard, CASE WHEN mse > 0 AND bit_depth > 0 THEN mse ELSE 0 END AS total, CASE WHEN mse > 0 AND bit_depth > 0 THEN 1 ELSE 0 END AS n, CAST(NULL AS DOUBLE) AS reference, CAST(0 AS DOUBLE) AS wear FROM ix WHERE i = 1
  UNION ALL SELECT well_id, i, seq, fm, CASE WHEN closes THEN NULL ELSE top END, hard, total, n, CASE WHEN closes THEN coalesce(reference, level) ELSE reference END, CASE WHEN closes THEN greatest((level - coalesce(reference, level)) / coalesce(reference, level), 0) ELSE wear END FROM (
    SELECT *, sees AND bit_depth - top >= 100 AS closes, total / greatest(n, 1) / (5000 + hard * 8000) AS level FROM (
      SELECT well_id, i, seq, fm, bit_depth, reference, wear, sees, CASE WHEN sees THEN coalesce(t0, bit_depth) ELSE t0 END AS top, CASE WHEN t0 IS NULL THEN hardness ELSE hard END AS hard, CASE WHEN sees THEN mse + CASE WHEN t0 IS NULL THEN 0 ELSE total END ELSE total END AS total, CASE WHEN sees THEN 1 + CASE WHEN t0 IS NULL THEN 0 ELSE n END ELSE n END AS n FROM (
        SELECT x.well_id, x.i, x.seq, x.fm, x.bit_depth, x.mse, x.hardness, s.reference, s.wear, s.hard, s.total, s.n, x.mse > 0 AND x.bit_depth > 0 AS sees, CASE WHEN x.fm = s.fm THEN s.top END AS t0 FROM st s {NEXT}) c) a) b)
  SELECT seq, well_id, round(wear, 6) AS wear_index, CASE WHEN wear > 0.8 THEN 'pull' WHEN wear > 0.5 THEN 'inspect' WHEN wear > 0.3 THEN 'watch' END AS wear_advice FROM st""")
def bit_wear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wear with a formation each 270 ft."""
    m = drilling_metrics(telemetry(spark, sf_dir)).withColumn("formation", F.floor(F.col("bit_depth") / 270))
    return kernels.apply(m, kernels.BitWear()).select("seq", "well_id", r(F.col("wear_index"), "wear_index"), "wear_advice")


@query(REC + WALK.format("tel") + f""", st AS (SELECT well_id, i, seq, spp, [spp] AS vs, [spp] AS rs, least(greatest(0.1 + 0.005 * (0.1 - (spp > 0)::INT), 0.001), 0.5) AS alpha, 1 - (spp > 0)::INT AS hits FROM ix WHERE i = 1
  UNION ALL SELECT well_id, i, seq, spp, list_append(vs[greatest(len(vs) - 198, 1):], spp), list_append(rs[greatest(len(rs) - 198, 1):], res), least(greatest(alpha + 0.005 * (0.1 - (res > rad)::INT), 0.001), 0.5), hits + 1 - (res > rad)::INT FROM (
    SELECT x.well_id, x.i, x.seq, x.spp, s.vs, s.rs, s.alpha, s.hits, abs(x.spp - list_median(s.vs)) AS res, list_sort(s.rs)[least(CAST(ceil(len(s.rs) * least(greatest(1 - s.alpha, 0.01), 0.999)) AS BIGINT), len(s.rs) - 1) + 1] AS rad FROM st s {NEXT}) a)
  SELECT seq, well_id, round(mid - half, 5) AS lower, round(mid + half, 5) AS upper, round(CASE WHEN half > 1e-10 THEN abs(spp - mid) / half ELSE 0 END, 5) AS deviation, round(hits * 1.0 / i, 6) AS coverage, abs(spp - mid) > half AND i >= 10 AS is_outlier FROM (
    SELECT *, list_median(vs) AS mid, list_sort(rs)[least(CAST(ceil(len(rs) * least(greatest(1 - alpha, 0.01), 0.999)) AS BIGINT), len(rs) - 1) + 1] AS half FROM st) b""")
def conformal_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = kernels.apply(telemetry(spark, sf_dir), kernels.Conformal("spp"))
    return c.select("seq", "well_id", r(F.col("lower"), "lower", 5), r(F.col("upper"), "upper", 5), r(F.col("deviation"), "deviation", 5), r(F.col("coverage"), "coverage"), "is_outlier")


@query(TEL + """, q AS (SELECT seq, well_id, spp, row_number() OVER (PARTITION BY well_id ORDER BY ts, seq) AS i, quantile_cont(spp, 0.5) OVER w AS mid, quantile_cont(spp, 0.95) OVER w AS hi, quantile_cont(spp, 0.05) OVER w AS lo FROM tel WINDOW w AS (PARTITION BY well_id ORDER BY ts, seq ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
  SELECT seq, round(mid, 4) AS mid, round(lo, 4) AS lower, round(hi, 4) AS upper, spp < lo OR spp > hi AS is_outlier FROM q WHERE i > 10""")
def quantile_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval without feedback: exact quantiles over a row frame, no Python."""
    frame = last_rows(1).rowsBetween(-50, -1)
    t = windows.quantiles(windows.with_index(telemetry(spark, sf_dir).select("seq", "well_id", "ts", "spp")), {"mid": ("spp", 0.5), "lower": ("spp", 0.05), "upper": ("spp", 0.95)}, frame).filter("idx > 10")
    return t.select("seq", r(F.col("mid"), "mid", 4), r(F.col("lower"), "lower", 4), r(F.col("upper"), "upper", 4), ((F.col("spp") < F.col("lower")) | (F.col("spp") > F.col("upper"))).alias("is_outlier"))


@query(REC + WALK.format("(SELECT *, [wob, rpm, torque, rop] AS p FROM tel)") + f""", st AS (SELECT well_id, i, seq, [p] AS c, 0 AS regime FROM ix WHERE i = 1
  UNION ALL SELECT well_id, i, seq, CASE WHEN grows THEN list_append(c, p) WHEN len(c) < 4 THEN c ELSE list_transform(range(1, 5), lambda j: CASE WHEN j = best THEN list_transform(range(1, 5), lambda q: c[j][q] + 0.01 * (p[q] - c[j][q])) ELSE c[j] END) END, CASE WHEN len(c) + grows::INT < 4 THEN 0 WHEN grows THEN 3 ELSE best - 1 END FROM (
    SELECT *, len(c) < 4 AND list_min(g) > 1e-12 AS grows, list_position(g, list_min(g)) AS best FROM (
      SELECT x.well_id, x.i, x.seq, x.p, s.c, list_transform(s.c, lambda e: (e[1] - x.p[1]) * (e[1] - x.p[1]) + (e[2] - x.p[2]) * (e[2] - x.p[2]) + (e[3] - x.p[3]) * (e[3] - x.p[3]) + (e[4] - x.p[4]) * (e[4] - x.p[4])) AS g FROM st s {NEXT}) a) b)
  SELECT seq, well_id, CAST(regime AS INTEGER) AS regime FROM st""")
def regime_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.apply(telemetry(spark, sf_dir), kernels.Regimes(("wob", "rpm", "torque", "rop"))).select("seq", "well_id", "regime")


SIGMA_SQL = ", ".join(f"coalesce(abs({c} - avg({c}) OVER w) / nullif(stddev_pop({c}) OVER w, 0), 0) AS s_{c}" for c in ("wob", "torque", "rop", "spp"))


@query(REC + f", sg AS (SELECT seq, well_id, ts, k % 7 = 0 AS advised, {SIGMA_SQL} FROM tel WINDOW w AS (PARTITION BY well_id ORDER BY ts, seq ROWS 199 PRECEDING)), su AS (SELECT seq, well_id, ts, advised, (s_wob > 0.8)::INT + (s_torque > 0.8)::INT + (s_rop > 0.8)::INT + (s_spp > 0.8)::INT >= 2 AS hit FROM sg)" + WALK.format("su") + f""", st AS (SELECT well_id, i, seq, hit::INT AS run, false AS fires FROM ix WHERE i = 1
  UNION ALL SELECT well_id, i, seq, CASE WHEN run >= 2 AND NOT advised THEN 0 ELSE run END, run >= 2 AND NOT advised FROM (SELECT x.well_id, x.i, x.seq, x.advised, CASE WHEN x.hit THEN s.run + 1 ELSE 0 END AS run FROM st s {NEXT}) a) SELECT seq, well_id, fires AS transition FROM st""")
def formation_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions with limits low enough for these data; an active advisory (each seventh k) holds them back."""
    frame = last_rows(200)
    sigma = lambda c: F.coalesce(F.try_divide(F.abs(F.col(c) - F.avg(c).over(frame)), F.stddev_pop(c).over(frame)), F.lit(0.0))
    t = telemetry(spark, sf_dir).withColumns({f"s_{c}": sigma(c) for c in ("wob", "torque", "rop", "spp")} | {"advised": F.col("k") % 7 == 0})
    return kernels.apply(t, kernels.TransitionDetector(("s_wob", "s_torque", "s_rop", "s_spp"), sigma=0.8, least=2, packets=2)).select("seq", "well_id", "transition")


def stepped(metrics: DataFrame, net_score: Column) -> DataFrame:
    """Severities of tickets: base, then stepped by the intervals' count, then by the nets' score (null: not calibrated)."""
    base = tickets.base_severity({k: F.col(v) for k, v in PARTS.items()})[0]
    return metrics.withColumn("severity", anomalies.net_adjusted(anomalies.aci_adjusted(base, F.col("category"), F.when(F.col("steady"), F.col("outliers"))), F.col("category"), net_score))


#: What the severity and the gate need of a packet beyond what intervals and nets add.
FOR_GATE = ("k", "bit_depth", "state", "rule", "learning", *PARTS.values())


def drilling() -> Column:
    return F.col("state").isin("Drilling", "Reaming")


def gated(metrics: DataFrame) -> DataFrame:
    """The gate behind adaptive intervals of drilling packets; the nets are stood in for by the packet's k."""
    judged = lockstep.apply(metrics, Intervals(), drilling(), keep=FOR_GATE)
    score = F.col("k") / 100.0
    return kernels.apply(stepped(judged, score).withColumn("net_ok", score >= 0.4), kernels.TicketGate(), keep=("outliers",))


#: Adaptive intervals of eleven metrics in long form, walked by recursion; ``locks`` of a packet begin a new ``part`` of its well.
INTERVAL_SQL = f"""dr AS (SELECT *, row_number() OVER (PARTITION BY well_id, part ORDER BY ts, seq) AS j FROM {{0}} WHERE state IN ('Drilling', 'Reaming')),
  lg AS (SELECT well_id, part, j, seq, unnest({list(Intervals.METRICS)}) AS metric, unnest([{", ".join(Intervals.METRICS)}]) AS v FROM dr),
  cs AS (SELECT well_id, part, metric, j, seq, v, [v] AS vs, [abs(v)] AS rs, least(greatest(0.1 + 0.005 * (0.1 - (abs(v) > 0)::INT), 0.001), 0.5) AS alpha FROM lg WHERE j = 1
    UNION ALL SELECT well_id, part, metric, j, seq, v, list_append(vs[greatest(len(vs) - 198, 1):], v), list_append(rs[greatest(len(rs) - 198, 1):], res), least(greatest(alpha + 0.005 * (0.1 - (res > rad)::INT), 0.001), 0.5) FROM (
      SELECT x.*, s.vs, s.rs, s.alpha, abs(x.v - list_median(s.vs)) AS res, list_sort(s.rs)[least(CAST(ceil(len(s.rs) * least(greatest(1 - s.alpha, 0.01), 0.999)) AS BIGINT), len(s.rs) - 1) + 1] AS rad
      FROM cs s JOIN lg x ON x.well_id = s.well_id AND x.part = s.part AND x.metric = s.metric AND x.j = s.j + 1) a),
  co AS (SELECT seq, j, metric, len(rs) >= 10 AND abs(v - list_median(vs)) > greatest(list_sort(rs)[least(CAST(ceil(len(rs) * least(greatest(1 - alpha, 0.01), 0.999)) AS BIGINT), len(rs) - 1) + 1],
    CASE metric {" ".join(f"WHEN '{m}' THEN {x}" for m, x in Intervals.LEAST.items())} END) AS out FROM cs),
  ca AS (SELECT seq, any_value(j) AS j, CAST(sum(out::INT) AS INTEGER) AS outliers, {", ".join(f"bool_or(out AND metric = '{m}') AS o_{m}" for m in ("spp", "ecd", "torque", "wob", "mse"))} FROM co GROUP BY seq),
  gx AS (SELECT m.*, c.outliers, c.j >= 20 AS steady, CASE WHEN c.j >= 20 THEN CASE category WHEN 'Hydraulics' THEN o_spp OR o_ecd WHEN 'Mechanical' THEN o_torque OR o_wob WHEN 'DrillingEfficiency' THEN o_mse END END AS outlier,
    CASE category WHEN 'WellControl' THEN CASE WHEN abs(flow_balance) > 10 OR abs(pit_rate) > 15 THEN 4 ELSE 3 END WHEN 'Hydraulics' THEN CASE WHEN ecd_margin < 0.1 OR abs(spp_delta) > 200 THEN 3 ELSE 2 END
      WHEN 'Mechanical' THEN CASE WHEN torque_delta > 0.25 THEN 3 ELSE 2 END WHEN 'DrillingEfficiency' THEN CASE WHEN mse_efficiency < 50 THEN 2 ELSE 1 END ELSE 1 END AS lv0 FROM {{0}} m LEFT JOIN ca c ON c.seq = m.seq),
  gy AS (SELECT *, greatest(least(lv0 + CASE WHEN NOT coalesce(steady, false) THEN 0 WHEN outliers < 2 THEN CASE WHEN category = 'WellControl' AND lv0 < 4 THEN 0 ELSE -1 END WHEN outliers >= 5 THEN 1 ELSE 0 END, 4), 1) AS lv1, CASE WHEN k < 20 THEN -2 WHEN k < 40 THEN -1 WHEN k >= 80 THEN 2 WHEN k >= 60 THEN 1 ELSE 0 END AS st FROM gx),
  gt AS (SELECT seq, well_id, ts, bit_depth, state, rule, category, learning, outliers, k / 100.0 >= 0.4 AS net_ok, outlier, least(lv1 + CASE WHEN category = 'WellControl' THEN greatest(st, CASE WHEN lv1 < 4 THEN 0 ELSE -1 END) ELSE st END, 4) >= 4 AS critical FROM gy)"""
GATE_CATEGORIES = "['Hydraulics', 'Mechanical', 'DrillingEfficiency', 'WellControl']"
#: The gate, walked by recursion over ``gt``: lists hold cooldown places, depths and times, sustained counts and normal runs of the four categories.
GATE_SQL = WALK.format("gt") + f""", st AS (
  SELECT well_id, 0 AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS gate, [NULL, NULL, NULL, NULL]::BIGINT[] AS cn, [0, 0, 0, 0]::DOUBLE[] AS cd, [0, 0, 0, 0]::BIGINT[] AS ct, [0, 0, 0, 0] AS sc, [0, 0, 0, 0] AS sn, 0 AS fr, 0 AS pr FROM ix WHERE i = 1
  UNION ALL SELECT well_id, i, seq, gate, CASE WHEN gate = 'ticket' THEN list_transform(range(1, 5), lambda j: CASE WHEN j = c THEN i ELSE cn[j] END) ELSE cn END, CASE WHEN gate = 'ticket' THEN list_transform(range(1, 5), lambda j: CASE WHEN j = c THEN bit_depth ELSE cd[j] END) ELSE cd END,
    CASE WHEN gate = 'ticket' THEN list_transform(range(1, 5), lambda j: CASE WHEN j = c THEN ts ELSE ct[j] END) ELSE ct END, CASE WHEN gate = 'ticket' THEN list_transform(range(1, 5), lambda j: CASE WHEN j = c THEN sc[j] + 1 ELSE sc[j] END) ELSE sc END, sn, fr, pr FROM (
    SELECT *, CASE WHEN learning THEN 'learning' WHEN bit_depth <= 0 THEN 'no_depth' WHEN state NOT IN ('Drilling', 'Reaming') THEN 'state' WHEN category = 'None' THEN 'normal'
      WHEN cn[c] IS NOT NULL AND i - cn[c] < packets AND abs(bit_depth - cd[c]) < feet AND ts - ct[c] < secs THEN 'cooldown' WHEN c < 4 AND sc[c] >= 3 AND abs(bit_depth - cd[c]) < least(feet * pow(2.0, sc[c] - 3), 500) THEN 'throttled'
      WHEN c < 4 AND outlier = false THEN 'no_interval' WHEN c < 4 AND NOT net_ok THEN 'no_net' WHEN rule = 'founder' AND fr < 3 THEN 'debounce' WHEN rule = 'pit_rate' AND pr < 3 THEN 'debounce' ELSE 'ticket' END AS gate FROM (
      SELECT *, list_transform(range(1, 5), lambda j: CASE WHEN cn[j] IS NULL THEN 0 WHEN sn[j] >= 500 THEN 0 ELSE sc0[j] END) AS sc FROM (
        SELECT x.well_id, x.i, x.seq, x.ts, x.bit_depth, x.state, x.rule, x.category, x.learning, x.net_ok, x.outlier, s.cn, s.cd, s.ct, s.sc AS sc0, CAST(list_position({GATE_CATEGORIES}, x.category) AS INTEGER) AS c, CASE WHEN x.critical THEN 20 ELSE 50 END AS packets, CASE WHEN x.critical THEN 10.0 ELSE 50.0 END AS feet, CASE WHEN x.critical THEN 1 ELSE 60 END AS secs,
          list_transform(range(1, 5), lambda j: CASE WHEN s.cn[j] IS NULL THEN 0 WHEN x.state NOT IN ('Drilling', 'Reaming') THEN CASE WHEN s.gate = 'ticket' AND s.cn[j] = s.i THEN 0 ELSE s.sn[j] END WHEN list_position({GATE_CATEGORIES}, x.category) = j THEN 0 ELSE CASE WHEN s.gate = 'ticket' AND s.cn[j] = s.i THEN 0 ELSE s.sn[j] END + 1 END) AS sn,
          CASE WHEN x.rule = 'founder' THEN s.fr + 1 ELSE 0 END AS fr, CASE WHEN x.rule = 'pit_rate' THEN s.pr + 1 ELSE 0 END AS pr FROM st s {NEXT}) a) b) d)"""
GATED_SQL = " SELECT g.seq, g.well_id, x.category, x.outliers, g.gate FROM st g JOIN ix x ON x.well_id = g.well_id AND x.i = g.i"


@query(REC_MET + ", gm AS (SELECT *, 0 AS part, false AS learning FROM met), " + INTERVAL_SQL.format("gm") + GATE_SQL + GATED_SQL)
def ticket_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets under fixed thresholds: adaptive intervals and severities as they are, nets stood in for by k."""
    m = drilling_metrics(telemetry(spark, sf_dir)).withColumns({"locks": F.lit(False), "learning": F.lit(False)})
    return gated(m).select("seq", "well_id", "category", "outliers", "gate")


#: Packets with their mode and what holds at each: the first block of 100 teaching packets in which a sensor is clean locks the well.
MODES_SQL = f"""cu AS (SELECT *, state IN ('Drilling', 'Reaming') AS teaches, sum((state IN ('Drilling', 'Reaming'))::INT) OVER (PARTITION BY well_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS lessons FROM met),
  bk AS (SELECT well_id, ts, seq, lessons, (lessons + 99) // 100 AS block, unnest({list(modes.SENSORS)}) AS sensor, unnest([{", ".join(modes.SENSORS)}]) AS v FROM cu WHERE teaches),
  ru AS (SELECT *, count(*) OVER w AS n, avg(v) OVER w AS m, stddev_samp(v) OVER w AS s FROM bk WINDOW w AS (PARTITION BY well_id, block, sensor ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
  bl AS (SELECT well_id, block, sensor, avg(v) AS mean, stddev_samp(v) AS std, count(*) FILTER (WHERE n > 10 AND s > 0.001 AND abs(v - m) > 3 * s) AS bad FROM ru GROUP BY 1, 2, 3 HAVING count(*) = 100),
  lk AS (SELECT *, min(block) OVER (PARTITION BY well_id) * 100 AS locked_after FROM bl WHERE bad <= 5 QUALIFY block * 100 = locked_after),
  sp AS (SELECT *, greatest(std, abs(mean) * 0.001, 0.001) AS sd FROM lk),
  ov AS (SELECT well_id, any_value(locked_after) AS locked_after, max(CASE WHEN sensor = 'flow_balance' THEN 3 * sd END) AS fw, max(CASE WHEN sensor = 'spp' THEN greatest(2 * sd, 30) END) AS sw, max(CASE WHEN sensor = 'spp' THEN greatest(3 * sd, 50) END) AS sc,
    max(CASE WHEN sensor = 'torque' AND mean > 0 THEN greatest(2 * least(sd / mean, 10), 0.1) END) AS tw, max(CASE WHEN sensor = 'torque' AND mean > 0 THEN greatest(3 * least(sd / mean, 10), 0.2) END) AS tc FROM sp GROUP BY 1),
  dy AS (SELECT c.*, v.* EXCLUDE (well_id, fw, sw, sc, tw, tc), coalesce(lessons >= locked_after, false) AS dynamic, CASE WHEN lessons >= locked_after THEN fw END AS fw0, CASE WHEN lessons >= locked_after THEN sw END AS sw0, CASE WHEN lessons >= locked_after THEN sc END AS sc0, CASE WHEN lessons >= locked_after THEN tw END AS tw0, CASE WHEN lessons >= locked_after THEN tc END AS tc0 FROM cu c LEFT JOIN ov v ON v.well_id = c.well_id),
  dz AS (SELECT *, coalesce(fw0, 5) AS fw, coalesce(sw0, 100) AS sw, coalesce(sc0, 200) AS sc, coalesce(tw0, 0.15) AS tw, coalesce(tc0, 0.25) AS tc FROM dy),
  dk AS (SELECT *, (flow_out - flow_in > fw)::INT + (pit_change > 5)::INT + (gas_units - background_gas > 50)::INT AS kn, (flow_in - flow_out > fw)::INT + (pit_change < -5)::INT + (greatest(spp_delta, 0) > sw)::INT AS ln FROM dz),
  dj AS (SELECT * EXCLUDE (rule, category), CASE WHEN NOT active THEN 'none' WHEN (flow_out > 0 OR flow_in <= 0) AND kn >= 2 THEN 'kick' WHEN (flow_out > 0 OR flow_in <= 0) AND ln >= 2 THEN 'loss' WHEN gas_units > 100 THEN 'gas' WHEN h2s > 10 THEN 'h2s' WHEN abs(pit_rate) > 5 THEN 'pit_rate' WHEN ecd_margin < 0.3 THEN 'ecd' WHEN abs(spp_delta) > sw THEN 'spp'
    WHEN torque_delta > tw THEN 'torque' WHEN founders AND state = 'Drilling' THEN 'founder' WHEN state = 'Drilling' AND mse_efficiency < 70 THEN 'mse' ELSE 'none' END AS rule FROM dk),
  dm AS (SELECT *, CASE WHEN rule IN ('kick', 'loss', 'gas', 'h2s', 'pit_rate') THEN 'WellControl' WHEN rule IN ('ecd', 'spp') THEN 'Hydraulics' WHEN rule IN ('torque', 'founder') THEN 'Mechanical' WHEN rule = 'mse' THEN 'DrillingEfficiency' ELSE 'None' END AS category, NOT dynamic AS learning, dynamic::INT AS part, teaches AND coalesce(lessons = locked_after, false) AS locks FROM dj)"""


@query(MET + ", " + MODES_SQL + " SELECT well_id, seq, CASE WHEN dynamic THEN 'dynamic' ELSE 'learning' END AS mode, locks, rule, category, round(fw0, 5) AS flow_warning, round(sw0, 5) AS spp_warning, round(sc0, 5) AS spp_critical, round(tw0, 5) AS torque_warning, round(tc0, 5) AS torque_critical FROM dm")
def dynamic_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both phases of each well: fixed thresholds while it learns, its own from the packet that locks on."""
    m = drilling_metrics(telemetry(spark, sf_dir))
    d = modes.with_modes(m, modes.learned(m))
    return d.select("well_id", "seq", "mode", "locks", "rule", "category", *[r(F.col(x), x, 5) for x in OVERRIDES])


@query(MET.replace("WITH ", "WITH ", 1) + ", " + MODES_SQL + " SELECT well_id, sensor, locked_after, round(mean, 5) AS mean, round(std, 5) AS std, bad AS outliers FROM lk")
def locked_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve sensors of each well, learned from drilling and reaming packets, as they lock."""
    d = modes.learned(drilling_metrics(telemetry(spark, sf_dir)))
    return d.select("well_id", "sensor", "locked_after", r(F.col("mean"), "mean", 5), r(F.col("std"), "std", 5), "outliers")


@query(REC_MET + ", " + MODES_SQL + ", " + INTERVAL_SQL.format("dm") + GATE_SQL + GATED_SQL)
def dynamic_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets after the lock: own thresholds, intervals that begin anew at the lock, none while a well learns."""
    m = drilling_metrics(telemetry(spark, sf_dir))
    return gated(modes.with_modes(m, modes.learned(m))).select("seq", "well_id", "category", "outliers", "gate")


def with_nets(spark: SparkSession, sf_dir: str, kernel) -> DataFrame:
    """Drilling metrics with what ``kernel`` says of each drilling packet; grave words of the cascade count as an active advisory."""
    f = drilling_metrics(telemetry(spark, sf_dir)).withColumns({"advised": F.col("severity").isin("CRITICAL", "HIGH"), "locks": F.lit(False), "learning": F.lit(False)})
    if "depth_into" in kernel.reads:
        f = joins.first_interval(f, formations(spark, sf_dir).select("formation", "hard", "top", "base"), "bit_depth", "top", "base")
        f = f.withColumns({"depth_into": F.coalesce(F.col("bit_depth") - F.col("top"), F.lit(0.0)), "formation_hardness": F.coalesce("hard", F.lit(0.0))})
    return lockstep.apply(f, kernel, drilling(), keep=FOR_GATE)


@query()
def corroborated_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate behind intervals and nets, both of drilling packets alone, severities stepped by both; tests hold it against the parts alone."""
    n = with_nets(spark, sf_dir, Together(Intervals(), TacticalNets(("net_score", "net_calibrated", "net_ok"))))
    c = kernels.apply(stepped(n, F.when(F.col("net_calibrated"), F.col("net_score"))), kernels.TicketGate(), keep=("outliers", "net_score"))
    return c.select("seq", "well_id", "category", "outliers", r(F.col("net_score"), "net_score"), "severity", "gate")


@query(REC + WALK.format("tel") + f""", st AS (SELECT well_id, i, seq, ts AS since, wob AS value, true AS allowed FROM ix WHERE i = 1
  UNION ALL SELECT well_id, i, seq, CASE WHEN free THEN ts ELSE since END, CASE WHEN free THEN wob ELSE value END, free FROM (SELECT x.well_id, x.i, x.seq, x.ts, x.wob, s.since, s.value, x.ts - s.since >= 300 OR abs(x.wob - s.value) > 0.1 * greatest(abs(s.value), 1e-6) AS free FROM st s {NEXT}) a)
  SELECT seq, well_id, allowed FROM st""")
def recommendation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.apply(telemetry(spark, sf_dir), kernels.RateLimiter("wob")).select("seq", "well_id", "allowed")


CV_SQL = ", cv AS (SELECT *, CASE WHEN count(*) OVER w >= 5 AND avg(torque) OVER w > 0 THEN stddev_pop(torque) OVER w / avg(torque) OVER w ELSE 0 END AS cv FROM tel WINDOW w AS (PARTITION BY well_id ORDER BY ts, seq ROWS 59 PRECEDING))"


@query(RUN_REC + CV_SQL + WALK.format("cv") + f""", st AS (SELECT well_id, i, seq, CASE WHEN cv > 0.15 THEN ts END AS began, CASE WHEN cv > 0.15 THEN cv END AS base, CASE WHEN cv > 0.15 THEN 'advise' END AS damping FROM ix WHERE i = 1
  UNION ALL SELECT well_id, i, seq, CASE WHEN damping = 'advise' THEN ts WHEN damping = 'watch' THEN began END, CASE WHEN damping = 'advise' THEN cv WHEN damping = 'watch' THEN base END, damping FROM (
    SELECT x.well_id, x.i, x.seq, x.ts, x.cv, s.began, s.base, CASE WHEN s.began IS NULL THEN CASE WHEN x.cv > 0.15 THEN 'advise' END WHEN (x.cv - s.base) / s.base <= -0.2 THEN 'success' WHEN (x.cv - s.base) / s.base >= 0.15 THEN 'retract' WHEN x.ts - s.began >= 120 THEN 'escalate' ELSE 'watch' END AS damping FROM st s {NEXT}) a)
  SELECT seq, well_id, damping FROM st WHERE damping IS NOT NULL""")
def damping_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follows the variation of torque over the last 60 packets of a shift."""
    t = runs(spark, sf_dir).withColumn("cv", windows.variation(F.col("torque"), last_rows(60), 5))
    return kernels.apply(t, kernels.DampingMonitor()).filter("damping IS NOT NULL").select("seq", "well_id", "damping")


#: Events of shifts: tickets by the gate's walk, criticals and recommendations by walks over their own rows, damping and summaries with what is due before each packet.
EVENTS_SQL = f""", gm AS (SELECT *, severity AS word FROM met),
  gt AS (SELECT seq, well_id, ts, bit_depth, state, rule, category, false AS learning, true AS net_ok, NULL::BOOLEAN AS outlier, sv, sv = 'Critical' AS critical FROM (SELECT *, CASE category WHEN 'WellControl' THEN CASE WHEN abs(flow_balance) > 10 OR abs(pit_rate) > 15 THEN 'Critical' ELSE 'High' END WHEN 'Hydraulics' THEN CASE WHEN ecd_margin < 0.1 OR abs(spp_delta) > 200 THEN 'High' ELSE 'Medium' END
      WHEN 'Mechanical' THEN CASE WHEN torque_delta > 0.25 THEN 'High' ELSE 'Medium' END WHEN 'DrillingEfficiency' THEN CASE WHEN mse_efficiency < 50 THEN 'Medium' ELSE 'Low' END ELSE 'Low' END AS sv FROM gm) q)""" + GATE_SQL + CV_SQL.replace(", cv AS", ", vr AS").replace("FROM tel", "FROM met") + f""",
  vx AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY ts, seq) AS i FROM vr),
  cr AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY ts, seq) AS c FROM gm WHERE word = 'CRITICAL'),
  cw AS (SELECT well_id, c, ts AS since, true AS free, category, bit_depth, rule, ts FROM cr WHERE c = 1 UNION ALL SELECT x.well_id, x.c, CASE WHEN x.ts - w.since >= 30 THEN x.ts ELSE w.since END, x.ts - w.since >= 30, x.category, x.bit_depth, x.rule, x.ts FROM cw w JOIN cr x ON x.well_id = w.well_id AND x.c = w.c + 1),
  rp AS (SELECT well_id, i, ts, unnest(['wob', 'rpm', 'flow_in']) AS name, unnest([wob, rpm, flow_in]) AS v FROM vx),
  rw AS (SELECT well_id, name, i, ts, v, ts AS since, v AS held, true AS free FROM rp WHERE i = 1 UNION ALL SELECT well_id, name, i, ts, v, CASE WHEN free THEN ts ELSE since END, CASE WHEN free THEN v ELSE held END, free FROM (
    SELECT x.*, w.since, w.held, x.ts - w.since >= 300 OR abs(x.v - w.held) > 0.1 * greatest(abs(w.held), 1e-6) AS free FROM rw w JOIN rp x ON x.well_id = w.well_id AND x.name = w.name AND x.i = w.i + 1) a),
  dw AS (SELECT well_id, i, ts, cv, CASE WHEN cv > 0.15 THEN ts END AS began, CASE WHEN cv > 0.15 THEN cv END AS base, CASE WHEN cv > 0.15 THEN 'advise' END AS said, NULL::BIGINT AS late_at, NULL::DOUBLE AS late_cv FROM vx WHERE i = 1
    UNION ALL SELECT well_id, i, ts, cv, CASE WHEN said = 'advise' THEN ts WHEN said = 'watch' THEN b0 END, CASE WHEN said = 'advise' THEN cv WHEN said = 'watch' THEN c0 END, said, late_at, late_cv FROM (
      SELECT *, CASE WHEN b0 IS NULL THEN CASE WHEN cv > 0.15 THEN 'advise' END WHEN (cv - c0) / c0 <= -0.2 THEN 'success' WHEN (cv - c0) / c0 >= 0.15 THEN 'retract' WHEN ts - b0 >= 120 THEN 'escalate' ELSE 'watch' END AS said FROM (
        SELECT x.well_id, x.i, x.ts, x.cv, CASE WHEN w.began + 120 < x.ts THEN NULL ELSE w.began END AS b0, w.base AS c0, CASE WHEN w.began + 120 < x.ts THEN w.began + 120 END AS late_at, CASE WHEN w.began + 120 < x.ts THEN w.base END AS late_cv FROM dw w JOIN vx x ON x.well_id = w.well_id AND x.i = w.i + 1) a) b),
  sw AS (SELECT well_id, i, ts AS since, 1 AS n, rop AS sr, mse AS sm, bit_depth AS top, (SELECT count(*) FROM st g WHERE g.well_id = vx.well_id AND g.i = 1 AND g.gate = 'ticket') AS tk, NULL::BIGINT AS due_at, NULL::BIGINT AS pn, NULL::DOUBLE AS pr, NULL::DOUBLE AS pm, NULL::DOUBLE AS pt, NULL::BIGINT AS pk FROM vx WHERE i = 1
    UNION ALL SELECT well_id, i, CASE WHEN NOT over THEN since WHEN ts > since + 1200 THEN ts ELSE since + 600 END, CASE WHEN over THEN 1 ELSE n + 1 END, CASE WHEN over THEN rop ELSE sr + rop END, CASE WHEN over THEN mse ELSE sm + mse END, CASE WHEN over THEN bit_depth ELSE greatest(top, bit_depth) END, CASE WHEN over THEN hit ELSE tk + hit END,
      CASE WHEN over THEN since + 600 END, n, sr, sm, top, tk FROM (SELECT x.well_id, x.i, x.ts, x.rop, x.mse, x.bit_depth, (g.gate = 'ticket')::INT AS hit, w.since, w.n, w.sr, w.sm, w.top, w.tk, w.since + 600 < x.ts AS over FROM sw w JOIN vx x ON x.well_id = w.well_id AND x.i = w.i + 1 JOIN st g ON g.well_id = x.well_id AND g.i = x.i) a)
  SELECT g.well_id, x.ts AS "at", 'ticket' AS kind, x.category AS name, round(x.bit_depth, 5) AS value, x.sv AS detail FROM st g JOIN ix x ON x.well_id = g.well_id AND x.i = g.i WHERE g.gate = 'ticket'
  UNION ALL SELECT well_id, ts, 'critical', category, round(bit_depth, 5), rule FROM cw WHERE free
  UNION ALL SELECT well_id, ts, 'recommendation', name, round(v, 5), '' FROM rw WHERE free
  UNION ALL SELECT well_id, ts, 'damping', said, round(cv, 5), '' FROM dw WHERE said <> 'watch'
  UNION ALL SELECT well_id, late_at, 'damping', 'escalate', round(late_cv, 5), '' FROM dw WHERE late_at IS NOT NULL
  UNION ALL SELECT well_id, due_at, 'summary', 'rop', round(pr / pn, 5), pn || ' packets, ' || pk || ' tickets, depth ' || printf('%.1f', pt) FROM sw WHERE due_at IS NOT NULL"""


@query(RUN_REC.rstrip() + ", " + METRICS_SQL + EVENTS_SQL)
def shift_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets, criticals, damping, limited recommendations and summaries of shifts, as the streaming processor gives them."""
    m = drilling_metrics(runs(spark, sf_dir)).withColumn("cv", windows.variation(F.col("torque"), last_rows(60), 5))
    e = rig_events.events(processor.judged(m))
    return e.select("well_id", "at", "kind", "name", r(F.col("value"), "value", 5), "detail")


OPERATION_SQL = """CASE WHEN flow_in < 50 AND rpm < 10 THEN 'Static' WHEN flow_in >= 50 AND rpm < 10 AND wob < 5 THEN 'Circulating' WHEN rpm >= 10 OR wob >= 5 THEN 'ProductionDrilling' ELSE 'Static' END"""


@query(REC + f", op AS (SELECT *, {OPERATION_SQL} AS o FROM tel)" + WALK.format("op") + f""", st AS (SELECT well_id, i, seq, o AS now, CAST(NULL AS VARCHAR) AS nxt, 0 AS run FROM ix WHERE i = 1
  UNION ALL SELECT well_id, i, seq, CASE WHEN o <> now AND r >= 3 THEN o ELSE now END, CASE WHEN o = now OR r >= 3 THEN NULL ELSE o END, CASE WHEN o = now OR r >= 3 THEN 0 ELSE r END FROM (SELECT x.well_id, x.i, x.seq, x.o, s.now, CASE WHEN x.o = s.nxt THEN s.run + 1 ELSE 1 END AS r FROM st s {NEXT}) a)
  SELECT seq, well_id, now AS steady FROM st""")
def steady_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).withColumn("operation", states.operation(*[F.col(c) for c in ("flow_in", "rpm", "wob", "torque", "rop")], F.lit(False)))
    return windows.debounced(t, "operation").select("seq", "well_id", "steady")


@query(TEL + FORMATION_SQL + """, ah AS (SELECT t.well_id, t.seq, t.ts, f.formation FROM tel t ASOF JOIN fm f ON t.bit_depth < f.top WHERE (f.top - t.bit_depth) / t.rop * 60 <= 30)
  SELECT well_id, formation, arg_min(seq, ts * 10000000 + seq) AS seq FROM ah GROUP BY 1, 2""")
def look_ahead_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first packet that comes within 30 minutes of each boundary at its present rate."""
    t = with_neighbours(spark, sf_dir, telemetry(spark, sf_dir).select("well_id", "seq", "ts", "bit_depth", "rop"))
    near = t.filter(minutes_to(F.col("next_mark"), F.col("bit_depth"), F.col("rop")) <= 30)
    return near.groupBy("well_id", F.col("next_name").alias("formation")).agg(F.min_by("seq", F.struct("ts", "seq")).alias("seq"))


@query()
def liquid_net_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and surprises of the online nets, regimes of their motor values and transitions, which no SQL expresses; tests check gradients, learning, lock step and feedback."""
    n = with_nets(spark, sf_dir, TacticalNets(("net_score", "net_calibrated", "net_surprised", "net_surprises", "regime", "transition"))).filter("net_score IS NOT NULL")
    names = F.array_join(F.transform("net_surprises", lambda s: s["name"]), ",")
    return n.select("seq", "well_id", r(F.col("net_score"), "net_score"), "net_calibrated", "net_surprised", names.alias("surprises"), "regime", "transition")


@query()
def depth_ahead_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of the depth-ahead net, which transitions reset; tests check its nets."""
    n = with_nets(spark, sf_dir, TacticalNets(("ahead_confidence", "ahead_calibrated"))).filter("ahead_confidence IS NOT NULL")
    return n.select("seq", "well_id", r(F.col("ahead_confidence"), "ahead_confidence"), "ahead_calibrated")
