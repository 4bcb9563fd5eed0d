"""Row-wise physics, states, quality rules, the anomaly cascade and votes over the telemetry view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mudline.functions import anomalies, physics, states, tickets, voting
from mudline.functions.digits import rounded
from mudline.functions.frames import last_rows, ordered, so_far
from mudline.operators import quality
from mudline.operators.metrics import METRICS_SQL, STATE_SQL, drilling_metrics, with_state
from mudline.registry import query
from mudline.telemetry import NAMES, TELEMETRY_SQL, telemetry

TEL, MET = f"WITH {TELEMETRY_SQL} ", f"WITH {TELEMETRY_SQL}, {METRICS_SQL} "
REC, REC_MET = f"WITH RECURSIVE {TELEMETRY_SQL} ", f"WITH RECURSIVE {TELEMETRY_SQL}, {METRICS_SQL} "


def r(x: Column, name: str, digits: int = 6) -> Column:
    return rounded(x, digits).alias(name)


def cols(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


@query(TEL + "SELECT seq, well_id, ts, " + ", ".join(f"round({c}, 6) AS {c}" for c in [*NAMES, "bit_depth", "hole_depth"]) + " FROM tel")
def telemetry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).select("seq", "well_id", "ts", *[r(F.col(c), c) for c in [*NAMES, "bit_depth", "hole_depth"]])


@query(TEL + f"SELECT state, count(*) AS n FROM (SELECT {STATE_SQL} AS state FROM tel) GROUP BY state")
def rig_state_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_state(telemetry(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("n"))


@query(TEL + """SELECT seq, CASE WHEN rpm > 20 AND wob > 5 AND rop > 2 THEN 'Drilling' WHEN rpm > 20 AND wob > 2 AND rop <= 0 THEN 'Reaming' WHEN rpm > 0 AND wob < 5 THEN 'Circulating'
  WHEN rpm < 5 AND k % 3 > 0 AND hook_load > 150 THEN 'TrippingOut' WHEN rpm < 5 AND k % 3 > 0 THEN 'TrippingIn' WHEN rpm < 5 AND hook_load > 50 AND hook_load < 200 THEN 'Connection' ELSE 'Idle' END AS feed_state,
  CASE WHEN rpm > 20 AND wob > 5 AND rop > 0 THEN 'Drilling' WHEN rpm > 20 AND wob > 2 THEN 'Reaming' WHEN rpm > 0 AND wob < 5 THEN 'Circulating' WHEN rpm < 5 AND hook_load > 50 AND hook_load < 200 THEN 'Connection' ELSE 'Idle' END AS csv_state FROM tel""")
def rig_state_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    return t.select("seq", states.rig_state_from_feed(*cols("rpm", "wob", "hook_load", "rop"), F.col("k") % 3).alias("feed_state"), states.rig_state_from_csv(*cols("rpm", "wob", "hook_load", "rop")).alias("csv_state"))


@query(TEL + """SELECT seq, CASE WHEN flow_in < 50 AND rpm < 10 THEN 'Static' WHEN flow_in >= 50 AND rpm < 10 AND wob < 5 THEN 'Circulating'
  WHEN k % 2 = 0 AND flow_in >= 50 AND rpm >= 10 AND torque >= 15 AND rop < 5 THEN 'Milling' WHEN k % 2 = 0 AND flow_in >= 50 AND rpm >= 10 AND wob >= 15 AND torque >= 12 AND rop > 0 AND rop < 20 THEN 'CementDrillOut'
  WHEN rpm >= 10 OR wob >= 5 THEN 'ProductionDrilling' ELSE 'Static' END AS operation FROM tel""")
def operation_by_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    return t.select("seq", states.operation(*cols("flow_in", "rpm", "wob", "torque", "rop"), F.col("k") % 2 == 0).alias("operation"))


@query(MET + "SELECT seq, well_id, state, round(mse, 4) AS mse, round(hardness, 6) AS hardness, round(5000 + hardness * 8000, 4) AS optimal_mse, round(mse_efficiency, 6) AS mse_efficiency FROM met")
def mse_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = drilling_metrics(telemetry(spark, sf_dir))
    return m.select("seq", "well_id", "state", r(F.col("mse"), "mse", 4), r(F.col("hardness"), "hardness"), r(physics.optimal_mse(F.col("hardness")), "optimal_mse", 4), r(F.col("mse_efficiency"), "mse_efficiency"))


@query(TEL + """SELECT seq, round(CASE WHEN rop > 0 AND rpm > 0 AND wob > 0 AND abs(log10(12 * wob / bit_diameter)) >= 1e-10 THEN greatest(log10(rop / (60 * rpm)) / log10(12 * wob / bit_diameter), 0) ELSE 0 END, 6) AS d_exponent,
  round(CASE WHEN rop > 0 AND rpm > 0 AND wob > 0 THEN log10(rop / (60 * rpm)) / log10(12 * wob / (1000 * bit_diameter)) ELSE 0 END, 6) AS textbook,
  round(8.6 / mud_weight_in, 6) AS dxc_of_one, round(0.1 * flow_in * bit_depth / 1000, 6) AS pressure_loss, round(mud_weight_in + 0.1 * flow_in * bit_depth / 1000 / (0.052 * bit_depth), 6) AS ecd_model,
  round(fracture_gradient - ecd, 6) AS margin FROM tel""")
def exponents_and_hydraulics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    loss = physics.annular_pressure_loss(*cols("flow_in", "bit_depth"))
    return t.select(
        "seq", r(physics.d_exponent(*cols("rop", "rpm", "wob", "bit_diameter")), "d_exponent"), r(physics.d_exponent_textbook(*cols("rop", "rpm", "wob", "bit_diameter")), "textbook"),
        r(physics.dxc(F.lit(1.0), F.col("mud_weight_in")), "dxc_of_one"), r(loss, "pressure_loss"), r(physics.ecd(F.col("mud_weight_in"), loss, F.col("bit_depth")), "ecd_model"), r(physics.ecd_margin(*cols("fracture_gradient", "ecd")), "margin"),
    )


@query(MET + """SELECT seq, kick_n >= 2 AS kick, round(CASE WHEN kick_n > 0 THEN least(kick_sum / kick_n, 1) ELSE 0 END, 6) AS kick_severity, loss_n >= 2 AS loss, round(CASE WHEN loss_n > 0 THEN least(loss_sum / loss_n, 1) ELSE 0 END, 6) AS loss_severity,
  torque_delta > 0.15 AND (spp_delta / 2500 > 0.1 OR -(rop - prev_rop) / nullif(prev_rop, 0) > 0.2) AS packed, round(CASE WHEN pn > 0 THEN least(ps / pn, 1) ELSE 0 END, 6) AS packed_severity, founders AS founder FROM (
    SELECT *, (torque_delta > 0.15)::INT + (spp_delta / 2500 > 0.1)::INT + (rd > 0.2)::INT AS pn, CASE WHEN torque_delta > 0.15 THEN least(torque_delta / 0.3, 1) ELSE 0 END + CASE WHEN spp_delta / 2500 > 0.1 THEN least(spp_delta / 2500 / 0.25, 1) ELSE 0 END + CASE WHEN rd > 0.2 THEN least(rd / 0.5, 1) ELSE 0 END AS ps FROM (SELECT *, coalesce(-(rop - prev_rop) / nullif(prev_rop, 0), 0) AS rd FROM met WHERE prev_ts IS NOT NULL) a) b""")
def kick_loss_packoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = drilling_metrics(telemetry(spark, sf_dir)).filter("prev_ts IS NOT NULL")
    kick, ks = physics.kick(*cols("flow_in", "flow_out", "pit_change", "gas_units", "background_gas"))
    loss, ls = physics.lost_circulation(*cols("flow_in", "flow_out", "pit_change"), F.greatest(F.col("spp_delta"), F.lit(0.0)))
    drop = F.coalesce(-physics.ratio(F.col("rop") - F.col("prev_rop"), F.col("prev_rop")), F.lit(0.0))
    packed, ps = physics.packoff(F.col("torque_delta"), F.col("spp_delta") / 2500, drop)
    founder, _, _ = physics.founder_quick(*cols("prev_wob", "prev_rop", "wob", "rop"))
    return m.select("seq", kick.alias("kick"), r(ks, "kick_severity"), loss.alias("loss"), r(ls, "loss_severity"), packed.alias("packed"), r(ps, "packed_severity"), founder.alias("founder"))


@query(MET + "SELECT seq, well_id, state, rule, category, severity, round(pit_rate, 5) AS pit_rate, round(torque_delta, 6) AS torque_delta, round(spp_delta, 5) AS spp_delta, round(pit_change, 6) AS pit_change FROM met")
def anomaly_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = drilling_metrics(telemetry(spark, sf_dir))
    return m.select("seq", "well_id", "state", "rule", "category", "severity", r(F.col("pit_rate"), "pit_rate", 5), r(F.col("torque_delta"), "torque_delta"), r(F.col("spp_delta"), "spp_delta", 5), r(F.col("pit_change"), "pit_change"))


@query(MET + "SELECT category, severity, count(*) AS n, round(avg(mse_efficiency), 5) AS avg_efficiency, round(max(bit_depth), 4) AS max_depth FROM met GROUP BY category, severity")
def anomaly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = drilling_metrics(telemetry(spark, sf_dir))
    return m.groupBy("category", "severity").agg(F.count("*").alias("n"), r(F.avg("mse_efficiency"), "avg_efficiency", 5), r(F.max("bit_depth"), "max_depth", 4))


VOTES_SQL = """
tr AS (SELECT *, coalesce(dxc - lag(dxc) OVER w, 0) AS dxc_trend, coalesce((wob - lag(wob) OVER w) / 30, 0) AS wob_trend, coalesce((rop - lag(rop) OVER w) / 80, 0) AS rop_trend, seq % 6 AS regime FROM met WINDOW w AS (PARTITION BY well_id ORDER BY ts, seq)),
sp AS (SELECT *, CASE WHEN wob_trend > 0.05 AND rop_trend <= 0 THEN least(wob_trend * 5, 1) ELSE 0 END * 0.25 + CASE WHEN torque_delta > 0.15 THEN least((torque_delta - 0.15) * 4, 1) ELSE 0 END * 0.25
  + CASE WHEN spp_delta > hardness * 10 + 50 THEN least((spp_delta - hardness * 10 - 50) / 200, 1) ELSE 0 END * 0.2
  + CASE WHEN rop < 2 AND wob > 10 THEN (1 - least(rop / 2, 1)) * least((wob - 10) / 20, 1) ELSE 0 END * 0.2 + CASE WHEN rule = 'torque' THEN 0.06 ELSE 0 END AS stuck FROM tr),
vo AS (SELECT *, CASE WHEN mse_efficiency <= 0 THEN 1 WHEN mse_efficiency < 50 THEN 3 WHEN mse_efficiency < 70 THEN 2 ELSE 1 END AS v_mse,
  CASE WHEN ecd_margin < 0.1 THEN 4 WHEN ecd_margin < 0.3 OR abs(spp_delta) > 200 THEN 3 WHEN abs(spp_delta) > 100 THEN 2 ELSE 1 END AS v_hyd,
  CASE WHEN abs(flow_balance) > 10 OR abs(pit_rate) > 15 THEN 4 WHEN abs(flow_balance) > 5 OR abs(pit_rate) > 5 THEN 3 WHEN abs(pit_rate) > 2 THEN 2 ELSE 1 END AS v_wc,
  CASE WHEN dxc_trend < -0.15 THEN 3 WHEN abs(dxc_trend) > 0.1 THEN 2 ELSE 1 END AS v_for, CASE WHEN stuck > 0.7 THEN 4 WHEN stuck > 0.5 THEN 3 WHEN stuck > 0.3 THEN 2 ELSE 1 END AS v_st,
  0.2 * CASE regime WHEN 0 THEN 1 WHEN 1 THEN 0.8 WHEN 2 THEN 1.4 ELSE 0.7 END AS w_mse, 0.2 * CASE regime WHEN 0 THEN 1 WHEN 1 THEN 1.4 WHEN 2 THEN 0.8 ELSE 1 END AS w_hyd, 0.3 * CASE regime WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0.9 ELSE 1.5 END AS w_wc,
  0.15 * CASE regime WHEN 0 THEN 1 WHEN 1 THEN 0.8 WHEN 2 THEN 1.1 ELSE 0.8 END AS w_for, 0.15 * CASE regime WHEN 0 THEN 1 WHEN 1 THEN 1.3 WHEN 2 THEN 1.4 ELSE 0.8 END AS w_st FROM sp),
su AS (SELECT *, (v_mse * w_mse + v_hyd * w_hyd + v_wc * w_wc + v_for * w_for + v_st * w_st) / (w_mse + w_hyd + w_wc + w_for + w_st) AS total,
  (v_mse = 4)::INT + (v_hyd = 4)::INT + (v_wc = 4)::INT + (v_for = 4)::INT + (v_st = 4)::INT AS n4, (v_mse = 3)::INT + (v_hyd = 3)::INT + (v_wc = 3)::INT + (v_for = 3)::INT + (v_st = 3)::INT AS n3 FROM vo)
"""


VOTE_INPUTS = {k: k for k in ("ecd_margin", "spp_delta", "flow_balance", "pit_rate", "dxc_trend", "wob_trend", "rop_trend", "torque_delta", "hardness", "rop", "wob", "drag")} | {"efficiency": "mse_efficiency"}


def voted(m: DataFrame) -> DataFrame:
    """``vote_`` of each specialist, with trends against the packet before and a regime by packet."""
    change = lambda x, by: F.coalesce((F.col(x) - F.lag(x).over(ordered())) / by, F.lit(0.0))
    m = m.withColumns({"dxc_trend": change("dxc", 1.0), "wob_trend": change("wob", 30.0), "rop_trend": change("rop", 80.0), "regime": F.col("seq") % 6, "drag": F.col("rule") == "torque"})
    p = {k: F.col(v) for k, v in VOTE_INPUTS.items()}
    return m.withColumns({f"vote_{k}": f(p, voting.DEFAULT) for k, f in voting.SPECIALISTS.items()})


@query(MET + f", {VOTES_SQL}" + """SELECT seq, round(stuck, 6) AS stuck, round(total, 6) AS total, CASE WHEN v_wc = 4 OR round(total, 9) > 3.5 THEN 'Critical' WHEN round(total, 9) > 2.5 THEN 'High' WHEN round(total, 9) > 1.5 THEN 'Medium' WHEN total > 0.5 THEN 'Low' ELSE 'Healthy' END AS final,
  CASE WHEN n4 > 0 THEN 'Critical' WHEN category = 'WellControl' OR n3 >= 2 THEN 'High' WHEN n3 >= 1 THEN 'Elevated' ELSE 'Low' END AS risk,
  CAST(floor(greatest(least(mse_efficiency - CASE category WHEN 'WellControl' THEN 30 WHEN 'Hydraulics' THEN 20 WHEN 'Mechanical' THEN 15 WHEN 'DrillingEfficiency' THEN 10 ELSE 0 END + CASE WHEN dxc_trend < 0 AND mse_efficiency > 70 THEN 5 ELSE 0 END, 100), 0)) AS INTEGER) AS efficiency_score FROM su""")
def ensemble_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = voted(drilling_metrics(telemetry(spark, sf_dir)))
    p = {k: F.col(v) for k, v in VOTE_INPUTS.items()}
    votes = {k: F.col(f"vote_{k}") for k in voting.SPECIALISTS}
    # in columns of their own, so that what follows does not compute them for each comparison
    m = m.withColumn("weighed", voting.weighted_sum(votes, F.col("regime"))).withColumn("rounded", F.round("weighed", 9))
    total = F.col("weighed")
    final = F.when(votes["well_control"] == "Critical", "Critical").otherwise(voting.final_severity(F.col("rounded")))
    score = anomalies.efficiency_score(F.col("mse_efficiency"), F.col("category") != "None", F.col("category"), F.col("dxc_trend"))
    return m.select("seq", r(voting.stuck_pipe_score(p), "stuck"), r(total, "total"), final.alias("final"), voting.risk_level(votes, F.col("category")).alias("risk"), score.alias("efficiency_score"))


@query(TEL + """SELECT seq, round(pc, 6) AS pressure_change, round(emw, 6) AS emw, round(emw - pore_pressure, 6) AS to_pore, round(fracture_gradient - emw, 6) AS to_fracture,
  CASE WHEN still THEN 'Safe' WHEN emw - pore_pressure < 0 OR fracture_gradient - emw < 0 THEN 'Critical' WHEN emw - pore_pressure < 0.3 OR fracture_gradient - emw < 0.3 THEN 'Warning' ELSE 'Safe' END AS risk FROM (
  SELECT *, mud_weight_in + CASE WHEN still THEN 0 ELSE pc / (0.052 * bit_depth) END AS emw FROM (
  SELECT *, k % 40 < 1 AS still, CASE WHEN k % 40 < 1 THEN 0 ELSE CASE WHEN k % 2 = 0 THEN 0.45 ELSE -0.45 END * (15 * ((k % 40) * 25.0 / (8.5 * 8.5 - 25.0)) * bit_depth / (60000 * 1.75 * 1.75) + 10 * bit_depth / (200 * 1.75)) END AS pc FROM tel) a) b""")
def swab_surge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    s = physics.swab_surge((F.col("k") % 40).cast("double"), *cols("bit_depth", "mud_weight_in", "pore_pressure", "fracture_gradient", "bit_diameter"), F.col("k") % 2 == 0)
    return t.withColumn("s", s).select("seq", *[r(F.col(f"s.{x}"), x) for x in ("pressure_change", "emw", "to_pore", "to_fracture")], "s.risk")


@query(TEL + """SELECT seq, round(CASE WHEN wob >= 3 THEN greatest(wob * (1 - least(CASE WHEN k % 2 = 0 THEN 10 + 5 * s ELSE 10 END, 20) / 100), 3) END, 6) AS new_wob,
  round(CASE WHEN wob >= 3 THEN CASE WHEN k % 2 = 0 THEN least(rpm * (1 + least(5 + 5 * s, 20) / 100), rpm * 1.5) ELSE rpm END END, 6) AS new_rpm FROM (SELECT *, greatest(least(k / 100.0, 1), 0.5) AS s FROM tel) a""")
def damping_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    new_wob, new_rpm = physics.damping(F.when(F.col("k") % 2 == 0, "StickSlip").otherwise("Torsional"), F.col("k") / 100.0, F.col("wob"), F.col("rpm"))
    return t.select("seq", r(new_wob, "new_wob"), r(new_rpm, "new_rpm"))


@query(TEL + """SELECT seq, round(k / 10.0, 6) AS miners, round(CASE WHEN rpm > 0 AND wob > 0 THEN 1e6 / (60 * rpm) * pow(30.0 / wob, 3) ELSE 0 END, 4) AS l10, round(k * 9.0 / 5 + 32, 6) AS from_c, round(CASE WHEN k <= 0 THEN 0 ELSE (k * 10 - 273.15) * 9.0 / 5 + 32 END, 6) AS from_k,
  round(1 / (1 + exp(-(k - 50) / 10.0)), 8) AS sig, round(CASE WHEN k > 20 THEN k ELSE ln(1 + exp(k)) END, 8) AS soft,
  CASE WHEN k / 100.0 - 0.5 > 0.2 AND wob > 10 AND value % 1 > 0.05 THEN 'HardStringer' WHEN k / 100.0 - 0.5 < -0.2 AND wob < 10 THEN 'SoftStringer' WHEN value % 1 < -0.05 AND abs(k / 100.0 - 0.5) < 0.1 THEN 'PressureIncrease' ELSE 'None' END AS change FROM (SELECT t.*, e.value FROM tel t JOIN events e ON t.seq = e.event_id) a""")
def component_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), "value"), "seq")
    k = F.col("k").cast("double")
    return t.select(
        "seq", r(physics.miners_rule(F.col("k"), F.lit(10.0)), "miners"), r(physics.l10_life(F.col("rpm"), F.col("wob"), F.lit(30.0)), "l10", 4), r(physics.fahrenheit_from_celsius(k), "from_c"), r(physics.fahrenheit_from_kelvin(k * 10), "from_k"),
        r(physics.sigmoid((k - 50) / 10), "sig", 8), r(physics.softplus(k), "soft", 8), physics.formation_change(F.col("wob") - 10, F.col("value") % 1, k / 100 - 0.5).alias("change"),
    )


QUALITY_SQL = """
q AS (SELECT seq, well_id, ts, bit_depth, hole_depth, CASE WHEN k = 3 THEN -5 ELSE rop END AS rop, CASE WHEN k = 7 THEN 250 ELSE wob END AS wob, CASE WHEN k = 11 THEN 900 WHEN k = 12 THEN -3 ELSE rpm END AS rpm, CASE WHEN k = 13 THEN -2 ELSE torque END AS torque,
  CASE WHEN k = 17 THEN 12000 ELSE spp END AS spp, flow_in, flow_out, CASE WHEN k = 19 THEN -1 ELSE hook_load END AS hook_load, CASE WHEN k = 23 THEN 30 ELSE ecd END AS ecd, mud_weight_in, h2s, k FROM tel),
qi AS (SELECT *, (rop < -1)::INT + (rop > 1000)::INT + (wob > 200)::INT + (rpm > 500)::INT + (torque < -50)::INT + (torque > 100)::INT + (spp > 10000)::INT + (hook_load < 0)::INT + (hook_load > 1000)::INT + (ecd <> 0 AND (ecd < 5 OR ecd > 25))::INT + (mud_weight_in < 0 OR mud_weight_in > 25)::INT + (bit_depth < 0)::INT AS critical,
  (abs(bit_depth) < 2.3e-16)::INT + (abs(flow_in) < 2.3e-16)::INT + (rpm < 0)::INT + (spp < 0)::INT + (h2s < 0)::INT + (flow_out > 0 AND flow_in < 2.3e-16)::INT + (bit_depth > 0 AND hole_depth > 0 AND bit_depth > hole_depth + 10)::INT + (ts = 0)::INT AS warning FROM q)
"""


def _dirty(t: DataFrame) -> DataFrame:
    k = F.col("k")
    bad = {"rop": {3: -5.0}, "wob": {7: 250.0}, "rpm": {11: 900.0, 12: -3.0}, "torque": {13: -2.0}, "spp": {17: 12000.0}, "hook_load": {19: -1.0}, "ecd": {23: 30.0}}
    return t.withColumns({c: F.coalesce(*[F.when(k == at, F.lit(v)) for at, v in cases.items()], F.col(c)) for c, cases in bad.items()})


@query(TEL + f", {QUALITY_SQL} SELECT seq, CAST(critical AS BIGINT) AS n_critical, CAST(warning AS BIGINT) AS n_warning, critical = 0 AS usable FROM qi")
def packet_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.with_issues(_dirty(telemetry(spark, sf_dir)))
    n = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s)).cast("long")
    return q.select("seq", n("Critical").alias("n_critical"), n("Warning").alias("n_warning"), "usable")


@query(TEL + f", {QUALITY_SQL} SELECT seq, round(greatest(rop, 0), 6) AS rop, round(greatest(rpm, 0), 6) AS rpm, round(greatest(torque, 0), 6) AS torque, round(wob, 6) AS wob, round(greatest(spp, 0), 6) AS spp FROM qi WHERE critical = 0")
def sanitized_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.sanitize(_dirty(telemetry(spark, sf_dir)))
    return q.select("seq", *[r(F.col(c), c) for c in ("rop", "rpm", "torque", "wob", "spp")])


@query(MET + """SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM (SELECT CASE WHEN wob < 5 THEN 'LowWob' WHEN rpm < 40 THEN 'LowRpm' WHEN mse < 1000 OR mse > 500000 THEN 'InvalidMse' WHEN rop < 1 OR rop > 500 THEN 'InvalidRop' WHEN state NOT IN ('Drilling', 'Reaming') THEN 'WrongRigState' END AS reason FROM met) GROUP BY 1""")
def ml_quality_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = drilling_metrics(telemetry(spark, sf_dir))
    return m.select(F.coalesce(quality.rejection(F.col("wob"), F.col("rpm"), F.col("mse"), F.col("rop"), F.col("state")), F.lit("valid")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(MET + """SELECT seq, CASE WHEN category = 'None' THEN 'Low' WHEN severity = 'CRITICAL' THEN 'Critical' WHEN severity = 'HIGH' THEN 'High' ELSE 'Medium' END AS base,
  list_element(['Low', 'Medium', 'High', 'Critical'], CAST(greatest(least(lv + CASE WHEN seq % 8 < 2 AND NOT (category = 'WellControl' AND lv < 4) THEN -1 WHEN seq % 8 >= 5 THEN 1 ELSE 0 END, 4), 1) AS INTEGER)) AS by_intervals,
  list_element(['Low', 'Medium', 'High', 'Critical'], CAST(greatest(least(lv + CASE WHEN category = 'WellControl' THEN greatest(st, CASE WHEN lv < 4 THEN 0 ELSE -1 END) ELSE st END, 4), 1) AS INTEGER)) AS by_nets FROM (
  SELECT *, CASE WHEN category = 'None' THEN 1 WHEN severity = 'CRITICAL' THEN 4 WHEN severity = 'HIGH' THEN 3 ELSE 2 END AS lv, CASE WHEN k < 20 THEN -2 WHEN k < 40 THEN -1 WHEN k >= 80 THEN 2 WHEN k >= 60 THEN 1 ELSE 0 END AS st FROM met) a""")
def severity_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = drilling_metrics(telemetry(spark, sf_dir))
    base = F.when(F.col("category") == "None", "Low").when(F.col("severity") == "CRITICAL", "Critical").when(F.col("severity") == "HIGH", "High").otherwise("Medium")
    m = m.withColumn("base", base)
    return m.select("seq", "base", anomalies.aci_adjusted(F.col("base"), F.col("category"), F.col("seq") % 8).alias("by_intervals"), anomalies.net_adjusted(F.col("base"), F.col("category"), F.col("k") / 100.0).alias("by_nets"))


PARTS = {"category": "category", "flow_balance": "flow_balance", "pit_rate": "pit_rate", "ecd_margin": "ecd_margin", "spp_delta": "spp_delta", "torque_delta": "torque_delta", "efficiency": "mse_efficiency", "gas": "gas_units", "h2s": "h2s", "d_exponent": "d_exponent"}


@query(MET + """SELECT seq, CASE category WHEN 'WellControl' THEN CASE WHEN abs(flow_balance) > 10 OR abs(pit_rate) > 15 THEN 'Critical' ELSE 'High' END WHEN 'Hydraulics' THEN CASE WHEN ecd_margin < 0.1 OR abs(spp_delta) > 200 THEN 'High' ELSE 'Medium' END
  WHEN 'Mechanical' THEN CASE WHEN torque_delta > 0.25 THEN 'High' ELSE 'Medium' END WHEN 'DrillingEfficiency' THEN CASE WHEN mse_efficiency < 50 THEN 'Medium' ELSE 'Low' END END AS base,
  CASE category WHEN 'WellControl' THEN CASE WHEN abs(flow_balance) > 10 OR abs(pit_rate) > 15 THEN 'Intervention' ELSE 'RiskWarning' END WHEN 'Hydraulics' THEN 'RiskWarning' WHEN 'Mechanical' THEN CASE WHEN torque_delta > 0.25 THEN 'Intervention' ELSE 'RiskWarning' END ELSE 'Optimization' END AS kind,
  CASE category WHEN 'WellControl' THEN CASE WHEN abs(flow_balance) > 5 THEN 'flow_balance' ELSE 'pit_rate' END WHEN 'Hydraulics' THEN CASE WHEN ecd_margin < 0.3 THEN 'ecd_margin' ELSE 'spp_delta' END WHEN 'Mechanical' THEN 'torque_delta' ELSE 'mse_efficiency' END AS parameter,
  round(CASE category WHEN 'WellControl' THEN CASE WHEN abs(flow_balance) > 5 THEN flow_balance ELSE pit_rate END WHEN 'Hydraulics' THEN CASE WHEN ecd_margin < 0.3 THEN ecd_margin ELSE spp_delta END WHEN 'Mechanical' THEN torque_delta ELSE mse_efficiency END, 5) AS value,
  CAST((abs(flow_balance) > 5)::INT + (abs(pit_rate) > 5)::INT + (gas_units > 100)::INT + (h2s > 10)::INT + (ecd_margin < 0.3)::INT + (abs(spp_delta) > 100)::INT + (torque_delta * 100 > 15)::INT + (mse_efficiency < 70)::INT AS BIGINT) AS n_breaches,
  concat_ws(',', CASE WHEN abs(flow_balance) > 5 THEN 'flow_balance' END, CASE WHEN abs(pit_rate) > 5 THEN 'pit_rate' END, CASE WHEN gas_units > 100 THEN 'gas_units' END, CASE WHEN h2s > 10 THEN 'h2s' END, CASE WHEN ecd_margin < 0.3 THEN 'ecd_margin' END, CASE WHEN abs(spp_delta) > 100 THEN 'spp_delta' END, CASE WHEN torque_delta * 100 > 15 THEN 'torque_increase' END, CASE WHEN mse_efficiency < 70 THEN 'mse_efficiency' END) AS breaches,
  CAST((abs(flow_balance) > 10)::INT + (abs(pit_rate) > 15)::INT + (gas_units > 250)::INT + (h2s > 20)::INT + (ecd_margin < 0.1)::INT + (abs(spp_delta) > 200)::INT + (torque_delta * 100 > 25)::INT + (mse_efficiency < 50)::INT AS BIGINT) AS n_critical,
  CASE category WHEN 'WellControl' THEN CASE WHEN flow_balance > 10 THEN 'Kick' WHEN flow_balance > 5 THEN 'Kick Warning' WHEN flow_balance < -10 THEN 'Lost Circulation' WHEN flow_balance < -5 THEN 'Loss Warning' WHEN gas_units > 250 OR h2s > 20 THEN 'Gas Critical' WHEN gas_units > 100 THEN 'Gas Warning' WHEN abs(pit_rate) > 15 THEN 'Pit Rate Critical' ELSE 'Well Control Warning' END
  WHEN 'Hydraulics' THEN CASE WHEN ecd_margin < 0.1 THEN 'ECD Critical' WHEN ecd_margin < 0.3 THEN 'ECD Warning' WHEN abs(spp_delta) > 200 THEN 'SPP Critical' ELSE 'SPP Warning' END
  WHEN 'Mechanical' THEN CASE WHEN torque_delta > 0.25 AND spp_delta > 100 THEN 'Pack-off' WHEN torque_delta > 0.15 AND spp_delta > 0 THEN 'Pack-off Warning' WHEN torque_delta > 0.15 THEN 'Stick-slip' ELSE 'Founder' END ELSE CASE WHEN mse_efficiency < 50 THEN 'MSE Inefficiency' ELSE 'MSE Warning' END END AS pattern FROM met WHERE category <> 'None'""")
def ticket_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = drilling_metrics(telemetry(spark, sf_dir)).filter("category <> 'None'")
    p = {k: F.col(v) for k, v in PARTS.items()}
    base, kind = tickets.base_severity(p)
    m = m.withColumns({"t": tickets.trigger(p), "b": tickets.breaches(p)})
    return m.select("seq", base.alias("base"), kind.alias("kind"), "t.parameter", r(F.col("t.value"), "value", 5), F.size("b").cast("long").alias("n_breaches"), F.array_join(F.transform("b", lambda x: x["parameter"]), ",").alias("breaches"), F.size(F.filter("b", lambda x: x["level"] == "CRITICAL")).cast("long").alias("n_critical"), tickets.pattern(p).alias("pattern"))


@query(MET + """, av AS (SELECT *, avg(flow_balance) OVER w5 AS flow5, avg(pit_rate) OVER w5 AS pit5, avg(ecd_margin) OVER w10 AS ecd10, avg(spp_delta) OVER w10 AS spp10, avg(torque_delta) OVER w10 AS torque10, count(*) OVER wa AS n, sum((category <> 'None')::INT) OVER w10 >= 3 AS sustained, CASE WHEN k % 5 < 4 THEN k / 100.0 END AS net, (k % 10) / 10.0 AS cons FROM met
  WINDOW w5 AS (PARTITION BY well_id ORDER BY ts, seq ROWS 4 PRECEDING), w10 AS (PARTITION BY well_id ORDER BY ts, seq ROWS 9 PRECEDING), wa AS (PARTITION BY well_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
  ca AS (SELECT seq, net, CASE category
  WHEN 'WellControl' THEN CASE WHEN abs(flow5) > 15 OR abs(pit5) > 10 THEN CASE WHEN abs(flow5) > 20 OR abs(pit5) > 15 THEN 'C:Critical' ELSE 'C:High' END WHEN (sustained OR n >= 3) AND (abs(flow5) > 5 OR abs(pit5) > 3) THEN 'C:High' WHEN NOT (sustained OR n >= 3) AND abs(flow5) < 5 THEN 'R:Healthy' ELSE 'U:Medium' END
  WHEN 'Hydraulics' THEN CASE WHEN ecd10 < 0.1 THEN 'C:Critical' WHEN abs(spp10) > 150 AND sustained THEN 'C:High' WHEN ecd10 < 0.3 THEN 'C:Medium' WHEN abs(spp10) < 50 AND ecd10 > 0.3 THEN 'R:Healthy' ELSE 'U:Low' END
  WHEN 'Mechanical' THEN CASE WHEN rule = 'founder' THEN CASE WHEN k >= 70 AND NOT (k % 3 = 0) THEN 'C:High' WHEN k >= 30 THEN 'C:Medium' ELSE 'C:Low' END WHEN k % 4 = 0 AND cons > 0.5 THEN 'C:Medium' WHEN (torque_delta > 0.25 AND spp_delta > 100) OR (torque10 > 0.25 AND sustained) THEN CASE WHEN k % 3 = 0 THEN 'C:Medium' ELSE 'C:High' END WHEN torque10 > 0.15 THEN 'U:Medium' ELSE 'R:Healthy' END
  ELSE CASE WHEN mse_efficiency < 50 AND cons > 0.5 THEN 'C:Medium' WHEN mse_efficiency < 70 AND sustained THEN 'C:Low' WHEN mse_efficiency >= 70 THEN 'R:Healthy' ELSE 'U:Low' END END AS v FROM av WHERE category <> 'None')
  SELECT seq, CASE WHEN v LIKE 'C:%' THEN 'Confirmed' WHEN v LIKE 'R:%' THEN 'Rejected' WHEN net >= 0.65 THEN 'Confirmed' WHEN net < 0.35 THEN 'Rejected' ELSE 'Uncertain' END AS status, CASE WHEN v LIKE 'U:%' AND net < 0.35 THEN 'Healthy' ELSE substr(v, 3) END AS severity FROM ca""")
def ticket_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, w5, w10 = drilling_metrics(telemetry(spark, sf_dir)), last_rows(5), last_rows(10)
    k = F.col("k")
    m = m.withColumns({
        "flow5": F.avg("flow_balance").over(w5), "pit5": F.avg("pit_rate").over(w5), "ecd10": F.avg("ecd_margin").over(w10), "spp10": F.avg("spp_delta").over(w10), "torque10": F.avg("torque_delta").over(w10), "n": F.count("*").over(so_far()),
        "sustained": F.sum((F.col("category") != "None").cast("int")).over(w10) >= 3, "consistency": (k % 10) / 10.0, "founder": F.col("rule") == "founder", "founder_severity": k / 100.0, "stick_slip": k % 4 == 0, "packoff": (F.col("torque_delta") > 0.25) & (F.col("spp_delta") > 100),
        "near_boundary": k % 3 == 0, "net_score": F.when(k % 5 < 4, k / 100.0), "efficiency": F.col("mse_efficiency"), "dxc_trend": F.lit(0.0),
    }).filter("category <> 'None'")
    names = ("category", "flow5", "pit5", "ecd10", "spp10", "torque10", "n", "sustained", "consistency", "efficiency", "dxc_trend", "founder", "founder_severity", "stick_slip", "packoff", "near_boundary", "net_score")
    return m.withColumn("v", tickets.verify({c: F.col(c) for c in names})).select("seq", "v.status", "v.severity")


@query(MET + """, sp AS (SELECT *, CASE WHEN hardness < 3.5 THEN 5 WHEN hardness < 6 THEN 15 ELSE 20 END AS lo, CASE WHEN hardness < 3.5 THEN 10 WHEN hardness < 6 THEN 25 ELSE 30 END AS best, CASE WHEN hardness < 3.5 THEN 15 WHEN hardness < 6 THEN 35 ELSE 40 END AS hi, k / 3.0 AS offb FROM met),
  tg AS (SELECT *, CASE WHEN wob < lo THEN lo WHEN wob > hi THEN hi WHEN offb >= lo AND offb <= hi AND offb > 0 THEN offb ELSE best END AS target FROM sp) SELECT seq, round(CASE WHEN abs(target - wob) >= 0.05 * (hi - lo) THEN target END, 5) AS new_wob FROM tg""")
def weight_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = drilling_metrics(telemetry(spark, sf_dir)).withColumn("d", tickets.default_parameters(F.col("hardness")))
    return m.select("seq", r(tickets.recommend(F.col("wob"), F.col("d")["wob"], F.col("k") / 3.0), "new_wob", 5))
