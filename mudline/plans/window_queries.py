"""Windows, baselines and time aggregates over the telemetry view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mudline.functions.frames import last_rows, ordered
from mudline.functions.physics import ratio
from mudline.operators import baseline, scan, selection, windows
from mudline.operators.metrics import METRICS_SQL, drilling_metrics
from mudline.plans.physics_queries import MET, REC, TEL, r
from mudline.registry import query
from mudline.telemetry import TELEMETRY_SQL, telemetry

W10 = "(PARTITION BY well_id ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
W60 = "(PARTITION BY well_id ORDER BY ts, seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


@query(TEL + f"""SELECT seq, round(cv10, 6) AS cv10, round(cv60, 6) AS cv60, cv60 <= 10 AND cv60 > 0.15 AS slipping, round(CASE WHEN cv60 > 0.25 THEN 1 WHEN cv60 > 0.15 THEN (cv60 - 0.15) / 0.1 ELSE 0 END, 5) AS severity FROM (
  SELECT seq, CASE WHEN count(*) OVER w10 >= 10 THEN stddev_pop(torque) OVER w10 / avg(torque) OVER w10 ELSE 0 END AS cv10, CASE WHEN count(*) OVER w60 >= 5 THEN stddev_pop(torque) OVER w60 / avg(torque) OVER w60 ELSE 0 END AS cv60 FROM tel WINDOW w10 AS {W10}, w60 AS {W60}) a""")
def torque_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    cv10, cv60 = windows.variation(F.col("torque"), last_rows(10), 10), windows.variation(F.col("torque"), last_rows(60), 5)
    t = t.select("seq", cv10.alias("cv10"), cv60.alias("cv60"))
    slipping, severity = windows.stick_slip(F.col("cv60"))
    return t.select("seq", r(F.col("cv10"), "cv10"), r(F.col("cv60"), "cv60"), slipping.alias("slipping"), r(severity, "severity", 5))


@query(TEL + f""", ix AS (SELECT *, CAST(row_number() OVER (PARTITION BY well_id ORDER BY ts, seq) AS DOUBLE) AS i FROM tel)
  SELECT seq, coalesce(n >= 10 AND mw > 0 AND mr > 0 AND tw / mw > 0.02 AND tr / mr < 0.01, false) AS founder, round(tw, 5) AS wob_trend, round(tr, 5) AS rop_trend FROM (
  SELECT seq, count(*) OVER w AS n, avg(wob) OVER w AS mw, avg(rop) OVER w AS mr, CASE WHEN count(*) OVER w > 1 THEN regr_slope(wob, i) OVER w ELSE 0 END AS tw, CASE WHEN count(*) OVER w > 1 THEN regr_slope(rop, i) OVER w ELSE 0 END AS tr FROM ix WINDOW w AS {W10}) a""")
def founder_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = windows.founder_flags(telemetry(spark, sf_dir))
    return f.select("seq", "founder", r(windows.trend(F.col("wob"), F.col("idx"), last_rows(10)), "wob_trend", 5), r(windows.trend(F.col("rop"), F.col("idx"), last_rows(10)), "rop_trend", 5))


@query(TEL + f""", ix AS (SELECT *, CAST(row_number() OVER (PARTITION BY well_id ORDER BY ts, seq) AS DOUBLE) AS i FROM tel)
  SELECT seq, round(CASE WHEN n < 3 OR n * vy < 1e-10 THEN 0 ELSE greatest(least(c * c / (vx * vy), 1), 0) END, 5) AS r2 FROM (
  SELECT seq, count(*) OVER w AS n, var_pop(spp) OVER w AS vy, var_pop(i) OVER w AS vx, covar_pop(i, spp) OVER w AS c FROM ix WINDOW w AS {W60}) a""")
def pressure_trend_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = windows.with_index(telemetry(spark, sf_dir))
    return t.select("seq", r(windows.r_squared(F.col("spp"), F.col("idx"), last_rows(60)), "r2", 5))


@query(TEL + """, ix AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY ts, seq) AS i, count(*) OVER (PARTITION BY well_id) AS n,
  avg(torque) OVER (PARTITION BY well_id ORDER BY ts, seq ROWS BETWEEN 60 PRECEDING AND 31 PRECEDING) AS o, avg(torque) OVER (PARTITION BY well_id ORDER BY ts, seq ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS nw FROM tel),
  fi AS (SELECT *, coalesce(i > 60 AND n >= 120 AND o > 0.1 AND abs(nw - o) > 0.15 * o, false) AS fires FROM ix),
  se AS (SELECT *, coalesce(lead(fires, 30) OVER (PARTITION BY well_id ORDER BY ts, seq), false) AS st FROM fi),
  sg AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY well_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS segment FROM se)
  SELECT well_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, round(avg(torque), 5) AS mean_torque, CAST(min(i) AS BIGINT) AS first_row FROM sg GROUP BY well_id, segment""")
def formation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.segments(telemetry(spark, sf_dir), "torque")
    return s.groupBy("well_id", "segment").agg(F.count("*").alias("n"), r(F.avg("torque"), "mean_torque", 5), F.min("idx").cast("long").alias("first_row"))


@query(TEL + """, hi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY ts DESC, seq DESC) AS back FROM tel) a WHERE back <= 60),
  lo AS (SELECT well_id, back, 'WOB' AS param, wob AS x, spp FROM hi UNION ALL SELECT well_id, back, 'RPM', rpm, spp FROM hi UNION ALL SELECT well_id, back, 'Torque', torque, spp FROM hi UNION ALL SELECT well_id, back, 'ROP', rop, spp FROM hi),
  pr AS (SELECT a.well_id, a.param, g.lag, corr(a.x, b.spp) AS r, count(*) AS n FROM lo a JOIN (SELECT unnest(range(1, 21)) AS lag) g ON true JOIN hi b ON a.well_id = b.well_id AND b.back = a.back - g.lag GROUP BY 1, 2, 3)
  SELECT well_id, param, CAST(lag AS INTEGER) AS lag, round(r, 5) AS r FROM (SELECT *, row_number() OVER (PARTITION BY well_id, param ORDER BY round(abs(r), 9) DESC, lag) AS k FROM pr) a WHERE k = 1""")
def lagged_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = Window.partitionBy("well_id").orderBy(F.desc("ts"), F.desc("seq"))
    hist = telemetry(spark, sf_dir).withColumn("back", F.row_number().over(newest)).filter("back <= 60")
    long = hist.select("well_id", "back", F.expr("stack(4, 'WOB', wob, 'RPM', rpm, 'Torque', torque, 'ROP', rop) AS (param, x)")).withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(20))))
    effect = hist.select("well_id", F.col("back").alias("effect_back"), "spp")
    pairs = long.withColumn("effect_back", F.col("back") - F.col("lag")).join(effect, ["well_id", "effect_back"])
    best = Window.partitionBy("well_id", "param").orderBy(F.desc(F.round(F.abs("r"), 9)), "lag")
    return pairs.groupBy("well_id", "param", "lag").agg(windows.pearson(F.col("x"), F.col("spp"), 3).alias("r")).withColumn("k", F.row_number().over(best)).filter("k = 1").select("well_id", "param", "lag", r(F.col("r"), "r", 5))


@query(TEL + "SELECT seq, round(lagged, 6) AS lagged_rop FROM (SELECT seq, lead(rop, 60) OVER (PARTITION BY well_id ORDER BY ts, seq) AS lagged FROM tel) a WHERE lagged IS NOT NULL")
def rop_lag_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    return t.select("seq", F.lead("rop", 60).over(ordered()).alias("lagged")).filter("lagged IS NOT NULL").select("seq", r(F.col("lagged"), "lagged_rop"))


CHANNELS_SQL = " UNION ALL ".join(f"SELECT well_id, ts, seq, '{c}' AS sensor, {c} AS v FROM tel" for c in ("spp", "torque", "rop", "gas_units"))
BASE_SQL = f""", lg AS ({CHANNELS_SQL}),
  ru AS (SELECT *, count(*) OVER w AS n, avg(v) OVER w AS m, stddev_samp(v) OVER w AS s FROM lg WINDOW w AS (PARTITION BY well_id, sensor ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
  ou AS (SELECT *, coalesce(n > 10 AND s > 0.001 AND abs(v - m) > 3 * s, false) AS outlier FROM ru),
  ba AS (SELECT well_id, sensor, count(*) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, min(v) AS lo, max(v) AS hi, sum(outlier::INT) AS outliers FROM ou GROUP BY 1, 2)"""


@query(TEL + BASE_SQL + "SELECT well_id, sensor, n, round(mean, 5) AS mean, round(std, 5) AS std, round(lo, 5) AS low, round(hi, 5) AS high, CAST(outliers AS BIGINT) AS outliers, CASE WHEN n < 100 THEN 'learning' WHEN outliers > 0.05 * n THEN 'contaminated' ELSE 'locked' END AS status FROM ba")
def sensor_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = baseline.baselines(baseline.long_form(telemetry(spark, sf_dir), ["spp", "torque", "rop", "gas_units"]))
    return b.select("well_id", "sensor", "n", r(F.col("mean"), "mean", 5), r(F.col("std"), "std", 5), r(F.col("low"), "low", 5), r(F.col("high"), "high", 5), "outliers", "status")


@query(TEL + BASE_SQL + """, ef AS (SELECT *, greatest(std, greatest(abs(mean) * 0.001, 0.001)) AS es FROM ba)
  SELECT sensor, level, count(*) AS n FROM (SELECT l.sensor, CASE WHEN abs(l.v - e.mean) / e.es >= 5 THEN 'Critical' WHEN abs(l.v - e.mean) / e.es >= 1.6 THEN 'Warning' ELSE 'Normal' END AS level FROM lg l JOIN ef e ON l.well_id = e.well_id AND l.sensor = e.sensor) a GROUP BY 1, 2""")
def baseline_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = baseline.long_form(telemetry(spark, sf_dir), ["spp", "torque", "rop", "gas_units"])
    checked = baseline.check(long, baseline.baselines(long), warning=1.6, critical=5.0, both_sides=True)
    return checked.groupBy("sensor", "level").agg(F.count("*").alias("n"))


@query(TEL + BASE_SQL + """, ov AS (SELECT well_id, max(CASE WHEN sensor = 'spp' THEN std END) AS spp_std, max(CASE WHEN sensor = 'torque' THEN greatest(std, greatest(abs(mean) * 0.001, 0.001)) / mean END) AS cv FROM ba GROUP BY well_id)
  SELECT well_id, round(greatest(2 * spp_std, 30), 5) AS spp_warning, round(greatest(3 * spp_std, 50), 5) AS spp_critical, round(greatest(2 * cv, 0.1), 6) AS torque_warning, round(greatest(3 * cv, 0.2), 6) AS torque_critical FROM ov""")
def baseline_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = baseline.overrides(baseline.baselines(baseline.long_form(telemetry(spark, sf_dir), ["spp", "torque"])))
    return o.select("well_id", r(F.col("spp_warning"), "spp_warning", 5), r(F.col("spp_critical"), "spp_critical", 5), r(F.col("torque_warning"), "torque_warning"), r(F.col("torque_critical"), "torque_critical"))


ZONE_CHANNELS = ("spp", "torque", "rop", "wob", "gas_units")
ZONE_SQL = " + ".join(f"coalesce({c} < quantile_cont({c}, 0.1) OVER w OR {c} > quantile_cont({c}, 0.9) OVER w, false)::INT" for c in ZONE_CHANNELS)


@query(TEL + f""", ou AS (SELECT *, {ZONE_SQL} AS outliers FROM tel WINDOW w AS (PARTITION BY well_id ORDER BY ts, seq ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
  ma AS (SELECT *, coalesce(lag(outliers >= 3) OVER (PARTITION BY well_id ORDER BY ts, seq), false) AS was FROM ou),
  ru AS (SELECT *, sum((outliers >= 3 AND NOT was)::INT) OVER (PARTITION BY well_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM ma)
  SELECT well_id, CAST(run AS BIGINT) AS run, count(*) AS n, min(ts) AS began, max(ts) AS ended, CAST(max(outliers) AS INTEGER) AS peak, round(min(bit_depth), 4) AS top, round(max(bit_depth), 4) AS base FROM ru WHERE outliers >= 3 GROUP BY 1, 2""")
def alert_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of packets with three or more of five channels outside their interval over the 50 packets before."""
    frame = ordered().rowsBetween(-50, -1)
    t = windows.quantiles(telemetry(spark, sf_dir).select("well_id", "ts", "seq", "bit_depth", *ZONE_CHANNELS), {f"{side}_{c}": (c, p) for c in ZONE_CHANNELS for side, p in (("low", 0.1), ("high", 0.9))}, frame)
    out = lambda c: F.coalesce((F.col(c) < F.col(f"low_{c}")) | (F.col(c) > F.col(f"high_{c}")), F.lit(False)).cast("int")
    z = windows.runs(t.withColumn("outliers", sum((out(c) for c in ZONE_CHANNELS), F.lit(0))), F.col("outliers") >= 3)
    return z.groupBy("well_id", "run").agg(F.count("*").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"), F.max("outliers").alias("peak"), r(F.min("bit_depth"), "top", 4), r(F.max("bit_depth"), "base", 4))


HOUR_SQL = """, hx AS (SELECT *, ts - ts % 3600 AS hour, CAST(row_number() OVER (PARTITION BY well_id, ts - ts % 3600 ORDER BY ts, seq) AS DOUBLE) AS i FROM met),
  ho AS (SELECT well_id, hour, count(*) AS n, avg(mse_efficiency) AS eff, min(mse_efficiency) AS eff_lo, max(mse_efficiency) AS eff_hi, avg(torque) AS torque, avg(spp) AS spp, avg(rop) AS rop, avg(wob) AS wob, avg(mse) AS mse, avg(flow_balance) AS flow_balance, CASE WHEN count(*) > 1 THEN regr_slope(torque, i) ELSE 0 END AS torque_slope, CASE WHEN count(*) > 1 THEN regr_slope(spp, i) ELSE 0 END AS spp_slope, CASE WHEN count(*) > 1 THEN regr_slope(rop, i) ELSE 0 END AS rop_slope, CASE WHEN count(*) > 1 THEN regr_slope(mse_efficiency, i) ELSE 0 END AS eff_slope FROM hx GROUP BY 1, 2)"""


@query(MET + HOUR_SQL + "SELECT well_id, hour, n, round(eff, 5) AS eff, round(eff_lo, 5) AS eff_lo, round(eff_hi, 5) AS eff_hi, round(torque, 5) AS torque, round(spp, 4) AS spp, round(rop, 5) AS rop, round(wob, 5) AS wob, round(mse, 3) AS mse, round(flow_balance, 5) AS flow_balance, round(torque_slope, 4) AS torque_slope, round(spp_slope, 4) AS spp_slope, round(rop_slope, 4) AS rop_slope, round(eff_slope, 4) AS eff_slope FROM ho")
def hourly_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = baseline.hourly(drilling_metrics(telemetry(spark, sf_dir)))
    return h.select("well_id", "hour", "n", *[r(F.col(c), c, d) for c, d in (("eff", 5), ("eff_lo", 5), ("eff_hi", 5), ("torque", 5), ("spp", 4), ("rop", 5), ("wob", 5), ("mse", 3), ("flow_balance", 5), ("torque_slope", 4), ("spp_slope", 4), ("rop_slope", 4), ("eff_slope", 4))])


@query(MET + HOUR_SQL + """SELECT well_id, hour - hour % 86400 AS day, count(*) AS hours, round(avg(eff), 5) AS eff, round(avg(torque), 3) AS torque, round(min(eff_lo), 5) AS eff_lo, round(max(eff_hi), 5) AS eff_hi,
  round(CASE WHEN count(*) > 1 THEN regr_slope(eff, i) ELSE 0 END, 4) AS eff_trend FROM (SELECT *, CAST(row_number() OVER (PARTITION BY well_id, hour - hour % 86400 ORDER BY hour) AS DOUBLE) AS i FROM ho) a GROUP BY 1, 2""")
def daily_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = baseline.daily(baseline.hourly(drilling_metrics(telemetry(spark, sf_dir))))
    return d.select("well_id", "day", "hours", *[r(F.col(c), c, n) for c, n in (("eff", 5), ("torque", 3), ("eff_lo", 5), ("eff_hi", 5), ("eff_trend", 4))])


@query(MET + """, bu AS (SELECT well_id, ts - ts % 600 AS slot, count(*) AS n, avg(rop) AS rop, avg(wob) AS wob, avg((category <> 'None')::INT) AS rate, max(CASE category WHEN 'WellControl' THEN 4 WHEN 'Hydraulics' THEN 3 WHEN 'Mechanical' THEN 2 WHEN 'DrillingEfficiency' THEN 1 ELSE 0 END) AS worst FROM met GROUP BY 1, 2)
  SELECT well_id, slot, n, round(rop, 5) AS rop, round(wob, 5) AS wob, round(rate, 6) AS anomaly_rate, list_element(['None', 'DrillingEfficiency', 'Mechanical', 'Hydraulics', 'WellControl'], worst + 1) AS worst FROM bu""")
def ten_minute_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = drilling_metrics(telemetry(spark, sf_dir))
    order = ["None", "DrillingEfficiency", "Mechanical", "Hydraulics", "WellControl"]
    rank = F.coalesce(*[F.when(F.col("category") == c, F.lit(i)) for i, c in enumerate(order)])
    b = m.groupBy("well_id", (F.col("ts") - F.col("ts") % 600).alias("slot")).agg(F.count("*").alias("n"), r(F.avg("rop"), "rop", 5), r(F.avg("wob"), "wob", 5), r(F.avg((F.col("category") != "None").cast("int")), "anomaly_rate"), F.max(rank).alias("worst"))
    return b.withColumn("worst", F.element_at(F.array(*[F.lit(c) for c in order]), F.col("worst") + 1))


@query(TEL + """, m AS (SELECT well_id, torque, avg(torque) OVER (PARTITION BY well_id) AS mean, lag(torque) OVER (PARTITION BY well_id ORDER BY ts, seq) AS before, lag(torque, 2) OVER (PARTITION BY well_id ORDER BY ts, seq) AS before2 FROM tel)
  SELECT well_id, count(*) AS n, round(stddev_pop(torque) / avg(torque), 6) AS cv, CAST(sum((before IS NOT NULL AND (torque >= mean) <> (before >= mean))::INT) AS BIGINT) AS crossings, round(sum((before IS NOT NULL AND (torque >= mean) <> (before >= mean))::INT) / (2.0 * (count(*) - 1)), 6) AS hz, round((max(torque) - min(torque)) / avg(torque), 6) AS amplitude,
  round(kurtosis_pop(torque), 5) AS kurt, round(avg(torque - 2 * before + before2), 6) AS acceleration FROM m GROUP BY well_id""")
def oscillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    # added up in the packets' order, as the SQL adds, so that values equal to the mean fall to the same side however rows arrive
    whole = ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = t.select("well_id", "torque", F.avg("torque").over(whole).alias("mean"), F.lag("torque").over(ordered()).alias("before"), F.lag("torque", 2).over(ordered()).alias("before2"))
    cross = F.sum(F.coalesce(((F.col("torque") >= F.col("mean")) != (F.col("before") >= F.col("mean"))).cast("int"), F.lit(0)))
    return m.groupBy("well_id").agg(
        F.count("*").alias("n"), r(ratio(F.stddev_pop("torque"), F.avg("torque")), "cv"), cross.alias("crossings"), r(ratio(cross, 2.0 * (F.count("*") - 1)), "hz"), r(ratio(F.max("torque") - F.min("torque"), F.avg("torque")), "amplitude"),
        r(F.kurtosis("torque"), "kurt", 5), r(F.avg(F.col("torque") - 2 * F.col("before") + F.col("before2")), "acceleration"),
    )


@query(MET + f"""SELECT seq, round(avg(pit_rate) OVER w5, 4) AS pit5, round(avg(flow_balance) OVER w10, 5) AS flow10, round(CASE WHEN count(*) OVER w10 < 5 THEN 0.3 ELSE avg((mse_efficiency < 70)::INT) OVER w10 END, 6) AS consistency, CAST(sum((category <> 'None')::INT) OVER w10 AS BIGINT) AS recent FROM met
  WINDOW w5 AS (PARTITION BY well_id ORDER BY ts, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w10 AS {W10}""")
def verification_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, w5, w10 = drilling_metrics(telemetry(spark, sf_dir)), last_rows(5), last_rows(10)
    steady = F.when(F.count("*").over(w10) < 5, 0.3).otherwise(F.avg((F.col("mse_efficiency") < 70).cast("int")).over(w10))
    return m.select("seq", r(F.avg("pit_rate").over(w5), "pit5", 4), r(F.avg("flow_balance").over(w10), "flow10", 5), r(steady, "consistency"), F.sum((F.col("category") != "None").cast("int")).over(w10).alias("recent"))


@query(REC + """, ix AS (SELECT well_id, seq, spp * 6.894757 AS spp, row_number() OVER (PARTITION BY well_id ORDER BY ts, seq) AS i FROM tel),
  em AS (SELECT well_id, seq, i, spp, spp AS ema FROM ix WHERE i = 1 UNION ALL SELECT f.well_id, f.seq, f.i, f.spp, CASE WHEN f.spp > 0 THEN e.ema + CASE WHEN f.i <= 10 THEN 0.5 ELSE 0.1 END * (f.spp - e.ema) ELSE e.ema END FROM em e JOIN ix f ON f.well_id = e.well_id AND f.i = e.i + 1)
  SELECT seq, round(ema, 4) AS ema, round(CASE WHEN i > 5 THEN spp - ema ELSE 0 END, 4) AS delta FROM em""")
def pressure_moving_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moving baseline of pressure (in kPa) at every packet, and how far the packet is from it once five are seen."""
    e = baseline.moving_baseline(telemetry(spark, sf_dir).withColumn("spp", F.col("spp") * 6.894757), "spp")
    return e.select("seq", r(F.col("ema"), "ema", 4), r(F.when(F.col("idx") > 5, F.col("spp") - F.col("ema")).otherwise(0.0), "delta", 4))


#: All packets as one well.
ONE_WELL_SQL = TELEMETRY_SQL.replace("user_id // 10 AS well_id", "CAST(0 AS BIGINT) AS well_id")


@query(f"WITH RECURSIVE {ONE_WELL_SQL}, {METRICS_SQL}" + """, ix AS (SELECT *, row_number() OVER w AS i, count(rop) OVER u AS n, avg(rop) OVER u AS mean, stddev_samp(rop) OVER u AS std FROM met WINDOW w AS (ORDER BY ts, seq), u AS (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
  em AS (SELECT seq, i, spp AS ema FROM ix WHERE i = 1 UNION ALL SELECT f.seq, f.i, CASE WHEN f.spp > 0 THEN e.ema + CASE WHEN f.i <= 10 THEN 0.5 ELSE 0.1 END * (f.spp - e.ema) ELSE e.ema END FROM em e JOIN ix f ON f.i = e.i + 1)
  SELECT x.seq, prev_ts, round(torque_delta, 6) AS torque_delta, round(pit_change, 6) AS pit_change, rule, n, round(mean + 1.234e-7, 6) AS mean, round(coalesce(std, 0), 5) AS std, round(ema + 1.234e-6, 4) AS ema FROM ix x JOIN em USING (i)""")
def one_long_well(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All packets as one well, cut into chunks of six hours: cascade, running moments and the moving baseline by scans, in as many tasks as there are chunks."""
    span = 21_600
    m = drilling_metrics(telemetry(spark, sf_dir, span), span=span)
    s = scan.Scan(span=span).moments("m", F.col("rop")).over(m.select("well_id", "ts", "seq", "prev_ts", "torque_delta", "pit_change", "rule", "rop", "spp"))
    e = scan.moving_mean(s, "spp", span=span)
    std = F.when(F.col("m.n") > 1, F.sqrt(F.col("m.m2") / (F.col("m.n") - 1))).otherwise(0.0)
    return e.select("seq", "prev_ts", r(F.col("torque_delta"), "torque_delta"), r(F.col("pit_change"), "pit_change"), "rule", "m.n", r(F.col("m.mean") + 1.234e-7, "mean"), r(std, "std", 5), r(F.col("ema") + 1.234e-6, "ema", 4))  # the shift keeps halves from being rounded apart


@query(MET + "SELECT state, median(torque) AS torque, median(spp) AS spp, median(gas_units) AS gas_units, median(pit_change) AS pit_change, median(CASE WHEN mse > 0 THEN mse END) AS mse FROM met GROUP BY 1")
def state_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of each rig state over all wells; states of over 500 packets by counting instead of holding their values."""
    m = drilling_metrics(telemetry(spark, sf_dir)).withColumn("mse", F.when(F.col("mse") > 0, F.col("mse")))
    return selection.medians(m, ["state"], ["torque", "spp", "gas_units", "pit_change", "mse"], few=500)
