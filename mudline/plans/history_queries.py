"""Reports over recent packets, texts, the life cycle of baselines and what overrides do to the cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mudline.functions import anomalies, physics, texts, voting
from mudline.operators import baseline, history, windows
from mudline.operators.metrics import drilling_metrics, with_overrides
from mudline.plans.physics_queries import MET, TEL, VOTES_SQL, r
from mudline.plans.window_queries import BASE_SQL, W10, W60
from mudline.registry import query
from mudline.telemetry import telemetry

IX = ", ix AS (SELECT *, CAST(row_number() OVER (PARTITION BY well_id ORDER BY ts, seq) AS DOUBLE) AS i FROM met)"


def slope_sql(column: str, window: str = "w60") -> str:
    return f"CASE WHEN count(*) OVER {window} > 1 THEN regr_slope({column}, i) OVER {window} ELSE 0 END"


@query(MET + IX + f""", st AS (SELECT *, count(*) OVER w60 AS n, avg(mse) OVER w60 AS am, {slope_sql('mse')} AS mt, {slope_sql('dxc')} AS dt, {slope_sql('wob')} AS wt, {slope_sql('rop')} AS rt, avg(wob) OVER w60 AS mw, avg(rop) OVER w60 AS mr, avg(pit_rate) OVER w60 AS ap,
    CASE WHEN count(*) OVER w60 >= 5 AND avg(torque) OVER w60 > 0 THEN stddev_pop(torque) OVER w60 / avg(torque) OVER w60 ELSE 0 END AS cv, first_value(torque) OVER w60 AS t0, first_value(spp) OVER w60 AS s0, first_value(ts) OVER w60 AS ts0, var_pop(mse) OVER w60 AS vy, var_pop(i) OVER w60 AS vx, covar_pop(i, mse) OVER w60 AS cxy,
    avg((state IN ('Drilling', 'Reaming'))::INT) OVER w60 AS ope, sum((category <> 'None')::INT) OVER w10 AS recent FROM ix WINDOW w60 AS {W60}, w10 AS {W10}),
  sr AS (SELECT *, greatest(least((am - 5000) / 8000, 10), 0) AS hd, n >= 5 AND mw > 0 AND mr > 0 AND wt / mw > 0.02 AND rt / mr < 0.01 AS fnd, (torque - t0) / t0 > 0.15 AND (spp - s0) / s0 > 0.1 AS pck, CASE WHEN n < 3 OR n * vy < 1e-10 THEN 0 ELSE greatest(least(cxy * cxy / (vx * vy), 1), 0) END AS r2 FROM st)
  SELECT seq, round(am, 3) AS avg_mse, round(mt, 3) AS mse_trend, round(dt, 6) AS dxc_trend, round(hd, 6) AS hardness, round(CASE WHEN am <= 0 THEN 0 ELSE least((5000 + hd * 8000) / am * 100, 100) END, 5) AS efficiency, fnd AS founder, CAST(CASE WHEN NOT fnd THEN 0 WHEN rt / mr < -0.05 THEN 1 WHEN rt / mr < -0.02 THEN 0.7 WHEN rt / mr < 0 THEN 0.5 ELSE 0.3 END AS DOUBLE) AS founder_severity,
    CAST((cv <= 10 AND cv > 0.15)::INT + pck::INT + fnd::INT AS INTEGER) AS n_dysfunctions, round(least(n / 60.0, 1), 6) AS confidence, round(least(least(n / 60.0, 1) * 0.4 + r2 * 0.3 + ope * 0.3, 1), 5) AS confidence_factor, round((ts - ts0) / 3600.0, 5) AS hours, recent >= 3 AS sustained, round(ap, 4) AS avg_pit_rate FROM sr""")
def strategic_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the last 60 packets at every packet."""
    s = history.strategic_report(drilling_metrics(telemetry(spark, sf_dir)))
    return s.select("seq", r(F.col("avg_mse"), "avg_mse", 3), r(F.col("mse_trend"), "mse_trend", 3), r(F.col("dxc_trend"), "dxc_trend"), r(F.col("report_hardness"), "hardness"), r(F.col("report_efficiency"), "efficiency", 5), F.col("founder60").alias("founder"), "founder_severity", F.size("dysfunctions").alias("n_dysfunctions"), r(F.col("confidence"), "confidence"), r(F.col("confidence_factor"), "confidence_factor", 5), r(F.col("hours"), "hours", 5), "sustained", r(F.col("avg_pit_rate"), "avg_pit_rate", 4))


@query(MET + f""", h AS (SELECT *, list(mse) OVER w60 AS lm, list(d_exponent) OVER w60 AS ld, list(flow_balance) OVER w60 AS lf, avg(mse) OVER w60 AS am FROM met WINDOW w60 AS {W60}),
  t AS (SELECT seq, len(lm) AS n, am, list_avg(lm[1:5]) AS m0, list_avg(lm[greatest(len(lm) - 4, 1):]) AS m1, list_avg(ld[1:5]) AS d0, list_avg(ld[greatest(len(ld) - 4, 1):]) AS d1, list_avg(lf[1:5]) AS f0, list_avg(lf[greatest(len(lf) - 4, 1):]) AS f1 FROM h)
  SELECT seq, round(CASE WHEN n >= 5 THEN (m1 - m0) / greatest(m0, 1) * 100 ELSE 0 END, 3) AS mse_trend_pct, round(CASE WHEN n >= 5 THEN (d1 - d0) / greatest(d0, 0.1) * 100 ELSE 0 END, 4) AS dxc_trend_pct, round(CASE WHEN n >= 5 THEN f1 - f0 ELSE 0 END, 5) AS flow_change, round(am, 3) AS history_mse FROM t""")
def trend_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = history.recent_trends(drilling_metrics(telemetry(spark, sf_dir)))
    return t.select("seq", r(F.col("mse_trend_pct"), "mse_trend_pct", 3), r(F.col("dxc_trend_pct"), "dxc_trend_pct", 4), r(F.col("flow_change"), "flow_change", 5), r(F.col("history_mse"), "history_mse", 3))


@query(MET + """, s AS (SELECT well_id, ts - ts % 600 AS slot, count(*) AS n, avg(mse) AS am, avg(rop) AS ar, 100 * avg((category <> 'None')::INT) AS rate, sum((category <> 'None')::INT) AS hits, max((category = 'WellControl')::INT) = 1 AS well, arg_max(category, ts * 10000000 + seq) FILTER (WHERE category <> 'None') AS worst FROM met GROUP BY 1, 2)
  SELECT well_id, slot, n, round(am, 3) AS avg_mse, round(rate, 4) AS anomaly_rate, CASE WHEN well THEN 'RiskWarning' WHEN rate > 30 THEN 'Intervention' ELSE 'Optimization' END AS kind, CASE WHEN well THEN 'High' WHEN rate > 30 THEN 'Medium' ELSE 'Low' END AS severity, CASE WHEN well THEN 'WellControl' WHEN rate > 30 THEN worst WHEN am > 50000 THEN 'DrillingEfficiency' ELSE 'None' END AS category,
    CASE WHEN well THEN 'well_control_events' WHEN rate > 30 THEN 'anomaly_rate' WHEN am > 50000 THEN 'avg_mse' ELSE 'periodic_summary' END AS trigger, round(CASE WHEN well THEN hits WHEN rate > 30 THEN rate WHEN am > 50000 THEN am ELSE 0 END, 3) AS trigger_value FROM s""")
def periodic_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = history.periodic_summary(drilling_metrics(telemetry(spark, sf_dir)))
    return s.select("well_id", "slot", "n", r(F.col("avg_mse"), "avg_mse", 3), r(F.col("anomaly_rate"), "anomaly_rate", 4), "kind", "severity", "category", "trigger", r(F.col("trigger_value"), "trigger_value", 3))


@query(MET + """, a AS (SELECT well_id, count(*) AS acks FROM tel WHERE k = 9 AND ts BETWEEN 1704500000 AND 1705500000 GROUP BY 1)
  SELECT m.well_id, count(*) AS packets, count(*) FILTER (WHERE category = 'WellControl') AS well_control, count(*) FILTER (WHERE category = 'Mechanical') AS mechanical, list_element(['NONE', 'LOW', 'WARNING', 'HIGH', 'CRITICAL'], max(CASE severity WHEN 'NONE' THEN 1 WHEN 'LOW' THEN 2 WHEN 'WARNING' THEN 3 WHEN 'HIGH' THEN 4 ELSE 5 END)) AS peak_severity, round(avg(mse_efficiency), 5) AS avg_efficiency, coalesce(max(a.acks), 0) AS acks
  FROM met m LEFT JOIN a ON a.well_id = m.well_id WHERE ts BETWEEN 1704500000 AND 1705500000 GROUP BY 1""")
def shift_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    s = history.shift_summary(drilling_metrics(t), t.filter("k = 9").select("well_id", "ts"), 1_704_500_000, 1_705_500_000)
    return s.select("well_id", "packets", F.col("n_WellControl").alias("well_control"), F.col("n_Mechanical").alias("mechanical"), "peak_severity", r(F.col("avg_mse_efficiency"), "avg_efficiency", 5), "acks")


@query(MET + """, b AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY ts DESC, seq DESC) AS k2, lead(mse) OVER (PARTITION BY well_id ORDER BY ts DESC, seq DESC) AS before FROM met)
  SELECT well_id, seq, state, category, round(0.85 * mse, 4) AS baseline_mse, CASE WHEN (mse - before) / nullif(before, 0) > 0.05 THEN 'rising' WHEN (mse - before) / nullif(before, 0) < -0.05 THEN 'falling' ELSE 'stable' END AS trend FROM b WHERE k2 = 1""")
def live_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.live_view(drilling_metrics(telemetry(spark, sf_dir))).select("well_id", "seq", "state", "category", r(F.col("baseline_mse"), "baseline_mse", 4), "trend")


@query(MET + """, p AS (SELECT *, coalesce((wob - prev_wob) / nullif(prev_wob, 0), 0) AS dw, coalesce((rop - prev_rop) / nullif(prev_rop, 0), 0) AS dr FROM met WHERE rule <> 'none')
  SELECT seq, regexp_replace(severity || ': ' || CASE rule WHEN 'kick' THEN printf('Potential kick detected - flow imbalance %.1f gpm, gas %.0f units', flow_balance, gas_units) WHEN 'loss' THEN printf('Potential lost circulation - flow imbalance %.1f gpm, pit rate %.1f bbl/hr', flow_balance, pit_rate) WHEN 'gas' THEN printf('Elevated gas %.0f units (background: %.0f)', gas_units, background_gas) WHEN 'h2s' THEN printf('H2S detected at %.1f ppm', h2s)
    WHEN 'pit_rate' THEN printf('Pit %s rate %.1f bbl/hr', CASE WHEN pit_rate > 0 THEN 'gain' ELSE 'loss' END, abs(pit_rate)) WHEN 'ecd' THEN printf('ECD margin only %.2f ppg to fracture', ecd_margin) WHEN 'spp' THEN printf('SPP %s of %.0f psi', CASE WHEN spp_delta > 0 THEN 'increase' ELSE 'decrease' END, abs(spp_delta)) WHEN 'torque' THEN printf('Torque increase %.1f%% - potential pack-off', torque_delta * 100)
    WHEN 'founder' THEN printf('Founder condition - WOB increased %.1f%% but ROP %s %.1f%%. Reduce WOB.', dw * 100, CASE WHEN dr < 0 THEN 'decreased' ELSE 'flat' END, abs(dr) * 100) ELSE printf('MSE efficiency %.0f%% - optimization opportunity', mse_efficiency) END, '-?[0-9]+([.][0-9]+)?', '#', 'g') AS description FROM p""")
def anomaly_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of each anomaly; its numbers, checked elsewhere, are masked, as engines round halves apart."""
    m = drilling_metrics(telemetry(spark, sf_dir)).filter("rule <> 'none'")
    change = lambda x: F.coalesce(physics.ratio(F.col(x) - F.col(f"prev_{x}"), F.col(f"prev_{x}")), F.lit(0.0))
    names = {"rule": "rule", "severity": "severity", "flow_balance": "flow_balance", "pit_rate": "pit_rate", "gas": "gas_units", "background": "background_gas", "h2s": "h2s", "ecd_margin": "ecd_margin", "spp_delta": "spp_delta", "torque_delta": "torque_delta", "efficiency": "mse_efficiency"}
    p = {k: F.col(v) for k, v in names.items()} | {"wob_change": change("wob"), "rop_change": change("rop")}
    return m.select("seq", F.regexp_replace(texts.describe(p), "-?[0-9]+([.][0-9]+)?", "#").alias("description"))


@query(MET + f", {VOTES_SQL}" + """, nm AS (SELECT *, list_value(v_mse, v_hyd, v_wc, v_for, v_st) AS vs, list_value(w_mse, w_hyd, w_wc, w_for, w_st) AS ws, w_mse + w_hyd + w_wc + w_for + w_st AS tw FROM su)
  SELECT seq, regexp_replace('Final severity ' || CASE WHEN v_wc = 4 OR round(total, 9) > 3.5 THEN 'Critical' WHEN round(total, 9) > 2.5 THEN 'High' WHEN round(total, 9) > 1.5 THEN 'Medium' WHEN total > 0.5 THEN 'Low' ELSE 'Healthy' END || ' from ensemble [regime ' || regime || ':' || CASE regime WHEN 0 THEN 'baseline' WHEN 1 THEN 'hydraulic-stress' WHEN 2 THEN 'high-wob' ELSE 'unstable' END || ']: ' ||
    array_to_string(list_transform(range(1, 6), lambda j: ['mse', 'hydraulic', 'well_control', 'formation', 'stuck_pipe'][j] || '=' || ['Low', 'Medium', 'High', 'Critical'][vs[j]]), ', '), ' ', ' ', 'g') AS reasoning FROM nm""")
def voting_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the ensemble decided; the shares in brackets are cut off here, as engines round halves apart."""
    from mudline.plans.physics_queries import voted

    m = voted(drilling_metrics(telemetry(spark, sf_dir)))
    votes = {k: F.col(f"vote_{k}") for k in voting.SPECIALISTS}
    w = voting.weights(F.col("regime"))
    final = F.when(votes["well_control"] == "Critical", "Critical").otherwise(voting.final_severity(F.round(voting.weighted_sum(votes, F.col("regime")), 9)))
    each = F.array(*[F.struct(F.lit(k).alias("specialist"), v.alias("vote"), w[k].alias("weight")) for k, v in votes.items()])
    return m.select("seq", F.regexp_replace(texts.voting_reasoning(final, F.col("regime"), each), r" \([0-9]+%\)", "").alias("reasoning"))


@query(TEL + """, t AS (SELECT well_id, seq, ts, bit_depth, lag(bit_depth) OVER w AS d, lag(ts) OVER w AS p, k FROM tel WINDOW w AS (PARTITION BY well_id ORDER BY ts, seq))
  SELECT seq, round(least(abs(bit_depth - d) / greatest(ts - p, 1) * 60, 150), 5) AS speed, CAST(CASE WHEN k % 2 = 0 THEN 1.2 ELSE 1.0 END AS DOUBLE) AS shock FROM t WHERE least(abs(bit_depth - d) / greatest(ts - p, 1) * 60, 150) > 0.5""")
def trip_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    state = F.when(F.col("k") % 2 == 0, "Reaming").otherwise("Idle")
    return t.select("seq", r(history.trip_speed(t), "speed", 5), history.shock_factor(state).alias("shock")).filter("speed IS NOT NULL")


@query(MET + """, pa AS (SELECT a.well_id, a.seq, a.ts, a.wob, a.rpm, a.rop, a.mse, row_number() OVER (PARTITION BY a.well_id ORDER BY a.ts, a.seq) AS i, count(b.seq) AS n, avg(b.wob) AS mw, avg(b.rpm) AS mr FROM met a LEFT JOIN met b ON a.well_id = b.well_id AND b.ts BETWEEN a.ts - 30 AND a.ts AND (b.ts < a.ts OR b.seq < a.seq) GROUP BY 1, 2, 3, 4, 5, 6, 7),
  ch AS (SELECT *, CASE WHEN i = 1 OR (n > 0 AND (abs(wob - mw) > 2 OR abs(rpm - mr) > 10)) THEN ts END AS c FROM pa), sc AS (SELECT *, ts - last_value(c IGNORE NULLS) OVER (PARTITION BY well_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS sin FROM ch)
  SELECT well_id, round(avg(rop), 5) AS avg_rop, round(max(rop), 5) AS best_rop, round(avg(mse), 3) AS avg_mse, count(*) AS samples FROM sc WHERE sin > 120 GROUP BY 1""")
def sustained_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = history.sustained(windows.parameter_changes(drilling_metrics(telemetry(spark, sf_dir))))
    return s.select("well_id", r(F.col("avg_rop"), "avg_rop", 5), r(F.col("best_rop"), "best_rop", 5), r(F.col("avg_mse"), "avg_mse", 3), "samples")


@query(MET + "SELECT seq, ts AS timestamp, bit_depth AS depth, round(mse, 3) AS mse, round(ecd_margin, 6) AS ecd_margin, round(pit_rate, 4) AS pit_rate FROM met")
def history_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = history.snapshot(drilling_metrics(telemetry(spark, sf_dir)))
    return s.select("seq", "timestamp", "depth", r(F.col("mse"), "mse", 3), r(F.col("ecd_margin"), "ecd_margin"), r(F.col("pit_rate"), "pit_rate", 4))


@query(TEL + BASE_SQL + "SELECT well_id, CAST(count(*) FILTER (WHERE n >= 100 AND outliers <= 0.05 * n) AS BIGINT) AS locked, count(*) FILTER (WHERE n >= 100 AND outliers <= 0.05 * n) = 4 AS all_locked FROM ba GROUP BY 1")
def locked_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = baseline.baselines(baseline.long_form(telemetry(spark, sf_dir), ["spp", "torque", "rop", "gas_units"]))
    return baseline.locks(b, 4)


@query(TEL + """, ru AS (SELECT well_id, k % 3 AS formation, ts, seq, torque, count(*) OVER w AS n, avg(torque) OVER w AS m, stddev_samp(torque) OVER w AS s FROM tel WINDOW w AS (PARTITION BY well_id, k % 3 ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
  ou AS (SELECT *, sum(coalesce(n > 10 AND s > 0.001 AND abs(torque - m) > 3 * s, false)::INT) OVER (PARTITION BY well_id, formation ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS o FROM ru), lk AS (SELECT *, row_number() OVER (PARTITION BY well_id, formation ORDER BY n) AS k FROM ou WHERE n >= 100 AND o <= 0.05 * n)
  SELECT well_id, CAST(formation AS VARCHAR) AS formation, seq AS locked_at, n, round(m, 5) AS mean, round(s, 5) AS std FROM lk WHERE k = 1""")
def formation_baseline_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formation baselines as they stand at the first packet where they are long and clean enough."""
    t = telemetry(spark, sf_dir).select("well_id", "ts", "seq", F.lit("torque").alias("sensor"), F.col("torque").alias("v"), (F.col("k") % 3).cast("string").alias("formation"))
    b = baseline.formation_locks(t)
    return b.select("well_id", "formation", "locked_at", "n", r(F.col("mean"), "mean", 5), r(F.col("std"), "std", 5))


@query(MET + ", bs AS (SELECT well_id, greatest(stddev_samp(flow_balance), greatest(abs(avg(flow_balance)) * 0.001, 0.001)) AS fs, greatest(stddev_samp(spp), greatest(abs(avg(spp)) * 0.001, 0.001)) AS ss, greatest(stddev_samp(torque), greatest(abs(avg(torque)) * 0.001, 0.001)) / avg(torque) AS cv FROM met GROUP BY 1)," + """
  ov AS (SELECT well_id, 3 * fs AS fw, greatest(2 * ss, 30) AS sw, greatest(3 * ss, 50) AS sc, greatest(2 * cv, 0.1) AS tw, greatest(3 * cv, 0.2) AS tc FROM bs),
  o AS (SELECT m.*, v.*, (flow_out - flow_in > fw)::INT + (pit_change > 5)::INT + (gas_units - background_gas > 50)::INT AS kn, (flow_in - flow_out > fw)::INT + (pit_change < -5)::INT + (greatest(spp_delta, 0) > sw)::INT AS ln FROM met m JOIN ov v ON v.well_id = m.well_id)
  SELECT seq, CASE WHEN NOT active THEN 'none' WHEN (flow_out > 0 OR flow_in <= 0) AND kn >= 2 THEN 'kick' WHEN (flow_out > 0 OR flow_in <= 0) AND ln >= 2 THEN 'loss' WHEN gas_units > 100 THEN 'gas' WHEN h2s > 10 THEN 'h2s' WHEN abs(pit_rate) > 5 THEN 'pit_rate' WHEN ecd_margin < 0.3 THEN 'ecd' WHEN abs(spp_delta) > sw THEN 'spp'
    WHEN torque_delta > tw THEN 'torque' WHEN founders AND state = 'Drilling' THEN 'founder' WHEN state = 'Drilling' AND mse_efficiency < 70 THEN 'mse' ELSE 'none' END AS rule FROM o""")
def cascade_with_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade under thresholds that each well's own baselines set."""
    m = drilling_metrics(telemetry(spark, sf_dir))
    long = baseline.long_form(m, ["flow_balance", "spp", "torque"])
    stats = long.groupBy("well_id", "sensor").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    return with_overrides(m, baseline.overrides(stats)).select("seq", "rule")


@query(TEL + """, hi AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY ts DESC, seq DESC) AS back FROM tel QUALIFY back <= 60), cnt AS (SELECT well_id, count(*) AS n FROM hi GROUP BY 1),
  lo AS (SELECT well_id, back, unnest([{'p': 'WOB', 'x': wob}, {'p': 'RPM', 'x': rpm}, {'p': 'Torque', 'x': torque}, {'p': 'SPP', 'x': spp}], recursive := true) FROM hi),
  pr AS (SELECT a.well_id, a.p AS parameter, g.lag, coalesce(corr(a.x, b.rop), 0) AS r FROM lo a JOIN (SELECT unnest(range(1, 21)) AS lag) g ON true JOIN hi b ON a.well_id = b.well_id AND b.back = a.back - g.lag JOIN cnt c ON c.well_id = a.well_id AND c.n >= 20 AND g.lag <= least(20, c.n // 3) GROUP BY 1, 2, 3),
  be AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY well_id, parameter ORDER BY round(abs(r), 9) DESC, lag) = 1), tp AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY round(abs(r), 9) DESC, parameter) AS place FROM be WHERE abs(r) >= 0.2)
  SELECT well_id, parameter, CAST(lag AS INTEGER) AS lag, round(r, 5) AS r FROM tp WHERE place <= 3""")
def causal_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that lead the rate of penetration over the last 60 packets (0.2 or more here), three a well at most."""
    return windows.leads(telemetry(spark, sf_dir), {"WOB": "wob", "RPM": "rpm", "Torque": "torque", "SPP": "spp"}, "rop", least_r=0.2).select("well_id", "parameter", "lag", r(F.col("r"), "r", 5))
