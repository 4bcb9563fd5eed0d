"""Reports over a well's recent packets: strategic physics, trends, periodic summaries, shifts, the live view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mudline.config import DEFAULT, Config
from mudline.functions import digits, physics
from mudline.functions.frames import last_rows, ordered
from mudline.functions.physics import ratio
from mudline.operators import windows

HISTORY = 60


def founder(rows: DataFrame, n: int = HISTORY, least: int = 5) -> DataFrame:
    """``founder60``, ``founder_severity`` and ``optimal_wob`` (at the first highest rate) over the last ``n`` packets; ``rows`` carry ``idx``."""
    frame, i = last_rows(n), F.col("idx")
    # each aggregate of the frame is a column first: one that an expression names twice is computed twice
    parts = {"_n": F.count("*"), "_wob": F.avg("wob"), "_rop": F.avg("rop"), "_best": F.max_by("wob", F.struct("rop", -F.col("idx")))}
    rows = rows.withColumns({c: x.over(frame) for c, x in parts.items()} | {f"_{c}_trend": windows.trend(F.col(c), i, frame) for c in ("wob", "rop")})
    w, p = ratio(F.col("_wob_trend"), F.col("_wob")), ratio(F.col("_rop_trend"), F.col("_rop"))
    fires = F.coalesce((F.col("_n") >= least) & (F.col("_wob") > 0) & (F.col("_rop") > 0) & (w > 0.02) & (p < 0.01), F.lit(False))
    severity = F.when(p < -0.05, 1.0).when(p < -0.02, 0.7).when(p < 0, 0.5).otherwise(0.3)
    return rows.withColumns({"founder60": fires, "founder_severity": F.when(fires, severity).otherwise(0.0), "optimal_wob": F.when(fires, F.col("_best")).otherwise(0.0)}).drop(*parts, "_wob_trend", "_rop_trend")


def strategic_report(metrics: DataFrame, n: int = HISTORY, c: Config = DEFAULT) -> DataFrame:
    """The physics report of the last ``n`` packets at each packet: means, trends, hardness, efficiency, dysfunctions, confidence, duration, persistence."""
    frame = last_rows(n)
    rows = founder(windows.with_index(metrics), n, c.founder.min_samples)
    i, count = F.col("idx"), F.count("*").over(frame).cast("double")
    mean, trend = lambda x: F.avg(x).over(frame), lambda x: windows.trend(F.col(x), i, frame)
    rows = rows.withColumns({
        "n": count, "avg_mse": mean("mse"), "mse_trend": trend("mse"), "dxc_trend": trend("dxc"), "flow_balance_trend": trend("flow_balance"), "wob_trend": trend("wob"), "rop_trend": trend("rop"), "avg_pit_rate": mean("pit_rate"),
        "_torque_n": F.count("torque").over(frame), "_torque": mean("torque"), "_torque_std": F.stddev_pop("torque").over(frame), "torque_first": F.first("torque").over(frame), "spp_first": F.first("spp").over(frame),
        "_mse_n": F.count("mse").over(frame), "_idx_var": F.var_pop(i).over(frame), "_mse_var": F.var_pop("mse").over(frame), "_mse_idx": F.covar_pop(i, F.col("mse")).over(frame), "hours": (F.col("ts") - F.first("ts").over(frame)) / 3600.0,
        "operating": F.avg(F.col("state").isin("Drilling", "Reaming").cast("int")).over(frame), "recent_anomalies": F.sum((F.col("category") != "None").cast("int")).over(last_rows(10)),
    })
    parts = {"torque_cv": ("_torque_n", "_torque", "_torque_std"), "consistency": ("_mse_n", "_idx_var", "_mse_var", "_mse_idx")}
    of = {name: [F.col(x) for x in columns] for name, columns in parts.items()}
    rows = rows.withColumns({"torque_cv": windows.variation_of(*of["torque_cv"], c.mechanical.stick_slip_min_samples), "consistency": windows.r_squared_of(*of["consistency"])}).drop(*(x for columns in parts.values() for x in columns))
    hardness = physics.clamp((F.col("avg_mse") - c.physics.formation_hardness_base_psi) / c.physics.formation_hardness_multiplier, 0, 10)
    rise = lambda x, first: F.coalesce(F.when(F.col(first) > 0, ratio(F.col(x) - F.col(first), F.col(first))), F.lit(0.0))
    slipping, _ = windows.stick_slip(F.col("torque_cv"))
    packed, _ = physics.packoff(rise("torque", "torque_first"), rise("spp", "spp_first"), F.lit(0.0), c)
    rows = rows.withColumns({"report_hardness": hardness, "report_optimal": physics.optimal_mse(hardness, c)}).withColumns({
        "report_efficiency": physics.mse_efficiency(F.col("avg_mse"), F.col("report_optimal")), "confidence": F.least(F.col("n") / c.physics.confidence_full_window, F.lit(1.0)),
        "dysfunctions": F.filter(F.array(F.when(slipping, "Stick-slip detected"), F.when(packed, "Pack-off condition"), F.when(F.col("founder60"), "Founder condition")), lambda x: x.isNotNull()),
        "confidence_factor": F.least(F.least(F.col("n") / 60.0, F.lit(1.0)) * 0.4 + F.col("consistency") * 0.3 + F.col("operating") * 0.3, F.lit(1.0)), "sustained": F.col("recent_anomalies") >= 3,
    })
    return rows.drop("torque_first", "spp_first")


def recent_trends(metrics: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last five against the first five of the last ``n`` packets: percentages for energy and exponent, difference for flow; 0 under five packets."""
    frame = last_rows(n)
    rows = metrics.withColumn("_held", F.least(F.row_number().over(ordered()), F.lit(n)))
    # the first five of the window end four rows after its first
    head = lambda x: F.aggregate(F.slice(F.collect_list(x).over(frame), 1, 5), F.lit(0.0), lambda s, v: s + v) / 5.0
    tail = lambda x: F.avg(x).over(last_rows(5))
    enough = F.col("_held") >= 5
    change = lambda x, least: F.when(enough, (tail(x) - head(x)) / F.greatest(head(x), F.lit(least)) * 100.0).otherwise(0.0)
    return rows.withColumns({
        "mse_trend_pct": change("mse", 1.0), "dxc_trend_pct": change("d_exponent", 0.1), "flow_change": F.when(enough, tail("flow_balance") - head("flow_balance")).otherwise(0.0), "history_mse": F.avg("mse").over(frame), "history_pit_rate": F.avg("pit_rate").over(frame),
    }).drop("_held")


def periodic_summary(metrics: DataFrame, seconds: int = 600, poor_percent: float = DEFAULT.mse.efficiency_poor_percent) -> DataFrame:
    """Per well and slot: means, anomaly rate, worst category, and the ladder of ticket kind, severity and trigger."""
    hit = (F.col("category") != "None").cast("int")
    well = F.count_if(F.col("category") == "WellControl") > 0
    last_hit = F.max_by(F.when(hit == 1, F.col("category")), F.when(hit == 1, F.struct("ts", "seq")))
    bounded = F.when((F.col("ecd_margin") < 100) & (F.col("ecd_margin") > -100), F.col("ecd_margin")).otherwise(0.0)
    out = metrics.groupBy("well_id", (F.col("ts") - F.col("ts") % seconds).alias("slot")).agg(
        F.count("*").alias("n"), F.avg("mse").alias("avg_mse"), F.avg("flow_balance").alias("avg_flow_balance"), F.avg("rop").alias("avg_rop"), F.avg(bounded).alias("avg_ecd_margin"), (100.0 * F.avg(hit)).alias("anomaly_rate"), F.sum(hit).alias("anomalies"), well.alias("well_control"), last_hit.alias("worst"),
    )
    rate, energy = F.col("anomaly_rate"), F.col("avg_mse")
    ladder = lambda a, b, c, d: F.when(F.col("well_control"), a).when(rate > 30, b).when(energy > poor_percent * 1000.0, c).otherwise(d)
    lit = lambda x: F.lit(x)
    return out.withColumns({
        "kind": ladder(lit("RiskWarning"), lit("Intervention"), lit("Optimization"), lit("Optimization")), "severity": ladder(lit("High"), lit("Medium"), lit("Low"), lit("Low")),
        "category": ladder(lit("WellControl"), F.col("worst"), lit("DrillingEfficiency"), lit("None")), "trigger": ladder(lit("well_control_events"), lit("anomaly_rate"), lit("avg_mse"), lit("periodic_summary")),
        "trigger_value": ladder(F.col("anomalies").cast("double"), rate, energy, lit(0.0)),
        "description": digits.printf("Periodic 10-minute summary: %.1f%% anomaly rate, avg ROP %.1f ft/hr", rate, F.col("avg_rop")),
    }).drop("anomalies", "well_control", "worst")


def shift_handover(metrics: DataFrame, seconds: int = 43200) -> DataFrame:
    """Per well and shift: depths, footage, means and ranges of parameters, tickets."""
    span = lambda x: (F.avg(x).alias(f"avg_{x}"), F.min(x).alias(f"min_{x}"), F.max(x).alias(f"max_{x}"))
    return metrics.groupBy("well_id", (F.col("ts") - F.col("ts") % seconds).alias("shift")).agg(
        F.count("*").alias("n"), F.min("bit_depth").alias("depth_start"), F.max("bit_depth").alias("depth_end"), F.round(F.max("bit_depth") - F.min("bit_depth"), 1).alias("footage"), *span("rop"), *span("wob"), *span("rpm"),
        F.count_if(F.col("category") != "None").alias("tickets"), F.count_if(F.col("category") == "WellControl").alias("well_control"),
    )


def shift_summary(metrics: DataFrame, acks: DataFrame, began: int, ended: int) -> DataFrame:
    """Per well between two times: packets, tickets by category, worst severity, mean efficiency and acknowledgements (well_id, ts)."""
    inside = lambda rows: rows.filter(F.col("ts").between(began, ended))
    tickets = {c: F.count_if(F.col("category") == c).alias(f"n_{c}") for c in ("WellControl", "Hydraulics", "Mechanical", "DrillingEfficiency")}
    rank = F.coalesce(*[F.when(F.col("severity") == s, F.lit(i)) for i, s in enumerate(("NONE", "LOW", "WARNING", "HIGH", "CRITICAL"))], F.lit(0))
    out = inside(metrics).groupBy("well_id").agg(F.count("*").alias("packets"), *tickets.values(), F.max_by("severity", rank).alias("peak_severity"), F.avg("mse_efficiency").alias("avg_mse_efficiency"))
    seen = inside(acks).groupBy("well_id").agg(F.count("*").alias("acks"))
    return out.join(seen, "well_id", "left").withColumns({"acks": F.coalesce("acks", F.lit(0)), "hours": F.lit((ended - began) / 3600.0)})


def live_view(metrics: DataFrame) -> DataFrame:
    """The newest packet of each well with the energy of its baseline (85 % where none is locked) and the direction of its trend."""
    newest = metrics.withColumn("_back", F.row_number().over(Window.partitionBy("well_id").orderBy(F.desc("ts"), F.desc("seq")))).filter("_back <= 2")
    at = lambda k, x: F.max(F.when(F.col("_back") == k, F.col(x)))
    out = newest.groupBy("well_id").agg(*[at(1, x).alias(x) for x in ("seq", "ts", "bit_depth", "state", "rop", "wob", "rpm", "mse", "mse_efficiency", "category", "severity")], at(2, "mse").alias("_before"))
    change = ratio(F.col("mse") - F.col("_before"), F.col("_before"))
    return out.withColumns({"baseline_mse": 0.85 * F.col("mse"), "trend": F.when(change > 0.05, "rising").when(change < -0.05, "falling").otherwise("stable")}).drop("_before")


def trip_speed(rows: DataFrame) -> Column:
    """Feet a minute from the packet before, 150 at most; NULL at 0.5 or less."""
    order = ordered()
    seconds = F.greatest((F.col("ts") - F.lag("ts").over(order)).cast("double"), F.lit(1.0))
    speed = F.least(F.abs(F.col("bit_depth") - F.lag("bit_depth").over(order)) / seconds * 60.0, F.lit(150.0))
    return F.when(speed > 0.5, speed)


def shock_factor(state: Column) -> Column:
    return F.when(state.isin("Drilling", "Reaming"), 1.2).otherwise(1.0)


def sustained(rows: DataFrame, seconds: int = 120) -> DataFrame:
    """Means per well of packets whose parameters did not change for over ``seconds``."""
    held = rows.filter(F.col("since_change") > seconds)
    return held.groupBy("well_id").agg(F.avg("rop").alias("avg_rop"), F.greatest(F.max("rop"), F.lit(0.0)).alias("best_rop"), F.avg("mse").alias("avg_mse"), F.avg("wob").alias("avg_wob"), F.avg("rpm").alias("avg_rpm"), F.count("*").alias("samples"))


def snapshot(metrics: DataFrame) -> DataFrame:
    """The sixteen columns of a history snapshot."""
    return metrics.select("seq", F.col("ts").alias("timestamp"), F.col("bit_depth").alias("depth"), "rop", "wob", "rpm", "torque", "spp", "flow_in", "flow_out", "mse", "mse_efficiency", "d_exponent", "flow_balance", "pit_rate", "ecd_margin", "gas_units")
