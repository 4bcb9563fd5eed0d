"""What a ticket says: base severity and type, trigger, breaches, pattern, verification, and advice texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mudline.config import DEFAULT, Config


def base_severity(p: dict[str, Column], c: Config = DEFAULT) -> tuple[Column, Column]:
    """Severity and type by category, before any adjustment."""
    w, h, cat = c.well_control, c.hydraulics, p["category"]
    grave = {
        "WellControl": (F.abs(p["flow_balance"]) > w.flow_imbalance_critical_gpm) | (F.abs(p["pit_rate"]) > w.pit_rate_critical_bbl_hr),
        "Hydraulics": (p["ecd_margin"] < h.ecd_margin_critical_ppg) | (F.abs(p["spp_delta"]) > h.spp_deviation_critical_psi),
        "Mechanical": p["torque_delta"] > c.mechanical.torque_increase_critical,
        "DrillingEfficiency": p["efficiency"] < c.mse.efficiency_poor_percent,
    }
    #: Severity and type where grave and where not (fixed values).
    words = {"WellControl": (("Critical", "Intervention"), ("High", "RiskWarning")), "Hydraulics": (("High", "RiskWarning"), ("Medium", "RiskWarning")), "Mechanical": (("High", "Intervention"), ("Medium", "RiskWarning")), "DrillingEfficiency": (("Medium", "Optimization"), ("Low", "Optimization"))}
    out = []
    for k in (0, 1):
        chain = F.when(F.lit(False), "")
        for name, (hard, soft) in words.items():
            chain = chain.when((cat == name) & grave[name], hard[k]).when(cat == name, soft[k])
        out.append(chain.otherwise(("Low", "Optimization")[k]))
    return out[0], out[1]


def trigger(p: dict[str, Column], c: Config = DEFAULT) -> Column:
    """Struct (parameter, value, threshold) of what set the ticket off."""
    w, h = c.well_control, c.hydraulics
    made = lambda name, value, limit: F.struct(F.lit(name).alias("parameter"), value.alias("value"), F.lit(float(limit)).alias("threshold"))
    cat = p["category"]
    return (
        F.when((cat == "WellControl") & (F.abs(p["flow_balance"]) > w.flow_imbalance_warning_gpm), made("flow_balance", p["flow_balance"], w.flow_imbalance_warning_gpm))
        .when(cat == "WellControl", made("pit_rate", p["pit_rate"], w.pit_rate_warning_bbl_hr))
        .when((cat == "Hydraulics") & (p["ecd_margin"] < h.ecd_margin_warning_ppg), made("ecd_margin", p["ecd_margin"], h.ecd_margin_warning_ppg))
        .when(cat == "Hydraulics", made("spp_delta", p["spp_delta"], h.spp_deviation_warning_psi))
        .when(cat == "Mechanical", made("torque_delta", p["torque_delta"], c.mechanical.torque_increase_warning))
        .when(cat == "DrillingEfficiency", made("mse_efficiency", p["efficiency"], c.mse.efficiency_warning_percent))
        .when(cat == "Formation", made("d_exponent", p["d_exponent"], 0.0))
    )


def breaches(p: dict[str, Column], c: Config = DEFAULT) -> Column:
    """Array of (parameter, value, threshold, level, unit) of all limits that are passed."""
    w, h, m = c.well_control, c.hydraulics, c.mechanical
    size = lambda x: F.abs(x)
    above = [
        ("flow_balance", p["flow_balance"], size(p["flow_balance"]), w.flow_imbalance_warning_gpm, w.flow_imbalance_critical_gpm, "gpm"), ("pit_rate", p["pit_rate"], size(p["pit_rate"]), w.pit_rate_warning_bbl_hr, w.pit_rate_critical_bbl_hr, "bbl/hr"),
        ("gas_units", p["gas"], p["gas"], w.gas_units_warning, w.gas_units_critical, "units"), ("h2s", p["h2s"], p["h2s"], w.h2s_warning_ppm, w.h2s_critical_ppm, "ppm"), ("ecd_margin", p["ecd_margin"], -p["ecd_margin"], -h.ecd_margin_warning_ppg, -h.ecd_margin_critical_ppg, "ppg"),
        ("spp_delta", p["spp_delta"], size(p["spp_delta"]), h.spp_deviation_warning_psi, h.spp_deviation_critical_psi, "psi"), ("torque_increase", p["torque_delta"] * 100.0, p["torque_delta"] * 100.0, m.torque_increase_warning * 100, m.torque_increase_critical * 100, "%"),
        ("mse_efficiency", p["efficiency"], -p["efficiency"], -c.mse.efficiency_warning_percent, -c.mse.efficiency_poor_percent, "%"),
    ]
    made = []
    for name, value, measure, warning, critical, unit in above:
        grave = measure > critical
        limit = F.when(grave, abs(float(critical))).otherwise(abs(float(warning)))
        made.append(F.when(measure > warning, F.struct(F.lit(name).alias("parameter"), value.alias("value"), limit.alias("threshold"), F.when(grave, "CRITICAL").otherwise("WARNING").alias("level"), F.lit(unit).alias("unit"))))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def pattern(p: dict[str, Column], c: Config = DEFAULT) -> Column:
    """The name of the pattern behind a ticket."""
    w, h, m, cat, flow = c.well_control, c.hydraulics, c.mechanical, p["category"], p["flow_balance"]
    well, hydraulic, mechanical = cat == "WellControl", cat == "Hydraulics", cat == "Mechanical"
    return (
        F.when(well & (flow > w.flow_imbalance_critical_gpm), "Kick").when(well & (flow > w.flow_imbalance_warning_gpm), "Kick Warning")
        .when(well & (flow < -w.flow_imbalance_critical_gpm), "Lost Circulation").when(well & (flow < -w.flow_imbalance_warning_gpm), "Loss Warning")
        .when(well & ((p["gas"] > w.gas_units_critical) | (p["h2s"] > w.h2s_critical_ppm)), "Gas Critical").when(well & (p["gas"] > w.gas_units_warning), "Gas Warning")
        .when(well & (F.abs(p["pit_rate"]) > w.pit_rate_critical_bbl_hr), "Pit Rate Critical").when(well, "Well Control Warning")
        .when(hydraulic & (p["ecd_margin"] < h.ecd_margin_critical_ppg), "ECD Critical").when(hydraulic & (p["ecd_margin"] < h.ecd_margin_warning_ppg), "ECD Warning")
        .when(hydraulic & (F.abs(p["spp_delta"]) > h.spp_deviation_critical_psi), "SPP Critical").when(hydraulic, "SPP Warning")
        .when(mechanical & (p["torque_delta"] > m.torque_increase_critical) & (p["spp_delta"] > h.spp_deviation_warning_psi), "Pack-off").when(mechanical & (p["torque_delta"] > m.torque_increase_warning) & (p["spp_delta"] > 0), "Pack-off Warning")
        .when(mechanical & (p["torque_delta"] > m.stick_slip_cv_warning), "Stick-slip").when(mechanical, "Founder")
        .when((cat == "DrillingEfficiency") & (p["efficiency"] < c.mse.efficiency_poor_percent), "MSE Inefficiency").when(cat == "DrillingEfficiency", "MSE Warning")
        .when(cat == "Formation", "Formation Change").otherwise("Normal")
    )


#: Limits of the second look at a ticket (fixed values).
VERIFY = {"flow_confirm": 15.0, "flow_critical": 20.0, "pit_confirm": 10.0, "pit_critical": 15.0, "flow_transient": 5.0, "pit_transient": 3.0, "spp_sustained": 150.0, "spp_normal": 50.0, "consistency": 0.5, "formation_consistency": 0.6, "dxc": 0.1}


def verify(p: dict[str, Column], c: Config = DEFAULT) -> Column:
    """Struct (status, severity) of a ticket from the averages around it.

    ``p``: category, flow5 and pit5 (means over 5 rows), ecd10, spp10 and torque10
    (over 10), n (rows so far), sustained, consistency, efficiency, dxc_trend,
    founder, founder_severity, stick_slip, packoff, near_boundary, net_score
    (NULL where not calibrated).
    """
    v, h, m = VERIFY, c.hydraulics, c.mechanical
    said = lambda status, severity: F.struct(F.lit(status).alias("status"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"))
    # an open case follows the networks where they are sure
    unsure = lambda severity: F.when(p["net_score"] >= 0.65, said("Confirmed", severity)).when(p["net_score"] < 0.35, said("Rejected", "Healthy")).otherwise(said("Uncertain", severity))
    flow, pit = F.abs(p["flow5"]), F.abs(p["pit5"])
    lasting = p["sustained"] | (p["n"] >= 3)
    well = (
        F.when((flow > v["flow_confirm"]) | (pit > v["pit_confirm"]), said("Confirmed", F.when((flow > v["flow_critical"]) | (pit > v["pit_critical"]), "Critical").otherwise("High")))
        .when(lasting & ((flow > v["flow_transient"]) | (pit > v["pit_transient"])), said("Confirmed", "High"))
        .when(~lasting & (flow < v["flow_transient"]), said("Rejected", "Healthy"))
        .otherwise(unsure("Medium"))
    )
    hydraulic = (
        F.when(p["ecd10"] < h.ecd_margin_critical_ppg, said("Confirmed", "Critical"))
        .when((F.abs(p["spp10"]) > v["spp_sustained"]) & p["sustained"], said("Confirmed", "High"))
        .when(p["ecd10"] < h.ecd_margin_warning_ppg, said("Confirmed", "Medium"))
        .when((F.abs(p["spp10"]) < v["spp_normal"]) & (p["ecd10"] > h.ecd_margin_warning_ppg), said("Rejected", "Healthy"))
        .otherwise(unsure("Low"))
    )
    founder = F.when((p["founder_severity"] >= 0.7) & ~p["near_boundary"], "High").when(p["founder_severity"] >= 0.3, "Medium").otherwise("Low")
    mechanical = (
        F.when(p["founder"], said("Confirmed", founder))
        .when(p["stick_slip"] & (p["consistency"] > v["consistency"]), said("Confirmed", "Medium"))
        .when(p["packoff"] | ((p["torque10"] > m.torque_increase_critical) & p["sustained"]), said("Confirmed", F.when(p["near_boundary"], "Medium").otherwise("High")))
        .when(p["torque10"] > m.torque_increase_warning, unsure("Medium"))
        .otherwise(said("Rejected", "Healthy"))
    )
    efficiency = (
        F.when((p["efficiency"] < c.mse.efficiency_poor_percent) & (p["consistency"] > v["consistency"]), said("Confirmed", "Medium"))
        .when((p["efficiency"] < c.mse.efficiency_warning_percent) & p["sustained"], said("Confirmed", "Low"))
        .when(p["efficiency"] >= c.mse.efficiency_warning_percent, said("Rejected", "Healthy"))
        .otherwise(unsure("Low"))
    )
    formation = (
        F.when((F.abs(p["dxc_trend"]) > v["dxc"]) & (p["consistency"] > v["formation_consistency"]), said("Confirmed", "Low"))
        .when(p["dxc_trend"] < -0.15, said("Confirmed", "Medium"))
        .otherwise(said("Rejected", "Healthy"))
    )
    cat = p["category"]
    return F.when(cat == "WellControl", well).when(cat == "Hydraulics", hydraulic).when(cat == "Mechanical", mechanical).when(cat == "DrillingEfficiency", efficiency).when(cat == "Formation", formation)


def default_parameters(hardness: Column) -> Column:
    """Operating ranges by hardness: soft under 3.5, medium under 6, else hard (fixed values)."""
    span = lambda low, best, high: F.struct(F.lit(float(low)).alias("min"), F.lit(float(best)).alias("optimal"), F.lit(float(high)).alias("max"))
    made = lambda wob, rpm, flow, mud: F.struct(span(*wob).alias("wob"), span(*rpm).alias("rpm"), span(*flow).alias("flow"), F.lit(mud).alias("mud_weight"))
    return (
        F.when(hardness < 3.5, made((5, 10, 15), (80, 120, 160), (400, 500, 600), 9.0))
        .when(hardness < 6.0, made((15, 25, 35), (80, 110, 140), (450, 520, 600), 10.0))
        .otherwise(made((20, 30, 40), (60, 90, 120), (500, 550, 650), 11.0))
    )


def recommend(current: Column, span: Column, offset_best: Column) -> Column:
    """A new value where it lies 5 % of the span away: the bound if outside, else the offset wells' best if inside the range, else the optimum."""
    inside = (offset_best >= span["min"]) & (offset_best <= span["max"]) & (offset_best > 0)
    target = F.when(current < span["min"], span["min"]).when(current > span["max"], span["max"]).when(inside, offset_best).otherwise(span["optimal"])
    return F.when(F.abs(target - current) >= 0.05 * (span["max"] - span["min"]), target)


def trace_line(steps: Column) -> Column:
    """``[stage] message`` of an array of (stage, status, message), joined by arrows."""
    return F.array_join(F.transform(steps, lambda s: F.concat(F.lit("["), s["stage"], F.lit("] "), s["message"])), " -> ")
