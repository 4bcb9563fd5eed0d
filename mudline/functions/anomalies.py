"""The anomaly cascade and what follows from its category, as CASE chains (first match wins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mudline.config import DEFAULT, Config
from mudline.functions import physics
from mudline.functions.states import ACTIVE

#: Ordinals of ticket severities (fixed values).
LEVELS = {"Low": 1, "Medium": 2, "High": 3, "Critical": 4}


def ordinal(severity: Column) -> Column:
    """The place of a severity among ``LEVELS``, which are in ascending order; its argument stands in the expression once, so that steps do not multiply."""
    return F.nullif(F.array_position(F.array(*[F.lit(k) for k in LEVELS]), severity), F.lit(0)).cast("int")


def named(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in LEVELS]), F.least(F.greatest(level, F.lit(1)), F.lit(len(LEVELS))))


def cascade(state: Column, p: dict[str, Column], c: Config = DEFAULT, overrides: dict[str, Column] | None = None) -> Column:
    """Struct (rule, category, severity word) of the first rule that fires, or rule ``none``.

    ``overrides`` may hold flow_warning, spp_warning, spp_critical, torque_warning
    and torque_critical of a well's own baselines; NULL falls back to ``c``.

    ``p`` holds the packet's columns, the derived ones and those of the packet
    before: flow_in, flow_out, pit_change, gas, background, h2s, pit_rate,
    ecd_margin, spp_delta, torque_delta, prev_wob, prev_rop, wob, rop, efficiency.
    """
    w, h, m = c.well_control, c.hydraulics, c.mechanical
    word = lambda high, a, b: F.when(high, a).otherwise(b)
    three = lambda s: F.when(s > 0.7, "CRITICAL").when(s > 0.4, "HIGH").otherwise("WARNING")
    limit = lambda name, default: F.coalesce((overrides or {}).get(name, F.lit(None).cast("double")), F.lit(float(default)))
    flow_limit, spp_limit, spp_grave = limit("flow_warning", w.flow_imbalance_warning_gpm), limit("spp_warning", h.spp_deviation_warning_psi), limit("spp_critical", h.spp_deviation_critical_psi)
    torque_limit, torque_grave = limit("torque_warning", m.torque_increase_warning), limit("torque_critical", m.torque_increase_critical)
    trusted = physics.flow_available(p["flow_in"], p["flow_out"])
    kicks, kick_s = physics.kick(p["flow_in"], p["flow_out"], p["pit_change"], p["gas"], p["background"], c, flow_limit)
    loses, loss_s = physics.lost_circulation(p["flow_in"], p["flow_out"], p["pit_change"], F.greatest(p["spp_delta"], F.lit(0.0)), c, flow_limit, spp_limit)
    founders, _, rop_change = physics.founder_quick(p["prev_wob"], p["prev_rop"], p["wob"], p["rop"], c)
    pit, spp = F.abs(p["pit_rate"]), F.abs(p["spp_delta"])
    rules = [
        ("kick", trusted & kicks, "WellControl", three(kick_s)),
        ("loss", trusted & loses, "WellControl", three(loss_s)),
        ("gas", p["gas"] > w.gas_units_warning, "WellControl", word(p["gas"] > w.gas_units_critical, "CRITICAL", "WARNING")),
        ("h2s", p["h2s"] > w.h2s_warning_ppm, "WellControl", word(p["h2s"] > w.h2s_critical_ppm, "CRITICAL", "WARNING")),
        ("pit_rate", pit > w.pit_rate_warning_bbl_hr, "WellControl", word(pit > w.pit_rate_critical_bbl_hr, "CRITICAL", "WARNING")),
        ("ecd", p["ecd_margin"] < h.ecd_margin_warning_ppg, "Hydraulics", word(p["ecd_margin"] < h.ecd_margin_critical_ppg, "CRITICAL", "WARNING")),
        ("spp", spp > spp_limit, "Hydraulics", word(spp > spp_grave, "HIGH", "WARNING")),
        ("torque", p["torque_delta"] > torque_limit, "Mechanical", word(p["torque_delta"] > torque_grave, "HIGH", "WARNING")),
        ("founder", founders & (state == "Drilling"), "Mechanical", word(rop_change < -0.05, "HIGH", "WARNING")),
        ("mse", (state == "Drilling") & (p["efficiency"] < c.mse.efficiency_warning_percent), "DrillingEfficiency", word(p["efficiency"] < c.mse.efficiency_poor_percent, "HIGH", "LOW")),
    ]
    made = lambda rule, category, severity: F.struct(F.lit(rule).alias("rule"), F.lit(category).alias("category"), severity.alias("severity"))
    out = F.when(~state.isin(*ACTIVE), made("none", "None", F.lit("NONE")))
    for rule, fires, category, severity in rules:
        out = out.when(F.coalesce(fires, F.lit(False)), made(rule, category, severity))
    return out.otherwise(made("none", "None", F.lit("NONE")))


def efficiency_score(efficiency: Column, is_anomaly: Column, category: Column, mse_trend: Column) -> Column:
    """0 to 100, truncated: efficiency less a penalty by category, plus 5 where MSE falls above 70 %."""
    #: Penalties by category (fixed values).
    penalties = {"WellControl": 30.0, "Hydraulics": 20.0, "Mechanical": 15.0, "DrillingEfficiency": 10.0, "Formation": 5.0}
    penalty = F.coalesce(*[F.when(is_anomaly & (category == k), F.lit(v)) for k, v in penalties.items()], F.lit(0.0))
    bonus = F.when((mse_trend < 0) & (efficiency > 70), 5.0).otherwise(0.0)
    return physics.clamp(efficiency - penalty + bonus, 0, 100).cast("int")


def aci_adjusted(base: Column, category: Column, outliers: Column) -> Column:
    """Severity after counting conformal outliers: fewer than 2 step it down, 5 or more step it up."""
    level = ordinal(base)
    guarded = (category == "WellControl") & (level < 4)
    return named(level + F.when((outliers < 2) & ~guarded, -1).when(outliers >= 5, 1).otherwise(0))


def net_adjusted(base: Column, category: Column, score: Column) -> Column:
    """Severity after the networks' anomaly score: two levels down under 0.2, up to two up from 0.8; well control never falls under High."""
    step = F.when(score < 0.2, -2).when(score < 0.4, -1).when(score >= 0.8, 2).when(score >= 0.6, 1).otherwise(0)
    level = ordinal(base)
    guarded = F.greatest(step, F.when(level < 4, F.lit(0)).otherwise(-1))
    return named(level + F.when(category == "WellControl", guarded).otherwise(step))
