"""Scalar drilling physics as Column expressions (JVM side, foldable into one codegen span).

Doubles in, doubles out; zero stands for "cannot be assessed", as in the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from mudline.config import DEFAULT, Config



def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` between two limits; NULL stays NULL (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL for b = 0 (ANSI mode would raise)."""
    return F.try_divide(a, b)


def mse(torque: Column, rpm: Column, diameter: Column, rop: Column, wob: Column, c: Config = DEFAULT) -> Column:
    """Mechanical specific energy in psi."""
    area = diameter * diameter
    rotary = F.when(rop > c.physics.min_rop_for_mse, ratio(480.0 * torque * 1000.0 * rpm, area * rop)).otherwise(0.0)
    axial = ratio(4.0 * wob * 1000.0, math.pi * area)
    return F.when((diameter <= 0) | (rop <= 0), 0.0).otherwise(rotary + axial)


def hardness(rop: Column, wob: Column, rpm: Column) -> Column:
    """Formation hardness 0 to 10 from how far the rate of penetration lags the expected one."""
    expected = F.greatest(wob * rpm * 0.01, F.lit(1.0))
    return F.when((rop <= 0) | (wob <= 0) | (rpm <= 0), 5.0).otherwise(clamp(5.0 / F.greatest(rop / expected, F.lit(0.1)), 0, 10))


def optimal_mse(hard: Column, c: Config = DEFAULT) -> Column:
    return c.physics.formation_hardness_base_psi + clamp(hard, 0, 10) * c.physics.formation_hardness_multiplier


def mse_efficiency(actual: Column, optimal: Column) -> Column:
    """Percent, 0 to 100."""
    return F.when((actual <= 0) | (optimal <= 0), 0.0).otherwise(clamp(ratio(optimal, actual) * 100.0, 0, 100))


def d_exponent(rop: Column, rpm: Column, wob: Column, diameter: Column) -> Column:
    """The logged d-exponent: log10(ROP / 60 RPM) / log10(12 WOB / D), never negative."""
    sound = (rop > 0) & (rpm > 0) & (wob > 0) & (diameter > 0)
    below = F.log10(ratio(12.0 * wob, diameter))
    return F.when(sound & (F.abs(below) >= 1e-10), F.greatest(ratio(F.log10(ratio(rop, 60.0 * rpm)), below), F.lit(0.0))).otherwise(0.0)


def d_exponent_textbook(rop: Column, rpm: Column, wob_klbs: Column, diameter: Column) -> Column:
    """The textbook form with weight in pounds; an extra beside the logged one."""
    sound = (rop > 0) & (rpm > 0) & (wob_klbs > 0) & (diameter > 0)
    return F.when(sound, ratio(F.log10(ratio(rop, 60.0 * rpm)), F.log10(ratio(12.0 * wob_klbs, 1000.0 * diameter)))).otherwise(0.0)


def dxc(d: Column, mud_weight: Column, c: Config = DEFAULT) -> Column:
    """d-exponent corrected for mud weight."""
    return F.when(mud_weight <= 0, d).otherwise(d * ratio(F.lit(c.hydraulics.normal_mud_weight_ppg), mud_weight))


def annular_pressure_loss(flow: Column, depth: Column, c: Config = DEFAULT) -> Column:
    return c.hydraulics.annular_pressure_loss_coefficient * flow * depth / 1000.0


def ecd(mud_weight: Column, pressure_loss: Column, tvd: Column) -> Column:
    return F.when(tvd <= 0, mud_weight).otherwise(mud_weight + ratio(pressure_loss, 0.052 * tvd))


def flow_available(flow_in: Column, flow_out: Column) -> Column:
    """Whether flow-out can be trusted: present, or no flow at all."""
    return (flow_out > 0) | ~((flow_in > 0) | (flow_out > 0))


def flow_balance(flow_in: Column, flow_out: Column) -> Column:
    return F.when((flow_out > 0), flow_out - flow_in).otherwise(0.0)


def ecd_margin(fracture_gradient: Column, ecd_: Column) -> Column:
    """Margin to fracture; 1.5 ppg where either value is missing."""
    return F.when((fracture_gradient > 0) & (ecd_ > 0), fracture_gradient - ecd_).otherwise(1.5)


def scored(parts: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Number of conditions that hold, and the mean of their strengths (each capped at 1)."""
    n = sum((p.cast("int") for p, _ in parts[1:]), parts[0][0].cast("int"))
    total = sum((F.when(p, F.least(s, F.lit(1.0))).otherwise(0.0) for p, s in parts[1:]), F.when(parts[0][0], F.least(parts[0][1], F.lit(1.0))).otherwise(0.0))
    return n, F.when(n > 0, F.least(total / F.greatest(n, F.lit(1)), F.lit(1.0))).otherwise(0.0)


def kick(flow_in: Column, flow_out: Column, pit_change: Column, gas: Column, background: Column, c: Config = DEFAULT, flow_limit: Column | None = None) -> tuple[Column, Column]:
    """Whether two of flow, pit and gas point to an influx, and how strongly."""
    flow, rise = flow_out - flow_in, gas - background
    n, severity = scored([
        (flow > (F.lit(c.well_control.flow_imbalance_warning_gpm) if flow_limit is None else flow_limit), flow / c.physics.kick_flow_severity_divisor),
        (pit_change > c.well_control.pit_gain_warning_bbl, pit_change / c.physics.kick_pit_severity_divisor),
        (rise > c.physics.kick_gas_increase_threshold, rise / c.physics.kick_gas_severity_divisor),
    ])
    return n >= c.physics.kick_min_indicators, severity


def lost_circulation(flow_in: Column, flow_out: Column, pit_change: Column, spp_drop: Column, c: Config = DEFAULT, flow_limit: Column | None = None, spp_limit: Column | None = None) -> tuple[Column, Column]:
    flow = flow_in - flow_out
    n, severity = scored([
        (flow > (F.lit(c.well_control.flow_imbalance_warning_gpm) if flow_limit is None else flow_limit), flow / c.physics.kick_flow_severity_divisor),
        (pit_change < -c.well_control.pit_gain_warning_bbl, F.abs(pit_change) / c.physics.kick_pit_severity_divisor),
        (spp_drop > (F.lit(c.hydraulics.spp_deviation_warning_psi) if spp_limit is None else spp_limit), spp_drop / c.physics.kick_gas_severity_divisor),
    ])
    return n >= c.physics.loss_min_indicators, severity


def packoff(torque_rise: Column, spp_rise: Column, rop_drop: Column, c: Config = DEFAULT) -> tuple[Column, Column]:
    torque, spp, rop = torque_rise > c.mechanical.torque_increase_warning, spp_rise > c.mechanical.packoff_spp_increase_threshold, rop_drop > c.mechanical.packoff_rop_decrease_threshold
    _, severity = scored([(torque, torque_rise / 0.30), (spp, spp_rise / 0.25), (rop, rop_drop / 0.50)])
    return torque & (spp | rop), severity


def founder_quick(prev_wob: Column, prev_rop: Column, wob: Column, rop: Column, c: Config = DEFAULT) -> tuple[Column, Column, Column]:
    """Weight rose while the rate of penetration did not: flag and both relative changes."""
    sound = (prev_wob >= c.founder.min_wob_klbs) & (wob >= c.founder.min_wob_klbs) & (prev_rop > 0)
    dw, dr = F.when(sound, ratio(wob - prev_wob, prev_wob)).otherwise(0.0), F.when(sound, ratio(rop - prev_rop, prev_rop)).otherwise(0.0)
    return F.coalesce(sound & (dw > c.founder.quick_wob_delta_percent) & (dr <= 0), F.lit(False)), dw, dr


def formation_change(mse_trend: Column, dxc_trend: Column, mse_change: Column, c: Config = DEFAULT) -> Column:
    f = c.formation
    return (
        F.when((mse_change > f.mse_change_significant) & (mse_trend > 0) & (dxc_trend > f.dxc_trend_threshold), "HardStringer")
        .when((mse_change < -f.mse_change_significant) & (mse_trend < 0), "SoftStringer")
        .when((dxc_trend < f.dxc_pressure_threshold) & (F.abs(mse_change) < f.mse_pressure_tolerance), "PressureIncrease")
        .otherwise("None")
    )


def damping(kind: Column, severity: Column, wob: Column, rpm: Column, max_wob_pct: float = 20.0, max_rpm_pct: float = 20.0) -> tuple[Column, Column]:
    """Recommended weight and speed against oscillation; NULL for weights under 3 klbs."""
    s = clamp(severity, 0.5, 1.0)
    slip = kind == "StickSlip"
    cut = F.least(F.when(slip, 10.0 + 5.0 * s).otherwise(10.0), F.lit(max_wob_pct))
    rise = F.least(F.when(slip, 5.0 + 5.0 * s).otherwise(0.0), F.lit(max_rpm_pct))
    new_wob = F.greatest(wob * (1 - cut / 100.0), F.lit(3.0))
    new_rpm = F.when(rise > 0, F.least(rpm * (1 + rise / 100.0), rpm * 1.5)).otherwise(rpm)
    return F.when(wob >= 3.0, new_wob), F.when(wob >= 3.0, new_rpm)


def swab_surge(speed: Column, depth: Column, mud_weight: Column, pore: Column, fracture: Column, hole_diameter: Column, tripping_in: Column, c: Config = DEFAULT) -> Column:
    """Struct of pressure change, equivalent mud weight, margins and risk while tripping."""
    od = c.trip.pipe_od_in
    pipe, hole = math.pi / 4 * od * od, math.pi / 4 * hole_diameter * hole_diameter
    velocity = F.when(hole > pipe, ratio(speed * pipe, hole - pipe)).otherwise(0.0)
    gap = (hole_diameter - od) / 2
    friction = F.when(gap > 0, ratio(c.trip.plastic_viscosity_cp * velocity * depth, 60000.0 * gap * gap) + ratio(c.trip.yield_point * depth, 200.0 * gap)).otherwise(0.0)
    signed = F.when(tripping_in, 0.45 * friction).otherwise(-0.45 * friction)
    still, unknown = (F.abs(speed) < 0.01) | (depth <= 0), (pore <= 0) | (fracture <= 0)
    change = F.when(still | unknown, 0.0).otherwise(signed)
    weight = mud_weight + F.when(still | unknown, 0.0).otherwise(ratio(signed, 0.052 * depth))
    to_pore = F.when(~still & unknown, 0.0).otherwise(weight - pore)
    to_fracture = F.when(~still & unknown, 0.0).otherwise(fracture - weight)
    risk = F.when(still, "Safe").when(unknown, "Warning").when((to_pore < 0) | (to_fracture < 0), "Critical").when((to_pore < 0.3) | (to_fracture < 0.3), "Warning").otherwise("Safe")
    return F.struct(change.alias("pressure_change"), weight.alias("emw"), to_pore.alias("to_pore"), to_fracture.alias("to_fracture"), risk.alias("risk"))


def miners_rule(cycles: Column, rating: Column) -> Column:
    return F.when(rating <= 0, 1.0).otherwise(ratio(cycles.cast("double"), rating))


def l10_life(rpm: Column, load: Column, rating: Column) -> Column:
    """Bearing life in hours; 0 where load or speed is missing."""
    return F.when((rpm <= 0) | (load <= 0), 0.0).otherwise(ratio(F.lit(1e6), 60.0 * rpm) * F.pow(ratio(rating, load), F.lit(3.0)))


def fahrenheit_from_celsius(c: Column) -> Column:
    return c * 9.0 / 5.0 + 32.0


def fahrenheit_from_kelvin(k: Column) -> Column:
    return F.when(k <= 0, 0.0).otherwise((k - 273.15) * 9.0 / 5.0 + 32.0)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.when(x > 20.0, x).otherwise(F.log(1.0 + F.exp(x)))
