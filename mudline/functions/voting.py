"""Specialist votes and their weighted ensemble.

Each specialist is a Column of a severity word; ``SPECIALISTS`` is the registry
to which further ones may be added.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mudline.config import DEFAULT, Config
from mudline.functions.anomalies import ordinal
from mudline.functions.physics import clamp, ratio

#: Weight multipliers of specialists by regime 0 to 3, higher regimes as 3 (fixed values).
REGIMES = {
    "mse": (1.0, 0.8, 1.4, 0.7),
    "hydraulic": (1.0, 1.4, 0.8, 1.0),
    "well_control": (1.0, 1.0, 0.9, 1.5),
    "formation": (1.0, 0.8, 1.1, 0.8),
    "stuck_pipe": (1.0, 1.3, 1.4, 0.8),
}
REGIME_LABELS = ("baseline", "hydraulic-stress", "high-wob", "unstable")


def vote_mse(p: dict[str, Column], c: Config) -> Column:
    e = p["efficiency"]
    return F.when(e <= 0, "Low").when(e < c.mse.efficiency_poor_percent, "High").when(e < c.mse.efficiency_warning_percent, "Medium").otherwise("Low")


def vote_hydraulic(p: dict[str, Column], c: Config) -> Column:
    h, margin, spp = c.hydraulics, p["ecd_margin"], F.abs(p["spp_delta"])
    return F.when(margin < h.ecd_margin_critical_ppg, "Critical").when((margin < h.ecd_margin_warning_ppg) | (spp > h.spp_deviation_critical_psi), "High").when(spp > h.spp_deviation_warning_psi, "Medium").otherwise("Low")


def vote_well_control(p: dict[str, Column], c: Config) -> Column:
    w, flow, pit = c.well_control, F.abs(p["flow_balance"]), F.abs(p["pit_rate"])
    return (
        F.when((flow > w.flow_imbalance_critical_gpm) | (pit > w.pit_rate_critical_bbl_hr), "Critical")
        .when((flow > w.flow_imbalance_warning_gpm) | (pit > w.pit_rate_warning_bbl_hr), "High")
        .when((flow > 5) | (pit > 2), "Medium")
        .otherwise("Low")
    )


def vote_formation(p: dict[str, Column], c: Config) -> Column:
    t = p["dxc_trend"]
    return F.when(t < -0.15, "High").when(F.abs(t) > 0.1, "Medium").otherwise("Low")


def stuck_pipe_score(p: dict[str, Column]) -> Column:
    """Composite risk from overpull, torque, pressure, collapse of the penetration rate and drag."""
    overpull = F.when((p["wob_trend"] > 0.05) & (p["rop_trend"] <= 0), clamp(p["wob_trend"] * 5.0, 0, 1)).otherwise(0.0)
    torque = F.when(p["torque_delta"] > 0.15, clamp((p["torque_delta"] - 0.15) * 4.0, 0, 1)).otherwise(0.0)
    limit = clamp(p["hardness"], 0, 10) * 10.0 + 50.0
    pressure = F.when(p["spp_delta"] > limit, clamp((p["spp_delta"] - limit) / 200.0, 0, 1)).otherwise(0.0)
    collapse = F.when((p["rop"] < 2) & (p["wob"] > 10), (1 - clamp(p["rop"] / 2.0, 0, 1)) * clamp((p["wob"] - 10) / 20.0, 0, 1)).otherwise(0.0)
    drag = F.when(p["drag"], 0.6).otherwise(0.0)
    return overpull * 0.25 + torque * 0.25 + pressure * 0.20 + collapse * 0.20 + drag * 0.10


def vote_stuck_pipe(p: dict[str, Column], c: Config) -> Column:
    s = stuck_pipe_score(p)
    return F.when(s > 0.7, "Critical").when(s > 0.5, "High").when(s > 0.3, "Medium").otherwise("Low")


SPECIALISTS: dict[str, Callable[[dict[str, Column], Config], Column]] = {
    "mse": vote_mse,
    "hydraulic": vote_hydraulic,
    "well_control": vote_well_control,
    "formation": vote_formation,
    "stuck_pipe": vote_stuck_pipe,
}


def weights(regime: Column, c: Config = DEFAULT) -> dict[str, Column]:
    """Weights of the specialists under a regime, summing to 1; all of them known beforehand."""
    base, regimes = dataclasses.asdict(c.weights), range(len(REGIME_LABELS))
    raw = {name: [REGIMES[name][k] * base[name] for k in regimes] for name in SPECIALISTS}
    totals = [sum(raw[name][k] for name in SPECIALISTS) for k in regimes]
    shares = {name: [raw[name][k] / totals[k] if totals[k] > 1e-10 else 1.0 / len(raw) for k in regimes] for name in SPECIALISTS}
    *first, last = regimes
    pick = lambda w: functools.reduce(lambda chain, k: chain.when(regime == k, w[k]), first[1:], F.when(regime == first[0], w[first[0]])).otherwise(w[last])
    return {name: pick(w) for name, w in shares.items()}


def weighted_sum(votes: dict[str, Column], regime: Column, c: Config = DEFAULT) -> Column:
    w = weights(regime, c)
    return sum(ordinal(v) * w[k] for k, v in votes.items())


def final_severity(total: Column) -> Column:
    """Cut-offs are strict: over 3.5 critical, over 2.5 high, over 1.5 medium, over 0.5 low."""
    return F.when(total > 3.5, "Critical").when(total > 2.5, "High").when(total > 1.5, "Medium").when(total > 0.5, "Low").otherwise("Healthy")


def ensemble(votes: dict[str, Column], regime: Column, c: Config = DEFAULT) -> Column:
    """The severity of the weighted votes; a critical vote on well control overrides."""
    return F.when(votes["well_control"] == "Critical", "Critical").otherwise(final_severity(weighted_sum(votes, regime, c)))


def risk_level(votes: dict[str, Column], category: Column) -> Column:
    count = lambda level: sum((v == level).cast("int") for v in votes.values())
    critical, high = count("Critical"), count("High")
    well = category == "WellControl"
    return F.when(critical > 0, "Critical").when(well | (high >= 2), "High").when(high >= 1, "Elevated").otherwise("Low")
