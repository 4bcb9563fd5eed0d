"""Thresholds that the operators take, as frozen dataclasses; a TOML file may overlay them.

Values are fixed: they must equal the defaults that results depend on.
"""

from __future__ import annotations

import dataclasses
import math
import tomllib
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class WellControl:
    flow_imbalance_warning_gpm: float = 5.0
    flow_imbalance_critical_gpm: float = 10.0
    pit_gain_warning_bbl: float = 5.0
    pit_gain_critical_bbl: float = 10.0
    pit_rate_warning_bbl_hr: float = 5.0
    pit_rate_critical_bbl_hr: float = 15.0
    gas_units_warning: float = 100.0
    gas_units_critical: float = 250.0
    h2s_warning_ppm: float = 10.0
    h2s_critical_ppm: float = 20.0


@dataclass(frozen=True)
class Mse:
    efficiency_warning_percent: float = 70.0
    efficiency_poor_percent: float = 50.0


@dataclass(frozen=True)
class Hydraulics:
    normal_mud_weight_ppg: float = 8.6
    fracture_gradient_ppg: float = 14.0
    ecd_margin_warning_ppg: float = 0.3
    ecd_margin_critical_ppg: float = 0.1
    spp_deviation_warning_psi: float = 100.0
    spp_deviation_critical_psi: float = 200.0
    annular_pressure_loss_coefficient: float = 0.1


@dataclass(frozen=True)
class Mechanical:
    torque_increase_warning: float = 0.15
    torque_increase_critical: float = 0.25
    stick_slip_cv_warning: float = 0.15
    stick_slip_cv_critical: float = 0.25
    packoff_spp_increase_threshold: float = 0.10
    packoff_rop_decrease_threshold: float = 0.20
    stick_slip_min_samples: int = 5


@dataclass(frozen=True)
class Founder:
    wob_increase_min: float = 0.02
    rop_response_min: float = 0.01
    min_samples: int = 5
    quick_wob_delta_percent: float = 0.05
    min_wob_klbs: float = 3.0


@dataclass(frozen=True)
class Formation:
    mse_change_significant: float = 0.20
    dxc_trend_threshold: float = 0.05
    dxc_pressure_threshold: float = -0.05
    mse_pressure_tolerance: float = 0.10


@dataclass(frozen=True)
class RigState:
    idle_rpm_max: float = 5.0
    circulation_flow_min: float = 50.0
    drilling_wob_min: float = 1.0
    reaming_depth_offset: float = 5.0
    trip_out_hook_load_min: float = 200.0
    trip_in_hook_load_max: float = 50.0
    tripping_flow_max: float = 100.0
    drilling_rop_min: float = 2.0


@dataclass(frozen=True)
class OperationDetection:
    milling_torque_min: float = 15.0
    milling_rop_max: float = 5.0
    cement_drillout_wob_min: float = 15.0
    cement_drillout_torque_min: float = 12.0
    cement_drillout_rop_max: float = 20.0
    no_rotation_rpm_max: float = 10.0
    off_bottom_wob_max: float = 5.0


@dataclass(frozen=True)
class Baseline:
    warning_sigma: float = 3.0
    critical_sigma: float = 5.0
    min_samples: int = 100
    min_std_floor: float = 0.001
    max_outlier_percentage: float = 0.05
    outlier_sigma: float = 3.0


@dataclass(frozen=True)
class Advisory:
    cooldown_seconds: int = 60
    cooldown_packets: int = 50
    well_control_packets: int = 20
    cooldown_depth_ft: float = 50.0
    well_control_depth_ft: float = 10.0
    throttle_onset: int = 3
    throttle_factor: float = 2.0
    throttle_cap_ft: float = 500.0
    reset_packets: int = 500


@dataclass(frozen=True)
class EnsembleWeights:
    mse: float = 0.20
    hydraulic: float = 0.20
    well_control: float = 0.30
    formation: float = 0.15
    stuck_pipe: float = 0.15


@dataclass(frozen=True)
class Trip:
    pipe_od_in: float = 5.0
    plastic_viscosity_cp: float = 15.0
    yield_point: float = 10.0


@dataclass(frozen=True)
class Physics:
    formation_hardness_base_psi: float = 5000.0
    formation_hardness_multiplier: float = 8000.0
    kick_min_indicators: int = 2
    loss_min_indicators: int = 2
    kick_gas_increase_threshold: float = 50.0
    kick_flow_severity_divisor: float = 50.0
    kick_pit_severity_divisor: float = 20.0
    kick_gas_severity_divisor: float = 500.0
    confidence_full_window: int = 60
    min_rop_for_mse: float = 0.1


@dataclass(frozen=True)
class Ml:
    rop_lag_seconds: int = 60
    interval_seconds: int = 3600


@dataclass(frozen=True)
class Config:
    well_control: WellControl = field(default_factory=WellControl)
    mse: Mse = field(default_factory=Mse)
    hydraulics: Hydraulics = field(default_factory=Hydraulics)
    mechanical: Mechanical = field(default_factory=Mechanical)
    founder: Founder = field(default_factory=Founder)
    formation: Formation = field(default_factory=Formation)
    rig_state: RigState = field(default_factory=RigState)
    operation: OperationDetection = field(default_factory=OperationDetection)
    baseline: Baseline = field(default_factory=Baseline)
    advisory: Advisory = field(default_factory=Advisory)
    weights: EnsembleWeights = field(default_factory=EnsembleWeights)
    trip: Trip = field(default_factory=Trip)
    physics: Physics = field(default_factory=Physics)
    ml: Ml = field(default_factory=Ml)


DEFAULT = Config()


def distance(a: str, b: str) -> int:
    """Edit distance of two short keys."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def unknown_keys(table: dict) -> list[tuple[str, str | None]]:
    """Keys of a TOML table that no section has, each with the nearest known key within three edits."""
    known = {f.name: {g.name for g in dataclasses.fields(getattr(DEFAULT, f.name))} for f in dataclasses.fields(Config)}
    flat = [*known, *(f"{s}.{k}" for s, keys in known.items() for k in keys)]
    out = []
    for section, body in table.items():
        names = [section] if section not in known or not isinstance(body, dict) else [f"{section}.{k}" for k in body if k not in known[section]]
        for name in names:
            best = min(flat, key=lambda k: distance(name, k))
            out.append((name, best if distance(name, best) <= 3 else None))
    return out


def allowed(section: str, name: str) -> tuple[float, float]:
    """The range of a value: shares up to 1, percentages up to 100, counts and windows from 1, everything else from 0 (or to 0 where the default is negative)."""
    if getattr(getattr(DEFAULT, section), name) < 0:
        return -1e9, 0.0
    if section == "weights" or name in ("max_outlier_percentage", "torque_increase_warning", "torque_increase_critical", "quick_wob_delta_percent"):
        return 0.0, 1.0
    if name.startswith("efficiency_"):
        return 0.0, 100.0
    if name.endswith(("_packets", "_samples", "_indicators", "_window", "_seconds")):
        return 1.0, 1e9
    return 0.0, 1e9


def problems(config: Config) -> list[str]:
    """What makes a configuration unusable: values that aren't finite or out of their range, warnings beyond their critical values, weights that don't add up."""
    out = [f"{s.name}.{f.name} is not finite" for s in dataclasses.fields(config) for f in dataclasses.fields(getattr(config, s.name)) if not math.isfinite(getattr(getattr(config, s.name), f.name))]
    for section, low, high in (
        ("well_control", "flow_imbalance_warning_gpm", "flow_imbalance_critical_gpm"), ("well_control", "pit_gain_warning_bbl", "pit_gain_critical_bbl"),
        ("well_control", "gas_units_warning", "gas_units_critical"), ("well_control", "h2s_warning_ppm", "h2s_critical_ppm"), ("mse", "efficiency_poor_percent", "efficiency_warning_percent"),
        ("hydraulics", "ecd_margin_critical_ppg", "ecd_margin_warning_ppg"), ("hydraulics", "spp_deviation_warning_psi", "spp_deviation_critical_psi"), ("mechanical", "torque_increase_warning", "torque_increase_critical"),
    ):
        part = getattr(config, section)
        if getattr(part, low) >= getattr(part, high):
            out.append(f"{section}.{low} must be under {section}.{high}")
    for s in dataclasses.fields(config):
        for f in dataclasses.fields(getattr(config, s.name)):
            low, high = allowed(s.name, f.name)
            if not low <= getattr(getattr(config, s.name), f.name) <= high:
                out.append(f"{s.name}.{f.name} must be between {low:g} and {high:g}")
    total = sum(dataclasses.astuple(config.weights))
    if abs(total - 1) > 0.01:
        out.append(f"weights sum to {total:.3f}")
    return out


def overlay(table: dict, base: Config = DEFAULT) -> Config:
    """``base`` with the values of a TOML table; unknown keys raise with a suggestion."""
    if odd := unknown_keys(table):
        raise ValueError("; ".join(f"unknown key {k}" + (f", did you mean {s}?" if s else "") for k, s in odd))
    made = dataclasses.replace(base, **{s: dataclasses.replace(getattr(base, s), **body) for s, body in table.items()})
    if wrong := problems(made):
        raise ValueError("; ".join(wrong))
    return made


def load(path: str | Path) -> Config:
    return overlay(tomllib.loads(Path(path).read_text()))


def changes(old: Config, new: Config) -> list[tuple[str, float, float]]:
    """Values that differ, as (key, old, new)."""
    return [(f"{s.name}.{f.name}", a, b) for s in dataclasses.fields(old) for f in dataclasses.fields(getattr(old, s.name)) if (a := getattr(getattr(old, s.name), f.name)) != (b := getattr(getattr(new, s.name), f.name))]
