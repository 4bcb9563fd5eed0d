"""Rig states and operations as ordered CASE expressions; four classifiers serve four kinds of input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mudline.config import DEFAULT, Config

ACTIVE = ("Drilling", "Reaming", "Circulating")


def rig_state(rpm: Column, wob: Column, flow: Column, hook_load: Column, rop: Column, bit_depth: Column, hole_depth: Column, c: Config = DEFAULT) -> Column:
    """The physics classifier; tripping can only be met where speed or flow equals a threshold."""
    r = c.rig_state
    turning, still = rpm > r.idle_rpm_max, rpm < r.idle_rpm_max
    cutting = turning & (wob > r.drilling_wob_min) & (rop > r.drilling_rop_min)
    return (
        F.when(still & (flow < r.circulation_flow_min), "Idle")
        .when(still & (flow > r.circulation_flow_min), "Connection")
        .when(cutting & (bit_depth < hole_depth - r.reaming_depth_offset), "Reaming")
        .when(cutting, "Drilling")
        .when(turning & (wob < r.drilling_wob_min) & (flow > r.circulation_flow_min), "Circulating")
        .when(still & (flow < r.tripping_flow_max) & (hook_load > r.trip_out_hook_load_min), "TrippingOut")
        .when(still & (flow < r.tripping_flow_max) & (hook_load < r.trip_in_hook_load_max), "TrippingIn")
        .otherwise("Circulating")
    )


def rig_state_from_feed(rpm: Column, wob: Column, hook_load: Column, rop: Column, block: Column) -> Column:
    """The classifier of the live feed, which knows the block position."""
    return (
        F.when((rpm > 20) & (wob > 5) & (rop > 2), "Drilling")
        .when((rpm > 20) & (wob > 2) & (rop <= 0), "Reaming")
        .when((rpm > 0) & (wob < 5), "Circulating")
        .when((rpm < 5) & (block > 0) & (hook_load > 150), "TrippingOut")
        .when((rpm < 5) & (block > 0), "TrippingIn")
        .when((rpm < 5) & (hook_load > 50) & (hook_load < 200), "Connection")
        .otherwise("Idle")
    )


def rig_state_from_csv(rpm: Column, wob: Column, hook_load: Column, rop: Column) -> Column:
    """The classifier of the fixed CSV layout."""
    return (
        F.when((rpm > 20) & (wob > 5) & (rop > 0), "Drilling")
        .when((rpm > 20) & (wob > 2), "Reaming")
        .when((rpm > 0) & (wob < 5), "Circulating")
        .when((rpm < 5) & (hook_load > 50) & (hook_load < 200), "Connection")
        .otherwise("Idle")
    )


def operation(flow: Column, rpm: Column, wob: Column, torque: Column, rop: Column, plugging: Column, c: Config = DEFAULT) -> Column:
    """What the rig does; ``plugging`` marks plug-and-abandonment campaigns."""
    o = c.operation
    pumping, rotating, on_bottom = flow >= c.rig_state.circulation_flow_min, rpm >= o.no_rotation_rpm_max, wob >= o.off_bottom_wob_max
    both = pumping & rotating
    milling = plugging & both & (torque >= o.milling_torque_min) & (rop < o.milling_rop_max)
    cement = plugging & both & (wob >= o.cement_drillout_wob_min) & (torque >= o.cement_drillout_torque_min) & (rop > 0) & (rop < o.cement_drillout_rop_max)
    return (
        F.when(~pumping & ~rotating, "Static")
        .when(pumping & ~rotating & ~on_bottom, "Circulating")
        .when(milling, "Milling")
        .when(cement, "CementDrillOut")
        .when(rotating | on_bottom, "ProductionDrilling")
        .otherwise("Static")
    )
