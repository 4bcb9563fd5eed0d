"""Derived metrics per packet: one window per well, everything else row expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mudline.config import DEFAULT, Config
from mudline.functions import anomalies, physics, states
from mudline.functions.frames import before
from mudline.operators.scan import Scan


def with_state(packets: DataFrame, c: Config = DEFAULT) -> DataFrame:
    return packets.withColumn("state", states.rig_state(*[F.col(x) for x in ("rpm", "wob", "flow_in", "hook_load", "rop", "bit_depth", "hole_depth")], c))


def with_previous(packets: DataFrame, span: int | None = None) -> DataFrame:
    """Columns of the last active packet before, and the change of pit volume against the last positive one.

    ``span``: wells too long for one task are cut into chunks of so many seconds (``scan``).
    """
    active = F.col("state").isin(*states.ACTIVE)
    kept = F.struct(*(F.col(x) for x in ("torque", "spp", "ts", "pit_volume", "wob", "rop")))
    if span:
        out = Scan(span=span).last("last_active", kept, where=active).last("last_pit", F.col("pit_volume"), where=F.col("pit_volume") > 0).over(packets)
    else:
        last = lambda cond, x: F.last(F.when(cond, x), ignorenulls=True).over(before())
        out = packets.withColumns({"last_active": last(active, kept), "last_pit": last(F.col("pit_volume") > 0, F.col("pit_volume"))})
    out = out.withColumns({f"prev_{x}": F.col(f"last_active.{x}") for x in ("torque", "spp", "ts", "pit_volume", "wob", "rop")})
    out = out.withColumn("pit_change", F.coalesce(F.when(F.col("pit_volume") > 0, F.col("pit_volume") - F.col("last_pit")), F.lit(0.0)))
    return out.drop("last_active", "last_pit")


def drilling_metrics(packets: DataFrame, c: Config = DEFAULT, span: int | None = None) -> DataFrame:
    """Packets with state, energy, exponents, balances, deltas and the anomaly cascade; ``span`` as in ``with_previous``."""
    return derived(with_previous(with_state(packets, c), span), c)


def derived(p: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """What follows from a packet and the packet before alone: no window, so streams take it too."""
    x = {n: F.col(n) for n in p.columns}
    cutting = F.col("state").isin("Drilling", "Reaming")
    elapsed = x["ts"] - x["prev_ts"]
    p = p.withColumns({
        "mse": F.when(cutting, physics.mse(x["torque"], x["rpm"], x["bit_diameter"], x["rop"], x["wob"], c)).otherwise(0.0),
        "d_exponent": F.when(F.col("state") == "Drilling", physics.d_exponent(x["rop"], x["rpm"], x["wob"], x["bit_diameter"])).otherwise(0.0),
        "hardness": physics.hardness(x["rop"], x["wob"], x["rpm"]),
        "flow_balance": physics.flow_balance(x["flow_in"], x["flow_out"]),
        "pit_rate": F.coalesce(F.when(elapsed >= 10, physics.clamp((x["pit_volume"] - x["prev_pit_volume"]) / (F.greatest(elapsed, F.lit(10)) / 3600.0), -50, 50)), F.lit(0.0)),
        "ecd_margin": physics.ecd_margin(x["fracture_gradient"], x["ecd"]),
        "torque_delta": F.coalesce(F.when(x["prev_torque"] > 3, physics.ratio(x["torque"] - x["prev_torque"], x["prev_torque"])), F.lit(0.0)),
        "spp_delta": F.coalesce(x["spp"] - x["prev_spp"], F.lit(0.0)),
    })
    p = p.withColumns({"dxc": physics.dxc(F.col("d_exponent"), F.col("mud_weight_in"), c), "mse_efficiency": physics.mse_efficiency(F.col("mse"), physics.optimal_mse(F.col("hardness"), c))})
    return judged(p, c)


#: Names of the cascade's inputs and the columns that hold them.
INPUTS = {"flow_in": "flow_in", "flow_out": "flow_out", "pit_change": "pit_change", "gas": "gas_units", "background": "background_gas", "h2s": "h2s", "pit_rate": "pit_rate", "ecd_margin": "ecd_margin", "spp_delta": "spp_delta", "torque_delta": "torque_delta", "prev_wob": "prev_wob", "prev_rop": "prev_rop", "wob": "wob", "rop": "rop", "efficiency": "mse_efficiency"}
OVERRIDES = ("flow_warning", "spp_warning", "spp_critical", "torque_warning", "torque_critical")


def judged(metrics: DataFrame, c: Config = DEFAULT, overrides: tuple[str, ...] = ()) -> DataFrame:
    """``metrics`` with the cascade's rule, category and severity, under thresholds of their own in the columns ``overrides``."""
    hit = anomalies.cascade(F.col("state"), {k: F.col(v) for k, v in INPUTS.items()}, c, {x: F.col(x) for x in overrides})
    return metrics.withColumn("hit", hit).withColumns({"rule": F.col("hit.rule"), "category": F.col("hit.category"), "severity": F.col("hit.severity")}).drop("hit")


def with_overrides(metrics: DataFrame, overrides: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """The cascade once more under each well's own thresholds (``baseline.overrides``); wells without any keep the defaults."""
    return judged(metrics.drop("rule", "category", "severity").join(overrides, "well_id", "left"), c, OVERRIDES)


STATE_SQL = """CASE WHEN rpm < 5 AND flow_in < 50 THEN 'Idle' WHEN rpm < 5 AND flow_in > 50 THEN 'Connection'
  WHEN rpm > 5 AND wob > 1 AND rop > 2 AND bit_depth < hole_depth - 5 THEN 'Reaming' WHEN rpm > 5 AND wob > 1 AND rop > 2 THEN 'Drilling'
  WHEN rpm > 5 AND wob < 1 AND flow_in > 50 THEN 'Circulating' WHEN rpm < 5 AND flow_in < 100 AND hook_load > 200 THEN 'TrippingOut'
  WHEN rpm < 5 AND flow_in < 100 AND hook_load < 50 THEN 'TrippingIn' ELSE 'Circulating' END"""

_BEFORE = "OVER (PARTITION BY well_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_PREV = ", ".join(f"last_value(CASE WHEN active THEN {x} END IGNORE NULLS) {_BEFORE} AS prev_{x}" for x in ("torque", "spp", "ts", "pit_volume", "wob", "rop"))
METRICS_SQL = f"""
sta AS (SELECT *, {STATE_SQL} AS state FROM tel),
act AS (SELECT *, state IN ('Drilling', 'Reaming', 'Circulating') AS active FROM sta),
pre AS (SELECT *, {_PREV}, last_value(CASE WHEN pit_volume > 0 THEN pit_volume END IGNORE NULLS) {_BEFORE} AS last_pit FROM act),
der AS (SELECT *, coalesce(CASE WHEN pit_volume > 0 THEN pit_volume - last_pit END, 0) AS pit_change,
  CASE WHEN state IN ('Drilling', 'Reaming') AND bit_diameter > 0 AND rop > 0 THEN
    CASE WHEN rop > 0.1 THEN 480 * torque * 1000 * rpm / (bit_diameter * bit_diameter * rop) ELSE 0 END + 4 * wob * 1000 / (pi() * bit_diameter * bit_diameter) ELSE 0 END AS mse,
  CASE WHEN state = 'Drilling' AND rop > 0 AND rpm > 0 AND wob > 0 AND abs(log10(12 * wob / bit_diameter)) >= 1e-10
    THEN greatest(log10(rop / (60 * rpm)) / log10(12 * wob / bit_diameter), 0) ELSE 0 END AS d_exponent,
  CASE WHEN rop <= 0 OR wob <= 0 OR rpm <= 0 THEN 5.0 ELSE greatest(least(5.0 / greatest(rop / greatest(wob * rpm * 0.01, 1), 0.1), 10), 0) END AS hardness,
  CASE WHEN flow_out > 0 THEN flow_out - flow_in ELSE 0 END AS flow_balance,
  coalesce(CASE WHEN ts - prev_ts >= 10 THEN greatest(least((pit_volume - prev_pit_volume) / ((ts - prev_ts) / 3600.0), 50), -50) END, 0) AS pit_rate,
  CASE WHEN fracture_gradient > 0 AND ecd > 0 THEN fracture_gradient - ecd ELSE 1.5 END AS ecd_margin,
  coalesce(CASE WHEN prev_torque > 3 THEN (torque - prev_torque) / prev_torque END, 0) AS torque_delta, coalesce(spp - prev_spp, 0) AS spp_delta FROM pre),
eff AS (SELECT *, CASE WHEN mud_weight_in <= 0 THEN d_exponent ELSE d_exponent * 8.6 / mud_weight_in END AS dxc,
  CASE WHEN mse <= 0 THEN 0 ELSE greatest(least((5000 + hardness * 8000) / mse * 100, 100), 0) END AS mse_efficiency,
  (flow_out - flow_in > 5)::INT + (pit_change > 5)::INT + (gas_units - background_gas > 50)::INT AS kick_n,
  CASE WHEN flow_out - flow_in > 5 THEN least((flow_out - flow_in) / 50, 1) ELSE 0 END + CASE WHEN pit_change > 5 THEN least(pit_change / 20, 1) ELSE 0 END + CASE WHEN gas_units - background_gas > 50 THEN least((gas_units - background_gas) / 500, 1) ELSE 0 END AS kick_sum,
  (flow_in - flow_out > 5)::INT + (pit_change < -5)::INT + (greatest(spp_delta, 0) > 100)::INT AS loss_n,
  CASE WHEN flow_in - flow_out > 5 THEN least((flow_in - flow_out) / 50, 1) ELSE 0 END + CASE WHEN pit_change < -5 THEN least(abs(pit_change) / 20, 1) ELSE 0 END + CASE WHEN greatest(spp_delta, 0) > 100 THEN least(greatest(spp_delta, 0) / 500, 1) ELSE 0 END AS loss_sum,
  coalesce(prev_wob >= 3 AND wob >= 3 AND prev_rop > 0 AND (wob - prev_wob) / nullif(prev_wob, 0) > 0.05 AND (rop - prev_rop) / nullif(prev_rop, 0) <= 0, false) AS founders FROM der),
rul AS (SELECT *, CASE WHEN NOT active THEN 'none'
  WHEN (flow_out > 0 OR flow_in <= 0) AND kick_n >= 2 THEN 'kick' WHEN (flow_out > 0 OR flow_in <= 0) AND loss_n >= 2 THEN 'loss'
  WHEN gas_units > 100 THEN 'gas' WHEN h2s > 10 THEN 'h2s' WHEN abs(pit_rate) > 5 THEN 'pit_rate' WHEN ecd_margin < 0.3 THEN 'ecd' WHEN abs(spp_delta) > 100 THEN 'spp'
  WHEN torque_delta > 0.15 THEN 'torque' WHEN founders AND state = 'Drilling' THEN 'founder' WHEN state = 'Drilling' AND mse_efficiency < 70 THEN 'mse' ELSE 'none' END AS rule FROM eff),
met AS (SELECT *, CASE WHEN rule IN ('kick', 'loss', 'gas', 'h2s', 'pit_rate') THEN 'WellControl' WHEN rule IN ('ecd', 'spp') THEN 'Hydraulics' WHEN rule IN ('torque', 'founder') THEN 'Mechanical' WHEN rule = 'mse' THEN 'DrillingEfficiency' ELSE 'None' END AS category,
  CASE rule WHEN 'kick' THEN CASE WHEN least(kick_sum / kick_n, 1) > 0.7 THEN 'CRITICAL' WHEN least(kick_sum / kick_n, 1) > 0.4 THEN 'HIGH' ELSE 'WARNING' END
  WHEN 'loss' THEN CASE WHEN least(loss_sum / loss_n, 1) > 0.7 THEN 'CRITICAL' WHEN least(loss_sum / loss_n, 1) > 0.4 THEN 'HIGH' ELSE 'WARNING' END
  WHEN 'gas' THEN CASE WHEN gas_units > 250 THEN 'CRITICAL' ELSE 'WARNING' END WHEN 'h2s' THEN CASE WHEN h2s > 20 THEN 'CRITICAL' ELSE 'WARNING' END
  WHEN 'pit_rate' THEN CASE WHEN abs(pit_rate) > 15 THEN 'CRITICAL' ELSE 'WARNING' END WHEN 'ecd' THEN CASE WHEN ecd_margin < 0.1 THEN 'CRITICAL' ELSE 'WARNING' END
  WHEN 'spp' THEN CASE WHEN abs(spp_delta) > 200 THEN 'HIGH' ELSE 'WARNING' END WHEN 'torque' THEN CASE WHEN torque_delta > 0.25 THEN 'HIGH' ELSE 'WARNING' END
  WHEN 'founder' THEN CASE WHEN (rop - prev_rop) / prev_rop < -0.05 THEN 'HIGH' ELSE 'WARNING' END WHEN 'mse' THEN CASE WHEN mse_efficiency < 50 THEN 'HIGH' ELSE 'LOW' END ELSE 'NONE' END AS severity FROM rul)
"""
