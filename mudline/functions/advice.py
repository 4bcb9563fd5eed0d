"""Template advisories by category and the debrief's narrative.

Wordings are fixed values, each with the names of what it says in order; the
conditions that choose among them are expressions here, and the same table gives
the SQL that checks them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mudline.functions import digits

#: Sentences of advisories (fixed values).
WORDINGS: dict[str, tuple[str, tuple[str, ...]]] = {
    "well_control": (
        "WELL CONTROL: Verify flow balance and pit levels immediately%s. Flow imbalance %.1f gpm, pit rate %.1f bbl/hr. Check trip tank, confirm flow out reading, prepare for shut-in if trend continues. Current mud weight %.1f ppg, ECD %.1f ppg at %.0f ft.",
        ("campaign_note", "flow_balance", "pit_rate", "mud_weight", "ecd", "depth"),
    ),
    "well_control_why": ("Flow imbalance of %.1f gpm detected with pit rate %.1f bbl/hr. ECD margin: %.2f ppg. Flow balance trend: %.1f gpm/10min. Gas reading: %.0f units. Confidence limited — template-based analysis.", ("flow_balance", "pit_rate", "ecd_margin", "flow_trend", "gas")),
    "efficiency_low": ("Significant efficiency loss. Reduce WOB by 5 klbs or increase RPM by 10-15. Current WOB %.0f klbs, RPM %.0f. Target MSE: %.0f psi.", ("wob", "rpm", "optimal_mse")),
    "efficiency": ("Consider fine-tuning WOB/RPM combination. Current efficiency %.0f%%. Current WOB %.0f klbs, RPM %.0f, ROP %.1f ft/hr.", ("efficiency", "wob", "rpm", "rop")),
    "efficiency_gain": ("Potential %.0f%% efficiency improvement, reduced bit wear, improved ROP", ("gain",)),
    "efficiency_why": ("MSE %s: avg %.0f psi vs optimal %.0f psi (%.0f%% efficiency). Torque %.1f kft-lb at %.0f ft depth. Formation hardness %.1f/10.%s", ("mse_direction", "avg_mse", "optimal_mse", "efficiency", "torque", "depth", "hardness", "formation_note")),
    "ecd_low": ("ECD margin critically low at %.2f ppg. Reduce flow rate or ROP immediately. SPP %.0f psi, flow in %.0f gpm.", ("ecd_margin", "spp", "flow_in")),
    "spp_off": ("SPP deviation %.0f psi — check for washout (drop) or pack-off (rise). Current SPP %.0f psi, flow %.0f gpm. Monitor over next 5 minutes.", ("spp_delta", "spp", "flow_in")),
    "hydraulics": ("Monitor standpipe pressure and flow rates. SPP deviation %.0f psi, ECD margin %.2f ppg. No immediate action required.", ("spp_delta", "ecd_margin")),
    "hydraulics_why": ("Flow balance trend: %.1f gpm/10min. ECD margin: %.2f ppg. SPP delta: %.0f psi. Mud weight in %.1f ppg, ECD %.1f ppg.", ("flow_trend", "ecd_margin", "spp_delta", "mud_weight", "ecd")),
    "founder": ("FOUNDER CONDITION: WOB exceeds optimal (%.0f klbs, optimal ~%.0f klbs). ROP no longer responding to WOB increases. Reduce WOB by 5-10 klbs.", ("wob", "optimal_wob")),
    "torque_high": ("Torque elevated %.0f%% above baseline (%.1f kft-lb). Monitor for pack-off. Consider backreaming if torque continues to rise. Reduce WOB if stick-slip develops.", ("torque_percent", "torque")),
    "mechanical": ("Mechanical parameter deviation detected. Torque %.1f kft-lb (delta %.0f%%). Continue monitoring torque and drag trends.", ("torque", "torque_percent")),
    "mechanical_why": ("Torque delta %.0f%% at %.0f ft. WOB %.0f klbs, RPM %.0f. Founder detected: %s. Current ROP %.1f ft/hr.%s", ("torque_percent", "depth", "wob", "rpm", "founder_word", "rop", "formation_note")),
    "pore_pressure": (
        "D-exponent DECREASING (%.3f) in %s — possible abnormal pore pressure. Monitor mud weight vs pore pressure closely. Consider increasing mud weight. Current depth %.0f ft, formation hardness %.1f/10.",
        ("dxc_trend", "formation_name", "depth", "hardness"),
    ),
    "entering": ("Formation transition detected — entering %s (%s rock). Adjust WOB/RPM for new formation. D-exponent trend %.3f at %.0f ft.", ("formation_name", "rock", "dxc_trend", "depth")),
    "formation": ("Formation change indicated in %s. D-exponent trend %.3f, hardness %.1f/10. Continue with current parameters, monitor ROP response.", ("formation_name", "dxc_trend", "hardness")),
    "formation_why": ("D-exponent trend: %.3f. Formation: %s (hardness %.1f/10). MSE efficiency: %.0f%%. Current ROP: %.1f ft/hr at %.0f ft.", ("dxc_trend", "formation_name", "hardness", "efficiency", "rop", "depth")),
    "normal": ("Continue monitoring drilling parameters. ROP %.1f ft/hr, efficiency %.0f%% at %.0f ft.", ("rop", "efficiency", "depth")),
}
#: Benefits that say no value (fixed values).
BENEFITS = {
    "WellControl": "Well control incident prevention — immediate safety priority", "Hydraulics": "Hydraulic efficiency optimization, equipment damage prevention", "Mechanical": "Pack-off/stick-slip prevention, reduced NPT risk",
    "Formation": "Optimized drilling through formation transition, pore pressure awareness", "None": "Maintained operational efficiency",
}
CAMPAIGN_NOTE, NORMAL_WHY, CONFIDENCE = " (P&A mode: tighter flow tolerance)", "Normal drilling operations — periodic summary.", 0.70


def said(name: str, p: dict[str, Column]) -> Column:
    text, names = WORDINGS[name]
    return digits.printf(text, *[p[n] for n in names])


def said_sql(name: str) -> str:
    text, names = WORDINGS[name]
    return f"printf('{text}', {', '.join(names)})"


def with_words(p: dict[str, Column]) -> dict[str, Column]:
    """What sentences need beyond the measured values: notes, directions, percentages."""
    named = p["formation"]
    return p | {
        "campaign_note": F.when(p["plugging"], CAMPAIGN_NOTE).otherwise(""), "mse_direction": F.when(p["mse_trend"] > 0, "increasing (worsening)").otherwise("stable/improving"), "gain": F.least(100 - p["efficiency"], F.lit(30.0)),
        "formation_note": F.coalesce(F.concat(F.lit(" Formation: "), named, F.lit(".")), F.lit("")), "formation_name": F.coalesce(named, F.lit("unknown")), "torque_percent": p["torque_delta"] * 100,
        "founder_word": p["founder"].cast("string"), "rock": F.when(p["dxc_trend"] > 0, "harder").otherwise("softer"),
    }


def advisory(category: Column, p: dict[str, Column], causes: Column | None = None) -> dict[str, Column]:
    """``recommendation``, ``benefit`` and ``reasoning`` (with ``causes`` at its end) of a ticket."""
    q = with_words(p)
    say = lambda name: said(name, q)
    words = {
        "WellControl": (say("well_control"), F.lit(BENEFITS["WellControl"]), say("well_control_why")),
        "DrillingEfficiency": (F.when(q["efficiency"] < 50, say("efficiency_low")).otherwise(say("efficiency")), say("efficiency_gain"), say("efficiency_why")),
        "Hydraulics": (F.when(q["ecd_margin"] < 0.3, say("ecd_low")).when(F.abs(q["spp_delta"]) > 100, say("spp_off")).otherwise(say("hydraulics")), F.lit(BENEFITS["Hydraulics"]), say("hydraulics_why")),
        "Mechanical": (F.when(q["founder"], say("founder")).when(q["torque_delta"] > 0.15, say("torque_high")).otherwise(say("mechanical")), F.lit(BENEFITS["Mechanical"]), say("mechanical_why")),
        "Formation": (F.when(q["dxc_trend"] < -0.1, say("pore_pressure")).when(F.abs(q["dxc_trend"]) > 0.05, say("entering")).otherwise(say("formation")), F.lit(BENEFITS["Formation"]), say("formation_why")),
    }
    normal = (say("normal"), F.lit(BENEFITS["None"]), F.lit(NORMAL_WHY))
    out = []
    for k in range(3):
        chain = F.when(F.lit(False), "")
        for name, texts in words.items():
            chain = chain.when(category == name, texts[k])
        out.append(chain.otherwise(normal[k]))
    reasoning = out[2] if causes is None else F.concat(out[2], causes)
    return {"recommendation": out[0], "benefit": out[1], "reasoning": reasoning}
