"""Texts of anomalies, votes, leads and advice as Column expressions; wordings are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mudline.functions import digits
from mudline.functions.voting import REGIME_LABELS


def describe(p: dict[str, Column]) -> Column:
    """The sentence of the cascade's rule; NULL where none fired.

    ``p``: rule, severity, flow_balance, pit_rate, gas, background, h2s, ecd_margin,
    spp_delta, torque_delta, wob_change, rop_change, efficiency.
    """
    f, grave = digits.printf, p["severity"]
    return (
        F.when(p["rule"] == "kick", f("%s: Potential kick detected - flow imbalance %.1f gpm, gas %.0f units", grave, p["flow_balance"], p["gas"]))
        .when(p["rule"] == "loss", f("%s: Potential lost circulation - flow imbalance %.1f gpm, pit rate %.1f bbl/hr", grave, p["flow_balance"], p["pit_rate"]))
        .when(p["rule"] == "gas", f("%s: Elevated gas %.0f units (background: %.0f)", grave, p["gas"], p["background"]))
        .when(p["rule"] == "h2s", f("%s: H2S detected at %.1f ppm", grave, p["h2s"]))
        .when(p["rule"] == "pit_rate", f("%s: Pit %s rate %.1f bbl/hr", grave, F.when(p["pit_rate"] > 0, "gain").otherwise("loss"), F.abs(p["pit_rate"])))
        .when(p["rule"] == "ecd", f("%s: ECD margin only %.2f ppg to fracture", grave, p["ecd_margin"]))
        .when(p["rule"] == "spp", f("%s: SPP %s of %.0f psi", grave, F.when(p["spp_delta"] > 0, "increase").otherwise("decrease"), F.abs(p["spp_delta"])))
        .when(p["rule"] == "torque", f("%s: Torque increase %.1f%% - potential pack-off", grave, p["torque_delta"] * 100.0))
        .when(p["rule"] == "founder", f("%s: Founder condition - WOB increased %.1f%% but ROP %s %.1f%%. Reduce WOB.", grave, p["wob_change"] * 100.0, F.when(p["rop_change"] < 0, "decreased").otherwise("flat"), F.abs(p["rop_change"]) * 100.0))
        .when(p["rule"] == "mse", f("%s: MSE efficiency %.0f%% - optimization opportunity", grave, p["efficiency"]))
    )


def voting_reasoning(final: Column, regime: Column, votes: Column) -> Column:
    """Why the ensemble decided: ``votes`` is an array of (specialist, vote, weight)."""
    label = F.coalesce(F.get(F.array(*[F.lit(x) for x in REGIME_LABELS]), regime.cast("int")), F.lit(REGIME_LABELS[-1]))
    each = F.transform(votes, lambda v: digits.printf("%s=%s (%.0f%%)", v["specialist"], v["vote"], v["weight"] * 100.0))
    return digits.printf("Final severity %s from ensemble [regime %d:%s]: %s", final, regime.cast("int"), label, F.array_join(each, ", "))


def causal_block(leads: Column) -> Column:
    """Leads, an array of (parameter, lag, r), in one sentence; empty without any."""
    each = F.transform(leads, lambda x: digits.printf("%s %s precedes MSE rise by %ds (r=%+.2f)", x["parameter"], F.when(x["r"] > 0, "rising").otherwise("falling"), x["lag"], x["r"]))
    return F.when(F.size(leads) > 0, F.concat(F.lit(" Causal leads: "), F.array_join(each, "; "), F.lit("."))).otherwise("")


def trigger_of_votes(votes: Column, flow_balance: Column, efficiency: Column) -> Column:
    """Struct (parameter, value, threshold) from critical votes, else from the flow balance."""
    made = lambda name, value, limit: F.struct(F.lit(name).alias("parameter"), value.alias("value"), F.lit(float(limit)).alias("threshold"))
    critical = F.filter(votes, lambda v: (v["vote"] == "Critical") & v["specialist"].isin("WellControl", "MSE"))
    # a well-control vote counts only where its reasoning names the flow
    said = lambda v: F.regexp_extract(v["reasoning"], r"(?i)flow (?:im)?balance[^0-9-]*(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    found = F.filter(critical, lambda v: (v["specialist"] == "MSE") | said(v).isNotNull())
    first = F.get(found, 0)
    return (
        F.when(first["specialist"] == "WellControl", made("Flow Balance", said(first), 10))
        .when(first["specialist"] == "MSE", made("MSE Efficiency", efficiency, 70))
        .when(F.abs(flow_balance) > 10, made("Flow Balance", flow_balance, 10))
        .otherwise(made("Unknown", F.lit(0.0), 0))
    )


def parameter_steps(wob: Column, rpm: Column, flow: Column) -> Column:
    """What to change ahead of a formation: steps over 1 klb, 5 rpm or 10 gpm."""
    part = lambda x, limit, text: F.when(F.abs(x) > limit, digits.printf(text, x))
    steps = F.filter(F.array(part(wob, 1, "WOB %+.0f klbs"), part(rpm, 5, "RPM %+.0f"), part(flow, 10, "Flow %+.0f gpm")), lambda s: s.isNotNull())
    return F.when(F.size(steps) > 0, F.array_join(steps, ", ")).otherwise("no parameter change")


def look_ahead_text(formation: Column, minutes: Column, feet: Column, steps: Column) -> Column:
    return digits.printf("%s in %.0f min (%.0f ft): %s", formation, minutes, feet, steps)


def optimization_text(formation: Column, recommendations: Column, confidence: Column) -> Column:
    """Recommendations, an array of (parameter, current, recommended, impact), the largest impact first."""
    ordered = F.array_sort(recommendations, lambda a, b: F.when(a["impact"] > b["impact"], -1).when(a["impact"] < b["impact"], 1).otherwise(0))
    each = F.transform(ordered, lambda x: digits.printf("%s %.1f -> %.1f", x["parameter"], x["current"], x["recommended"]))
    return digits.printf("%s: %s (confidence %.0f%%)", formation, F.array_join(each, "; "), confidence * 100.0)


def composite_rating(score: Column) -> Column:
    return F.when(score > 0.75, "EXCELLENT (fast and stable)").when(score > 0.60, "GOOD efficiency").when(score > 0.45, "ACCEPTABLE").otherwise("POOR - optimization needed")


def lithology(d_exponent: Column) -> Column:
    """The kind of formation that a mean d-exponent points to."""
    return F.when(d_exponent < 1.2, "Soft Shale").when(d_exponent < 1.6, "Medium Shale/Siltstone").when(d_exponent < 2.0, "Hard Sandstone").otherwise("Very Hard Formation")


def query_category(text: Column) -> Column:
    """The anomaly category that a question is about, by its words."""
    has = lambda *words: F.greatest(*[F.coalesce(text.contains(w), F.lit(False)) for w in words]) if len(words) > 1 else text.contains(words[0])
    return (
        F.when(has("well control", "kick", "loss"), "WellControl").when(has("MSE", "efficiency", "ROP"), "DrillingEfficiency").when(has("pressure", "ECD", "hydraulic"), "Hydraulics")
        .when(has("torque", "pack-off", "stick-slip"), "Mechanical").when(has("d-exponent", "formation", "pore"), "Formation").otherwise("None")
    )


def jitter_hash(name: Column) -> Column:
    """Polynomial hash (factor 31) of a name's bytes modulo 2^31 - 1: spreads retries of peers.

    Spark has no wrapping 64-bit arithmetic in ANSI mode, so the modulus is prime
    and small; only the spread of the jitter matters, not its value.
    """
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % 2147483647)
