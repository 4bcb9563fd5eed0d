"""Data quality: issue lists, sanitising, and rejection reasons for batch analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 2.220446049250313e-16
#: Field, lowest and highest possible value, and severity (fixed values).
RANGES = [
    ("bit_depth", 0.0, None, "Critical"), ("rop", -1.0, 1000.0, "Critical"), ("wob", None, 200.0, "Critical"), ("rpm", 0.0, None, "Warning"), ("rpm", None, 500.0, "Critical"), ("torque", -50.0, 100.0, "Critical"),
    ("spp", 0.0, None, "Warning"), ("spp", None, 10000.0, "Critical"), ("hook_load", 0.0, 1000.0, "Critical"), ("h2s", 0.0, None, "Warning"),
]
NONNEGATIVE = ("wob", "torque", "rpm", "rop", "flow_in", "flow_out", "spp")
FINITE = ("bit_depth", "hole_depth", "rop", "wob", "rpm", "torque", "spp", "flow_in", "flow_out", "pit_volume", "mud_weight_in", "mud_weight_out", "ecd", "gas_units", "mud_temp_in", "mud_temp_out")


def issue(fires: Column, field: str, severity: str, text: str) -> Column:
    return F.when(fires, F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"), F.lit(text).alias("message")))


def with_issues(packets: DataFrame) -> DataFrame:
    """``issues`` (array of field, severity, message) and ``usable``: no critical issue."""
    # a value that is no number passes every limit; sanitising makes it 0 later
    x = {c: F.when(~F.isnan(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in ("bit_depth", "hole_depth", "rop", "wob", "rpm", "torque", "spp", "flow_in", "flow_out", "hook_load", "ecd", "mud_weight_in", "h2s")}
    dead = sum(F.abs(x[c]) for c in ("bit_depth", "rop", "wob", "rpm", "torque", "spp", "flow_in")) < TINY
    found = [issue(F.abs(x[c]) < TINY, c, "Warning", f"{c} is zero") for c in ("bit_depth", "flow_in")]
    for field, low, high, severity in RANGES:
        for limit, fires in ((low, x[field] < low if low is not None else None), (high, x[field] > high if high is not None else None)):
            if fires is not None:
                found.append(issue(fires, field, severity, f"{field} beyond {limit:g}"))
    found += [
        issue((x["ecd"] != 0) & ((x["ecd"] < 5) | (x["ecd"] > 25)), "ecd", "Critical", "ecd out of 5 to 25"),
        issue((x["mud_weight_in"] < 0) | (x["mud_weight_in"] > 25), "mud_weight_in", "Critical", "mud weight out of 0 to 25"),
        issue((x["flow_out"] > 0) & (x["flow_in"] < TINY), "flow_in", "Warning", "flow out without flow in"),
        issue((x["bit_depth"] > 0) & (x["hole_depth"] > 0) & (x["bit_depth"] > x["hole_depth"] + 10), "bit_depth", "Warning", "bit below the hole"),
        issue(F.col("ts") == 0, "ts", "Warning", "clock not set"),
    ]
    alone = F.array(issue(F.lit(True), "ALL", "Critical", "all critical fields are zero"))
    issues = F.when(dead, alone).otherwise(F.filter(F.array(*found), lambda i: i.isNotNull()))
    return packets.withColumn("issues", issues).withColumn("usable", ~F.exists("issues", lambda i: i["severity"] == "Critical"))


def sanitize(packets: DataFrame) -> DataFrame:
    """Usable packets only, negatives of seven channels as 0, then values that aren't finite as 0."""
    kept = with_issues(packets).filter("usable").drop("issues", "usable")
    zeroed = kept.withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in NONNEGATIVE if c in kept.columns})
    whole = lambda c: F.when(F.isnan(c) | F.col(c).isNull() | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c))
    return zeroed.withColumns({c: whole(c) for c in FINITE if c in kept.columns})


def rejection(wob: Column, rpm: Column, mse: Column, rop: Column, state: Column) -> Column:
    """The first reason why a row can't enter the batch analysis; NULL where it can."""
    return (
        F.when(wob < 5, "LowWob")
        .when(rpm < 40, "LowRpm")
        .when((mse < 1000) | (mse > 500_000), "InvalidMse")
        .when((rop < 1) | (rop > 500), "InvalidRop")
        .when(~state.isin("Drilling", "Reaming"), "WrongRigState")
    )
