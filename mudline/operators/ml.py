"""The hourly batch analysis: stability filter, WOB x RPM grid, optimum, correlations, p-values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mudline.functions.frames import last_rows
from mudline.functions.physics import clamp
from mudline.operators import selection, windows

WOB_BINS, RPM_BINS, BIN_ROWS = 8, 6, 10
#: Weights of rate, efficiency and stability by campaign (fixed values).
CAMPAIGNS = {"Production": (0.50, 0.30, 0.20), "PlugAbandonment": (0.25, 0.45, 0.30)}


def dysfunction(cv: Column, torque_delta: Column, spp_delta: Column, founder: Column, efficiency: Column, category: Column) -> Column:
    """The first reason why a row is not steady drilling; NULL for steady rows."""
    combined = F.greatest(torque_delta, F.lit(0.0)) * 0.6 + clamp(spp_delta / 200.0, 0, 1) * 0.4
    return (
        F.when(cv > 0.12, "TorqueInstability")
        .when((torque_delta > 0.10) & (spp_delta > 75), "PackOff")
        .when(combined > 0.15, "PackOff")
        .when(founder, "Founder")
        .when(efficiency < 50, "LowEfficiency")
        .when((category == "Mechanical") & (torque_delta > 0.10), "PackOff")
        .when(category == "Mechanical", "StickSlip")
        .when(category != "None", "LowEfficiency")
    )


def with_dysfunction(metrics: DataFrame, enough: int = 10) -> DataFrame:
    """``cv`` and ``dysfunction`` per packet; wells with fewer than ``enough`` rows pass whole (0: none does)."""
    m = windows.founder_flags(metrics).withColumn("cv", windows.variation(F.col("torque"), last_rows(10), 10))
    reason = dysfunction(*[F.col(c) for c in ("cv", "torque_delta", "spp_delta", "founder", "mse_efficiency", "category")])
    return m.withColumn("dysfunction", F.when(F.count("*").over(Window.partitionBy("well_id")) >= enough, reason) if enough else reason)


def stability(cv: Column, torque_delta: Column, efficiency: Column, spp_delta: Column) -> Column:
    """1 less penalties that grow from half of each limit."""
    part = lambda x, start, span, weight: F.when(x > start, weight * F.least((x - start) / span, F.lit(1.0))).otherwise(0.0)
    low = F.when(efficiency < 70, 0.2 * F.least((70 - efficiency) / 20.0, F.lit(1.0))).otherwise(0.0)
    return F.greatest(1.0 - part(cv, 0.06, 0.06, 0.3) - part(torque_delta, 0.05, 0.05, 0.25) - low - part(spp_delta, 37.5, 37.5, 0.15), F.lit(0.0))


def confidence(n: Column) -> Column:
    return F.when(n >= 1800, "High").when(n >= 900, "Medium").when(n >= 360, "Low").otherwise("Insufficient")


def grid(rows: DataFrame, campaign: str = "Production", few: int | None = None) -> DataFrame:
    """Bins of weight and speed per well with medians and scores; ``rows`` carry cv, deltas and efficiency.

    ``few``: medians of groups over so many rows are selected by counting, so that no task holds a group.

    The range per well is a window over the partition that the medians shuffle by
    anyway; wells of under 1 klb or 5 rpm range and bins of under ``BIN_ROWS`` rows
    have none (see ``best_parameters``).
    """
    whole = Window.partitionBy("well_id")
    ranged = rows.withColumns({"w0": F.min("wob").over(whole), "w1": F.max("wob").over(whole), "r0": F.min("rpm").over(whole), "r1": F.max("rpm").over(whole)}).filter("w1 - w0 >= 1 AND r1 - r0 >= 5")
    at = lambda x, lo, hi, n: F.least(F.greatest(F.floor((F.col(x) - F.col(lo)) / ((F.col(hi) - F.col(lo)) / n)), F.lit(0)), F.lit(n - 1))
    binned = ranged.withColumn("bin", at("wob", "w0", "w1", WOB_BINS) * RPM_BINS + at("rpm", "r0", "r1", RPM_BINS))
    score = stability(*[F.col(c) for c in ("cv", "torque_delta", "mse_efficiency", "spp_delta")])
    wr, we, ws = CAMPAIGNS[campaign]
    stats = with_medians(binned, ["well_id", "bin"], few, F.avg(score).alias("stability")).filter(F.col("n") >= BIN_ROWS)
    return stats.withColumn("score", wr * F.least(F.col("rop") / 100.0, F.lit(1.0)) + we * F.col("efficiency") / 100.0 + ws * F.col("stability"))


#: Medians by name and the column they are of.
MEDIANS = {"wob": "wob", "rpm": "rpm", "flow": "flow_in", "rop": "rop", "efficiency": "mse_efficiency"}


def with_medians(rows: DataFrame, by: list[str], few: int | None, *more: Column) -> DataFrame:
    """``n``, ``MEDIANS`` and ``more`` per group."""
    if few is None:
        return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.median(c).alias(name) for name, c in MEDIANS.items()], *more)
    middle = selection.medians(rows.select(*by, *[F.col(c).alias(name) for name, c in MEDIANS.items()]), by, list(MEDIANS), few)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *more).join(middle, by)


def best_parameters(rows: DataFrame, campaign: str = "Production", least: int = 360, few: int | None = None) -> DataFrame:
    """Each well's best bin; medians of all rows, score 0.5 and stability 1, where no bin is good; wells of under ``least`` rows have none.  ``few`` as in ``grid``."""
    best = optimum(grid(rows, campaign, few)).select("well_id", F.struct("bins", "bin", "wob", "rpm", "flow", "rop", "efficiency", "stability", "score").alias("b"))
    whole = with_medians(rows, ["well_id"], few).filter(F.col("n") >= least)
    met = whole.join(best, "well_id", "left")
    pick = lambda c: F.coalesce(f"b.{c}", c).alias(c)
    return met.select("well_id", "n", F.coalesce("b.bins", F.lit(0)).alias("bins"), "b.bin", *[pick(c) for c in ("wob", "rpm", "flow", "rop", "efficiency")], F.coalesce("b.stability", F.lit(1.0)).alias("stability"), F.coalesce("b.score", F.lit(0.5)).alias("score"))


def optimum(bins: DataFrame) -> DataFrame:
    """Each well's best bin; the highest bin on ties."""
    best = F.max_by(F.struct(*[c for c in bins.columns if c != "well_id"]), F.struct("score", "bin")).alias("b")
    return bins.groupBy("well_id").agg(best, F.count("*").alias("bins")).select("well_id", "bins", "b.*")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or 1e-300)
        c = 1 + step / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation; 1 under three rows, 0 for nearly perfect ones."""
    if n < 3:
        return 1.0
    if abs(r) >= 0.9999:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))


def with_p_values(rows: DataFrame) -> DataFrame:
    """``p`` for columns ``r`` and ``n``; Spark has no t distribution, so a vectorised UDF."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([p_value(float(a), int(b)) if a == a else 1.0 for a, b in zip(r, n, strict=True)], dtype=np.float64)

    return rows.withColumn("p", p(F.col("r"), F.col("n")))


def correlations(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``r``, ``n`` and ``p`` for pairs of columns per well, in one aggregate."""
    aggs = [windows.pearson(F.col(x), F.col(y)).alias(f"{x}_{y}") for x, y in pairs]
    wide = rows.groupBy("well_id").agg(F.count("*").alias("n"), *aggs)
    parts = ", ".join(f"'{x}', '{y}', {x}_{y}" for x, y in pairs)
    return with_p_values(wide.select("well_id", "n", F.expr(f"stack({len(pairs)}, {parts}) AS (x, y, r)")).filter("r IS NOT NULL"))


