"""Sensor baselines, conformity checks, moving baselines and time aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mudline.config import DEFAULT, Config
from mudline.functions.frames import so_far
from mudline.functions import physics
from mudline.functions.physics import ratio
from mudline.operators.kernels import in_order, places
from mudline.operators.versions import Store


def long_form(rows: DataFrame, channels: list[str]) -> DataFrame:
    """One row per packet and sensor."""
    pairs = ", ".join(f"'{c}', {c}" for c in channels)
    return rows.select("well_id", "ts", "seq", F.expr(f"stack({len(channels)}, {pairs}) AS (sensor, v)"))


def baselines(long: DataFrame, c: Config = DEFAULT, by: tuple[str, ...] = ("well_id", "sensor")) -> DataFrame:
    """Mean, spread, range, outliers against the running spread, and status per group."""
    frame = so_far(*by)
    running = long.withColumns({"n": F.count("v").over(frame), "m": F.avg("v").over(frame), "s": F.stddev_samp("v").over(frame)})
    outlier = (F.col("n") > 10) & (F.col("s") > c.baseline.min_std_floor) & (F.abs(F.col("v") - F.col("m")) > c.baseline.outlier_sigma * F.col("s"))
    out = running.groupBy(*by).agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum(F.coalesce(outlier, F.lit(False)).cast("int")).alias("outliers")
    )
    status = F.when(F.col("n") < c.baseline.min_samples, "learning").when(F.col("outliers") > c.baseline.max_outlier_percentage * F.col("n"), "contaminated").otherwise("locked")
    return out.withColumn("status", status)


def check(long: DataFrame, base: DataFrame, warning: float = 3.0, critical: float = 5.0, both_sides: bool = False) -> DataFrame:
    """``z`` and ``level`` of each value against its baseline; the spread never counts as under 0.1 % of the mean."""
    spread = F.greatest("std", F.greatest(F.abs("mean") * 0.001, F.lit(0.001)))
    z = ratio(F.col("v") - F.col("mean"), spread)
    out = long.join(base.select("well_id", "sensor", "mean", "std"), ["well_id", "sensor"]).withColumn("z", F.abs(z) if both_sides else z)
    return out.withColumn("level", F.when(F.col("z") >= critical, "Critical").when(F.col("z") >= warning, "Warning").otherwise("Normal"))


def overrides(base: DataFrame) -> DataFrame:
    """Thresholds that follow a well's own spread, with floors; ``base`` has mean and std per well and sensor."""
    spread = F.greatest("std", F.greatest(F.abs("mean") * 0.001, F.lit(0.001)))
    of = lambda sensor, x: F.max(F.when(F.col("sensor") == sensor, x))
    variation = F.when(F.col("mean") > 0, physics.clamp(ratio(spread, F.col("mean")), 0, 10))
    p = base.groupBy("well_id").agg(of("flow_balance", spread).alias("f"), of("spp", spread).alias("s"), of("torque", variation).alias("cv"))
    floor = lambda x, low: F.when(x.isNotNull(), F.greatest(x, F.lit(low)))
    return p.select(
        "well_id", (3 * F.col("f")).alias("flow_warning"), floor(2 * F.col("s"), 30.0).alias("spp_warning"), floor(3 * F.col("s"), 50.0).alias("spp_critical"), floor(2 * F.col("cv"), 0.10).alias("torque_warning"), floor(3 * F.col("cv"), 0.20).alias("torque_critical")
    )


def locks(base: DataFrame, sensors: int = 12) -> DataFrame:
    """Per well how many baselines are locked, and whether all of ``sensors`` are."""
    return base.groupBy("well_id").agg(F.count_if(F.col("status") == "locked").alias("locked")).withColumn("all_locked", F.col("locked") == sensors)


def formation_locks(long: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Baselines per well, sensor and formation as they stand at the first packet that makes them long and clean enough.

    Formation names of no or over 256 characters have none.
    """
    by = ("well_id", "sensor", "formation")
    frame = so_far(*by)
    named = long.filter(F.length("formation").between(1, 256))
    running = named.withColumns({"n": F.count("v").over(frame), "m": F.avg("v").over(frame), "s": F.stddev_samp("v").over(frame)})
    outlier = (F.col("n") > 10) & (F.col("s") > c.baseline.min_std_floor) & (F.abs(F.col("v") - F.col("m")) > c.baseline.outlier_sigma * F.col("s"))
    counted = running.withColumn("outliers", F.sum(F.coalesce(outlier, F.lit(False)).cast("int")).over(frame))
    clean = counted.filter((F.col("n") >= c.baseline.min_samples) & (F.col("outliers") <= c.baseline.max_outlier_percentage * F.col("n")))
    at = F.min_by(F.struct(F.col("seq").alias("locked_at"), "n", F.col("m").alias("mean"), F.col("s").alias("std")), "n").alias("at")
    return clean.groupBy(*by).agg(at).select(*by, "at.*")


def forced(base: DataFrame, least: int = 2) -> DataFrame:
    """Baselines locked whatever their outliers, from ``least`` samples on."""
    return base.withColumn("status", F.when(F.col("n") >= least, "locked").otherwise(F.col("status")))


#: Version of stored baselines; the version before reads alike but for outliers, which it lacks.
STATE_VERSION = 3


def save(base: DataFrame, folder: str) -> int:
    """Baselines as the next version of a store in ``folder``: there whole or not at all, the ones before stay readable."""
    return Store(base.sparkSession, folder).commit({"baselines": base.withColumn("version", F.lit(STATE_VERSION))})


def load(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """Stored baselines, the last ones by default, or those of a plain table; states of versions 2 and 3 are read, others are an error."""
    stored = Store(spark, folder).read("baselines", version)
    rows = spark.read.parquet(folder) if stored is None else stored
    if rows.filter(~F.col("version").isin(2, STATE_VERSION)).limit(1).count():
        raise ValueError("baselines of an unknown version")
    return (rows if "outliers" in rows.columns else rows.withColumn("outliers", F.lit(0).cast("long"))).drop("version")


def hourly(metrics: DataFrame) -> DataFrame:
    """Hours of a well: means of seven measures, the range of efficiency, and four slopes against the packet's place."""
    hour = F.col("ts") - F.col("ts") % 3600
    i = F.row_number().over(Window.partitionBy("well_id", "hour").orderBy("ts", "seq")).cast("double")
    slope = lambda x: F.coalesce(F.regr_slope(x, "i"), F.lit(0.0))
    means = {"eff": "mse_efficiency", "torque": "torque", "spp": "spp", "rop": "rop", "wob": "wob", "mse": "mse", "flow_balance": "flow_balance"}
    slopes = {"torque_slope": "torque", "spp_slope": "spp", "rop_slope": "rop", "eff_slope": "mse_efficiency"}
    return metrics.withColumn("hour", hour).withColumn("i", i).groupBy("well_id", "hour").agg(
        F.count("*").alias("n"), *[F.avg(x).alias(n) for n, x in means.items()], F.min("mse_efficiency").alias("eff_lo"), F.max("mse_efficiency").alias("eff_hi"), *[slope(x).alias(n) for n, x in slopes.items()]
    )


def daily(hours: DataFrame) -> DataFrame:
    """Days from hours: means of means, as reports are built in two steps."""
    day = F.col("hour") - F.col("hour") % 86400
    i = F.row_number().over(Window.partitionBy("well_id", "day").orderBy("hour")).cast("double")
    return hours.withColumn("day", day).withColumn("i", i).groupBy("well_id", "day").agg(
        F.count("*").alias("hours"), F.avg("eff").alias("eff"), F.avg("torque").alias("torque"), F.min("eff_lo").alias("eff_lo"), F.max("eff_hi").alias("eff_hi"), F.coalesce(F.regr_slope("eff", "i"), F.lit(0.0)).alias("eff_trend")
    )


def moving_baseline(rows: DataFrame, channel: str, fast: float = 0.5, slow: float = 0.1, warm: int = 10) -> DataFrame:
    """``ema`` per well: fast for the first ``warm`` rows, then slow; values that aren't positive leave it alone.

    A recursion, so rows stream through one task per well, sorted; state is one
    number, and no well is held in memory.
    """
    schema = f"well_id long, ts long, seq long, {channel} double, idx long, ema double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, ema = 0, 0.0
        for b in batches:
            if b.empty:
                continue
            begins = set(places(b["_place"], n))
            v, out = b[channel].to_numpy(), np.empty(len(b))
            for i in range(len(b)):
                if i in begins:
                    n, ema = 0, 0.0
                if v[i] > 0:
                    ema = v[i] if ema == 0 else ema + (fast if n < warm else slow) * (v[i] - ema)
                n += 1
                out[i] = ema
            yield b.rename(columns={"_place": "idx"}).assign(ema=out)

    return in_order(rows.select("well_id", "ts", "seq", channel), "well_id", ("ts", "seq")).mapInPandas(run, schema)
