"""Learning, lock and dynamic thresholds of a well: which packets teach, at which one the baselines lock, and what holds from there on.

Only drilling and reaming packets teach.  After each ``min_samples`` of them every
sensor whose outliers are few enough locks; the first time that one does, the
well turns from ``learning`` to ``dynamic`` at this very packet, and learns no
more.  Where none does, all begin to learn anew.  Thresholds of the well's own
hold from the lock on, never before, and intervals begin anew there (``locks``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mudline.config import DEFAULT, Config
from mudline.functions.frames import so_far
from mudline.operators import baseline
from mudline.operators.metrics import OVERRIDES, judged

#: Channels that learn (fixed values).
SENSORS = ("mse", "d_exponent", "dxc", "flow_balance", "spp", "torque", "rop", "wob", "rpm", "ecd", "pit_volume", "gas_units")


def placed(metrics: DataFrame) -> DataFrame:
    """``teaches``, and ``lessons``: how many packets of the well have taught so far."""
    teaches = F.col("state").isin("Drilling", "Reaming")
    return metrics.withColumn("teaches", teaches).withColumn("lessons", F.sum(teaches.cast("int")).over(so_far()).cast("long"))


def learned(metrics: DataFrame, c: Config = DEFAULT, sensors: tuple[str, ...] = SENSORS) -> DataFrame:
    """The baselines that lock: ``well_id``, ``sensor``, ``mean``, ``std``, ``outliers`` and ``locked_after`` (packets that taught)."""
    size = c.baseline.min_samples
    cut = placed(metrics).filter("teaches").withColumn("block", F.ceil(F.col("lessons") / size))
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    frame = so_far("well_id", "block")
    running = cut.select("well_id", "ts", "seq", "block", *[finite(F.col(s).cast("double")).alias(s) for s in sensors])
    running = running.withColumns({f"n_{s}": F.count(s).over(frame) for s in sensors} | {f"m_{s}": F.avg(s).over(frame) for s in sensors} | {f"s_{s}": F.stddev_samp(s).over(frame) for s in sensors})
    strays = lambda s: (F.col(f"n_{s}") > 10) & (F.col(f"s_{s}") > c.baseline.min_std_floor) & (F.abs(F.col(s) - F.col(f"m_{s}")) > c.baseline.outlier_sigma * F.col(f"s_{s}"))
    one = lambda s: F.struct(F.lit(s).alias("sensor"), F.count(s).alias("n"), F.avg(s).alias("mean"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("std"), F.count_if(strays(s)).alias("outliers"))
    blocks = running.groupBy("well_id", "block").agg(F.count("*").alias("size"), F.array(*[one(s) for s in sensors]).alias("all")).filter(F.col("size") == size)
    clean = blocks.withColumn("all", F.filter("all", lambda b: (b["n"] >= size) & (b["outliers"] <= c.baseline.max_outlier_percentage * b["n"]))).filter(F.size("all") > 0)
    first = clean.groupBy("well_id").agg(F.min_by("all", "block").alias("all"), (F.min("block") * size).cast("long").alias("locked_after"))
    return first.select("well_id", "locked_after", F.inline("all")).select("well_id", "sensor", "mean", "std", "outliers", "locked_after")


def with_modes(metrics: DataFrame, locked: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """``metrics`` with ``mode``, ``learning``, ``locks`` (the one packet at which the well locks), and judged by what holds at each packet."""
    wells = locked.groupBy("well_id").agg(F.max("locked_after").alias("locked_after")).join(baseline.overrides(locked), "well_id")
    rows = placed(metrics.drop("rule", "category", "severity")).join(wells, "well_id", "left")
    dynamic = F.coalesce(F.col("lessons") >= F.col("locked_after"), F.lit(False))
    locks = dynamic & F.col("teaches") & (F.col("lessons") == F.col("locked_after"))
    rows = rows.withColumns({"mode": F.when(dynamic, "dynamic").otherwise("learning"), "learning": ~dynamic, "locks": locks} | {x: F.when(dynamic, F.col(x)) for x in OVERRIDES})
    return judged(rows, c, OVERRIDES).drop("teaches")


