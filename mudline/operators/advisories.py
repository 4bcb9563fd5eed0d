"""What becomes an advisory: oscillations and damping, the optimiser's gate, the order of sources, feature vectors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mudline.functions import physics, tickets
from mudline.functions.frames import last_rows, ordered
from mudline.operators.kernels import Kernel, in_order, places
from mudline.operators.nets import AHEAD, FEATURES
from mudline.operators.reading import blended

#: Sources of an advisory, the first that speaks wins (fixed values).
PRIORITY = ("ticket", "periodic", "damping", "optimization", "look_ahead")


def oscillation(torques: Column, least: int = 20, threshold: float = 0.05) -> Column:
    """Struct (cv, hz, amplitude, kind) of a torque series; NULL for too few sound values or steady torque.

    Values that are not positive or not finite are dropped; the frequency counts
    crossings of the mean, one sample a second; under 1 Hz it is stick-slip.
    """
    sound = F.filter(torques, lambda x: (x > 0) & ~F.isnan(x) & (x < float("inf")))
    n = F.size(sound)
    mean = F.aggregate(sound, F.lit(0.0), lambda s, x: s + x) / n
    with_mean = F.struct(sound.alias("v"), mean.alias("m"))
    made = F.transform(F.array(with_mean), lambda s: F.struct(
        s["m"].alias("m"), (F.sqrt(F.aggregate(s["v"], F.lit(0.0), lambda t, x: t + (x - s["m"]) * (x - s["m"])) / F.size(s["v"])) / s["m"]).alias("cv"),
        F.size(F.filter(F.sequence(F.lit(1), F.size(s["v"]) - 1), lambda i: (F.get(s["v"], i) >= s["m"]) != (F.get(s["v"], i - 1) >= s["m"]))).alias("crossings"),
        ((F.array_max(s["v"]) - F.array_min(s["v"])) / s["m"]).alias("amplitude"), F.size(s["v"]).alias("n"),
    ))[0]
    hz = made["crossings"] / (2.0 * (made["n"] - 1))
    out = F.struct(made["cv"].alias("cv"), hz.alias("hz"), made["amplitude"].alias("amplitude"), F.when(hz < 1.0, "StickSlip").otherwise("Torsional").alias("kind"))
    return F.when(n >= F.greatest(F.lit(least), F.lit(2)), F.when(made["cv"] >= threshold, out))


def swings(values: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Sound values, cv, hz and amplitude of the last ``n`` values of each row's key, where ``place`` counts the rows of a key from 1 and the first n - 1 rows may lie in another key; a step for each place in the window, over all rows at once."""
    sound = (values > 0) & np.isfinite(values)
    x = np.where(sound, values, 0.0)
    steps = [(back, max(len(x) - back, 0)) for back in range(min(n, len(x)) - 1, -1, -1)]  # the oldest value first, as sums run
    there = [np.concatenate([np.zeros(back, bool), sound[:m] & (place[back:] > back)]) for back, m in steps]
    shifted = [np.concatenate([np.zeros(back), x[:m]]) for back, m in steps]
    count, total = np.zeros(len(x), np.int64), np.zeros(len(x))
    low, high = np.full(len(x), np.inf), np.full(len(x), -np.inf)
    for ok, v in zip(there, shifted, strict=True):
        count += ok
        total += np.where(ok, v, 0.0)
        low, high = np.where(ok, np.minimum(low, v), low), np.where(ok, np.maximum(high, v), high)
    mean = total / np.maximum(count, 1)
    squares, crossings = np.zeros(len(x)), np.zeros(len(x), np.int64)
    side, begun = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for ok, v in zip(there, shifted, strict=True):
        squares += np.where(ok, (v - mean) * (v - mean), 0.0)
        above = v >= mean
        crossings += ok & begun & (above != side)
        side, begun = np.where(ok, above, side), begun | ok
    some = np.where(count > 0, mean, 1.0)
    return count, np.sqrt(squares / np.maximum(count, 1)) / some, crossings / (2.0 * np.maximum(count - 1, 1)), np.where(count > 0, high - low, 0.0) / some


def oscillations(rows: DataFrame, value: str, keep: tuple[str, ...] = ("seq",), n: int = 60, least: int = 20, threshold: float = 0.05, key: str = "well_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """``keep`` and cv, hz, amplitude and kind of each row whose last ``n`` values swing, as ``oscillation`` has them of a list; rows stream in order, a task holds a batch and the n - 1 rows before it."""
    picked = in_order(rows.select(*dict.fromkeys([key, *order, *keep, value])), key, order).select(*keep, F.col(value).alias("_value"), "_place")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.select(*keep).schema), "cv double, hz double, amplitude double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, values, place = 0, np.zeros(0), np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            new = b.column("_place").to_numpy()
            places(new, last)
            last, held = int(new[-1]), len(values)
            # nulls become NaN, which is not sound
            values, place = np.concatenate([values, b.column("_value").to_numpy(zero_copy_only=False).astype(float)]), np.concatenate([place, new])
            count, cv, hz, amplitude = (a[held:] for a in swings(values, place, n))
            values, place = values[-(n - 1) :], place[-(n - 1) :]
            found = np.flatnonzero((count >= max(least, 2)) & (cv >= threshold))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(found)) for c in keep), *(pa.array(a[found]) for a in (cv, hz, amplitude))], [*keep, "cv", "hz", "amplitude"])

    return picked.mapInArrow(run, schema).withColumn("kind", F.when(F.col("hz") < 1.0, "StickSlip").otherwise("Torsional"))


def with_damping(rows: DataFrame, recipes: DataFrame, n: int = 60, least_cv: float = 0.15, max_wob_pct: float = 20.0, max_rpm_pct: float = 20.0) -> DataFrame:
    """Recommended weight and speed for stick-slip tickets, refined by the formation's best recipe (formation, best) where it has one.

    ``rows`` carry ``slipping`` (a ticket whose pattern is stick-slip) and
    ``formation``.  Other rows, and steady ones, get NULL.
    """
    seen = rows.withColumn("torques", F.collect_list("torque").over(last_rows(n))).withColumn("o", F.when(F.col("slipping"), oscillation(F.col("torques")))).drop("torques")
    wob, rpm = physics.damping(F.col("o.kind"), physics.clamp((F.col("o.cv") - 0.15) / 0.10, 0, 1), F.col("wob"), F.col("rpm"), max_wob_pct, max_rpm_pct)
    own = seen.withColumns({"own_wob": F.when(F.col("o.cv") >= least_cv, wob), "own_rpm": F.when(F.col("o.cv") >= least_cv, rpm)})
    met = own.join(recipes.select("formation", F.col("best.wob_change_pct").alias("recipe_wob"), F.col("best.rpm_change_pct").alias("recipe_rpm")), "formation", "left")
    pct = lambda new, old: physics.ratio(F.col(new) - F.col(old), F.col(old)) * 100.0
    wob_pct, rpm_pct = blended(pct("own_wob", "wob"), F.col("recipe_wob")), blended(pct("own_rpm", "rpm"), F.col("recipe_rpm"))
    return met.withColumns({"damped_wob": F.col("wob") * (1 + wob_pct / 100.0), "damped_rpm": F.col("rpm") * (1 + rpm_pct / 100.0)}).drop("own_wob", "own_rpm", "recipe_wob", "recipe_rpm")


def recommendation_confidence(offset: Column, gap: Column, trend: Column, sensor: Column, nets: Column) -> Column:
    """How far a recommendation can be trusted, 0 to 1 (weights are fixed values)."""
    return 0.30 * offset + 0.25 * gap + 0.20 * trend + 0.15 * sensor + 0.10 * nets


def offset_score(wells: Column) -> Column:
    """What 0, 1, 2 or more offset wells are worth."""
    return F.when(wells <= 0, 0.0).when(wells == 1, 0.4).when(wells == 2, 0.7).otherwise(1.0)


def gap_score(pairs: list[tuple[Column, Column, Column]]) -> Column:
    """Mean distance of parameters from their optimum over their span: (current, optimum, span)."""
    each = [physics.clamp(F.coalesce(physics.ratio(F.abs(c - o), s), F.lit(0.0)), 0, 1) for c, o, s in pairs]
    return sum(each[1:], each[0]) / float(len(each))


def net_agreement(score: Column) -> Column:
    """What the nets' anomaly score says for a recommendation; 0.5 where they say nothing."""
    return F.when(score.isNull(), 0.5).when(score < 0.3, 1.0).when(score < 0.5, 0.7).when(score < 0.7, 0.3).otherwise(0.0)


def optimizer_gate(net_score: Column, state: Column, confidence: Column, recommendations: Column, every: int = 10, most: float = 0.7, least: int = 10, least_confidence: float = 0.6) -> Column:
    """Why the optimiser stays silent at a packet; NULL where it speaks."""
    place = F.row_number().over(ordered())
    held = F.least(place, F.lit(60))
    return (
        F.when(place % every != 0, "RateLimited").when(net_score > most, "AnomalyActive").when(state != "Drilling", "NotDrilling").when(held < least, "InsufficientHistory")
        .when((F.round(confidence, 2) < least_confidence) | (recommendations <= 0), "LowConfidence")
    )


def advisory_source(flags: dict[str, Column]) -> Column:
    """The source whose advisory a packet gives: the first of ``PRIORITY`` whose flag holds; NULL for none."""
    return F.coalesce(*[F.when(F.coalesce(flags[s], F.lit(False)), F.lit(s)) for s in PRIORITY if s in flags])


class CriticalCooldown(Kernel):
    """Critical advisories pass once in 30 seconds of event time; others always pass."""

    schema = "composed boolean"
    reads = ("ts", "severity")

    def __init__(self, seconds: int = 30):
        self.seconds = seconds

    def start(self) -> dict[str, Any]:
        return {"ts": None}

    def step(self, s: dict[str, Any], x: dict[str, Any]) -> tuple:
        if x["severity"] != "CRITICAL":
            return (True,)
        free = s["ts"] is None or x["ts"] - s["ts"] >= self.seconds
        if free:
            s["ts"] = x["ts"]
        return (free,)


def recommendations(rows: DataFrame, ranges: Column, offset_best: dict[str, float]) -> DataFrame:
    """Rows (seq, parameter, place, current, recommended, impact): what to change, the largest share of its range first; ``ranges`` as ``tickets.default_parameters`` gives them."""
    current = {"wob": "wob", "rpm": "rpm", "flow": "flow_in"}
    r = rows.withColumn("_ranges", ranges)
    each = [F.struct(F.lit(n).alias("parameter"), F.col(c).alias("current"), tickets.recommend(F.col(c), F.col(f"_ranges.{n}"), F.lit(offset_best[n])).alias("recommended"), (F.col(f"_ranges.{n}.max") - F.col(f"_ranges.{n}.min")).alias("span")) for n, c in current.items()]
    found = r.select("seq", F.inline(F.filter(F.array(*each), lambda x: x["recommended"].isNotNull())))
    impact = found.withColumn("impact", F.abs(F.col("recommended") - F.col("current")) / F.col("span"))
    return impact.withColumn("place", F.row_number().over(Window.partitionBy("seq").orderBy(F.desc(F.round("impact", 9)), "parameter")))


def feature_vector(columns: list[str]) -> Column:
    """The sixteen features of the nets, 0 where a column is missing."""
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in columns else F.lit(0.0) for f in FEATURES])


def ahead_vector(columns: list[str]) -> Column:
    """The features of the depth-ahead net: eight in use, eight zeros."""
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in columns else F.lit(0.0) for f in AHEAD], *[F.lit(0.0)] * 8)


def plan_tables(plan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A flat plan as geology, depths and parameters, keyed by name."""
    return plan.select("name", "lithology", "hardness", "hazards"), plan.select("name", "top", "base", "pore_pressure", "fracture_gradient"), plan.select("name", "wob", "rpm")
