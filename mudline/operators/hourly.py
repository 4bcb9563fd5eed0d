"""The hourly analysis end to end: filters, regimes, segments, correlations, best parameters, best partition.

``well_id`` names the dataset: a well, or a well's hour.  Datasets are analysed
side by side; one dataset's boundaries (not its rows) meet in one row.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mudline.functions.texts import composite_rating, lithology
from mudline.operators import joins, ml, quality

LEAST = 360
SMALL_REGIME = 50
#: What a partition is called that joins all regimes (fixed value).
COMBINED = 255
PAIRS = [("wob", "rop"), ("wob", "mse"), ("rpm", "rop"), ("rpm", "mse"), ("flow_in", "rop")]


def nearest_regimes(centres: Column) -> Column:
    """For each regime the others, the nearest centre first (ties: the smaller number)."""
    away = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    others = lambda c, i: F.filter(F.transform(centres, lambda o, j: F.struct(away(c, o).alias("away"), j.alias("regime"))), lambda o: o["regime"] != i)
    return F.transform(centres, lambda c, i: F.transform(F.array_sort(others(c, i)), lambda o: o["regime"]))


def last_centres(regimes: DataFrame) -> DataFrame:
    """Each dataset's centres as they stand at its end: ``well_id`` and ``centres``, of rows that carry them."""
    return regimes.groupBy("well_id").agg(F.max_by("centres", F.struct("ts", "seq")).alias("centres"))


def partitions(stable: DataFrame, centres: DataFrame, least: int = LEAST) -> DataFrame:
    """``stable`` rows with ``part``: regimes under 50 rows join the nearest larger one by the dataset's ``centres``; where no partition is large enough, all rows are one; small partitions go."""
    whole, own = Window.partitionBy("well_id"), lambda *c: Window.partitionBy("well_id", *c)
    nearest = centres.select("well_id", nearest_regimes(F.col("centres")).alias("_nearest"))
    sized = stable.withColumn("_n", F.count("*").over(own("regime"))).withColumn("_large", F.collect_set(F.when(F.col("_n") >= SMALL_REGIME, F.col("regime"))).over(whole))  # regimes are few
    target = F.get(F.filter(F.coalesce(F.get("_nearest", F.col("regime")), F.array().cast("array<int>")), lambda x: F.array_contains("_large", x)), 0)
    named = sized.join(nearest, "well_id", "left").withColumn("part", F.when((F.col("_n") < SMALL_REGIME) & (F.size("_large") > 0), F.coalesce(target, F.col("regime"))).otherwise(F.col("regime")))
    merged = named.withColumn("_size", F.count("*").over(own("part")))
    viable = merged.withColumns({"_viable": F.max("_size").over(whole) >= least, "_all": F.count("*").over(whole)})
    final = viable.withColumns({"part": F.when(F.col("_viable"), F.col("part")).otherwise(COMBINED), "_size": F.when(F.col("_viable"), F.col("_size")).otherwise(F.col("_all"))})
    return final.filter(F.col("_size") >= least).drop("_n", "_large", "_size", "_viable", "_all", "_nearest")


def spaced(boundaries: Column, gap: int = 30) -> Column:
    """Sorted boundaries less those under ``gap`` rows after the last that stayed."""
    return F.aggregate(boundaries, F.array().cast("array<int>"), lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= gap), F.array_append(kept, x)).otherwise(kept))


def segments(rows: DataFrame, transitions: DataFrame, half: int = 30, shift: float = 0.15, least_rows: int = 120) -> DataFrame:
    """``well_id``, ``part``, ``began``, ``ended`` (rows from 0, end excluded) of each partition's segments.

    Boundaries are shifts of the mean d-exponent between the ``half`` rows before a
    row and the ``half`` before them, ``half`` rows back, and the first packets at
    or after the ``transitions`` (well_id, at).
    """
    by = ["well_id", "part"]
    order = Window.partitionBy(*by).orderBy("ts", "seq")
    old, new = (F.avg("d_exponent").over(order.rowsBetween(a, b)) for a, b in ((-2 * half, -half - 1), (-half, -1)))
    placed = rows.select(*by, "ts", "seq", "d_exponent").withColumns({"row": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy(*by)), "old": old, "new": new})
    fires = placed.filter((F.col("row") >= 2 * half) & (F.col("n") >= least_rows) & (F.col("old") > 0.1) & (F.abs(F.col("new") - F.col("old")) > shift * F.col("old"))).select(*by, (F.col("row") - half).alias("at"))
    sizes = placed.groupBy(*by).agg(F.max("n").cast("int").alias("n"))
    asked = transitions.join(sizes.filter(F.col("n") >= least_rows), "well_id").select(*by, F.col("at").alias("moment"))
    told = joins.asof(asked, placed.select(*by, "ts", "row"), by, "moment", "ts", ["row"], forward=True, ties="row").filter("row IS NOT NULL").select(*by, F.col("row").alias("at"))
    marks = fires.unionByName(told).filter("at > 0").distinct().groupBy(*by).agg(F.array_sort(F.collect_list("at")).cast("array<int>").alias("marks"))
    cuts = sizes.join(marks, by, "left").withColumn("cuts", F.concat(F.array(F.lit(0)), F.filter(spaced(F.coalesce("marks", F.array().cast("array<int>")), half), lambda x: x < F.col("n")), F.array("n")))
    spans = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda k: F.struct(F.get("cuts", k).alias("began"), F.get("cuts", k + 1).alias("ended")))
    return cuts.select(*by, F.explode(spans).alias("s")).select(*by, "s.*")


def stable_rows(metrics: DataFrame, enough: int = 10) -> DataFrame:
    """Rows for analysis with their ``reason``: why one was rejected or is not steady; NULL for those that stay.  ``enough``: valid rows from which a dataset is judged at all."""
    rejected = quality.rejection(*[F.col(c) for c in ("wob", "rpm", "mse", "rop", "state")])
    marked = metrics.withColumn("rejected", rejected)
    valid = ml.with_dysfunction(marked.filter("rejected IS NULL"), enough)
    bad = marked.filter("rejected IS NOT NULL").withColumns({c: F.lit(None).cast(t) for c, t in valid.dtypes if c not in marked.columns})
    return valid.unionByName(bad).withColumn("reason", F.coalesce("rejected", "dysfunction"))


def analysis(metrics: DataFrame, transitions: DataFrame, centres: DataFrame, campaign: str = "Production", least: int = LEAST, enough: int = 10) -> DataFrame:
    """One report per dataset: ``result``, ``reason``, and of its best partition the parameters, score, correlation, confidence and formation.

    ``metrics`` carry ``regime``; ``transitions``: well_id and at (seconds);
    ``centres`` of the regimes as ``last_centres`` gives them.  ``reason`` of a
    failure is what most rows were left out for: by the quality rules where no row
    passes them, else as unsteady.  ``enough`` as in ``stable_rows``.
    """
    # six branches read the judged rows, so they are kept once: on disk, and made anew where an executor is lost
    columns = ["well_id", "ts", "seq", "regime", "bit_depth", "wob", "rpm", "rop", "flow_in", "mse", "mse_efficiency", "torque_delta", "spp_delta", "d_exponent", "cv", "rejected", "reason"]
    judged = stable_rows(metrics, enough).select(*columns).persist(StorageLevel.DISK_ONLY)
    per_reason = judged.groupBy("well_id", "reason").agg(F.count("*").alias("count"), F.count_if(F.col("rejected").isNull()).alias("valid"))
    unsteady = F.when(F.col("reason").isNotNull() & (F.col("valid") > 0), F.struct("count", "reason"))
    refused = F.when(F.col("reason").isNotNull() & (F.col("valid") == 0), F.struct("count", "reason"))
    counts = per_reason.groupBy("well_id").agg(F.sum("valid").alias("valid"), F.sum(F.when(F.col("reason").isNull(), F.col("count")).otherwise(0)).alias("stable"), F.when(F.sum("valid") == 0, F.max(refused)["reason"]).otherwise(F.max(unsteady)["reason"]).alias("primary_reason"))
    rows = partitions(judged.filter("reason IS NULL").drop("rejected", "reason"), centres, least)
    best_segment = segments(rows, transitions).withColumn("size", F.col("ended") - F.col("began")).groupBy("well_id", "part").agg(F.max_by(F.struct("began", "ended"), F.struct("size", "began")).alias("s"), F.count("*").alias("segments"), F.max("size").alias("largest"))
    steady = best_segment.filter(~((F.col("segments") > 1) & (F.col("largest") < least)))
    numbered = rows.withColumn("row", F.row_number().over(Window.partitionBy("well_id", "part").orderBy("ts", "seq")) - 1)
    picked = numbered.join(steady.select("well_id", "part", "s.*"), ["well_id", "part"]).filter((F.col("row") >= F.col("began")) & (F.col("row") < F.col("ended")))
    unit = picked.withColumn("well_id", F.struct("well_id", "part"))
    found = ml.best_parameters(unit, campaign, least)
    related = ml.correlations(unit, PAIRS).filter("p < 0.05")
    strongest = related.groupBy("well_id").agg(F.max_by(F.struct("x", "y", "r", "p"), F.struct(F.round(F.abs("r"), 9), "x", "y")).alias("strongest"), F.count("*").alias("related"))
    kind = unit.groupBy("well_id").agg(F.avg("d_exponent").alias("avg_d"), F.min("bit_depth").alias("depth_from"), F.max("bit_depth").alias("depth_to"))
    units = found.join(kind, "well_id").join(strongest, "well_id", "left").select(F.col("well_id.well_id").alias("dataset"), F.col("well_id.part").alias("part"), "*").drop("well_id")
    best = units.groupBy("dataset").agg(F.max_by(F.struct(*[c for c in units.columns if c != "dataset"]), F.struct("score", "part")).alias("b")).select(F.col("dataset").alias("well_id"), "b.*")
    level = ml.confidence(F.col("n"))
    out = counts.join(best, "well_id", "left").withColumns({
        "result": F.when(F.col("valid") == 0, "AllDataRejected").when(F.col("valid") < least, "InsufficientData").when(F.col("stable") < least, "AllDataRejected").when(F.col("part").isNull(), "InsufficientData").otherwise("Success"),
        "confidence": F.when(F.col("related").isNull() & (level == "High"), "Medium").otherwise(level), "rating": F.when(F.col("score").isNotNull(), composite_rating(F.col("score"))), "formation": F.when(F.col("avg_d").isNotNull(), lithology(F.col("avg_d"))), "stability_share": F.try_divide("stable", "valid"),
    })
    return out.withColumn("primary_reason", F.when(F.col("result") == "AllDataRejected", F.col("primary_reason")))


def dataset_summary(metrics: DataFrame) -> DataFrame:
    """Per dataset: packets, mean depth, packets by state, and the formation that its mean d-exponent points to."""
    states = metrics.groupBy("well_id", "state").agg(F.count("*").alias("n")).groupBy("well_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("states"))  # eight states at most
    drilled = F.avg(F.when(F.col("d_exponent") > 0, F.col("d_exponent")))
    return metrics.groupBy("well_id").agg(F.count("*").alias("n"), F.avg("bit_depth").alias("avg_depth"), lithology(drilled).alias("formation")).join(states, "well_id")
