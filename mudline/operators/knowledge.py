"""Knowledge over wells: plans from geology and offset wells, post-well performance, debriefs, fleet views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mudline.functions import digits
from mudline.functions.tickets import default_parameters
from mudline.sources.plans import safe_name

#: Weight of a snapshot by its confidence (fixed values).
CONFIDENCE = {"High": 1.0, "Medium": 0.7, "Low": 0.4, "Insufficient": 0.1}


def post_well(snapshots: DataFrame) -> DataFrame:
    """Performance per field, well and formation from snapshots (rop, mse, wob, rpm, depth, confidence, samples)."""
    worth = F.coalesce(*[F.when(F.col("confidence") == k, F.lit(v)) for k, v in CONFIDENCE.items()], F.lit(0.1))
    best = F.max_by(F.struct("wob", "rpm"), F.struct("rop", "depth")).alias("best")
    return snapshots.groupBy("field", "well", "formation").agg(
        F.avg("rop").alias("avg_rop"), F.max("rop").alias("best_rop"), F.avg("mse").alias("avg_mse"), best, F.min("depth").alias("depth_from"), F.max("depth").alias("depth_to"), F.avg(worth).alias("avg_confidence"), F.sum("samples").alias("samples"), F.count("*").alias("snapshots")
    )


def offset_performance(formations: DataFrame, performance: DataFrame) -> DataFrame:
    """Per formation of a plan: weighted means over other wells whose formation name begins alike, and the best parameters.

    Names are joined on their first three cleaned characters and then compared
    whole, so no pair of unlike names is built.
    """
    a = formations.select("formation").distinct().withColumn("stem", safe_name(F.col("formation"))).withColumn("key", F.substring("stem", 1, 3))
    b = performance.withColumnRenamed("formation", "theirs").withColumn("name", safe_name(F.col("theirs"))).withColumn("key", F.substring("name", 1, 3))
    met = a.join(b, "key").filter(F.col("name").startswith(F.col("stem")))
    n = F.sum("snapshots")
    return met.groupBy("formation").agg(
        F.array_sort(F.collect_set("well")).alias("wells"), F.try_divide(F.sum(F.col("avg_rop") * F.col("snapshots")), n).alias("avg_rop"), F.max("best_rop").alias("best_rop"), F.try_divide(F.sum(F.col("avg_mse") * F.col("snapshots")), n).alias("avg_mse"), F.max_by("best", F.struct("best_rop", "well")).alias("best")
    )


def assemble(geology: DataFrame, plan: DataFrame, offsets: DataFrame) -> DataFrame:
    """Geology with the plan's overrides and parameters, defaults by hardness where it has none, and offset results."""
    p = plan.select("formation", *[F.col(c).alias(f"plan_{c}") for c in ("top", "base", "parameters")])
    o = offsets.select("formation", *[F.col(c).alias(f"offset_{c}") for c in ("wells", "avg_rop", "best_rop", "best")])
    return geology.join(p, "formation", "left").join(o, "formation", "left").select(
        "formation", F.coalesce("plan_top", "top").alias("top"), F.coalesce("plan_base", "base").alias("base"), "hardness", F.coalesce("plan_parameters", default_parameters(F.col("hardness"))).alias("parameters"), F.coalesce("offset_wells", F.array().cast("array<string>")).alias("wells"), F.coalesce("offset_avg_rop", F.lit(0.0)).alias("offset_rop"), "offset_best"
    )


def debrief(tickets: DataFrame, ratings: DataFrame) -> DataFrame:
    """Ratings per well: advisories, rated, confirmed, false positives and the confirmation rate."""
    joined = tickets.join(ratings, "ticket", "left").groupBy("well")
    n = lambda o: F.count_if(F.col("outcome") == o)
    out = joined.agg(F.count("*").alias("advisories"), n("Confirmed").alias("confirmed"), n("FalsePositive").alias("false_positives"), n("Unclear").alias("unclear"))
    return out.withColumn("rate", F.try_divide(F.col("confirmed").cast("double"), (F.col("confirmed") + F.col("false_positives")).cast("double")))


def fleet_status(seen: DataFrame, now: int, fresh_seconds: int = 300) -> DataFrame:
    """Rigs online (seen within ``fresh_seconds``) and in all, and the newest sighting."""
    last = seen.groupBy("rig").agg(F.max("at").alias("at"))
    return last.agg(F.count_if(F.col("at") >= now - fresh_seconds).alias("online"), F.count("*").alias("total"), F.max("at").alias("newest"))


def neighbours(edges: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """Node - edge - node triples of one edge kind."""
    a = nodes.select(F.col("id").alias("source"), F.col("label").alias("source_label"))
    b = nodes.select(F.col("id").alias("target"), F.col("label").alias("target_label"))
    return edges.filter(F.col("kind") == kind).join(a, "source").join(b, "target")


def snapshots_by_rank(snapshots: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` snapshots of each well, ties to the larger id."""
    order = Window.partitionBy("field", "well").orderBy(F.desc("ts"), F.desc("id"))
    return snapshots.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)


#: Sentences of a debrief (fixed values).
NARRATIVE = {
    "summary": "Well %s reached %.0f ft TD in %.1f bit hours across %d formation(s). A total of %d advisories were generated during the well.",
    "formation": "- **%s** (%.0f-%.0f ft): Actual avg ROP %.1f ft/hr vs %s. Delta: %s. Assessment: **%s**. %d advisory(ies), %d critical.",
    "critical": "- **Critical advisories**: %d event(s)",
    "at": "  - At %.0f ft (%s): %s",
    "mechanical": "- **Mechanical events**: %d event(s) (stick-slip, vibration, torque)",
    "rated": "- %d of %d advisories received operator feedback (%.0f%% coverage).",
    "rate": "- Overall confirmation rate: **%.0f%%** (%d confirmed, %d false positive, %d unclear).",
    "suggest": "- **Suggestion**: Low confirmation rate indicates thresholds may need tightening. Review the threshold suggestions for specific recommendations.",
    "worked": "- %s exceeded planned ROP by %.0f%% (actual %.1f vs planned %.1f ft/hr). Best params: WOB %.1f klbs, RPM %.0f.",
    "fell": "- %s fell %.0f%% below planned ROP (actual %.1f vs planned %.1f ft/hr).",
    "blamed": " (%d mechanical event(s) may have contributed)",
}
#: Critical events that a debrief names (a fixed value).
NAMED_EVENTS = 5


def narrative(wells: DataFrame, compared: DataFrame, timeline: DataFrame, ratings: DataFrame) -> DataFrame:
    """``well_id`` and ``narrative``: summary, formations, highlights, feedback and lessons, each part where there is something to say.

    Wells: depth and hours; ``compared``: formations with actual and planned rates
    and counts; ``timeline``: advisories; ``ratings``: outcomes by seq.  Lines are made
    where the rows are; only a well's formations and its first critical events meet.
    """
    f = lambda name, *args: digits.printf(NARRATIVE[name], *args)
    c = F.col
    lines = lambda column, order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column.alias("_t")))), lambda x: x["_t"]), "\n")
    near = F.lit(1.234e-6)  # keeps halves from being rounded in two ways
    delta = F.try_divide(c("rop") - c("planned"), c("planned")) * 100
    kind = F.when(c("planned").isNull(), "NO PLAN DATA").when(delta > 10, "EXCEEDED PLAN").when(delta < -10, "BELOW PLAN").otherwise("MET PLAN")
    plan = F.when(c("planned").isNull(), "N/A (no plan data)").otherwise(digits.printf("%.1f ft/hr (planned)", c("planned")))
    change = F.when(delta.isNull(), "N/A").when(delta > 0, digits.printf("+%.1f%%", delta)).otherwise(digits.printf("%.1f%%", delta))
    told = f("formation", c("formation"), c("top"), c("base"), c("rop"), plan, change, kind, c("advisories"), c("critical"))
    rose = F.when(kind == "EXCEEDED PLAN", f("worked", c("formation"), delta, c("rop"), c("planned"), c("wob"), c("rpm")))
    fell = F.when(kind == "BELOW PLAN", F.concat(f("fell", c("formation"), F.abs(delta), c("rop"), c("planned")), F.when(c("mechanical") > 0, f("blamed", c("mechanical"))).otherwise("")))
    some = lambda column: F.when(F.count(column) > 0, F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("top", column.alias("_t")))), lambda x: x["_t"].isNotNull()), lambda x: x["_t"]), "\n"))
    formations = compared.groupBy("well_id").agg(lines(told, "top").alias("performance"), some(rose).alias("rose"), some(fell).alias("fell"), F.count("*").alias("formations"))
    order = Window.partitionBy("well_id").orderBy("ts", "seq")
    grave = timeline.filter("severity = 'CRITICAL'").withColumn("_n", F.row_number().over(order)).filter(c("_n") <= NAMED_EVENTS)
    events = grave.groupBy("well_id").agg(lines(f("at", c("depth"), F.coalesce("formation", F.lit("unknown formation")), c("recommendation")), "_n").alias("grave"))
    counts = timeline.join(ratings, ["well_id", "seq"], "left").groupBy("well_id").agg(
        F.count("*").alias("n"), F.count_if(c("severity") == "CRITICAL").alias("critical"), F.count_if(c("category") == "Mechanical").alias("mechanical"), F.count("outcome").alias("rated"),
        *[F.count_if(c("outcome") == o).alias(a) for o, a in (("Confirmed", "ok"), ("FalsePositive", "bad"), ("Unclear", "unclear"))],
    )
    x = wells.join(formations, "well_id", "left").join(counts, "well_id", "left").join(events, "well_id", "left")
    part = lambda title, text: F.concat(F.lit(f"## {title}\n\n"), text)
    highlights = F.concat_ws("\n", F.when(c("critical") > 0, F.concat(f("critical", c("critical")), F.lit("\n"), c("grave"))), F.when(c("mechanical") > 0, f("mechanical", c("mechanical"))))
    low = (c("ok") < 0.5 * (c("ok") + c("bad"))) & (c("rated") >= 10)
    feedback = F.concat_ws("\n", f("rated", c("rated"), c("n"), c("rated") * 100.0 / c("n") + near), f("rate", c("ok") * 100.0 / F.greatest(c("ok") + c("bad"), F.lit(1)) + near, c("ok"), c("bad"), c("unclear")), F.when(low, NARRATIVE["suggest"]))
    lessons = F.concat_ws("\n", F.concat(F.lit("**What worked:**\n"), c("rose")), F.concat(F.lit("\n**Areas for improvement:**\n"), c("fell")))
    text = F.concat_ws(
        "\n\n", part("Summary", f("summary", c("well_id").cast("string"), c("depth"), c("hours"), F.coalesce("formations", F.lit(0)), F.coalesce("n", F.lit(0)))), part("Formation Performance", c("performance")),
        F.when((c("critical") > 0) | (c("mechanical") > 0), part("Advisory Timeline Highlights", highlights)), F.when(c("rated") > 0, part("Feedback Summary", feedback)), F.when(c("rose").isNotNull() | c("fell").isNotNull(), part("Lessons Learned", lessons)),
    )
    return x.select("well_id", text.alias("narrative"))
