"""The read side of stores: latest, history, ranges, cursors, nearest depths, searches and updates as table functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mudline.operators.stores import newest_per_group

#: Outcomes that an update may set (fixed values).
OUTCOMES = ("Pending", "Resolved", "Escalated", "FalsePositive", "Confirmed", "Unclear")
UPLOADED = ("Elevated", "High", "Critical")


def latest(reports: DataFrame, by: list[str], at: str, tie: str) -> DataFrame:
    """The newest report of each group."""
    rest = [c for c in reports.columns if c not in by]
    return reports.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def history(reports: DataFrame, by: list[str], at: str, tie: str, limit: int) -> DataFrame:
    """The newest ``limit`` reports of each group, with ``place`` from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc(at), F.desc(tie))
    return reports.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def between(rows: DataFrame, at: str, began: int, ended: int) -> DataFrame:
    return rows.filter(F.col(at).between(began, ended))


def newest(rows: DataFrame, at: str, tie: str, limit: int) -> DataFrame:
    """A reverse scan: the newest ``limit`` rows."""
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(limit)


def at_key(rows: DataFrame, key: str, value: object) -> DataFrame:
    return rows.filter(F.col(key) == F.lit(value))


def since(rows: DataFrame, cursor_col: str, cursor: int, tie: str, limit: int) -> DataFrame:
    """The next ``limit`` rows after a cursor, in order of change."""
    return rows.filter(F.col(cursor_col) > cursor).orderBy(cursor_col, tie).limit(limit)


def near_depth(reports: DataFrame, by: list[str], depth: Column, tie: str, tolerance: float = 500.0, limit: int = 5) -> DataFrame:
    """Reports whose depth range comes within ``tolerance`` of a depth, the nearest midpoints first, ``limit`` a group."""
    near = reports.filter((depth >= F.col("depth_from") - tolerance) & (depth <= F.col("depth_to") + tolerance))
    away = F.abs((F.col("depth_from") + F.col("depth_to")) / 2 - depth)
    order = Window.partitionBy(*by).orderBy("away", tie)
    return near.withColumn("away", away).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def best_at_depth(reports: DataFrame, by: list[str], depth: Column, tie: str, tolerance: float = 500.0, limit: int = 5) -> DataFrame:
    """Of the nearest reports the first that succeeded."""
    good = near_depth(reports, by, depth, tie, tolerance, limit).filter("success")
    rest = [c for c in good.columns if c not in by]
    return good.groupBy(*by).agg(F.min_by(F.struct(*rest), "place").alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def statistics(rows: DataFrame, at: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(at).alias("oldest"), F.max(at).alias("newest"), F.count_if("success").alias("succeeded"))


def by_formation(events: DataFrame, low: float, high: float, limit: int, at: str, tie: str) -> DataFrame:
    """Per formation the newest events between two depths that were no false positives."""
    return newest_per_group(events.filter(F.col("depth").between(low, high) & (F.col("outcome") != "FalsePositive")), ["formation"], [F.desc(at), F.desc(tie)], limit)


def uploads(advisories: DataFrame) -> DataFrame:
    return advisories.filter(F.col("risk").isin(*UPLOADED))


def accepted(messages: DataFrame, peers: DataFrame, version: int) -> DataFrame:
    """Messages of known peers that speak the same version of the protocol."""
    return messages.filter(F.col("version") == version).join(peers, "sender", "left_semi")


def intelligence(rows: DataFrame, kind: str | None = None, formation: str | None = None) -> DataFrame:
    """Rows of a kind and formation; a filter that is not given lets all pass."""
    wanted = [F.col(c) == v for c, v in (("kind", kind), ("formation", formation)) if v is not None]
    return reduce(DataFrame.filter, wanted, rows)


def update_outcomes(events: DataFrame, updates: DataFrame, key: str, now: int) -> DataFrame:
    """``events`` with the outcome of ``updates`` (key, new_outcome) and the time of change; outcomes off the list change nothing."""
    sound = updates.filter(F.col("new_outcome").isin(*OUTCOMES)).groupBy(key).agg(F.max("new_outcome").alias("new_outcome"))
    joined = events.join(sound, key, "left")
    return joined.withColumns({"outcome": F.coalesce("new_outcome", "outcome"), "last_modified": F.when(F.col("new_outcome").isNotNull(), F.lit(now)).otherwise(F.col("last_modified"))}).drop("new_outcome")


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` and those of ``rows`` whose key it lacks, the smallest row of a key."""
    rest = [c for c in table.columns if c != key]
    one = rows.select(*table.columns).groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]) if rest else rows.select(key).distinct()
    return table.unionByName(one.join(table.select(key), key, "left_anti").select(*table.columns))


def newest_episodes(episodes: DataFrame, at: str, tie: str, cap: int = 10_000) -> DataFrame:
    """The newest ``cap`` episodes: the cap is the feature."""
    return newest(episodes, at, tie, cap)


def episode(events: DataFrame) -> DataFrame:
    """Events as episodes: own id, a depth range of one point, and what resolved them."""
    summary = F.when(F.col("outcome") == "Resolved", F.col("note")).when(F.col("outcome") == "Escalated", F.concat(F.lit("Escalated: "), F.col("note"))).when(F.col("outcome") == "FalsePositive", "False positive — no action needed").otherwise("Pending resolution")
    return events.select(F.concat(F.col("id").cast("string"), F.lit("-episode")).alias("id"), "rig", "category", F.col("depth").alias("depth_from"), F.col("depth").alias("depth_to"), "risk", "severity", "outcome", "timestamp", summary.alias("resolution"))


def keyword_search(docs: DataFrame, terms: list[str], keywords_col: str, content_col: str, id_col: str, limit: int) -> DataFrame:
    """The best documents for some terms: 2 for each keyword that holds a term or lies in it, 1 for a term in the content; first ids on ties."""
    content = F.lower(F.coalesce(F.col(content_col), F.lit("")))
    words = F.coalesce(F.col(keywords_col), F.array().cast("array<string>"))

    def score(term: str) -> Column:
        # a lambda with a second parameter would get the place in the array there
        return 2 * F.size(F.filter(words, lambda k: k.contains(term) | F.lit(term).contains(k))) + content.contains(term).cast("int")

    each = [score(t.lower()) for t in terms]
    scored = docs.select(id_col, reduce(lambda a, b: a + b, each).cast("long").alias("score")).filter("score > 0")
    return scored.orderBy(F.desc("score"), id_col).limit(limit)


def best_recipe(recipes: DataFrame) -> DataFrame:
    """Per formation how many recipes, the largest reduction, and the one of least variation (the first on ties)."""
    reduction = F.try_divide(F.col("baseline_cv") - F.col("achieved_cv"), F.col("baseline_cv"))
    best = F.min_by(F.struct("recipe", "wob_change_pct", "rpm_change_pct", "achieved_cv"), F.struct("achieved_cv", "recipe")).alias("best")
    return recipes.groupBy("formation").agg(F.count("*").alias("recipes"), F.max(reduction).alias("max_reduction"), best)


def blended(own_pct: Column, recipe_pct: Column, share: float = 0.7) -> Column:
    """A recommendation refined by a formation's recipe, where it has one."""
    return F.coalesce(recipe_pct * share + own_pct * (1 - share), own_pct)


def siblings(wells: DataFrame, field: str, well: str, of: str) -> DataFrame:
    """The other wells of the field of well ``of``."""
    one = wells.select(field, well).distinct()
    return one.join(one.filter(F.col(well) == of).select(field), field, "left_semi").filter(F.col(well) != of)
