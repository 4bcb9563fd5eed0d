"""Range, as-of and nearest joins as equi-joins plus residual predicates; no private API, no cross join but with one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SMALL_ROWS = 10_000
CELL = 100.0


def small(rows: DataFrame) -> DataFrame:
    """``rows``, to be broadcast where they are few (checked); larger ones go to shuffle joins, whatever Spark makes of the size of their files."""
    return F.broadcast(rows) if rows.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else rows.hint("merge")


def in_cells(intervals: DataFrame, top: str, base: str, cell: float = CELL) -> DataFrame:
    """Intervals [top, base) laid out over cells of the axis, one row per cell that they meet."""
    whole = intervals.filter(F.col(top) < F.col(base))
    return whole.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(top) / cell), F.ceil(F.col(base) / cell) - 1)))


def range_join(points: DataFrame, intervals: DataFrame, at: str, top: str, base: str, cell: float = CELL, how: str = "left") -> DataFrame:
    """Points with all the intervals [top, base) that hold them, left or inner.

    An equi-join by cell of the axis, so work follows the overlaps; few cells are
    broadcast.
    """
    cells = small(in_cells(intervals, top, base, cell).withColumnRenamed("_cell", "_their_cell"))
    placed = points.withColumn("_cell", F.floor(F.col(at) / cell))
    inside = (F.col("_cell") == F.col("_their_cell")) & (F.col(at) >= F.col(top)) & (F.col(at) < F.col(base))
    return placed.join(cells, inside, how).drop("_cell", "_their_cell")


def first_interval(points: DataFrame, intervals: DataFrame, at: str, top: str, base: str, cell: float = CELL) -> DataFrame:
    """Each point with the first interval, by top, that holds it (NULLs where none does).

    Intervals are made disjoint in each cell first (the smaller top wins, then the
    smaller base), so a point meets one at most and no aggregate follows.
    """
    order = Window.partitionBy("_their_cell").orderBy(top, base)
    clipped = in_cells(intervals, top, base, cell).withColumnRenamed("_cell", "_their_cell").withColumns({
        "_from": F.greatest(F.col(top), F.col("_their_cell") * cell), "_to": F.least(F.col(base), (F.col("_their_cell") + 1) * cell),
    })
    taken = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cells = small(clipped.withColumn("_from", F.greatest(F.col("_from"), F.coalesce(taken, F.col("_from")))).filter("_from < _to"))
    placed = points.withColumn("_cell", F.floor(F.col(at) / cell))
    inside = (F.col("_cell") == F.col("_their_cell")) & (F.col(at) >= F.col("_from")) & (F.col(at) < F.col("_to"))
    return placed.join(cells, inside, "left").select(*points.columns, *intervals.columns)


def spans_on_axis(marks: DataFrame, mark: str, name: str, cell: float = CELL) -> tuple[DataFrame, DataFrame]:
    """Marks of distinct places (``m``, ``n``), and each with the next one: ``last_mark``, ``last_name``, ``next_mark``, ``next_name``.

    Only cells, as many as the axis is long, are ever sorted in one task.
    """
    one = marks.groupBy(F.col(mark).alias("m")).agg(F.min(name).alias("n")).filter("m IS NOT NULL").withColumn("c", F.floor(F.col("m") / cell))
    first = one.groupBy("c").agg(F.min(F.struct("m", "n")).alias("first"))
    following = first.select("c", F.lead("first").over(Window.partitionBy(F.lit(0)).orderBy("c")).alias("beyond"))
    inside = F.lead(F.struct("m", "n")).over(Window.partitionBy("c").orderBy("m"))
    spans = one.withColumn("inside", inside).join(following.hint("merge"), "c").select("m", "n", F.coalesce("inside", "beyond").alias("after"))
    closed = spans.filter("after IS NOT NULL").select(F.col("m").alias("last_mark"), F.col("n").alias("last_name"), F.col("after.m").alias("next_mark"), F.col("after.n").alias("next_name"))
    return one, closed


def neighbours_on_axis(points: DataFrame, marks: DataFrame, at: str, mark: str, name: str, cell: float = CELL) -> DataFrame:
    """Each point with the last mark at or before it and the next one after it: ``last_mark``, ``last_name``, ``next_mark``, ``next_name``.

    Marks of equal place keep the smallest name.  Neighbouring marks make spans,
    which are joined by cell.
    """
    one, closed = spans_on_axis(marks, mark, name, cell)
    ends = one.agg(F.min(F.struct("m", "n")).alias("lowest"), F.max(F.struct("m", "n")).alias("highest"))
    met = range_join(points, closed, at, "last_mark", "next_mark", cell).join(F.broadcast(ends), how="cross")
    below, above = F.col(at) < F.col("lowest.m"), F.col(at) >= F.col("highest.m")
    return met.withColumns({
        "last_mark": F.coalesce("last_mark", F.when(above, F.col("highest.m"))), "last_name": F.coalesce("last_name", F.when(above, F.col("highest.n"))),
        "next_mark": F.coalesce("next_mark", F.when(below, F.col("lowest.m"))), "next_name": F.coalesce("next_name", F.when(below, F.col("lowest.n"))),
    }).drop("lowest", "highest")


def asof(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, carry: list[str], forward: bool = False, ties: str | None = None) -> DataFrame:
    """Each left row with ``carry`` of the nearest right row at or before it (``forward``: at or after), within ``by``.

    Of right rows at one place that with the largest ``ties`` counts (``forward``:
    the smallest); without ``ties`` any of them.

    Both sides are laid on one axis and the last right row is carried along: one
    shuffle and one sort, whatever the number of matches.
    """
    sign = -1 if forward else 1
    a = left.select("*", (F.col(left_at) * sign).alias("_at"), F.lit(1).alias("_side"), F.lit(None).alias("_carry"), F.lit(None).alias("_tie"))
    b = right.select(*[F.col(c) for c in by], (F.col(right_at) * sign).alias("_at"), F.lit(0).alias("_side"), F.struct(*carry).alias("_carry"), (F.col(ties) * sign if ties else F.lit(None)).alias("_tie"))
    kind = b.schema["_carry"].dataType
    both = a.withColumn("_carry", F.col("_carry").cast(kind)).unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_carry", ignorenulls=True).over(order)).filter("_side = 1")
    return found.select(*left.columns, *[F.col(f"_found.{c}").alias(c if c not in left.columns else f"right_{c}") for c in carry])


def nearest_centroid(points: DataFrame, vector: str, centroids: list[list[float]]) -> DataFrame:
    """``centroid`` (its place, the first on ties) and ``distance`` (squared) of each point; a literal of a few centroids, no join."""
    gap = lambda c: F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.array(*[F.struct(gap(c).alias("distance"), F.lit(i).alias("centroid")) for i, c in enumerate(centroids)]))
    return points.withColumn("_best", best).withColumns({"centroid": F.col("_best.centroid"), "distance": F.col("_best.distance")}).drop("_best")


def fallback(rows: DataFrame, special: DataFrame, general: DataFrame, special_keys: list[str], general_keys: list[str], values: list[str]) -> DataFrame:
    """Values from ``special`` where its keys match, else from ``general``."""
    a = special.select(*special_keys, *[F.col(v).alias(f"_s_{v}") for v in values])
    b = general.select(*general_keys, *[F.col(v).alias(f"_g_{v}") for v in values])
    return rows.join(a, special_keys, "left").join(b, general_keys, "left").select(*rows.columns, *[F.coalesce(f"_s_{v}", f"_g_{v}").alias(v) for v in values])
