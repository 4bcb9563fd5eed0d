"""Exact medians of groups of any size, by counting.

``F.median`` keeps all values of a group in one buffer.  Groups of up to ``few``
rows are left to it.  For a larger one the two middle ranks are narrowed: values
are counted in ``BINS`` bins between the least and the largest, the bin that
holds the rank becomes the new range, and so on, until a range is one value or
holds ``few`` values at most, which are then ranked.  Counting combines in the
tasks, so a round sends no more than the bins of its large groups, and no task
ever holds a group.  Bins come from subtraction, division and floor, which keep
order however they round, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mudline.shared import checkpointed

BINS = 4096
FEW = 100_000


def medians(rows: DataFrame, by: list[str], columns: list[str], few: int = FEW) -> DataFrame:
    """``by`` and the median of each of ``columns`` (null where it has no value); the middle of the two middle values."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    large = checkpointed(sizes.filter(F.col("_n") > few).select(*by))
    plain = lambda df: df.groupBy(*by).agg(*[F.median(c).alias(c) for c in columns])
    if not large.limit(1).count():
        return plain(rows)
    # no more than one in ``few`` rows is a large group, and all of these fit a task that holds ``few`` rows
    return plain(rows.join(F.broadcast(large), by, "left_anti")).unionByName(selected(rows.join(F.broadcast(large), by, "left_semi"), by, columns, few))


def selected(rows: DataFrame, by: list[str], columns: list[str], few: int = FEW) -> DataFrame:
    """``medians`` of large groups."""
    stacked = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    groups = rows.select(*by).distinct()
    values = rows.select(*by, F.expr(f"stack({len(columns)}, {stacked}) AS (_column, _v)")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    unit = [*by, "_column"]
    extremes = values.groupBy(*unit).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("_which"), F.floor((F.col("_n") - 1) / 2).alias("_rank")), F.struct(F.lit(1).alias("_which"), F.floor(F.col("_n") / 2).alias("_rank"))))
    state = checkpointed(extremes.withColumn("_both", both).select(*unit, "_n", "_lo", "_hi", "_both.*"))
    goal = [*unit, "_which"]
    wide = lambda s: s.filter((F.col("_hi") > F.col("_lo")) & (F.col("_n") > few))
    while wide(state).limit(1).count():
        within = values.join(F.broadcast(wide(state)), unit).filter("_v BETWEEN _lo AND _hi")
        # the difference of extremes may be too large for a double: halves are not; the largest value has the last bin, so every round narrows
        share = F.coalesce(F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2), F.lit(0.0))
        place = F.when(F.col("_v") == F.col("_hi"), BINS - 1).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        counted = within.withColumn("_bin", place).groupBy(*goal, "_rank", "_bin").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*goal).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counted.withColumn("_rank", F.col("_rank") - before).filter("_rank >= 0 AND _rank < _n").drop("_bin")
        state = checkpointed(state.join(wide(state).select(*goal), goal, "left_anti").unionByName(found))
    settled = state.filter("_lo = _hi").select(*goal, F.col("_lo").alias("_v"))
    last = values.join(F.broadcast(state.filter("_lo < _hi")), unit).filter("_v BETWEEN _lo AND _hi")
    ranked = last.withColumn("_place", F.row_number().over(Window.partitionBy(*goal).orderBy("_v")) - 1).filter("_place = _rank").select(*goal, "_v")
    ends = lambda c: [F.max(F.when((F.col("_column") == c) & (F.col("_which") == k), F.col("_v"))) for k in (0, 1)]
    halves = lambda low, high: F.when(low == high, low).otherwise(low / 2 + high / 2)
    middle = settled.unionByName(ranked).groupBy(*by).agg(*[halves(*ends(c)).alias(c) for c in columns])
    return groups.join(middle, by, "left").select(*by, *columns)
