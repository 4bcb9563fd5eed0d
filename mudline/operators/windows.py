"""Bounded and running windows per well: variation, trends, segments, lags, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from mudline.functions import digits
from mudline.functions.frames import last_rows, ordered
from mudline.functions.physics import ratio


def variation(x: Column, frame: WindowSpec, at_least: int) -> Column:
    """Population standard deviation over mean; 0 before the frame is full or without a positive mean."""
    return variation_of(F.count(x).over(frame), F.avg(x).over(frame), F.stddev_pop(x).over(frame), at_least)


def variation_of(n: Column, mean: Column, deviation: Column, at_least: int) -> Column:
    """``variation`` by its parts."""
    return F.when((n >= at_least) & (mean > 0), ratio(deviation, mean)).otherwise(0.0)


def trend(y: Column, index: Column, frame: WindowSpec) -> Column:
    """Least-squares slope against the row index; 0 for fewer than two rows."""
    return F.coalesce(F.regr_slope(y, index).over(frame), F.lit(0.0))


def r_squared(y: Column, index: Column, frame: WindowSpec) -> Column:
    """Share of variance that the line explains; 0 for fewer than three rows or flat values."""
    return r_squared_of(F.count(y).over(frame), F.var_pop(index).over(frame), F.var_pop(y).over(frame), F.covar_pop(index, y).over(frame))


def r_squared_of(n: Column, vx: Column, vy: Column, cxy: Column) -> Column:
    """``r_squared`` by its parts."""
    return F.when((n >= 3) & (n * vy >= 1e-10), F.least(F.greatest(ratio(F.pow(cxy, 2), vx * vy), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def with_index(rows: DataFrame) -> DataFrame:
    return rows.withColumn("idx", F.row_number().over(ordered()).cast("double"))


def stick_slip(cv: Column, warning: float = 0.15, critical: float = 0.25) -> tuple[Column, Column]:
    sound = cv <= 10.0
    return sound & (cv > warning), F.when(sound & (cv > critical), 1.0).when(sound & (cv > warning), (cv - warning) / (critical - warning)).otherwise(0.0)


def quantiles(rows: DataFrame, wanted: dict[str, tuple[str, float]], frame: WindowSpec) -> DataFrame:
    """``rows`` with a column for each (column, share) of ``wanted``: the interpolated quantile over the frame, NULL for none.

    A column's values are sorted once for all its shares; between two of them
    ``low * (1 - part) + high * part`` is rounded as DuckDB's fused product is, so
    that values equal to a quantile fall to the same side of it.
    """
    held = {c: f"_held_{c}" for c, _ in wanted.values()}
    rows = rows.withColumns({h: F.collect_list(c).over(frame) for c, h in held.items()}).withColumns({h: F.sort_array(h) for h in held.values()})
    places = {name: (F.size(held[c]) - 1) * F.lit(p) for name, (c, p) in wanted.items()}
    rows = rows.withColumns({f"_{part}_{name}": F.get(held[wanted[name][0]], end(place).cast("int")) for name, place in places.items() for part, end in (("low", F.floor), ("high", F.ceil))} | {f"_part_{name}": place - F.floor(place) for name, place in places.items()})

    def between(name: str) -> Column:
        low, high, part = (F.col(f"_{x}_{name}") for x in ("low", "high", "part"))
        return F.when(part == 0, low).otherwise(digits.fused(low, 1 - part, high * part))

    return rows.withColumns({name: between(name) for name in wanted}).drop(*held.values(), *(f"_{x}_{name}" for x in ("low", "high", "part") for name in wanted))


def founder_flags(rows: DataFrame, window: int = 10) -> DataFrame:
    """``founder``: weight trends up over 2 % of its mean while the rate of penetration trends under 1 %."""
    frame = last_rows(window)
    i, out = F.col("idx"), with_index(rows)
    mean_wob, mean_rop = F.avg("wob").over(frame), F.avg("rop").over(frame)
    w, p = ratio(trend(F.col("wob"), i, frame), mean_wob), ratio(trend(F.col("rop"), i, frame), mean_rop)
    fires = (F.count("*").over(frame) >= window) & (mean_wob > 0) & (mean_rop > 0) & (w > 0.02) & (p < 0.01)
    return out.withColumn("founder", F.coalesce(fires, F.lit(False)))


def segments(rows: DataFrame, value: str, half: int = 30, shift: float = 0.15, least: int = 120) -> DataFrame:
    """``segment``: a new one starts ``half`` rows before each row where the mean of the last ``half`` rows moved by ``shift`` against the ``half`` before them."""
    order = ordered()
    i = with_index(rows)
    old, new = (F.avg(value).over(order.rowsBetween(a, b)) for a, b in ((-2 * half, -half - 1), (-half, -1)))
    fires = (F.col("idx") > 2 * half) & (F.count("*").over(Window.partitionBy("well_id")) >= least) & (old > 0.1) & (F.abs(new - old) > shift * old)
    i = i.withColumn("fires", F.coalesce(fires, F.lit(False)))
    starts = F.coalesce(F.lead("fires", half).over(order), F.lit(False))
    return i.withColumn("segment", F.sum(F.when(starts, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fires")


def runs(rows: DataFrame, flag: Column) -> DataFrame:
    """Gaps and islands: maximal runs of rows where ``flag`` holds, with ``run`` numbered per well."""
    marked = rows.withColumn("flag", F.coalesce(flag, F.lit(False)))
    began = marked.withColumn("began", F.col("flag") & ~F.coalesce(F.lag("flag").over(ordered()), F.lit(False)))
    return began.withColumn("run", F.sum(F.col("began").cast("int")).over(ordered().rowsBetween(Window.unboundedPreceding, 0))).filter("flag").drop("flag", "began")


def pearson(x: Column, y: Column, least: int = 30) -> Column:
    """Correlation from centred moments, which large values do not cancel; 0 where a side is constant, NULL for too few rows."""
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when(F.count("*") >= least, F.coalesce(ratio(F.covar_pop(x, y), spread), F.lit(0.0)))


def parameter_changes(rows: DataFrame, seconds: int = 30, wob_step: float = 2.0, rpm_step: float = 10.0) -> DataFrame:
    """``since_change``: seconds since weight or speed last left its mean of the packets of the ``seconds`` before.

    Packets of the same second count as before where they come first, so the mean
    is a difference of running sums: those before this packet less those before
    the first packet in range.
    """
    order = ordered()
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    early = Window.partitionBy("well_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, -seconds - 1)
    mean = lambda c: ratio(F.coalesce(F.sum(c).over(upto), F.lit(0.0)) - F.coalesce(F.sum(c).over(early), F.lit(0.0)), F.col("_n"))
    counted = rows.withColumn("_n", (F.count("*").over(upto) - F.count("*").over(early)).cast("double"))
    moved = (F.abs(F.col("wob") - mean("wob")) > wob_step) | (F.abs(F.col("rpm") - mean("rpm")) > rpm_step)
    marked = counted.withColumn("_moved", F.when((F.row_number().over(order) == 1) | ((F.col("_n") > 0) & moved), F.col("ts")))
    since = F.col("ts") - F.last("_moved", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("since_change", since).drop("_n", "_moved")


def debounced(rows: DataFrame, label: str, packets: int = 3) -> DataFrame:
    """``steady``: a label that changes only after ``packets`` packets on end agree; the first packet counts at once.

    A run of equal labels that lasts long enough changes it, from its packet
    number ``packets`` on, so the last such packet at or before a row decides.
    """
    order = ordered()
    began = rows.withColumn("_began", ~F.coalesce(F.lag(label).over(order).eqNullSafe(F.col(label)), F.lit(False)))
    run = began.withColumn("_run", F.sum(F.col("_began").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = run.withColumn("_place", F.row_number().over(Window.partitionBy("well_id", "_run").orderBy("ts", "seq")))
    sure = F.when((F.col("_place") >= packets) | (F.col("_run") == 1), F.struct(F.col(label).alias("label")))
    steady = F.last(sure, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return place.withColumn("steady", steady["label"]).drop("_began", "_run", "_place")


def leads(rows: DataFrame, parameters: dict[str, str], effect: str, n: int = 60, max_lag: int = 20, least: int = 20, least_r: float = 0.45, top: int = 3) -> DataFrame:
    """Per well the parameters whose earlier values go with the effect: best lag by correlation, ``least_r`` or more, ``top`` at most."""
    newest = Window.partitionBy("well_id").orderBy(F.desc("ts"), F.desc("seq"))
    recent = rows.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= n)
    held = recent.withColumn("held", F.count("*").over(Window.partitionBy("well_id"))).filter(F.col("held") >= least)
    pairs = ", ".join(f"'{name}', {column}" for name, column in parameters.items())
    lags = F.sequence(F.lit(1), F.least(F.lit(max_lag), F.floor(F.col("held") / 3).cast("int")))
    causes = held.select("well_id", "back", "held", F.expr(f"stack({len(parameters)}, {pairs}) AS (parameter, x)")).withColumn("lag", F.explode(lags))
    effects = held.select("well_id", F.col("back").alias("at"), F.col(effect).alias("y"))
    met = causes.withColumn("at", F.col("back") - F.col("lag")).join(effects, ["well_id", "at"])
    scored = met.groupBy("well_id", "parameter", "lag").agg(F.coalesce(pearson(F.col("x"), F.col("y"), 3), F.lit(0.0)).alias("r"))
    strength = F.round(F.abs("r"), 9)
    one = Window.partitionBy("well_id", "parameter").orderBy(strength.desc(), "lag")
    best = scored.withColumn("_k", F.row_number().over(one)).filter((F.col("_k") == 1) & (F.abs("r") >= least_r))
    ranked = Window.partitionBy("well_id").orderBy(strength.desc(), "parameter")
    return best.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= top).drop("_k")
