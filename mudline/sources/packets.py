"""The packet schema, and readers for the fixed CSV layout, JSON lines and record frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANNELS = (
    "bit_depth", "hole_depth", "rop", "hook_load", "wob", "rpm", "torque", "bit_diameter", "spp", "pump_spm", "flow_in", "flow_out", "pit_volume", "pit_volume_change", "mud_weight_in", "mud_weight_out", "ecd", "mud_temp_in", "mud_temp_out",
    "gas_units", "background_gas", "connection_gas", "h2s", "co2", "casing_pressure", "annular_pressure", "pore_pressure", "fracture_gradient", "mse", "d_exponent", "dxc", "rop_delta", "torque_delta_percent", "spp_delta",
)
SCHEMA = T.StructType([T.StructField("timestamp", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in CHANNELS), T.StructField("rig_state", T.StringType()), T.StructField("regime_id", T.ShortType()), T.StructField("seconds_since_param_change", T.LongType())])
#: Columns of the fixed CSV layout, in order; the last five may be missing (fixed values, with their defaults).
CSV_COLUMNS = ("bit_depth", "hole_depth", "rop", "hook_load", "wob", "rpm", "torque", "spp", "pump_spm", "flow_in", "flow_out", "pit_volume", "mud_weight_in", "mud_weight_out", "ecd", "gas_units")
CSV_OPTIONAL = {"mud_temp_in": 100.0, "mud_temp_out": 120.0, "casing_pressure": 0.0, "h2s": 0.0, "co2": 0.0}
#: Record codes of the level-0 feed (fixed values).
CODES = {
    "0108": "bit_depth", "0110": "hole_depth", "0113": "rop", "0114": "hook_load", "0116": "wob", "0117": "rpm", "0118": "torque", "0119": "spp", "0120": "pump_spm", "0121": "flow_in", "0122": "flow_out", "0123": "pit_volume",
    "0124": "mud_weight_in", "0125": "mud_weight_out", "0126": "mud_temp_in", "0127": "mud_temp_out", "0130": "casing_pressure", "0140": "gas_units", "0141": "total_gas", "0142": "h2s", "0143": "co2", "0150": "ecd", "0105": "block_position",
}
#: Date patterns that timestamps may take, in order of trial (fixed values).
DATE_PATTERNS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd-MMM-yyyy HH:mm:ss")


def number(text: Column) -> Column:
    """A double from text; blanks, ``nan``, ``null``, ``-`` and values that aren't finite are 0 (missing)."""
    x = F.when(F.lower(F.trim(text)).isin("", "nan", "null", "-", "none"), None).otherwise(F.trim(text).try_cast("double"))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def epoch(text: Column) -> Column:
    """Seconds since 1970 from whole or decimal epochs (milliseconds too) or one of the date patterns."""
    t = F.trim(text)
    raw = t.try_cast("double")
    parsed = F.coalesce(*[F.unix_timestamp(F.try_to_timestamp(t, F.lit(p))) for p in DATE_PATTERNS])
    return F.coalesce(F.when(raw > 1e10, F.floor(raw / 1000)).otherwise(F.floor(raw)), parsed).cast("long")


def complete(rows: DataFrame) -> DataFrame:
    """Rows with all packet columns: missing channels are 0, the bit 8.5 inches."""
    have = set(rows.columns)
    zero = {c: F.lit(8.5 if c == "bit_diameter" else 0.0) for c in CHANNELS if c not in have}
    out = rows.withColumns(zero).withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in CHANNELS if c in have})
    for c, default in (("rig_state", F.lit(None).cast("string")), ("regime_id", F.lit(0).cast("short")), ("seconds_since_param_change", F.lit(0).cast("long"))):
        if c not in have:
            out = out.withColumn(c, default)
    return out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The fixed layout; rows without a timestamp or with fewer than 17 fields are skipped."""
    names = ["timestamp", *CSV_COLUMNS, *CSV_OPTIONAL]
    raw = spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("header", True).option("enforceSchema", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    rows = raw.filter(F.col(CSV_COLUMNS[-1]).isNotNull()).withColumn("timestamp", epoch(F.col("timestamp"))).filter("timestamp IS NOT NULL")
    rows = rows.withColumns({c: number(F.col(c)) for c in CSV_COLUMNS} | {c: F.when(F.col(c).isNull(), F.lit(d)).otherwise(number(F.col(c))) for c, d in CSV_OPTIONAL.items()})
    return complete(rows)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank and broken lines are dropped, missing channels are 0."""
    return complete(spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path))


def from_json_text(rows: DataFrame, column: str) -> DataFrame:
    return complete(rows.select(F.from_json(column, SCHEMA).alias("p")).filter("p IS NOT NULL").select("p.*"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Record frames: ``&&`` opens, ``!!`` closes, each line a four-digit code and a value.

    The reader itself cuts a file at ``&&``, so one row holds one frame, large files
    are split among tasks, and no window runs over all lines.  ``frame`` numbers
    the frames of a task, in order.
    """
    cut = spark.read.option("lineSep", "&&").text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("frame"), "value")
    frames = cut.filter(F.col("value").contains("!!"))
    body = frames.select("file", "frame", F.split(F.element_at(F.split("value", "!!"), 1), r"\r?\n").alias("lines"))
    items = body.withColumn("items", F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: F.length(x) >= 5))
    last = lambda code: F.try_element_at(F.transform(F.filter("items", lambda x: F.substring(x, 1, 4) == code), lambda x: F.substring(x, 5, 40)), F.lit(-1))
    found = items.filter(F.size("items") > 0).select("file", "frame", *[number(F.coalesce(last(code), F.lit(""))).alias(name) for code, name in CODES.items()])
    return complete(found)


def build_frame(rows: DataFrame) -> DataFrame:
    """``frame`` text per packet, values with two decimals and CRLF line ends."""
    lines = [F.concat(F.lit(code), F.format_string("%.2f", F.col(name))) for code, name in CODES.items() if name in rows.columns]
    return rows.withColumn("frame", F.concat_ws("\r\n", F.lit("&&"), *lines, F.lit("!!")))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Packets from a CSV path: a log of either dialect where the headers allow it, else the fixed layout."""
    from mudline.sources import logs

    try:
        return logs.read_log(spark, path)
    except ValueError:
        return read_csv(spark, path)


def in_depth_range(rows: DataFrame, low: float, high: float) -> DataFrame:
    return rows.filter(F.col("bit_depth").between(low, high))


def circulating_only(rows: DataFrame) -> DataFrame:
    """Rows with over 50 gpm that do not drill."""
    return rows.filter((F.col("flow_in") > 50) & ~((F.col("rpm") > 5) & (F.col("wob") > 1)))


def mud_changes(rows: DataFrame) -> DataFrame:
    """``mud_weight_change`` and ``mud_temp_change``: what comes out less what goes in."""
    return rows.withColumns({"mud_weight_change": F.col("mud_weight_out") - F.col("mud_weight_in"), "mud_temp_change": F.col("mud_temp_out") - F.col("mud_temp_in")})


def drilling_only(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("rpm") > 5) & (F.col("wob") > 1))

