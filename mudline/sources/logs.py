"""Field logs: two CSV dialects found from their header, and XML logs.

Headers are read on the driver (one line); rows are mapped by Column
expressions, converted to oilfield units and, where all channels are zero, left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mudline.shared import checkpointed
from mudline.sources.packets import complete, epoch, number

#: Header tokens that mark the metric dialect (fixed values).
METRIC_TOKENS = ("KKGF", "KPA", "KN.M", "G/CM3", "L/MIN")
#: Factors to feet, klbs, kft lb, psi, gpm, ppg and barrels (fixed values).
FEET, KLBS_PER_KKGF, KFTLB_PER_KNM, PSI_PER_KPA, GPM_PER_LMIN, PPG_PER_GCM3, BBL_PER_M3 = 3.28084, 2.20462, 0.737562, 0.145038, 0.264172, 8.345404, 6.28981
KLBS_PER_N, KFTLB_PER_NM, PSI_PER_PA, GPM_PER_M3S, PPG_PER_KGM3 = 0.000224809, 0.000737562, 0.000145038, 15850.32, 0.008345404
#: Metric dialect: channel, column prefix, factor (fixed values).
METRIC = [
    ("bit_depth", "bit depth (md)", FEET), ("hole_depth", "hole depth (md)", FEET), ("wob", "weight on bit", KLBS_PER_KKGF), ("torque", "average surface torque", KFTLB_PER_KNM), ("rpm", "average rotary speed", 1.0), ("rop", "rate of penetration", FEET),
    ("hook_load", "total hookload", KLBS_PER_KKGF), ("spp", "stand pipe pressure", PSI_PER_KPA), ("flow_in", "mud flow in", GPM_PER_LMIN), ("flow_out", "mud flow out", GPM_PER_LMIN), ("mud_weight_in", "mud density in", PPG_PER_GCM3), ("mud_weight_out", "mud density out", PPG_PER_GCM3), ("pit_volume", "tank volume (active)", BBL_PER_M3),
]
#: SI dialect: channel, mnemonics, factor (fixed values).
SI = [
    ("bit_depth", ("DEPTH", "DMEA", "DBTM"), FEET), ("wob", ("WOB", "SWOB"), KLBS_PER_N), ("torque", ("TORQUE", "TRQ"), KFTLB_PER_NM), ("rpm", ("RPM", "RPMA"), 60.0), ("rop", ("ROP", "ROPA"), FEET * 3600), ("spp", ("SPP", "SPPA"), PSI_PER_PA), ("flow_in", ("FLOWIN", "MFIA"), GPM_PER_M3S),
    ("mud_weight_in", ("MWIN", "MDIA"), PPG_PER_KGM3), ("ecd", ("ECD",), PPG_PER_KGM3), ("gas_units", ("TOTGAS", "GASA"), 1.0), ("dxc", ("DXC",), 1.0), ("hook_load", ("HOOKLOAD", "HKLA"), KLBS_PER_N),
]
TIMES = ("datetime parsed", "datetime", "time", "timestamp", "date time")


def dialect(header: list[str]) -> str:
    joined = " ".join(header).upper()
    return "metric" if any(t in joined for t in METRIC_TOKENS) else "si"


def mapping(header: list[str]) -> dict[str, tuple[str, float]]:
    """Channel to (column, factor); the first column that fits wins."""
    lower = {h: h.strip().lower() for h in header}
    found: dict[str, tuple[str, float]] = {}
    for t in TIMES:
        for h, low in lower.items():
            if low == t:
                found.setdefault("timestamp", (h, 1.0))
    if dialect(header) == "metric":
        for channel, prefix, factor in METRIC:
            for h, low in lower.items():
                if low.startswith(prefix):
                    found.setdefault(channel, (h, factor))
    else:
        for channel, names, factor in SI:
            for n in names:
                for h in header:
                    if h.strip().upper().split("(")[0].strip() == n:
                        found.setdefault(channel, (h, factor))
    if "timestamp" not in found and "bit_depth" not in found:
        raise ValueError("a log needs a time or a depth column")
    return found


def mode_state(text: Column, rpm: Column, wob: Column, rop: Column) -> Column:
    """Rig state from a mode text or activity code, else from the channels."""
    t, code = F.lower(F.trim(text)), F.trim(text).try_cast("double")
    bands = [(1, 3, "Drilling"), (4, 5, "Reaming"), (6, 8, "Circulating"), (9, 10, "TrippingIn"), (11, 13, "TrippingOut"), (14, 16, "Connection")]
    out = F.when(t.contains("drill"), "Drilling").when(t.contains("ream"), "Reaming").when(t.contains("circ"), "Circulating").when(t.contains("trip") & t.contains("out"), "TrippingOut").when(t.contains("trip"), "TrippingIn").when(t.contains("conn"), "Connection")
    for low, high, state in bands:
        out = out.when(code.between(low, high), state)
    return out.when((rpm > 20) & (wob > 2) & (rop > 0), "Drilling").when(rpm > 20, "Circulating").otherwise("Idle")


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by their header line: one short row a file reaches the driver."""
    lines = spark.read.option("ignoreCorruptFiles", True).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    first = lines.filter("block = 0").withColumn("at", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "at").alias("header"))
    out: dict[str, list[str]] = {}
    for r in first.collect():
        out.setdefault(r.header, []).append(r.file)
    return out


#: Channels of which one at least differs from 0 in a row that says something.
MEASURED = ("wob", "rpm", "torque", "rop", "spp", "flow_in", "bit_depth")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Packets from CSV logs of either dialect (a file, a folder or a pattern); ``file`` names the source.  Rows without time or with nothing but zeros are left out; ``read_counts`` tells how many."""
    return all_rows(spark, path).filter("skipped IS NULL").drop("skipped")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Per file: rows, those kept, and those left out for want of a time or of any value."""
    n = lambda why: F.count_if(F.col("skipped") == why)
    return all_rows(spark, path).groupBy("file").agg(F.count("*").alias("rows"), F.count_if(F.col("skipped").isNull()).alias("kept"), n("no time").alias("no_time"), n("all zero").alias("all_zero"))


def all_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of logs with ``skipped``: why a row is left out, NULL where it is not.

    Each header is mapped on its own, so a folder may mix dialects; files whose
    header has neither time nor depth are left out, and an error where all are.
    """
    parts, wrong = [], None
    for _, files in sorted(headers(spark, path).items()):
        try:
            parts.append(_read_alike(spark, files))
        except ValueError as e:
            wrong = e
    if not parts:
        raise wrong or ValueError("no log")
    return reduce(DataFrame.unionByName, parts)


def _read_alike(spark: SparkSession, files: list[str]) -> DataFrame:
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("ignoreCorruptFiles", True).csv(files)
    found = mapping(raw.columns)
    channels = [F.col(f"`{c}`") for c, _ in found.values()]
    at = dict(zip(found, channels, strict=True))
    select = [epoch(at["timestamp"]).alias("timestamp") if "timestamp" in at else F.lit(0).cast("long").alias("timestamp")]
    select += [(number(at[c]) * found[c][1]).alias(c) for c in found if c != "timestamp"]
    mode = next((h for h in raw.columns if h.strip().lower() in ("rig mode", "rigactivitycode", "activity code")), None)
    rows = raw.select(F.input_file_name().alias("file"), *select, (F.col(f"`{mode}`") if mode else F.lit(None).cast("string")).alias("mode"))
    out = complete(rows).withColumn("skipped", F.when(F.col("timestamp").isNull(), "no time").when(sum(F.abs(F.col(c)) for c in MEASURED) == 0, "all zero"))
    return out.withColumn("rig_state", mode_state(F.coalesce("mode", F.lit("")), F.col("rpm"), F.col("wob"), F.col("rop"))).drop("mode")


def summary(rows: DataFrame) -> DataFrame:
    """Per file: packets, drilling packets, depth and time range."""
    return rows.groupBy("file").agg(F.count("*").alias("packets"), F.count_if((F.col("rpm") > 5) & (F.col("wob") > 1)).alias("drilling"), F.min("bit_depth").alias("depth_from"), F.max("bit_depth").alias("depth_to"), F.min("timestamp").alias("began"), F.max("timestamp").alias("ended"))


#: Splits up to which their table is sent to every task.
FEW_SPLITS = 100_000


def read_xml_log(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``row``, ``mnemonic``, ``value`` of XML logs with a mnemonic list and data rows.

    The text reader ends its records at ``</data>``, so a file of any size is read in
    byte ranges, each of which finds its next record by itself.  What the ranges of a
    file must share comes as one small row a range: how many records it has, which
    numbers the rows, and the mnemonic list, which stands before the first of them.
    What follows the last ``</data>`` is no row.
    """
    text = spark.read.option("lineSep", "</data>").text(path)
    records = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    listed = F.regexp_extract("value", r"(?s)<mnemonicList>(.*?)</mnemonicList>", 1)
    has_list = F.col("value").contains("</mnemonicList>")
    splits = records.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.min_by(F.when(has_list, listed), F.when(has_list, F.col("id"))).alias("list"))
    of_file = Window.partitionBy("file").orderBy("block")
    upto = of_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = checkpointed(splits.select(
        "file", "block", "first", F.coalesce(F.sum("n").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(upto).alias("all"),
        F.split(F.coalesce(F.first("list", ignorenulls=True).over(upto), F.lit("")), ",").alias("names"),
    ))
    few = numbered.limit(FEW_SPLITS + 1).count() <= FEW_SPLITS
    placed = records.join(F.broadcast(numbered) if few else numbered, ["file", "block"]).withColumn("place", F.col("id") - F.col("first") + F.col("before"))
    data = F.regexp_extract("value", r"(?s)^.*?<data>(.*)$", 1)
    rows = placed.filter((F.col("place") < F.col("all") - 1) & F.col("value").contains("<data>")).select("file", "place", "names", data.alias("data"))
    pairs = rows.select("file", "place", F.explode(F.arrays_zip(F.col("names").alias("mnemonic"), F.split("data", ",").alias("value"))).alias("x"))
    return pairs.select("file", F.col("place").cast("int").alias("row"), F.trim("x.mnemonic").alias("mnemonic"), "x.value").filter("mnemonic <> ''")


def wide(xml: DataFrame, mnemonics: list[str]) -> DataFrame:
    """XML rows as columns, the first value of each mnemonic."""
    return xml.groupBy("file", "row").pivot("mnemonic", mnemonics).agg(F.first("value"))


