"""A telemetry view over the driver's tables: one arithmetic mapping of ``events`` to drilling channels.

``TELEMETRY_SQL`` is the same mapping for DuckDB.  Channels are doubles, zero
stands for a missing value, and rows are ordered by (well_id, ts, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mudline.functions.frames import ordered
from mudline.operators.scan import Scan

#: Channel and expression over event_id, value and k; both engines read them alike.  Constants are doubles: decimals of mixed precision would be computed as big numbers.
CHANNELS = [
    ("wob", "CASE WHEN k % 10 = 0 THEN 0 WHEN k % 10 = 1 THEN CAST(0.5 AS DOUBLE) ELSE 5 + (value * 3) % 30 END"),
    ("rpm", "CASE WHEN k % 10 IN (0, 2) THEN 0 ELSE 60 + event_id % 90 END"),
    ("rop", "CASE WHEN k % 10 = 3 THEN 1 ELSE 5 + (value * 7) % 80 END"),
    ("torque", "5 + (value * 3) % 20"),
    ("spp", "2000 + (value * 11) % 900"),
    ("flow_in", "CASE WHEN k % 10 = 0 THEN 0 ELSE 400 + event_id % 150 END"),
    ("flow_out", "CASE WHEN k % 10 = 0 THEN 0 ELSE 400 + event_id % 150 + (event_id * 7 % 17) - 6 END"),
    ("pit_volume", "400 + (value * 5) % 50"),
    ("gas_units", "(value * 2) % 120"),
    ("background_gas", "(event_id * 3) % 60"),
    ("h2s", "CASE WHEN k = 37 THEN event_id % 25 ELSE 0 END"),
    ("hook_load", "100 + event_id % 160"),
    ("bit_diameter", "8.5"),
    ("mud_weight_in", "9 + event_id % 4"),
    ("ecd", "CAST(9.5 AS DOUBLE) + event_id % 4"),
    ("fracture_gradient", "CAST(9.55 AS DOUBLE) + event_id % 4 + (k % 10) * CAST(0.1 AS DOUBLE)"),
    ("pore_pressure", "CAST(8.2 AS DOUBLE) + event_id % 4 + (k % 7) * CAST(0.1 AS DOUBLE)"),
]
NAMES = [c for c, _ in CHANNELS]


def telemetry(spark: SparkSession, sf_dir: str, span: int | None = None) -> DataFrame:
    """Packets of wells; ten users make a well, so wells grow with the data.  With ``span`` all packets are one well, in chunks of so many seconds."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "user_id", "value", "unix_seconds(CAST(ts AS TIMESTAMP)) AS ts", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    rows = events.selectExpr("event_id AS seq", "user_id", "ts", "k", *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in CHANNELS])
    rows = rows.withColumn("user_id", F.lit(0).cast("long") if span else F.expr("user_id DIV 10")).withColumnRenamed("user_id", "well_id")
    placed = Scan(span=span).count("place").over(rows) if span else rows.withColumn("place", F.row_number().over(ordered()))
    depth = placed.withColumn("bit_depth", (F.lit(1000.0) + 2.0 * F.col("place")).cast("double")).drop("place")
    return depth.withColumn("hole_depth", F.col("bit_depth") + F.when(F.col("k") % 10 == 4, 10.0).otherwise(0.0))


TELEMETRY_SQL = f"""
ev AS (SELECT event_id, user_id, value, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
raw AS (SELECT event_id AS seq, user_id // 10 AS well_id, ts, k, {", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in CHANNELS)} FROM ev),
dep AS (SELECT *, CAST(1000 + 2 * row_number() OVER (PARTITION BY well_id ORDER BY ts, seq) AS DOUBLE) AS bit_depth FROM raw),
tel AS (SELECT *, bit_depth + CASE WHEN k % 10 = 4 THEN 10 ELSE 0 END AS hole_depth FROM dep)
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packets as shifts: five seconds apart, a quarter of an hour's pause each 97, and torque that is wide, calm and middling in turns of 60."""
    t = telemetry(spark, sf_dir).withColumn("i", F.row_number().over(ordered()))
    spread = F.col("torque") - 5.0
    torque = F.when(F.floor(F.col("i") / 60) % 3 == 0, F.col("torque")).when(F.floor(F.col("i") / 60) % 3 == 1, 15.0 + spread / 20.0).otherwise(10.0 + spread / 2.0)
    return t.withColumns({"ts": (F.lit(1_700_000_000) + 5 * F.col("i") + 900 * F.floor(F.col("i") / 97)).cast("long"), "torque": torque}).drop("i")


RUNS_SQL = TELEMETRY_SQL.replace("tel AS (", "tel0 AS (") + """,
tel AS (SELECT * EXCLUDE (i) REPLACE (CAST(1700000000 + 5 * i + 900 * (i // 97) AS BIGINT) AS ts, CASE (i // 60) % 3 WHEN 0 THEN torque WHEN 1 THEN 15 + (torque - 5) / 20 ELSE 10 + (torque - 5) / 2 END AS torque)
  FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY ts, seq) AS i FROM tel0))
"""
