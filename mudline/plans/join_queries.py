"""Formations, feedback, plans and nearest lookups: the joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mudline.functions.frames import ordered
from mudline.operators import joins
from mudline.operators.metrics import drilling_metrics
from mudline.plans.physics_queries import MET, TEL, r
from mudline.registry import query
from mudline.telemetry import telemetry

#: Formations: every part is a layer of 30 to 34 feet, 40 feet apart, from 1,000 ft on; layers are disjoint.
FORMATION_SQL = """, fm AS (SELECT p_partkey AS fid, 'F' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS formation, CAST(p_size % 10 AS DOUBLE) AS hard, CAST(1000 + 40 * p_partkey + p_size % 5 AS DOUBLE) AS top, CAST(1030 + 40 * p_partkey + 2 * (p_size % 5) AS DOUBLE) AS base FROM part)"""


def minutes_to(top: Column, depth: Column, rop: Column) -> Column:
    """Minutes until a depth is reached at the present rate; NULL without one."""
    return F.try_divide(top - depth, rop) * 60


def formations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.selectExpr(
        "p_partkey AS fid", "'F' || lpad(CAST(p_partkey AS STRING), 9, '0') AS formation", "CAST(p_size % 10 AS DOUBLE) AS hard",
        "CAST(1000 + 40 * p_partkey + p_size % 5 AS DOUBLE) AS top", "CAST(1030 + 40 * p_partkey + 2 * (p_size % 5) AS DOUBLE) AS base",
    )


@query(TEL + FORMATION_SQL + "SELECT seq, formation, round(top, 3) AS top, round(base, 3) AS base FROM tel LEFT JOIN fm ON bit_depth >= top AND bit_depth < base")
def formation_at_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).select("seq", "bit_depth")
    f = joins.first_interval(t, formations(spark, sf_dir).select("formation", "top", "base"), "bit_depth", "top", "base")
    return f.select("seq", "formation", r(F.col("top"), "top", 3), r(F.col("base"), "base", 3))


def with_neighbours(spark: SparkSession, sf_dir: str, points: DataFrame, at: str = "bit_depth") -> DataFrame:
    return joins.neighbours_on_axis(points, formations(spark, sf_dir).select("formation", "top"), at, "top", "formation")


@query(TEL + FORMATION_SQL + """SELECT seq, formation AS next_formation, round(top - bit_depth, 4) AS feet, round((top - bit_depth) / rop * 60, 4) AS minutes FROM tel t ASOF JOIN fm f ON t.bit_depth < f.top WHERE (top - bit_depth) / rop * 60 <= 30""")
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next formation within half an hour at the present rate: an as-of join forward."""
    t = telemetry(spark, sf_dir).select("seq", "bit_depth", "rop")
    a = with_neighbours(spark, sf_dir, t).withColumn("minutes", minutes_to(F.col("next_mark"), F.col("bit_depth"), F.col("rop"))).filter("minutes <= 30")
    return a.select("seq", F.col("next_name").alias("next_formation"), r(F.col("next_mark") - F.col("bit_depth"), "feet", 4), r(F.col("minutes"), "minutes", 4))


@query(TEL + FORMATION_SQL + "SELECT seq, formation AS last_top FROM tel t ASOF LEFT JOIN fm f ON t.bit_depth >= f.top")
def last_formation_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).select("seq", "bit_depth")
    return with_neighbours(spark, sf_dir, t).select("seq", F.col("last_name").alias("last_top"))


@query(TEL + FORMATION_SQL + """SELECT seq, CASE WHEN n.top IS NULL OR t.bit_depth - l.top <= n.top - t.bit_depth THEN l.formation ELSE n.formation END AS boundary, round(least(coalesce(t.bit_depth - l.top, 1e18), coalesce(n.top - t.bit_depth, 1e18)), 4) AS feet
  FROM tel t ASOF LEFT JOIN fm l ON t.bit_depth >= l.top ASOF LEFT JOIN fm n ON t.bit_depth < n.top""")
def nearest_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary nearest to each packet, the upper one on ties."""
    t = with_neighbours(spark, sf_dir, telemetry(spark, sf_dir).select("seq", "bit_depth"))
    up, down = F.col("bit_depth") - F.col("last_mark"), F.col("next_mark") - F.col("bit_depth")
    nearer = F.when(down.isNull() | (up <= down), F.col("last_name")).otherwise(F.col("next_name"))
    return t.select("seq", nearer.alias("boundary"), r(F.least(up, down), "feet", 4))


@query(TEL + FORMATION_SQL + "SELECT well_id, formation, CAST(k - 1 AS INTEGER) AS place FROM (SELECT w.well_id, f.formation, row_number() OVER (PARTITION BY w.well_id ORDER BY f.top) AS k FROM (SELECT well_id, min(bit_depth) + 700 AS d FROM tel GROUP BY 1) w JOIN fm f ON f.top > w.d) a WHERE k BETWEEN 2 AND 4")
def upcoming_formations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three formations after the next one: an as-of join, then three steps from top to top."""
    at = telemetry(spark, sf_dir).groupBy("well_id").agg((F.min("bit_depth") + 700).alias("d"))
    met = with_neighbours(spark, sf_dir, at, "d").filter("next_mark IS NOT NULL").select("well_id", F.col("next_mark").alias("top"))
    _, spans = joins.spans_on_axis(formations(spark, sf_dir).select("formation", "top"), "top", "formation")
    for k in range(1, 4):
        onward = spans.select(F.col("last_mark").alias("top"), F.col("next_mark").alias("_next"), F.col("next_name").alias(f"formation{k}"))
        met = met.join(onward.hint("merge"), "top", "left").drop("top").withColumnRenamed("_next", "top")
    steps = F.array(*[F.struct(F.col(f"formation{k}").alias("formation"), F.lit(k).alias("place")) for k in range(1, 4)])
    return met.select("well_id", F.explode(steps).alias("s")).select("well_id", "s.*").filter("formation IS NOT NULL")


@query(TEL + FORMATION_SQL + """, fd AS (SELECT t.seq, t.well_id, t.ts, f.formation FROM tel t LEFT JOIN fm f ON bit_depth >= top AND bit_depth < base)
  SELECT seq, well_id, formation FROM (SELECT *, lag(formation) OVER (PARTITION BY well_id ORDER BY ts, seq) AS was FROM fd) a WHERE formation IS NOT NULL AND was IS DISTINCT FROM formation""")
def formation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).select("seq", "well_id", "ts", "bit_depth")
    f = joins.first_interval(t, formations(spark, sf_dir).select("formation", "top", "base"), "bit_depth", "top", "base")
    return f.withColumn("was", F.lag("formation").over(ordered())).filter("formation IS NOT NULL AND NOT (was <=> formation)").select("seq", "well_id", "formation")


@query(MET + FORMATION_SQL + """SELECT formation, round(top, 3) AS top, CAST(count(m.seq) AS BIGINT) AS packets, CAST(coalesce(sum((category <> 'None')::INT), 0) AS BIGINT) AS tickets, CAST(coalesce(sum((category = 'WellControl')::INT), 0) AS BIGINT) AS well_control, round(avg(rop), 8) AS rop, round(max(mse), 3) AS top_mse
  FROM fm f LEFT JOIN met m ON m.bit_depth >= f.top AND m.bit_depth < f.base GROUP BY 1, 2""")
def formation_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formations with what happened in them: a range join, aggregated before it meets the plan."""
    m = drilling_metrics(telemetry(spark, sf_dir)).select("seq", "bit_depth", "category", "rop", "mse")
    f = formations(spark, sf_dir)
    hit = joins.range_join(m, f.select("fid", "top", "base"), "bit_depth", "top", "base", how="inner")
    agg = hit.groupBy("fid").agg(F.count("*").alias("packets"), F.sum((F.col("category") != "None").cast("int")).alias("tickets"), F.sum((F.col("category") == "WellControl").cast("int")).alias("well_control"), F.avg("rop").alias("rop"), F.max("mse").alias("top_mse"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return f.join(agg, "fid", "left").select("formation", r(F.col("top"), "top", 3), zero("packets"), zero("tickets"), zero("well_control"), r(F.col("rop"), "rop", 8), r(F.col("top_mse"), "top_mse", 3))


FEEDBACK_SQL = """fb AS (SELECT o_orderkey % 3000 AS advisory, o_orderkey, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS rated_at, CASE o_orderkey % 5 WHEN 0 THEN 'WellControl' WHEN 1 THEN 'Hydraulics' WHEN 2 THEN 'Mechanical' WHEN 3 THEN 'DrillingEfficiency' ELSE 'Formation' END AS category,
  CASE WHEN o_orderstatus = 'F' OR o_orderkey % 5 = 2 THEN 'Confirmed' WHEN o_orderstatus = 'O' OR o_orderkey % 5 = 0 THEN 'FalsePositive' ELSE 'Unclear' END AS outcome, o_totalprice AS price FROM orders)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of advisories, from orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    names = ["WellControl", "Hydraulics", "Mechanical", "DrillingEfficiency", "Formation"]
    k = F.col("o_orderkey") % 5
    outcome = F.when((F.col("o_orderstatus") == "F") | (k == 2), "Confirmed").when((F.col("o_orderstatus") == "O") | (k == 0), "FalsePositive").otherwise("Unclear")
    return o.select((F.col("o_orderkey") % 3000).alias("advisory"), "o_orderkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("rated_at"), F.element_at(F.array(*[F.lit(n) for n in names]), (k + 1).cast("int")).alias("category"), outcome.alias("outcome"), F.col("o_totalprice").alias("price"))


@query(f"WITH {FEEDBACK_SQL}" + """, fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY advisory ORDER BY rated_at, o_orderkey) AS k FROM fb) a WHERE k = 1)
  SELECT e.event_id AS seq, f.outcome, f.category FROM events e LEFT JOIN fi f ON e.event_id = f.advisory""")
def advisory_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisories with their first rating."""
    first = feedback(spark, sf_dir).groupBy("advisory").agg(F.min_by(F.struct("outcome", "category"), F.struct("rated_at", "o_orderkey")).alias("f"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"))
    return e.join(first.withColumnRenamed("advisory", "seq"), "seq", "left").select("seq", "f.outcome", "f.category")


@query(TEL + FORMATION_SQL + """, wb AS (SELECT well_id, avg(torque) AS m, stddev_samp(torque) AS s, count(*) AS n FROM tel GROUP BY 1), th AS (SELECT t.*, f.hard FROM tel t JOIN fm f ON bit_depth >= top AND bit_depth < base),
  fo AS (SELECT well_id, hard, avg(torque) AS m, stddev_samp(torque) AS s FROM th GROUP BY 1, 2 HAVING count(*) >= 50)
  SELECT a.well_id, a.hard, round(coalesce(o.m, w.m), 3) AS mean, round(coalesce(o.s, w.s), 3) AS std, o.m IS NOT NULL AS own FROM (SELECT DISTINCT well_id, hard FROM th) a JOIN wb w ON w.well_id = a.well_id LEFT JOIN fo o ON o.well_id = a.well_id AND o.hard = a.hard""")
def baseline_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline of a well in each kind of formation that it meets where it has enough rows, else the well's."""
    t = telemetry(spark, sf_dir).select("well_id", "torque", "bit_depth")
    stats = [F.avg("torque").alias("mean"), F.stddev_samp("torque").alias("std"), F.count("*").alias("n")]
    met = joins.range_join(t, formations(spark, sf_dir).select("hard", "top", "base"), "bit_depth", "top", "base", how="inner").groupBy("well_id", "hard").agg(*stats)
    out = joins.fallback(met.select("well_id", "hard"), met.filter("n >= 50"), t.groupBy("well_id").agg(*stats), ["well_id", "hard"], ["well_id"], ["mean", "std", "n"])
    own = met.filter("n >= 50").select("well_id", "hard", F.lit(True).alias("own"))
    return out.join(own, ["well_id", "hard"], "left").select("well_id", "hard", r(F.col("mean"), "mean", 3), r(F.col("std"), "std", 3), F.coalesce("own", F.lit(False)).alias("own"))


@query("""WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT vec_id AS cid, v AS c FROM p WHERE vec_id < 4)
  SELECT vec_id, CAST(cid AS INTEGER) AS regime, round(d, 6) AS distance FROM (SELECT vec_id, cid, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, cid) AS k FROM (SELECT vec_id, cid, list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM p JOIN c ON true) b) a WHERE k = 1""")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest of four centroids (the first four vectors) over all its dimensions."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    centroids = [x.v for x in e.filter("vec_id < 4").orderBy("vec_id").collect()]  # four rows
    return joins.nearest_centroid(e, "v", centroids).select("vec_id", F.col("centroid").alias("regime"), r(F.col("distance"), "distance"))


@query("""SELECT s.s_suppkey AS rig, n.n_name AS field, count(l.l_orderkey) AS events FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey AND l.l_returnflag = 'R' GROUP BY 1, 2""")
def rig_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rigs, fields and their returned items: counts combine before the join."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    n = read("lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("rig")).agg(F.count("*").alias("events"))
    s = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("rig"), F.col("n_name").alias("field"))
    return s.join(n, "rig", "left").select("rig", "field", F.coalesce("events", F.lit(0)).alias("events"))


@query("SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def peers_with_urgent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership: a left-semi join."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    u = read("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return read("customer").join(u, "c_custkey", "left_semi").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def episodes_without_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal by id list: a left-anti join."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return read("customer").select("c_custkey").join(read("orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(TEL + FORMATION_SQL + """, ho AS (SELECT well_id, ts - ts % 3600 AS hour, t.mse0, f.formation FROM (SELECT *, 480 * torque * 1000 * rpm / (72.25 * rop) AS mse0 FROM tel WHERE rpm > 5 AND wob > 1) t LEFT JOIN fm f ON bit_depth >= top AND bit_depth < base)
  SELECT well_id, hour, coalesce(formation, 'none') AS formation, count(*) AS n, round(avg(mse0), 3) AS avg_mse, round(min(mse0), 3) AS min_mse, round(max(mse0), 3) AS max_mse FROM ho GROUP BY 1, 2, 3""")
def hourly_well_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: packets to rotary energy, by well, hour and formation.

    Formations are a small dimension, so their join is broadcast and the only
    shuffle is that of the aggregate, after partial aggregation.
    """
    t = telemetry(spark, sf_dir).filter("rpm > 5 AND wob > 1").withColumn("mse0", 480 * F.col("torque") * 1000 * F.col("rpm") / (72.25 * F.col("rop")))
    h = joins.range_join(t, formations(spark, sf_dir).select("formation", "top", "base"), "bit_depth", "top", "base")
    g = h.groupBy("well_id", (F.col("ts") - F.col("ts") % 3600).alias("hour"), F.coalesce("formation", F.lit("none")).alias("formation"))
    return g.agg(F.count("*").alias("n"), r(F.avg("mse0"), "avg_mse", 3), r(F.min("mse0"), "min_mse", 3), r(F.max("mse0"), "max_mse", 3))


