"""The read side over reports, events and recipes made from orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mudline.functions import reports, texts
from mudline.operators import knowledge, reading
from mudline.plans.physics_queries import r
from mudline.plans.report_queries import SNAP_SQL, snapshots
from mudline.registry import query

#: Reports: one an order, of 50 wells in five fields, each over a hundred feet of depth; both engines read them alike.
REPORT_COLUMNS = [
    ("id", "o_orderkey"), ("field", "o_orderpriority"), ("well", "o_custkey % 50"), ("kind", "o_orderkey % 3"), ("formation", "o_orderkey % 20"), ("category", "CASE o_orderkey % 5 WHEN 0 THEN 'WellControl' WHEN 1 THEN 'Hydraulics' WHEN 2 THEN 'Mechanical' WHEN 3 THEN 'DrillingEfficiency' ELSE 'Formation' END"),
    ("success", "o_orderstatus <> 'P'"), ("depth_from", "CAST(o_totalprice / 25 AS DOUBLE)"), ("depth_to", "CAST(o_totalprice / 25 + 100 AS DOUBLE)"), ("risk", "CASE o_custkey % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Elevated' WHEN 2 THEN 'High' ELSE 'Critical' END"),
    ("outcome", "CASE o_orderkey % 4 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Resolved' WHEN 2 THEN 'Escalated' ELSE 'FalsePositive' END"), ("score", "CAST(o_custkey % 97 AS DOUBLE) / 97"),
]
RP = "WITH rp AS (SELECT CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts, " + ", ".join(f"{e} AS {c}" for c, e in REPORT_COLUMNS) + " FROM orders) "


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS ts", *[f"{e} AS {c}" for c, e in REPORT_COLUMNS])


WELL = ["field", "well"]


@query(RP + "SELECT field, well, id, success FROM (SELECT *, row_number() OVER (PARTITION BY field, well ORDER BY ts DESC, id DESC) AS k FROM rp) a WHERE k = 1")
def latest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.latest(report_rows(spark, sf_dir), WELL, "ts", "id").select(*WELL, "id", "success")


@query(RP + "SELECT field, well, id, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY field, well ORDER BY ts DESC, id DESC) AS k FROM rp) a WHERE k <= 5")
def well_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.history(report_rows(spark, sf_dir), WELL, "ts", "id", 5).select(*WELL, "id", "place")


ND = "nd AS (SELECT *, abs((depth_from + depth_to) / 2 - 4000) AS away, row_number() OVER (PARTITION BY field, well ORDER BY abs((depth_from + depth_to) / 2 - 4000), id) AS k FROM rp WHERE 4000 >= depth_from - 500 AND 4000 <= depth_to + 500)"


@query(RP + f", {ND} SELECT field, well, id, round(away, 4) AS away FROM nd WHERE k <= 5")
def reports_near_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.near_depth(report_rows(spark, sf_dir), WELL, F.lit(4000.0), "id").select(*WELL, "id", r(F.col("away"), "away", 4))


@query(RP + f", {ND} SELECT field, well, arg_min(id, k) AS id FROM nd WHERE k <= 5 AND success GROUP BY 1, 2")
def best_at_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.best_at_depth(report_rows(spark, sf_dir), WELL, F.lit(4000.0), "id").select(*WELL, "id")


@query(RP + "SELECT field, count(*) AS n, min(ts) AS oldest, max(ts) AS newest, count(*) FILTER (WHERE success) AS succeeded FROM rp WHERE ts BETWEEN 788918400 AND 852076800 GROUP BY 1")
def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and ages of a range scan (1995 and 1996)."""
    return reading.statistics(reading.between(report_rows(spark, sf_dir), "ts", 788918400, 852076800), "ts", ["field"])


@query(RP + "SELECT id FROM (SELECT id, ts FROM rp ORDER BY ts DESC, id DESC LIMIT 30) a UNION ALL SELECT id FROM rp WHERE id = 7")
def newest_and_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reverse scan of 30 reports, and a point lookup."""
    rows = report_rows(spark, sf_dir)
    return reading.newest(rows, "ts", "id", 30).select("id").unionByName(reading.at_key(rows, "id", 7).select("id"))


@query(RP + "SELECT id, ts FROM rp WHERE ts > 820454400 ORDER BY ts, id LIMIT 100")
def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.since(report_rows(spark, sf_dir), "ts", 820454400, "id", 100).select("id", "ts")


@query(RP + "SELECT id, concat('MD5-', md5(concat_ws(':', CAST(ts AS VARCHAR), CAST(CAST(round(score * 100) AS INTEGER) AS VARCHAR), category || ' ' || outcome, CAST(CAST(round(depth_from) AS BIGINT) AS VARCHAR)))) AS signature FROM rp WHERE risk = 'Critical' ORDER BY ts DESC, id DESC LIMIT 25")
def critical_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reading.newest(report_rows(spark, sf_dir).filter("risk = 'Critical'"), "ts", "id", 25)
    return rows.select("id", reports.signature(F.col("ts"), F.round(F.col("score") * 100).cast("int"), F.concat_ws(" ", "category", "outcome"), F.round("depth_from").cast("long")).alias("signature"))


@query(RP + "SELECT id, risk FROM rp WHERE risk IN ('Elevated', 'High', 'Critical')")
def uploaded_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.uploads(report_rows(spark, sf_dir)).select("id", "risk")


@query(RP + "SELECT id, CASE WHEN id % 10 = 3 THEN 'Resolved' ELSE outcome END AS outcome, CASE WHEN id % 10 = 3 THEN 2000000000 ELSE ts % 2 END AS last_modified FROM rp")
def outcome_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of each tenth event; those to an outcome off the list change nothing."""
    e = report_rows(spark, sf_dir).withColumn("last_modified", F.col("ts") % 2)
    updates = e.filter("id % 10 IN (3, 4)").select("id", F.when(F.col("id") % 10 == 3, "Resolved").otherwise("Nonsense").alias("new_outcome"))
    return reading.update_outcomes(e, updates, "id", 2_000_000_000).select("id", "outcome", "last_modified")


@query("SELECT o_orderkey AS message, o_custkey AS sender FROM orders WHERE o_orderkey % 3 = 1 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def accepted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    messages = read("orders").select(F.col("o_orderkey").alias("message"), F.col("o_custkey").alias("sender"), (F.col("o_orderkey") % 3).alias("version"))
    peers = read("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("sender"))
    return reading.accepted(messages, peers, 1).select("message", "sender")


@query(RP + "SELECT formation, id FROM (SELECT *, row_number() OVER (PARTITION BY formation ORDER BY ts DESC, id DESC) AS k FROM rp WHERE depth_from BETWEEN 2000 AND 8000 AND outcome <> 'FalsePositive') a WHERE k <= 10")
def events_by_formation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report_rows(spark, sf_dir).withColumnRenamed("depth_from", "depth")
    return reading.by_formation(rows, 2000, 8000, 10, "ts", "id").select("formation", "id")


@query(RP + "SELECT id, kind, formation FROM rp WHERE kind = 1 AND formation = 7")
def intelligence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.intelligence(report_rows(spark, sf_dir), 1, 7).select("id", "kind", "formation")


@query("SELECT c_custkey AS k FROM customer UNION ALL SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
def episodes_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that a table lacks are added once."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    table, rows = read("customer").select(F.col("c_custkey").alias("k")), read("orders").select(F.col("o_orderkey").alias("k"))
    return reading.insert_new(table, rows.unionByName(rows.filter("k % 50 = 0")), "k")


@query(RP + "SELECT CAST(id AS VARCHAR) || '-episode' AS id, round(depth_from, 3) AS depth_from, risk, CASE outcome WHEN 'Resolved' THEN 'cleaned' WHEN 'Escalated' THEN 'Escalated: cleaned' WHEN 'FalsePositive' THEN 'False positive — no action needed' ELSE 'Pending resolution' END AS resolution FROM rp")
def episodes_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = report_rows(spark, sf_dir).selectExpr("id", "well AS rig", "category", "depth_from AS depth", "risk", "risk AS severity", "outcome", "ts AS timestamp", "'cleaned' AS note")
    return reading.episode(e).select("id", r(F.col("depth_from"), "depth_from", 3), "risk", "resolution")


@query(RP + "SELECT id, ts FROM rp ORDER BY ts DESC, id DESC LIMIT 10000")
def episode_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 10,000 episodes stay."""
    return reading.newest_episodes(report_rows(spark, sf_dir).select("ts", "id"), "ts", "id").select("id", "ts")


@query("""WITH d AS (SELECT p_partkey, string_split(lower(p_type), ' ') AS ks, lower(p_name) AS c FROM part), t AS (SELECT unnest(['promo', 'red', 'economy bolt']) AS term)
  SELECT p_partkey, CAST(sum(2 * len(list_filter(ks, lambda k: contains(k, term) OR contains(term, k))) + contains(c, term)::INT) AS BIGINT) AS score FROM d JOIN t ON true GROUP BY 1 HAVING sum(2 * len(list_filter(ks, lambda k: contains(k, term) OR contains(term, k))) + contains(c, term)::INT) > 0 ORDER BY score DESC, p_partkey LIMIT 20""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best parts for three terms, by their kinds as keywords and their names as content."""
    d = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("ks", F.split(F.lower("p_type"), " "))
    return reading.keyword_search(d, ["promo", "red", "economy bolt"], "ks", "p_name", "p_partkey", 20)


@query("""SELECT category, count(*) AS n FROM (SELECT CASE WHEN q LIKE '%well control%' OR q LIKE '%kick%' OR q LIKE '%loss%' THEN 'WellControl' WHEN q LIKE '%MSE%' OR q LIKE '%efficiency%' OR q LIKE '%ROP%' THEN 'DrillingEfficiency' WHEN q LIKE '%pressure%' OR q LIKE '%ECD%' OR q LIKE '%hydraulic%' THEN 'Hydraulics'
  WHEN q LIKE '%torque%' OR q LIKE '%pack-off%' OR q LIKE '%stick-slip%' THEN 'Mechanical' WHEN q LIKE '%d-exponent%' OR q LIKE '%formation%' OR q LIKE '%pore%' THEN 'Formation' ELSE 'None' END AS category FROM (
    SELECT list_element(['a kick?', 'why is ROP low', 'standpipe pressure', 'stick-slip now', 'pore fluid', 'hello', 'loss and torque'], CAST(o_orderkey % 7 + 1 AS INTEGER)) AS q FROM orders) a) b GROUP BY 1""")
def question_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = F.array(*[F.lit(x) for x in ("a kick?", "why is ROP low", "standpipe pressure", "stick-slip now", "pore fluid", "hello", "loss and torque")])
    q = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.get(questions, (F.col("o_orderkey") % 7).cast("int")).alias("q"))
    return q.groupBy(texts.query_category(F.col("q")).alias("category")).agg(F.count("*").alias("n"))


RC = "WITH rc AS (SELECT l_orderkey * 10 + l_linenumber AS recipe, l_partkey % 40 AS formation, -l_discount * 100 AS wob_change_pct, l_tax * 100 AS rpm_change_pct, 0.3 AS baseline_cv, round(0.05 + l_quantity / 400, 6) AS achieved_cv FROM lineitem) "


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey * 10 + l_linenumber AS recipe", "l_partkey % 40 AS formation", "-l_discount * 100 AS wob_change_pct", "l_tax * 100 AS rpm_change_pct", "0.3D AS baseline_cv", "round(0.05D + l_quantity / 400, 6) AS achieved_cv")


@query(RC + "SELECT formation, count(*) AS recipes, round(max((baseline_cv - achieved_cv) / baseline_cv), 6) AS max_reduction, arg_min(recipe, achieved_cv * 1e12 + recipe) AS recipe, round(arg_min(wob_change_pct, achieved_cv * 1e12 + recipe) * 0.7 - 12.5 * 0.3, 6) AS wob_pct FROM rc GROUP BY 1")
def damping_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes of each formation, the best one, and a reduction of 12.5 % refined by it."""
    b = reading.best_recipe(recipes(spark, sf_dir))
    return b.select("formation", "recipes", r(F.col("max_reduction"), "max_reduction"), "best.recipe", r(reading.blended(F.lit(-12.5), F.col("best.wob_change_pct")), "wob_pct"))


@query(f"WITH {SNAP_SQL}, w AS (SELECT DISTINCT field, well FROM sn) SELECT well FROM w WHERE field IN (SELECT field FROM w WHERE well = 'W3') AND well <> 'W3'")
def sibling_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.siblings(snapshots(spark, sf_dir), "field", "well", "W3").select("well")


@query(f"WITH {SNAP_SQL}" + ", e AS (SELECT DISTINCT formation AS source, formation || '/next' AS target FROM sn) SELECT e.source, count(*) AS n FROM e JOIN sn ON sn.formation = e.source GROUP BY 1")
def formation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node, edge, node: formations, what lies below them, and the snapshots that they label."""
    s = snapshots(spark, sf_dir)
    nodes = s.select(F.col("formation").alias("id"), F.col("well").alias("label")).unionByName(s.select("formation").distinct().selectExpr("formation || '/next' AS id", "'below' AS label"))
    edges = s.select("formation").distinct().selectExpr("formation AS source", "formation || '/next' AS target", "'above' AS kind")
    return knowledge.neighbours(edges, nodes, "above").groupBy("source").agg(F.count("*").alias("n"))
