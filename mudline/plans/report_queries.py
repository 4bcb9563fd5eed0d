"""Batch analysis, feedback, rankings, stores and report texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mudline.config import DEFAULT
from mudline.functions import physics, reports, texts
from mudline.operators import advisories, knowledge, ml, quality, stores
from mudline.operators.metrics import drilling_metrics
from mudline.plans.join_queries import FEEDBACK_SQL, feedback
from mudline.plans.physics_queries import MET, TEL, r
from mudline.plans.window_queries import W10
from mudline.registry import query
from mudline.telemetry import telemetry

DYS_SQL = f""", ix AS (SELECT *, CAST(row_number() OVER (PARTITION BY well_id ORDER BY ts, seq) AS DOUBLE) AS i FROM met),
  cw AS (SELECT *, CASE WHEN count(*) OVER w >= 10 AND avg(torque) OVER w > 0 THEN stddev_pop(torque) OVER w / avg(torque) OVER w ELSE 0 END AS cv,
    coalesce(count(*) OVER w >= 10 AND avg(wob) OVER w > 0 AND avg(rop) OVER w > 0 AND regr_slope(wob, i) OVER w / nullif(avg(wob) OVER w, 0) > 0.02 AND regr_slope(rop, i) OVER w / nullif(avg(rop) OVER w, 0) < 0.01, false) AS fnd FROM ix WINDOW w AS {W10}),
  dy AS (SELECT *, CASE WHEN cv > 0.12 THEN 'TorqueInstability' WHEN torque_delta > 0.1 AND spp_delta > 75 THEN 'PackOff' WHEN greatest(torque_delta, 0) * 0.6 + greatest(least(spp_delta / 200, 1), 0) * 0.4 > 0.15 THEN 'PackOff' WHEN fnd THEN 'Founder'
    WHEN mse_efficiency < 50 THEN 'LowEfficiency' WHEN category = 'Mechanical' AND torque_delta > 0.1 THEN 'PackOff' WHEN category = 'Mechanical' THEN 'StickSlip' WHEN category <> 'None' THEN 'LowEfficiency' END AS dysfunction,
    greatest(1 - CASE WHEN cv > 0.06 THEN 0.3 * least((cv - 0.06) / 0.06, 1) ELSE 0 END - CASE WHEN torque_delta > 0.05 THEN 0.25 * least((torque_delta - 0.05) / 0.05, 1) ELSE 0 END - CASE WHEN mse_efficiency < 70 THEN 0.2 * least((70 - mse_efficiency) / 20, 1) ELSE 0 END - CASE WHEN spp_delta > 37.5 THEN 0.15 * least((spp_delta - 37.5) / 37.5, 1) ELSE 0 END, 0) AS stab FROM cw),
  ok AS (SELECT * FROM dy WHERE wob >= 5 AND rpm >= 40 AND mse BETWEEN 1000 AND 500000 AND rop BETWEEN 1 AND 500 AND state IN ('Drilling', 'Reaming')),
  sp AS (SELECT well_id, min(wob) AS w0, max(wob) AS w1, min(rpm) AS r0, max(rpm) AS r1 FROM ok GROUP BY 1),
  bi AS (SELECT o.*, greatest(least(floor((wob - w0) / ((w1 - w0) / 8)), 7), 0) * 6 + greatest(least(floor((rpm - r0) / ((r1 - r0) / 6)), 5), 0) AS bin FROM ok o JOIN sp s ON o.well_id = s.well_id AND w1 - w0 >= 1 AND r1 - r0 >= 5),
  st AS (SELECT well_id, CAST(bin AS BIGINT) AS bin, count(*) AS n, median(wob) AS wob, median(rpm) AS rpm, median(flow_in) AS flow, median(rop) AS rop, median(mse_efficiency) AS efficiency, avg(stab) AS stability FROM bi GROUP BY 1, 2 HAVING count(*) >= 10),
  sc AS (SELECT *, 0.5 * least(rop / 100, 1) + 0.3 * efficiency / 100 + 0.2 * stability AS score FROM st)"""


def usable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ml.with_dysfunction(drilling_metrics(telemetry(spark, sf_dir)))
    return m.filter(quality.rejection(F.col("wob"), F.col("rpm"), F.col("mse"), F.col("rop"), F.col("state")).isNull())


@query(MET + DYS_SQL + "SELECT well_id, coalesce(dysfunction, 'stable') AS reason, count(*) AS n FROM dy GROUP BY 1, 2")
def dysfunction_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ml.with_dysfunction(drilling_metrics(telemetry(spark, sf_dir)), 0)
    return m.groupBy("well_id", F.coalesce("dysfunction", F.lit("stable")).alias("reason")).agg(F.count("*").alias("n"))


@query(MET + DYS_SQL + "SELECT well_id, bin, n, round(wob, 5) AS wob, round(rpm, 5) AS rpm, round(flow, 5) AS flow, round(rop, 5) AS rop, round(efficiency, 5) AS efficiency, round(stability, 4) AS stability, round(score, 4) AS score FROM sc")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ml.grid(usable_rows(spark, sf_dir))
    return g.select("well_id", "bin", "n", *[r(F.col(c), c, 5) for c in ("wob", "rpm", "flow", "rop", "efficiency")], r(F.col("stability"), "stability", 4), r(F.col("score"), "score", 4))


@query(MET + DYS_SQL + """SELECT well_id, bins, bin, round(wob, 5) AS wob, round(rpm, 5) AS rpm, round(score, 5) AS score, CASE WHEN score > 0.75 THEN 'EXCELLENT (fast and stable)' WHEN score > 0.6 THEN 'GOOD efficiency' WHEN score > 0.45 THEN 'ACCEPTABLE' ELSE 'POOR - optimization needed' END AS rating FROM (
  SELECT *, count(*) OVER (PARTITION BY well_id) AS bins, row_number() OVER (PARTITION BY well_id ORDER BY score DESC, bin DESC) AS k FROM sc) a WHERE k = 1""")
def optimal_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ml.optimum(ml.grid(usable_rows(spark, sf_dir)))
    s = F.col("score")
    return o.select("well_id", "bins", "bin", r(F.col("wob"), "wob", 5), r(F.col("rpm"), "rpm", 5), r(s, "score", 5), texts.composite_rating(s).alias("rating"))


@query(MET + DYS_SQL + """SELECT well_id, x, y, n, round(c, 5) AS r FROM (SELECT well_id, 'wob' AS x, 'rop' AS y, count(*) AS n, corr(wob, rop) AS c FROM ok GROUP BY 1 UNION ALL SELECT well_id, 'wob', 'mse', count(*), corr(wob, mse) FROM ok GROUP BY 1 UNION ALL SELECT well_id, 'rpm', 'rop', count(*), corr(rpm, rop) FROM ok GROUP BY 1
  UNION ALL SELECT well_id, 'rpm', 'mse', count(*), corr(rpm, mse) FROM ok GROUP BY 1 UNION ALL SELECT well_id, 'flow_in', 'rop', count(*), corr(flow_in, rop) FROM ok GROUP BY 1) a WHERE n >= 30""")
def drilling_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ml.correlations(usable_rows(spark, sf_dir), [("wob", "rop"), ("wob", "mse"), ("rpm", "rop"), ("rpm", "mse"), ("flow_in", "rop")])
    return c.select("well_id", "x", "y", "n", r(F.col("r"), "r", 5))


@query()
def correlation_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above with p-values, which SQL has no function for; tests hold them against integration."""
    c = ml.correlations(usable_rows(spark, sf_dir), [("wob", "rop"), ("wob", "mse"), ("rpm", "rop"), ("rpm", "mse"), ("flow_in", "rop")])
    return c.select("well_id", "x", "y", "n", r(F.col("r"), "r", 5), r(F.col("p"), "p", 9), (F.col("p") < 0.05).alias("significant"))


@query(f"WITH {FEEDBACK_SQL} SELECT category, count(*) AS total, count(*) FILTER (WHERE outcome = 'Confirmed') AS confirmed, count(*) FILTER (WHERE outcome = 'FalsePositive') AS false_positives, count(*) FILTER (WHERE outcome = 'Unclear') AS unclear, round(count(*) FILTER (WHERE outcome = 'Confirmed') * 1.0 / nullif(count(*) FILTER (WHERE outcome <> 'Unclear'), 0), 6) AS rate FROM fb GROUP BY category")
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(feedback(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


def _stats(records: DataFrame) -> DataFrame:
    n = lambda o: F.count_if(F.col("outcome") == o)
    s = records.groupBy("category").agg(F.count("*").alias("total"), n("Confirmed").alias("confirmed"), n("FalsePositive").alias("false_positives"), n("Unclear").alias("unclear"))
    return s.withColumn("rate", physics.ratio(F.col("confirmed").cast("double"), (F.col("confirmed") + F.col("false_positives")).cast("double")))


#: Threshold of each category, its value, and whether higher values alert more (fixed values).
TUNED = [
    ("DrillingEfficiency", "mse.efficiency_warning_percent", DEFAULT.mse.efficiency_warning_percent, True), ("Hydraulics", "hydraulics.ecd_margin_warning_ppg", DEFAULT.hydraulics.ecd_margin_warning_ppg, True),
    ("WellControl", "well_control.flow_imbalance_warning_gpm", DEFAULT.well_control.flow_imbalance_warning_gpm, False), ("Mechanical", "mechanical.stick_slip_cv_warning", DEFAULT.mechanical.stick_slip_cv_warning, False), ("Formation", "formation.dexp_decrease_warning", -0.15, False),
]


@query(f"WITH {FEEDBACK_SQL}" + """, st AS (SELECT category, count(*) FILTER (WHERE outcome = 'Confirmed') AS c, count(*) FILTER (WHERE outcome = 'FalsePositive') AS f FROM fb GROUP BY 1), mp AS (SELECT * FROM (VALUES ('DrillingEfficiency', 70.0, true), ('Hydraulics', 0.3, true), ('WellControl', 5.0, false), ('Mechanical', 0.15, false), ('Formation', -0.15, false)) v(category, cur, up)),
  ad AS (SELECT s.*, CAST(m.cur AS DOUBLE) AS cur, m.up, CASE WHEN c * 1.0 / (c + f) < 0.5 THEN -0.1 WHEN c * 1.0 / (c + f) > 0.9 AND c + f >= 20 THEN 0.05 END AS adj FROM st s JOIN mp m ON s.category = m.category WHERE c + f >= 10)
  SELECT category, round(cur, 4) AS current_value, round(cur * (1 + CASE WHEN up THEN adj ELSE -adj END), 3) AS suggested, round(greatest(least((c + f - 10) / 40.0, 1), 0) * 0.5 + 0.5, 6) AS confidence FROM ad WHERE adj IS NOT NULL""")
def threshold_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame([(c, float(v), up) for c, _, v, up in TUNED], "category string, cur double, up boolean")
    s = _stats(feedback(spark, sf_dir)).withColumn("rated", F.col("confirmed") + F.col("false_positives")).filter("rated >= 10").join(F.broadcast(table), "category")
    step = F.when(F.col("rate") < 0.5, -0.10).when((F.col("rate") > 0.9) & (F.col("rated") >= 20), 0.05)
    s = s.withColumn("step", step).filter("step IS NOT NULL")
    new = F.col("cur") * (1 + F.when(F.col("up"), F.col("step")).otherwise(-F.col("step")))
    low, high = F.least(F.col("cur") * 0.75, F.col("cur") * 1.25), F.greatest(F.col("cur") * 0.75, F.col("cur") * 1.25)
    return s.select("category", F.round("cur", 4).alias("current_value"), F.round(F.least(F.greatest(new, low), high), 3).alias("suggested"), r(physics.clamp((F.col("rated") - 10) / 40.0, 0, 1) * 0.5 + 0.5, "confidence"))


@query(f"WITH {FEEDBACK_SQL} SELECT advisory, o_orderkey, category, outcome FROM (SELECT *, row_number() OVER (PARTITION BY advisory ORDER BY rated_at DESC, o_orderkey DESC) AS k FROM fb) a WHERE k = 1")
def event_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep-latest by version, ties to the larger key; halves stand for a table and its changes."""
    f = feedback(spark, sf_dir)
    return stores.upsert(f.filter("o_orderkey % 2 = 0"), f.filter("o_orderkey % 2 = 1"), ["advisory"], "rated_at", "o_orderkey").select("advisory", "o_orderkey", "category", "outcome")


@query(f"WITH {FEEDBACK_SQL}, mx AS (SELECT max(rated_at) AS now FROM fb) SELECT category, tier, count(*) AS n FROM (SELECT category, CASE WHEN rated_at < now - 86400 * 365 THEN 'delete' WHEN row_number() OVER (PARTITION BY category ORDER BY rated_at DESC, o_orderkey DESC) <= 168 THEN 'hot' ELSE 'cold' END AS tier FROM fb, mx) a GROUP BY 1, 2")
def snapshot_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feedback(spark, sf_dir)
    now = f.agg(F.max("rated_at").alias("now"))
    marked = stores.tiers(f.join(F.broadcast(now), how="cross"), "rated_at", "o_orderkey", F.col("now"), 168, 86400 * 365, ["category"])
    return marked.groupBy("category", "tier").agg(F.count("*").alias("n"))


@query(f"WITH {FEEDBACK_SQL}, mx AS (SELECT max(rated_at) AS now FROM fb), kp AS (SELECT * FROM fb, mx WHERE rated_at >= now - 86400 * 365 AND NOT (outcome = 'FalsePositive' AND rated_at < now - 86400 * 90)) SELECT o_orderkey, outcome FROM (SELECT *, row_number() OVER (ORDER BY rated_at DESC, o_orderkey DESC) AS k FROM kp) a WHERE k <= 50000")
def event_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age limits by outcome, then the newest 50,000: the cap is the feature, taken by a top-k."""
    f = feedback(spark, sf_dir)
    now = f.agg(F.max("rated_at").alias("now"))
    kept = f.join(F.broadcast(now), how="cross").filter("rated_at >= now - 86400 * 365 AND NOT (outcome = 'FalsePositive' AND rated_at < now - 86400 * 90)")
    return kept.orderBy(F.desc("rated_at"), F.desc("o_orderkey")).limit(50_000).select("o_orderkey", "outcome")


@query(f"WITH {FEEDBACK_SQL} SELECT category, o_orderkey FROM (SELECT category, o_orderkey, row_number() OVER (PARTITION BY category ORDER BY price DESC, o_orderkey) AS k FROM fb) a WHERE k <= 20")
def recipes_per_formation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.newest_per_group(feedback(spark, sf_dir), ["category"], [F.desc("price"), F.col("o_orderkey")], 20).select("category", "o_orderkey")


@query(f"WITH {FEEDBACK_SQL}, mx AS (SELECT max(rated_at) AS now FROM fb) SELECT o_orderkey, round(0.4 / (1 + (now - rated_at) / 3600.0) + 0.6 * CASE outcome WHEN 'Confirmed' THEN 1 WHEN 'Unclear' THEN 0.3 ELSE 0.1 END, 8) AS score FROM fb, mx WHERE category = 'Mechanical' ORDER BY score DESC, o_orderkey LIMIT 25")
def episode_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best episodes by recency and outcome."""
    f = feedback(spark, sf_dir)
    now = f.agg(F.max("rated_at").alias("now"))
    worth = F.when(F.col("outcome") == "Confirmed", 1.0).when(F.col("outcome") == "Unclear", 0.3).otherwise(0.1)
    e = f.filter("category = 'Mechanical'").join(F.broadcast(now), how="cross").select("o_orderkey", F.round(0.4 / (1 + (F.col("now") - F.col("rated_at")) / 3600.0) + 0.6 * worth, 8).alias("score"))
    return e.orderBy(F.desc("score"), "o_orderkey").limit(25)


@query(MET + "SELECT seq, round(abs(bit_depth - 2000), 4) AS away FROM met WHERE category <> 'None' AND bit_depth BETWEEN 1500 AND 2500 ORDER BY abs(bit_depth - 2000), seq LIMIT 15")
def depth_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = drilling_metrics(telemetry(spark, sf_dir)).filter("category <> 'None' AND bit_depth BETWEEN 1500 AND 2500")
    return m.select("seq", F.round(F.abs(F.col("bit_depth") - 2000), 4).alias("away")).orderBy("away", "seq").limit(15)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 40")
def job_queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(40).select("o_orderkey")


@query(MET + """SELECT well_id, ts - ts % 43200 AS shift, count(*) AS n, round(min(bit_depth), 4) AS depth_start, round(max(bit_depth), 4) AS depth_end, round(max(bit_depth) - min(bit_depth), 1) AS footage, round(avg(rop), 3) AS avg_rop, round(min(wob), 3) AS min_wob, round(max(wob), 3) AS max_wob, count(*) FILTER (WHERE category <> 'None') AS tickets, count(*) FILTER (WHERE category = 'WellControl') AS well_control FROM met GROUP BY 1, 2""")
def shift_handover(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = drilling_metrics(telemetry(spark, sf_dir))
    return m.groupBy("well_id", (F.col("ts") - F.col("ts") % 43200).alias("shift")).agg(
        F.count("*").alias("n"), r(F.min("bit_depth"), "depth_start", 4), r(F.max("bit_depth"), "depth_end", 4), r(F.max("bit_depth") - F.min("bit_depth"), "footage", 1), r(F.avg("rop"), "avg_rop", 3), r(F.min("wob"), "min_wob", 3), r(F.max("wob"), "max_wob", 3),
        F.count_if(F.col("category") != "None").alias("tickets"), F.count_if(F.col("category") == "WellControl").alias("well_control"),
    )


@query(MET + "SELECT seq, concat('MD5-', md5(concat_ws(':', CAST(ts AS VARCHAR), CAST(seq AS VARCHAR), rule))) AS signature FROM met WHERE severity = 'CRITICAL'")
def critical_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = drilling_metrics(telemetry(spark, sf_dir)).filter("severity = 'CRITICAL'")
    return m.select("seq", reports.signature(F.col("ts"), F.col("seq"), F.col("rule")).alias("signature"))


@query("""WITH t AS (SELECT event_id AS seq, concat('<think>guess', chr(10), 'x</think>Health Score: ', CAST(event_id % 120 AS VARCHAR), '/100', chr(10), 'Severity: ', CASE event_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'low' WHEN 2 THEN 'Critical' ELSE '-' END, chr(10), 'Diagnosis: ', event_type, chr(10), 'Action: reduce ', user_id) AS txt FROM events)
  SELECT seq, CAST(CASE WHEN seq % 120 <= 10 THEN seq % 120 * 10.0 ELSE least(seq % 120, 100) * 1.0 END AS DOUBLE) AS health, CASE seq % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' WHEN 2 THEN 'Critical' ELSE 'Unknown' END AS severity, trim(regexp_extract(txt, 'Diagnosis: (.+)', 1)) AS diagnosis, trim(regexp_extract(txt, 'Action: (.+)', 1)) AS action FROM t""")
def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    word = F.element_at(F.array(*[F.lit(x) for x in ("HIGH", "low", "Critical", "-")]), (F.col("event_id") % 4 + 1).cast("int"))
    raw = F.concat(F.lit("<think>guess\nx</think>Health Score: "), (F.col("event_id") % 120).cast("string"), F.lit("/100\nSeverity: "), word, F.lit("\nDiagnosis: "), F.col("event_type"), F.lit("\nAction: reduce "), F.col("user_id").cast("string"))
    t = e.select(F.col("event_id").alias("seq"), reports.without_thoughts(raw).alias("txt"))
    x = F.col("txt")
    return t.select("seq", reports.health_score(x).alias("health"), reports.severity_word(x).alias("severity"), reports.section(x, "diagnosis").alias("diagnosis"), reports.section(x, "action").alias("action"))


@query("SELECT category, n, peak FROM (SELECT event_type AS category, count(*) AS n, CAST(coalesce(max(event_id), 0) AS BIGINT) AS peak FROM events GROUP BY 1) a")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n"), F.coalesce(F.max("event_id"), F.lit(0)).alias("peak"))


@query(f"WITH {FEEDBACK_SQL} SELECT category, count(*) AS n FROM fb WHERE outcome = 'Confirmed' GROUP BY 1")
def confirmed_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback(spark, sf_dir).filter("outcome = 'Confirmed'").groupBy("category").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey AS field, CAST(sum(n) AS BIGINT) AS samples, round(sum(v * n) / sum(n), 4) AS weighted, round(max(v), 4) AS best, min(s_suppkey) FILTER (WHERE v = mx) AS best_rig FROM (SELECT s.s_nationkey AS n_nationkey, s.s_suppkey, x.n, x.v, max(x.v) OVER (PARTITION BY s.s_nationkey) AS mx FROM supplier s JOIN (SELECT l_suppkey, count(*) AS n, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1) x ON s.s_suppkey = x.l_suppkey) a GROUP BY 1""")
def offset_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means over neighbours, and the best neighbour (the first on ties)."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    x = read("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("v"))
    j = read("supplier").select("s_suppkey", F.col("s_nationkey").alias("field")).join(x, "s_suppkey")
    best = F.max_by("s_suppkey", F.struct("v", -F.col("s_suppkey")))
    return j.groupBy("field").agg(F.sum("n").alias("samples"), r(F.sum(F.col("v") * F.col("n")) / F.sum("n"), "weighted", 4), r(F.max("v"), "best", 4), best.alias("best_rig"))


@query(TEL + """, x AS (SELECT well_id, mud_weight_in FROM tel WHERE mud_weight_in > 0) SELECT well_id, round(median(mud_weight_in), 4) AS mud_weight, round(stddev_samp(mud_weight_in) / abs(avg(mud_weight_in)), 6) AS cv, count(*) >= 30 AND stddev_samp(mud_weight_in) / abs(avg(mud_weight_in)) <= 0.15 AND median(mud_weight_in) BETWEEN 5 AND 25 AS detected FROM x GROUP BY 1""")
def mud_weight_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = telemetry(spark, sf_dir).filter("mud_weight_in > 0").groupBy("well_id").agg(F.median("mud_weight_in").alias("m"), physics.ratio(F.stddev_samp("mud_weight_in"), F.abs(F.avg("mud_weight_in"))).alias("cv"), F.count("*").alias("n"))
    return g.select("well_id", r(F.col("m"), "mud_weight", 4), r(F.col("cv"), "cv"), ((F.col("n") >= 30) & (F.col("cv") <= 0.15) & F.col("m").between(5, 25)).alias("detected"))


@query("""SELECT o_orderkey, round(0.3 * CASE o_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.4 WHEN 2 THEN 0.7 ELSE 1 END + 0.25 * least(abs(o_totalprice / 10000 - 25) / 25, 1) + 0.2 * (o_orderkey % 11) / 10.0 + 0.15 * 0.9 + 0.1 * CASE WHEN o_orderkey % 10 < 3 THEN 1 WHEN o_orderkey % 10 < 5 THEN 0.7 WHEN o_orderkey % 10 < 7 THEN 0.3 ELSE 0 END, 9) AS confidence FROM orders""")
def recommendation_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    score = (F.col("o_orderkey") % 10) / 10.0
    gap = advisories.gap_score([(F.col("o_totalprice") / 10000, F.lit(25.0), F.lit(25.0))])
    c = advisories.recommendation_confidence(advisories.offset_score(F.col("o_custkey") % 4), gap, (F.col("o_orderkey") % 11) / 10.0, F.lit(0.9), advisories.net_agreement(F.round(score, 3)))
    return o.select("o_orderkey", r(c, "confidence", 9))


@query("SELECT well, formation, category, n FROM (SELECT CAST(user_id % 8 AS BIGINT) AS well, CAST(event_id % 5 AS BIGINT) AS formation, event_type AS category, count(*) AS n FROM events GROUP BY ROLLUP (user_id % 8, event_id % 5, event_type)) a")
def event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by well, formation and category with all subtotals."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 8).alias("well"), (F.col("event_id") % 5).alias("formation"), F.col("event_type").alias("category"))
    return e.rollup("well", "formation", "category").agg(F.count("*").alias("n"))




SNAP_SQL = """sn AS (SELECT n.n_name AS field, 'W' || CAST(l.l_suppkey AS VARCHAR) AS well, 'Layer ' || CAST(l.l_partkey % 12 AS VARCHAR) AS formation, l_extendedprice / 1000 AS rop, l_quantity * 1000 AS mse, l_quantity AS wob, l_tax * 1000 AS rpm, CAST(l_orderkey AS DOUBLE) + l_partkey / 10000.0 AS depth, CASE l_linenumber % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' ELSE 'Insufficient' END AS confidence, l_linenumber AS samples
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey),
  pw AS (SELECT field, well, formation, avg(rop) AS avg_rop, max(rop) AS best_rop, avg(mse) AS avg_mse, min(depth) AS d0, max(depth) AS d1, avg(CASE confidence WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.7 WHEN 'Low' THEN 0.4 ELSE 0.1 END) AS conf, sum(samples) AS samples, count(*) AS snapshots FROM sn GROUP BY 1, 2, 3)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of wells (suppliers) in formations (parts), from line items."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    rigs = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("field"))
    return read("lineitem").join(rigs, "l_suppkey").selectExpr(
        "field", "'W' || CAST(l_suppkey AS STRING) AS well", "'Layer ' || CAST(l_partkey % 12 AS STRING) AS formation", "l_extendedprice / 1000 AS rop", "l_quantity * 1000 AS mse", "l_quantity AS wob", "l_tax * 1000 AS rpm", "CAST(l_orderkey AS DOUBLE) + l_partkey / 10000D AS depth",
        "CASE l_linenumber % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' ELSE 'Insufficient' END AS confidence", "l_linenumber AS samples",
    )


@query(f"WITH {SNAP_SQL} SELECT field, well, formation, round(avg_rop * snapshots, 5) AS rop_sum, round(best_rop, 6) AS best_rop, round(avg_mse * snapshots, 3) AS mse_sum, round(d0, 4) AS depth_from, round(d1, 4) AS depth_to, round(conf * snapshots, 3) AS confidence_sum, CAST(samples AS BIGINT) AS samples, snapshots FROM pw")
def post_well_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = knowledge.post_well(snapshots(spark, sf_dir))
    return p.select("field", "well", "formation", r(F.col("avg_rop") * F.col("snapshots"), "rop_sum", 5), r(F.col("best_rop"), "best_rop", 6), r(F.col("avg_mse") * F.col("snapshots"), "mse_sum", 3), r(F.col("depth_from"), "depth_from", 4), r(F.col("depth_to"), "depth_to", 4), r(F.col("avg_confidence") * F.col("snapshots"), "confidence_sum", 3), "samples", "snapshots")


@query(f"WITH {SNAP_SQL}, fo AS (SELECT DISTINCT formation, replace(formation, ' ', '_') AS stem FROM sn), me AS (SELECT f.formation, p.* EXCLUDE (formation) FROM fo f JOIN pw p ON starts_with(replace(p.formation, ' ', '_'), f.stem)) SELECT formation, count(DISTINCT well) AS wells, round(sum(avg_rop * snapshots) / sum(snapshots), 4) AS avg_rop, round(max(best_rop), 6) AS best_rop, round(sum(avg_mse * snapshots) / sum(snapshots), 2) AS avg_mse FROM me GROUP BY 1")
def offset_by_name_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots(spark, sf_dir)
    o = knowledge.offset_performance(s.select("formation"), knowledge.post_well(s))
    return o.select("formation", F.size("wells").cast("long").alias("wells"), r(F.col("avg_rop"), "avg_rop", 4), r(F.col("best_rop"), "best_rop", 6), r(F.col("avg_mse"), "avg_mse", 2))


@query(f"WITH {SNAP_SQL}, ge AS (SELECT formation, CAST(substr(formation, 7) AS DOUBLE) AS hardness FROM sn GROUP BY formation), ofs AS (SELECT f.formation, sum(p.avg_rop * p.snapshots) / sum(p.snapshots) AS rop FROM ge f JOIN pw p ON starts_with(replace(p.formation, ' ', '_'), replace(f.formation, ' ', '_')) GROUP BY 1) SELECT g.formation, CASE WHEN hardness % 3 = 0 THEN 111.0 ELSE hardness * 100 END AS top, CAST(CASE WHEN hardness < 3.5 THEN 10.0 WHEN hardness < 6 THEN 25.0 ELSE 30.0 END AS DOUBLE) AS best_wob, round(o.rop, 4) AS offset_rop FROM ge g LEFT JOIN ofs o ON g.formation = o.formation")
def assembled_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots(spark, sf_dir)
    geology = s.select("formation").distinct().selectExpr("formation", "CAST(substr(formation, 7) AS DOUBLE) AS hardness").selectExpr("*", "hardness * 100 AS top", "hardness * 100 + 100 AS base")
    plan = geology.filter("hardness % 3 = 0").selectExpr("formation", "111.0D AS top", "CAST(NULL AS DOUBLE) AS base").withColumn("parameters", F.lit(None).cast("struct<wob: struct<min: double, optimal: double, max: double>, rpm: struct<min: double, optimal: double, max: double>, flow: struct<min: double, optimal: double, max: double>, mud_weight: double>"))
    a = knowledge.assemble(geology, plan, knowledge.offset_performance(geology, knowledge.post_well(s)))
    return a.select("formation", "top", F.col("parameters.wob.optimal").alias("best_wob"), r(F.col("offset_rop"), "offset_rop", 4))


@query(f"WITH {FEEDBACK_SQL}, fi AS (SELECT advisory, arg_min(outcome, rated_at * 100000 + o_orderkey) AS outcome FROM fb GROUP BY 1) SELECT CAST(user_id % 8 AS BIGINT) AS well, count(*) AS advisories, count(*) FILTER (WHERE outcome = 'Confirmed') AS confirmed, count(*) FILTER (WHERE outcome = 'FalsePositive') AS false_positives, round(count(*) FILTER (WHERE outcome = 'Confirmed') * 1.0 / nullif(count(*) FILTER (WHERE outcome IN ('Confirmed', 'FalsePositive')), 0), 6) AS rate FROM events e LEFT JOIN fi f ON e.event_id = f.advisory GROUP BY 1")
def well_debrief(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("ticket"), (F.col("user_id") % 8).alias("well"))
    first = feedback(spark, sf_dir).groupBy(F.col("advisory").alias("ticket")).agg(F.min_by("outcome", F.struct("rated_at", "o_orderkey")).alias("outcome"))
    d = knowledge.debrief(t, first)
    return d.select("well", "advisories", "confirmed", "false_positives", F.round("rate", 6).alias("rate"))


@query("SELECT count(*) FILTER (WHERE last_seen >= 1706659000) AS online, count(*) AS total, max(last_seen) AS newest FROM (SELECT user_id, CAST(floor(max(epoch(ts))) AS BIGINT) AS last_seen FROM events GROUP BY 1) a")
def fleet_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("rig"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return knowledge.fleet_status(e, 1706659300, 300)
