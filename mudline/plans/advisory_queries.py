"""Advisories: oscillation, damping with recipes, the optimiser's gate, cooldown, order of sources, features, exposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mudline.functions import digits, reports
from mudline.operators import advisories, joins, kernels, reading
from mudline.operators.metrics import drilling_metrics
from mudline.operators.nets import FEATURES
from mudline.plans.kernel_queries import NEXT, WALK
from mudline.plans.physics_queries import MET, REC_MET, TEL, r
from mudline.plans.reading_queries import RC, recipes
from mudline.plans.window_queries import W60
from mudline.registry import query
from mudline.telemetry import NAMES, telemetry

OSC_SQL = f""", ol AS (SELECT *, list(torque) OVER w60 AS v FROM {{0}} WINDOW w60 AS {W60}), om AS (SELECT *, list_avg(v) AS mu FROM ol),
  oc AS (SELECT *, sqrt(list_avg(list_transform(v, lambda x: (x - mu) * (x - mu)))) / mu AS ocv, len(list_filter(range(2, len(v) + 1), lambda i: (v[i] >= mu) <> (v[i - 1] >= mu))) / (2.0 * (len(v) - 1)) AS hz, (list_max(v) - list_min(v)) / mu AS amp FROM om)"""


@query(TEL + OSC_SQL.format("tel") + "SELECT seq, round(ocv, 6) AS cv, round(hz, 6) AS hz, round(amp, 6) AS amplitude, CASE WHEN hz < 1 THEN 'StickSlip' ELSE 'Torsional' END AS kind FROM oc WHERE len(v) >= 20 AND ocv >= 0.05")
def torque_oscillations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = advisories.oscillations(telemetry(spark, sf_dir), "torque")
    return o.select("seq", r(F.col("cv"), "cv"), r(F.col("hz"), "hz"), r(F.col("amplitude"), "amplitude"), "kind")


@query(RC.replace("WITH rc", f"{MET.strip()}, rc") + OSC_SQL.format("met") + """, bp AS (SELECT formation, arg_min(wob_change_pct, achieved_cv * 1e12 + recipe) AS w, arg_min(rpm_change_pct, achieved_cv * 1e12 + recipe) AS p FROM rc GROUP BY 1),
  dm AS (SELECT *, seq % 60 AS formation, len(v) >= 20 AND ocv >= 0.15 AND rule = 'torque' AND wob >= 3 AS damps, greatest(greatest(least((ocv - 0.15) / 0.1, 1), 0), 0.5) AS s FROM oc),
  dn AS (SELECT *, CASE WHEN damps THEN (greatest(wob * (1 - (10 + 5 * s) / 100), 3) - wob) / nullif(wob, 0) * 100 END AS wp, CASE WHEN damps THEN (least(rpm * (1 + (5 + 5 * s) / 100), rpm * 1.5) - rpm) / nullif(rpm, 0) * 100 END AS pp FROM dm)
  SELECT seq, round(wob * (1 + coalesce(0.7 * b.w + 0.3 * wp, wp) / 100), 5) AS damped_wob, round(rpm * (1 + coalesce(0.7 * b.p + 0.3 * pp, pp) / 100), 5) AS damped_rpm FROM dn LEFT JOIN bp b ON b.formation = dn.formation WHERE wp IS NOT NULL""")
def damping_with_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations for tickets of rising torque, refined by recipes where the formation has some."""
    m = drilling_metrics(telemetry(spark, sf_dir)).withColumns({"slipping": F.col("rule") == "torque", "formation": F.col("seq") % 60})
    d = advisories.with_damping(m, reading.best_recipe(recipes(spark, sf_dir))).filter("damped_wob IS NOT NULL")
    return d.select("seq", r(F.col("damped_wob"), "damped_wob", 5), r(F.col("damped_rpm"), "damped_rpm", 5))


GATE = """, og AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY ts, seq) AS i, 0.3 * CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.4 WHEN 2 THEN 0.7 ELSE 1 END + 0.25 * greatest(least(abs(wob - 25) / 20, 1), 0) + 0.2 * 0.5 + 0.15 * 0.9 + 0.1 * CASE WHEN k < 30 THEN 1 WHEN k < 50 THEN 0.7 WHEN k < 70 THEN 0.3 ELSE 0 END AS conf FROM met),
  ow AS (SELECT *, CASE WHEN i % 10 <> 0 THEN 'RateLimited' WHEN k > 70 THEN 'AnomalyActive' WHEN state <> 'Drilling' THEN 'NotDrilling' WHEN i < 10 THEN 'InsufficientHistory' WHEN round(round(conf, 9), 2) < 0.6 OR abs(wob - 25) < 1 THEN 'LowConfidence' END AS reason FROM og)"""


@query(MET + GATE + " SELECT seq, reason, round(conf, 6) AS confidence FROM ow")
def optimizer_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = gated(drilling_metrics(telemetry(spark, sf_dir)))
    return m.select("seq", "reason", r(F.col("conf"), "confidence"))


def gated(m: DataFrame) -> DataFrame:
    k, score = F.col("k"), F.col("k") / 100.0
    gap = advisories.gap_score([(F.col("wob"), F.lit(25.0), F.lit(20.0))])
    m = m.withColumn("conf", advisories.recommendation_confidence(advisories.offset_score(k % 4), gap, F.lit(0.5), F.lit(0.9), advisories.net_agreement(score)))
    return m.withColumn("reason", advisories.optimizer_gate(score, F.col("state"), F.round("conf", 9), (F.abs(F.col("wob") - 25) >= 1).cast("int")))


@query(MET + GATE + " SELECT CASE WHEN category = 'WellControl' THEN 'ticket' WHEN ts % 600 < 30 THEN 'periodic' WHEN rule = 'torque' THEN 'damping' WHEN reason IS NULL THEN 'optimization' WHEN k = 50 THEN 'look_ahead' END AS source, count(*) AS n FROM ow GROUP BY 1")
def advisory_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source speaks at a packet: the first in order of priority."""
    m = gated(drilling_metrics(telemetry(spark, sf_dir)))
    flags = {"ticket": F.col("category") == "WellControl", "periodic": F.col("ts") % 600 < 30, "damping": F.col("rule") == "torque", "optimization": F.col("reason").isNull(), "look_ahead": F.col("k") == 50}
    return m.groupBy(advisories.advisory_source(flags).alias("source")).agg(F.count("*").alias("n"))


@query(REC_MET + WALK.format("met") + f""", st AS (SELECT well_id, i, seq, CASE WHEN severity = 'CRITICAL' THEN ts END AS passed, true AS composed FROM ix WHERE i = 1
  UNION ALL SELECT x.well_id, x.i, x.seq, CASE WHEN x.severity = 'CRITICAL' AND (s.passed IS NULL OR x.ts - s.passed >= 3000) THEN x.ts ELSE s.passed END, x.severity <> 'CRITICAL' OR s.passed IS NULL OR x.ts - s.passed >= 3000 FROM st s {NEXT}) SELECT seq, well_id, composed FROM st""")
def critical_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical advisories at most once in 3,000 seconds here, as packets are an hour apart."""
    return kernels.apply(drilling_metrics(telemetry(spark, sf_dir)), advisories.CriticalCooldown(3000)).select("seq", "well_id", "composed")


HELD = [*NAMES, "mse", "d_exponent", "dxc", "flow_balance", "pit_rate"]


@query(MET + "SELECT seq, round(" + " + ".join(f"{i + 1} * {f if f in HELD else 0}" for i, f in enumerate(FEATURES)) + ", 4) AS weighted FROM met")
def net_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of the nets, each weighted by its place to one number."""
    m = drilling_metrics(telemetry(spark, sf_dir))
    v = m.select("seq", advisories.feature_vector(m.columns).alias("v"))
    return v.select("seq", r(F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), "weighted", 4))


#: Metrics of the exposition: name, kind, help and the value in both engines; tickets are confirmed where k is under 60 and rejected from 90 on.
EXPOSED = (
    ("packets_total", "counter", "Total packets processed", "count(*)"),
    ("tickets_created_total", "counter", "Advisory tickets generated", "count_if(category <> 'None')"),
    ("tickets_verified_total", "counter", "Tickets confirmed", "count_if(category <> 'None' AND k < 60)"),
    ("tickets_rejected_total", "counter", "Tickets rejected as transient", "count_if(category <> 'None' AND k >= 90)"),
    ("uptime_seconds", "gauge", "Seconds between the first packet and the last", "max(ts) - min(ts)"),
    ("avg_mse_efficiency", "gauge", "Average MSE efficiency (0-100)", "avg(CASE WHEN mse > 0 THEN mse_efficiency END)"),
)


@query(MET + " UNION ALL ".join(f"SELECT '# HELP {n} {h}' || chr(10) || '# TYPE {n} {k}' || chr(10) || '{n} ' || " + (f"printf('%.2f', {e})" if n.startswith("avg") else f"({e})") + " AS text FROM met" for n, k, h, e in EXPOSED))
def metrics_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six metrics in the text exposition format, from one pass."""
    n = drilling_metrics(telemetry(spark, sf_dir)).agg(*[F.expr(e).alias(n) for n, _, _, e in EXPOSED])
    value = lambda n: digits.printf("%.2f", n) if n.startswith("avg") else F.col(n)
    return n.select(F.explode(F.array(*[reports.exposition(n, kind, words, value(n)) for n, kind, words, _ in EXPOSED])).alias("text"))
