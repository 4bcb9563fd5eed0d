"""Texts of reports and advisories: parsed bodies, template advisories, debrief narratives, optimiser rows, traces, exposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mudline.functions import advice, reports, tickets
from mudline.operators import advisories, knowledge
from mudline.operators.metrics import drilling_metrics
from mudline.plans.physics_queries import MET, r
from mudline.plans.reading_queries import RP, report_rows
from mudline.registry import query
from mudline.telemetry import telemetry

#: Report texts by event, of every form that is read; %d stands for the event.
FORMS = (
    "HEALTHSCORE: %d\nSEVERITY: Warning level\nDIAGNOSIS: torque of %d\nACTION: reduce weight",
    "<think>the health score is bad</think>\nHealth Score: 7.5\nSeverity: critical!\nDiagnosis: kick %d\nRecommended Action: shut in\nDETAILS:\nTREND: rising\nTOP_DRIVERS: gas %d\nCONFIDENCE: high\nNEXT_CHECK: 5 min",
    "```text\nhealth_score: 140\nseverity: Watch\ndiagnosis: none\naction: go on\ndetails: trend: up top_drivers: x\n```",
    "<think>long thought %d diagnosis: worn bit action: trip out",
    "We saw much. Therefore, the bit of well %d is worn out. Good.",
    "<div>nothing to say</div>",
    "SEVERITY: odd word\nDIAGNOSIS:\nACTION: wait<0x0A>DETAILS: none",
)
PARSED_SQL = "WITH t AS (SELECT event_id AS seq, replace(list_element([" + ", ".join("'" + f.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for f in FORMS) + f"], CAST(event_id % {len(FORMS)} + 1 AS INTEGER)), '%d', CAST(event_id % 100 AS VARCHAR)) AS raw, event_id % {len(FORMS)} AS form, event_id % 100 AS d FROM events)" + """
  SELECT seq, CASE form WHEN 0 THEN CASE WHEN d <= 10 THEN d * 10.0 ELSE d END WHEN 1 THEN 75.0 WHEN 2 THEN 100.0 END::DOUBLE AS health, CASE form WHEN 0 THEN 'Warning' WHEN 1 THEN 'Critical' WHEN 2 THEN 'Watch' WHEN 6 THEN 'odd word' END AS severity,
    CASE form WHEN 0 THEN 'torque of ' || d WHEN 1 THEN 'kick ' || d || chr(10) || 'Recommended' WHEN 2 THEN 'none' WHEN 3 THEN 'worn bit' WHEN 4 THEN 'Therefore, the bit of well ' || d || ' is worn out.' END AS diagnosis,
    CASE form WHEN 0 THEN 'reduce weight' WHEN 1 THEN 'shut in' WHEN 2 THEN 'go on' WHEN 3 THEN 'trip out' WHEN 4 THEN 'Continue monitoring.' WHEN 6 THEN 'wait' END AS action, CASE form WHEN 1 THEN 'rising' END AS trend, CASE form WHEN 1 THEN 'gas ' || d END AS top_drivers, CASE form WHEN 1 THEN 'high' END AS confidence, CASE form WHEN 1 THEN '5 min' END AS next_check FROM t"""


@query(PARSED_SQL)
def report_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly and daily reports of seven forms, parsed; the SQL says by form what each must give."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = F.replace(F.element_at(F.array(*[F.lit(f) for f in FORMS]), (F.col("event_id") % len(FORMS) + 1).cast("int")), F.lit("%d"), (F.col("event_id") % 100).cast("string"))
    return reports.parsed(e.select(F.col("event_id").alias("seq"), raw.alias("raw")), "raw").drop("raw")


#: Values that the sentences say, over the metrics; shifted by a little so that no engine rounds a half another way.
SAID = {
    "flow_balance": "flow_balance + 0.0123", "pit_rate": "pit_rate + 0.0123", "ecd_margin": "ecd_margin + 0.00123", "spp_delta": "spp_delta + 0.0123", "torque_delta": "torque_delta + 0.000123", "mud_weight": "mud_weight_in + 0.0123", "ecd": "ecd + 0.0123", "depth": "bit_depth + 0.0123",
    "flow_trend": "flow_balance / 10 + 0.0123", "gas": "gas_units + 0.0123", "efficiency": "mse_efficiency + 0.0123", "optimal_mse": "5000 + hardness * 8000 + 0.0123", "avg_mse": "mse + 0.0123", "mse_trend": "CAST(k - 50 AS DOUBLE)", "wob": "wob + 0.0123", "rpm": "rpm + 0.0123", "rop": "rop + 0.0123",
    "torque": "torque + 0.0123", "hardness": "hardness + 0.0123", "spp": "spp + 0.0123", "flow_in": "flow_in + 0.0123", "founder": "rule = 'founder'", "optimal_wob": "wob - 2.9877", "dxc_trend": "(k - 50) / CAST(250 AS DOUBLE) + 0.000123", "formation": "CASE WHEN k % 9 = 0 THEN NULL ELSE 'F' || CAST(k % 5 AS VARCHAR(9)) END",
    "plugging": "k % 2 = 0",
}
#: Categories of tickets; each eleventh packet's is Formation, which the cascade alone never says.
CATEGORY = "CASE WHEN k % 11 = 0 THEN 'Formation' ELSE category END"
S = advice.said_sql
ADVICE_SQL = MET + ", p0 AS (SELECT seq, " + CATEGORY + " AS category, " + ", ".join(f"{e} AS {n}" for n, e in SAID.items()) + f""" FROM met),
  p AS (SELECT *, CASE WHEN plugging THEN '{advice.CAMPAIGN_NOTE}' ELSE '' END AS campaign_note, CASE WHEN mse_trend > 0 THEN 'increasing (worsening)' ELSE 'stable/improving' END AS mse_direction, least(100 - efficiency, 30.0::DOUBLE) AS gain, coalesce(' Formation: ' || formation || '.', '') AS formation_note, coalesce(formation, 'unknown') AS formation_name,
    torque_delta * 100 AS torque_percent, CAST(founder AS VARCHAR) AS founder_word, CASE WHEN dxc_trend > 0 THEN 'harder' ELSE 'softer' END AS rock FROM p0)
  SELECT seq, category, CASE category WHEN 'WellControl' THEN {S('well_control')} WHEN 'DrillingEfficiency' THEN CASE WHEN efficiency < 50 THEN {S('efficiency_low')} ELSE {S('efficiency')} END WHEN 'Hydraulics' THEN CASE WHEN ecd_margin < 0.3 THEN {S('ecd_low')} WHEN abs(spp_delta) > 100 THEN {S('spp_off')} ELSE {S('hydraulics')} END
      WHEN 'Mechanical' THEN CASE WHEN founder THEN {S('founder')} WHEN torque_delta > 0.15 THEN {S('torque_high')} ELSE {S('mechanical')} END WHEN 'Formation' THEN CASE WHEN dxc_trend < -0.1 THEN {S('pore_pressure')} WHEN abs(dxc_trend) > 0.05 THEN {S('entering')} ELSE {S('formation')} END ELSE {S('normal')} END AS recommendation,
    CASE category WHEN 'DrillingEfficiency' THEN {S('efficiency_gain')} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in advice.BENEFITS.items())} END AS benefit,
    CASE category WHEN 'WellControl' THEN {S('well_control_why')} WHEN 'DrillingEfficiency' THEN {S('efficiency_why')} WHEN 'Hydraulics' THEN {S('hydraulics_why')} WHEN 'Mechanical' THEN {S('mechanical_why')} WHEN 'Formation' THEN {S('formation_why')} ELSE '{advice.NORMAL_WHY}' END AS reasoning FROM p"""


@query(ADVICE_SQL)
def template_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template advisory for each packet, all categories and their variants."""
    m = drilling_metrics(telemetry(spark, sf_dir))
    p = m.select("seq", F.expr(CATEGORY.replace("VARCHAR(9)", "STRING")).alias("category"), *[F.expr(e.replace("VARCHAR(9)", "STRING")).alias(n) for n, e in SAID.items()])
    said = advice.advisory(F.col("category"), {n: F.col(n) for n in SAID})
    return p.select("seq", "category", *[c.alias(n) for n, c in said.items()])


#: Formations of wells as a debrief compares them: 270 feet each, planned rates that each fifth lacks.
COMPARED_SQL = """fz AS (SELECT well_id, 'F' || CAST(CAST(floor(bit_depth / 270) AS INTEGER) AS VARCHAR) AS formation, CAST(floor(bit_depth / 270) AS INTEGER) AS f, bit_depth, rop, wob, rpm, seq, ts, category, severity FROM met),
  cp0 AS (SELECT well_id, formation, f * 270.0 AS top, f * 270.0 + 270 AS base, avg(rop) AS rop, max(wob) AS wob, max(rpm) AS rpm, CASE WHEN f % 5 = 4 THEN NULL ELSE 30.0 + 5 * (f % 7) END AS planned, count(*) FILTER (WHERE category <> 'None') AS advisories, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE category = 'Mechanical') AS mechanical FROM fz GROUP BY well_id, f, formation),
  cp AS (SELECT *, (rop - planned) / planned * 100 AS delta, CASE WHEN planned IS NULL THEN 'no_plan_data' WHEN (rop - planned) / planned * 100 > 10 THEN 'exceeded_plan' WHEN (rop - planned) / planned * 100 < -10 THEN 'below_plan' ELSE 'met_plan' END AS assessment FROM cp0)"""
L = knowledge.NARRATIVE


def line(name: str, *args: str) -> str:
    return f"printf('{L[name]}', {', '.join(args)})"


NARRATIVE_SQL = MET + ", " + COMPARED_SQL + f""",
  su AS (SELECT well_id, {line('summary', 'CAST(well_id AS VARCHAR)', 'max(bit_depth)', 'count(*) / 100.0', "count(DISTINCT formation)", "count(*) FILTER (WHERE category <> 'None')")} AS t FROM fz GROUP BY 1),
  pf AS (SELECT well_id, string_agg({line('formation', 'formation', 'top', 'base', 'rop', "CASE WHEN planned IS NULL THEN 'N/A (no plan data)' ELSE printf('%.1f ft/hr (planned)', planned) END", "CASE WHEN delta IS NULL THEN 'N/A' WHEN delta > 0 THEN printf('+%.1f%%', delta) ELSE printf('%.1f%%', delta) END", "CASE assessment WHEN 'exceeded_plan' THEN 'EXCEEDED PLAN' WHEN 'met_plan' THEN 'MET PLAN' WHEN 'below_plan' THEN 'BELOW PLAN' ELSE 'NO PLAN DATA' END", 'advisories', 'critical')}, chr(10) ORDER BY top) AS t FROM cp GROUP BY 1),
  ce AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY ts, seq) AS n FROM fz WHERE severity = 'CRITICAL'),
  ch AS (SELECT well_id, {line('critical', 'count(*)')} || string_agg(CASE WHEN n <= 5 THEN chr(10) || {line('at', 'bit_depth', 'formation', 'category')} ELSE '' END, '' ORDER BY n) AS t FROM ce GROUP BY 1),
  mh AS (SELECT well_id, {line('mechanical', 'count(*)')} AS t FROM fz WHERE category = 'Mechanical' GROUP BY 1),
  fb AS (SELECT well_id, count(*) AS advisories, count(*) FILTER (WHERE seq % 3 <> 0) AS rated, count(*) FILTER (WHERE seq % 6 IN (1, 2)) AS ok, count(*) FILTER (WHERE seq % 6 = 4) AS bad, count(*) FILTER (WHERE seq % 6 = 5) AS unclear FROM fz WHERE category <> 'None' GROUP BY 1),
  ft AS (SELECT well_id, {line('rated', 'rated', 'advisories', 'rated * 100.0 / advisories + 1.234e-6')} || chr(10) || {line('rate', 'ok * 100.0 / greatest(ok + bad, 1) + 1.234e-6', 'ok', 'bad', 'unclear')} || CASE WHEN ok < 0.5 * (ok + bad) AND rated >= 10 THEN chr(10) || '{L['suggest']}' ELSE '' END AS t FROM fb WHERE rated > 0),
  up AS (SELECT well_id, string_agg({line('worked', 'formation', 'delta', 'rop', 'planned', 'wob', 'rpm')}, chr(10) ORDER BY top) AS t FROM cp WHERE assessment = 'exceeded_plan' GROUP BY 1),
  dn AS (SELECT well_id, string_agg({line('fell', 'formation', 'abs(delta)', 'rop', 'planned')} || CASE WHEN mechanical > 0 THEN {line('blamed', 'mechanical')} ELSE '' END, chr(10) ORDER BY top) AS t FROM cp WHERE assessment = 'below_plan' GROUP BY 1)
  SELECT s.well_id, concat_ws(chr(10) || chr(10), '## Summary' || chr(10) || chr(10) || s.t, '## Formation Performance' || chr(10) || chr(10) || pf.t, CASE WHEN ch.t IS NOT NULL OR mh.t IS NOT NULL THEN '## Advisory Timeline Highlights' || chr(10) || chr(10) || concat_ws(chr(10), ch.t, mh.t) END, '## Feedback Summary' || chr(10) || chr(10) || ft.t,
    CASE WHEN up.t IS NOT NULL OR dn.t IS NOT NULL THEN '## Lessons Learned' || chr(10) || chr(10) || concat_ws(chr(10), '**What worked:**' || chr(10) || up.t, chr(10) || '**Areas for improvement:**' || chr(10) || dn.t) END) AS narrative
  FROM su s LEFT JOIN pf USING (well_id) LEFT JOIN ch USING (well_id) LEFT JOIN mh USING (well_id) LEFT JOIN ft USING (well_id) LEFT JOIN up USING (well_id) LEFT JOIN dn USING (well_id)"""


@query(NARRATIVE_SQL)
def debrief_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each well's debrief as one text."""
    m = drilling_metrics(telemetry(spark, sf_dir))
    f = F.floor(F.col("bit_depth") / 270).cast("int")
    rows = m.withColumns({"f": f, "formation": F.concat(F.lit("F"), f.cast("string"))})
    planned = F.when(F.col("f") % 5 != 4, 30.0 + 5 * (F.col("f") % 7))
    compared = rows.groupBy("well_id", "formation", "f").agg(
        F.avg("rop").alias("rop"), F.max("wob").alias("wob"), F.max("rpm").alias("rpm"), F.count_if(F.col("category") != "None").alias("advisories"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("category") == "Mechanical").alias("mechanical")
    ).withColumns({"top": F.col("f") * 270.0, "base": F.col("f") * 270.0 + 270, "planned": planned})
    wells = rows.groupBy("well_id").agg(F.max("bit_depth").alias("depth"), (F.count("*") / 100.0).alias("hours"))
    timeline = rows.filter("category <> 'None'").select("well_id", "ts", "seq", "severity", "category", F.col("bit_depth").alias("depth"), "formation", F.col("category").alias("recommendation"))
    ratings = timeline.filter("seq % 3 <> 0").select("well_id", "seq", F.when(F.col("seq") % 6 < 3, "Confirmed").when(F.col("seq") % 6 == 4, "FalsePositive").otherwise("Unclear").alias("outcome"))
    return knowledge.narrative(wells, compared, timeline, ratings)


@query(MET + """, fx AS (SELECT seq, wob, rpm, flow_in, hardness FROM met WHERE state = 'Drilling'),
  sp AS (SELECT *, unnest(['wob', 'rpm', 'flow']) AS parameter, unnest([wob, rpm, flow_in]) AS current, unnest(CASE WHEN hardness < 3.5 THEN [5, 80, 400] WHEN hardness < 6 THEN [15, 80, 450] ELSE [20, 60, 500] END)::DOUBLE AS lo, unnest(CASE WHEN hardness < 3.5 THEN [10, 120, 500] WHEN hardness < 6 THEN [25, 110, 520] ELSE [30, 90, 550] END)::DOUBLE AS best, unnest(CASE WHEN hardness < 3.5 THEN [15, 160, 600] WHEN hardness < 6 THEN [35, 140, 600] ELSE [40, 120, 650] END)::DOUBLE AS hi, unnest([8.0, 100.0, 0.0])::DOUBLE AS offset_best FROM fx),
  tg AS (SELECT *, CASE WHEN current < lo THEN lo WHEN current > hi THEN hi WHEN offset_best BETWEEN lo AND hi AND offset_best > 0 THEN offset_best ELSE best END AS target FROM sp),
  im AS (SELECT *, abs(target - current) / (hi - lo) AS impact FROM tg WHERE abs(target - current) >= 0.05 * (hi - lo))
  SELECT seq, parameter, CAST(row_number() OVER (PARTITION BY seq ORDER BY round(impact, 9) DESC, parameter) AS INTEGER) AS place, round(current, 4) AS current, target AS recommended, round(impact, 6) AS impact FROM im""")
def optimiser_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations of drilling packets as rows, the largest change of its range first."""
    m = drilling_metrics(telemetry(spark, sf_dir)).filter("state = 'Drilling'")
    found = advisories.recommendations(m, tickets.default_parameters(F.col("hardness")), {"wob": 8.0, "rpm": 100.0, "flow": 0.0})
    return found.select("seq", "parameter", "place", r(F.col("current"), "current", 4), "recommended", r(F.col("impact"), "impact"))


@query(RP + "SELECT id, '[created] ' || category || ' at ' || risk || ' -> [verified] ' || outcome || CASE WHEN outcome = 'Escalated' THEN ' -> [strategic] sent' ELSE '' END AS trace FROM rp")
def trace_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What befell each ticket, in one line."""
    step = lambda stage, message: F.struct(F.lit(stage).alias("stage"), F.lit("ok").alias("status"), message.alias("message"))
    steps = F.array(step("created", F.concat_ws(" at ", "category", "risk")), step("verified", F.col("outcome")), F.when(F.col("outcome") == "Escalated", step("strategic", F.lit("sent"))))
    return report_rows(spark, sf_dir).select("id", tickets.trace_line(F.filter(steps, lambda s: s.isNotNull())).alias("trace"))


@query(RP + "SELECT field, well, id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY field, well ORDER BY ts DESC, id DESC) AS INTEGER) AS place FROM rp) a WHERE place <= 3")
def newest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest snapshots of each well, ties to the larger id."""
    return knowledge.snapshots_by_rank(report_rows(spark, sf_dir), 3).select("field", "well", "id", "place")


@query("""WITH pl AS (SELECT p_partkey, p_name || ' ' || p_partkey AS name, p_type AS lithology, CAST(p_size % 10 AS DOUBLE) AS hardness, p_brand AS hazards, p_partkey * 10.0 AS top FROM part)
  SELECT name, 'geology' AS place, lithology AS word, hardness AS value FROM pl UNION ALL SELECT name, 'depths', NULL, top FROM pl UNION ALL SELECT name, 'parameters', NULL, 10 + hardness FROM pl""")
def migrated_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat well plan taken apart into geology, depths and parameters."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("lithology"), (F.col("p_size") % 10).cast("double").alias("hardness"), F.col("p_brand").alias("hazards"), (F.col("p_partkey") * 10.0).alias("top"), (F.col("p_partkey") * 10.0 + 10).alias("base"),
        F.lit(9.0).alias("pore_pressure"), F.lit(14.0).alias("fracture_gradient"), (10 + F.col("p_size") % 10).cast("double").alias("wob"), F.lit(100.0).alias("rpm"),
    )
    geology, depths, parameters = advisories.plan_tables(p)
    one = lambda df, place, word, value: df.select("name", F.lit(place).alias("place"), word.cast("string").alias("word"), value.cast("double").alias("value"))
    return one(geology, "geology", F.col("lithology"), F.col("hardness")).unionByName(one(depths, "depths", F.lit(None), F.col("top"))).unionByName(one(parameters, "parameters", F.lit(None), F.col("wob")))


