"""Report stores as versioned tables: written in several commits, read back from the last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mudline.operators import stores
from mudline.operators.replicas import Replica
from mudline.operators.versions import Store
from mudline.plans.reading_queries import RP, WELL, report_rows
from mudline.registry import query
from mudline.shared import shared_dir

#: Hourly reports older than 400 days before this second are cleaned up.
NOW, AGE = 902_000_000, 400 * 86_400


def new_store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


@query(RP + f"""SELECT 'snapshots' AS place, field, well, id, ts FROM (SELECT *, row_number() OVER (PARTITION BY field, well ORDER BY ts DESC, id DESC) AS k FROM rp WHERE success) a WHERE k = 1
  UNION ALL SELECT 'hourly', field, well, id, ts FROM rp WHERE kind = 0 AND ts >= {NOW - AGE} UNION ALL SELECT 'daily', field, well, id, ts FROM rp WHERE kind = 1
  UNION ALL SELECT 'ml', field, well, id, ts FROM (SELECT *, row_number() OVER (PARTITION BY field, well, ts ORDER BY id DESC) AS k FROM rp) a WHERE k = 1 UNION ALL SELECT 'acks', field, well, id, ts FROM rp WHERE id % 11 = 0""")
def versioned_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores of reports after several commits: snapshots of successful ones (the newest a well), hourly ones less what is too old, daily ones, one ML report a well and second, acknowledgements."""
    rows, store = report_rows(spark, sf_dir), new_store(spark)
    kind = lambda k: rows.filter(F.col("kind") == k)
    store.commit({"hourly": kind(0), "daily": kind(1).filter("id % 2 = 0"), "snapshots": kind(0).limit(0), "ml": rows.limit(0)}, note={"by": "first"})
    for k in (1, 0, 2):
        store.put("snapshots", kind(k).filter("success"), WELL, "ts", "id")
        store.put("ml", kind(k), [*WELL, "ts"], "ts", "id")
    store.append("daily", kind(1).filter("id % 2 <> 0"))
    store.change(lambda s, v: {"hourly": stores.retain(s.read("hourly", v), "ts", F.lit(NOW), AGE)})
    for part in (0, 1):
        store.append("acks", rows.filter(f"id % 11 = 0 AND id % 2 = {part}"))
    names = ("snapshots", "hourly", "daily", "ml", "acks")
    tables = [store.read(n).select(F.lit(n).alias("place"), *WELL, "id", "ts") for n in names]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


@query(RP + "SELECT CAST(v AS INTEGER) AS version, count(id) AS n, coalesce(max(ts), 0) AS newest FROM (SELECT unnest([1, 2, 3]) AS v) x LEFT JOIN rp ON kind < v GROUP BY 1")
def store_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each version of a store held: old versions stay readable."""
    rows, store = report_rows(spark, sf_dir), new_store(spark)
    for k in range(3):
        store.append("reports", rows.filter(F.col("kind") == k))
    out = None
    for v in store.versions():
        one = store.read("reports", v).agg(F.count("id").alias("n"), F.coalesce(F.max("ts"), F.lit(0)).alias("newest")).select(F.lit(v).alias("version"), "n", "newest")
        out = one if out is None else out.unionByName(one)
    return out


#: Events that three replicas saw: the first one all, the others two thirds each, with later words of their own on some.
SEEN_SQL = """ev AS (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type AS kind FROM events),
  seen AS (SELECT id, t + CASE WHEN id % 6 = 0 THEN 2 ELSE 0 END AS modified, 'a' AS origin, kind, 'Pending' AS outcome FROM ev UNION ALL SELECT id, t + id % 5, 'b', kind, 'Resolved' FROM ev WHERE id % 3 <> 0 UNION ALL SELECT id, t + id % 4, 'c', kind, CASE WHEN id % 2 = 0 THEN 'Escalated' ELSE 'FalsePositive' END FROM ev WHERE id % 3 <> 1)"""


@query(f"WITH {SEEN_SQL}, last AS (SELECT id, arg_max(struct_pack(modified, origin, kind, outcome), struct_pack(modified, origin)) AS r FROM seen GROUP BY 1) SELECT replica, id, r.modified AS modified, r.origin AS origin, r.kind AS kind, r.outcome AS outcome FROM last, (SELECT unnest(['a', 'b', 'c']) AS replica) n")
def replicas_converge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three replicas after rounds of exchange in another order each: all hold the newest word on every event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").alias("kind"))
    words = {"a": ("true", "CASE WHEN id % 6 = 0 THEN 2 ELSE 0 END", "'Pending'"), "b": ("id % 3 <> 0", "id % 5", "'Resolved'"), "c": ("id % 3 <> 1", "id % 4", "CASE WHEN id % 2 = 0 THEN 'Escalated' ELSE 'FalsePositive' END")}
    made = {name: Replica(spark, f"{shared_dir(spark)}/replica-{uuid.uuid4().hex}", name) for name in words}
    for name, (which, later, outcome) in words.items():
        mine = events.filter(which).selectExpr("id", f"t + {later} AS modified", "kind", f"{outcome} AS outcome")
        # early words first, so that the exchange has changes to carry
        made[name].write(mine.filter("id % 7 <> 0"))
    made["b"].pull(made["a"])
    for name, (which, later, outcome) in words.items():
        made[name].write(events.filter(which).filter("id % 7 = 0").selectExpr("id", f"t + {later} AS modified", "kind", f"{outcome} AS outcome"))
    for me, other in ("cb", "ca", "ac", "ba", "ac"):
        made[me].pull(made[other])
    made["a"].tidy(2)
    parts = [r.rows().select(F.lit(n).alias("replica"), "id", "modified", "origin", "kind", "outcome") for n, r in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
