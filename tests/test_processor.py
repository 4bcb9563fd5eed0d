"""The streaming processor against the batch over the same packets: shuffled, late, repeated, restarted."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from mudline.operators import rig_events
from mudline.operators.metrics import drilling_metrics
from mudline.operators.windows import variation
from mudline.functions.frames import last_rows
from mudline.streaming import processor
from mudline.telemetry import NAMES, runs

COLUMNS = ["well_id", "ts", "seq", *NAMES, "bit_depth", "hole_depth"]


def batch(packets, until):
    m = drilling_metrics(packets).withColumn("cv", variation(F.col("torque"), last_rows(60), 5))
    return rig_events.events(processor.judged(m), until)


def rounded(rows):
    return Counter((r.well_id, r.at, r.kind, r.name, round(r.value, 6), r.detail) for r in rows)


def test_stream_equals_batch_on_a_shuffled_late_restarted_feed(spark, sf_dir, tmp_path):
    packets = runs(spark, sf_dir).select(*COLUMNS).filter("well_id < 3")
    rows = [r.asDict() for r in packets.collect()]
    end = max(r["ts"] for r in rows)
    # one packet a well far behind all others moves the watermark past what is still due
    last = [dict(next(r for r in rows if r["well_id"] == w), ts=end + 10_000, seq=10**9) for w in {r["well_id"] for r in rows}]
    rng = random.Random(5)
    rows = sorted(rows, key=lambda r: r["ts"] + rng.uniform(0, 25))  # late by up to 25 s
    parts = [rows[: len(rows) // 3], rows[len(rows) // 3 : len(rows) // 2], rows[len(rows) // 2 :] + rng.sample(rows[-20:], 5), last]
    schema = packets.schema
    (tmp_path / "in").mkdir()
    for n, part in enumerate(parts):
        spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in part], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
        # a query of its own for each part: it starts again from the checkpoint
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        processor.to_tables(processor.rig_events(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = [r for r in batch(packets, end + 10_000).collect()]
    got = []
    for kind in ("ticket", "damping", "recommendation", "critical", "look_ahead", "summary"):
        path = tmp_path / "out" / kind
        got += [r for r in spark.read.parquet(str(path)).withColumn("kind", F.lit(kind)).collect() if r.at < end + 10_000]
    assert rounded(got) == rounded(want)
    kinds = Counter((r.kind, r.name) if r.kind == "damping" else r.kind for r in want)
    assert {("damping", n) for n in ("advise", "success", "retract", "escalate")} <= set(kinds) and min(kinds["ticket"], kinds["recommendation"], kinds["summary"]) > 3


def packet(ts, **change):
    x = dict.fromkeys(rig_events.READS, 0.0) | {"state": "Drilling", "rule": "none", "category": "None", "severity": "Low", "cascade_severity": "NONE", "outlier": None, "net_ok": True, "learning": False, "next_formation": None, "minutes": None, "bit_depth": 1000.0, "wob": 10.0, "rpm": 100.0, "flow_in": 500.0}
    return x | {"ts": ts} | change


def test_what_is_due_happens_by_the_clock():
    rig = rig_events.Rig()
    s = rig.start()
    kinds = lambda events: [(at, kind, name) for at, kind, name, _, _ in events if kind != "recommendation"]
    assert kinds(rig.step(s, packet(100, cv=0.5))) == [(100, "damping", "advise")]
    assert rig.next_due(s) == 220 and kinds(rig.step(s, packet(220, cv=0.3))) == [(220, "damping", "success")]
    assert kinds(rig.step(s, packet(230, cv=0.5))) == [(230, "damping", "advise")]
    assert kinds(rig.due(s, 350)) == [] and kinds(rig.due(s, 351)) == [(350, "damping", "escalate")]
    assert kinds(rig.due(s, 701)) == [(700, "summary", "rop")] and rig.next_due(s) is None
    assert kinds(rig.step(s, packet(5000))) == [] and rig.next_due(s) == 5600
    assert kinds(rig.step(s, packet(5600, next_formation="B", minutes=29.0))) == [(5600, "look_ahead", "B")]
    assert kinds(rig.step(s, packet(5601, next_formation="B", minutes=1.0))) == [(5600, "summary", "rop")]


def test_rates_are_limited_for_each_parameter():
    rig = rig_events.Rig()
    s = rig.start()
    names = lambda x: sorted(name for _, kind, name, _, _ in rig.step(s, x) if kind == "recommendation")
    assert names(packet(0)) == ["flow_in", "rpm", "wob"] and names(packet(10)) == []
    assert names(packet(20, wob=12.0)) == ["wob"] and names(packet(300)) == ["flow_in", "rpm", "wob"]
