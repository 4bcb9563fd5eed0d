"""A rig's packets as one stateful stream: late and shuffled packets put in order, metrics, and all events of ``operators.rig_events``.

Two stateful operators with native columns between them:

1. ``Ordered`` holds packets until the watermark has passed them and gives them
   out in order of (ts, seq), each with the last active packet before it, the pit
   change and the variation of torque over the last 60 packets.  A packet that is
   later than the watermark allows is dropped by Spark, none else; one that comes
   twice is given out once.
2. Metrics and the cascade are the same column expressions that batches use.
3. ``RigProcessor`` takes the packets in order and keeps its state in typed parts
   (values, maps by category, parameter and formation).  What is due by the clock
   alone has an event-time timer, so it happens when the watermark passes it, with or without a
   further packet.

A restarted query goes on from the state store; events carry their own second, so
each is the same as in a batch over the whole feed.  ``to_tables`` deals them into
a table a kind.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from mudline.functions import tickets
from mudline.functions.states import ACTIVE
from mudline.operators.metrics import derived, with_state
from mudline.operators.rig_events import READS, SCHEMA, Rig, frame_of, packets_of
from mudline.streaming import live

#: Columns of the last active packet that metrics read, and packets over which torque varies (fixed values).
PREVIOUS, VARIATION, FEWEST = ("torque", "spp", "ts", "pit_volume", "wob", "rop"), 60, 5
ADDED = "place long, pit_change double, cv double, " + ", ".join(f"prev_{c} {'long' if c == 'ts' else 'double'}" for c in PREVIOUS)


class Ordered(StatefulProcessor):
    """Packets of a well in order, with what the packets before them add."""

    def __init__(self, columns: list[tuple[str, str]]):
        self.columns = columns
        self.names = [c for c, _ in columns]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a packet's place in time and its values as JSON: as many as the watermark holds back
        self.waiting = handle.getMapState("waiting", "ts long, seq long", "packet string")
        self.before = handle.getValueState("before", f"place long, pit double, torques string, {', '.join(f'{c} double' for c in PREVIOUS if c != 'ts')}, ts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for frame in rows:
            for values in zip(*(frame[c].tolist() for c in self.names), strict=True):
                x = dict(zip(self.names, values, strict=True))
                x = {k: v for k, v in x.items() if k != "event_time"}
                at = (int(x["ts"]), int(x["seq"]))
                self.waiting.updateValue(at, (json.dumps(x, default=float),))
                self.handle.registerTimer(at[0] * 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        # the first timer gives out all that the watermark has passed, the others of this batch find nothing
        passed = timerValues.getCurrentWatermarkInMs()
        ready = sorted(k for k in self.waiting.keys() if k[0] * 1000 <= passed)  # noqa: SIM118
        if not ready:
            return
        held = self.before.get()
        state = dict(zip(("place", "pit", "torques", *(c for c in PREVIOUS if c != "ts"), "ts"), held, strict=True)) if held else {"place": 0, "pit": None, "torques": "[]", **dict.fromkeys(PREVIOUS)}
        torques, out = json.loads(state["torques"]), []
        for at in ready:
            x = json.loads(self.waiting.getValue(at)[0])
            self.waiting.removeKey(at)
            state["place"] += 1
            torques = [*torques, x["torque"]][-VARIATION:]
            mean = float(np.mean(torques))
            pit = x["pit_volume"]
            x |= {f"prev_{c}": state[c] for c in PREVIOUS} | {
                "place": state["place"], "cv": float(np.std(torques)) / mean if len(torques) >= FEWEST and mean > 0 else 0.0,
                "pit_change": pit - state["pit"] if pit > 0 and state["pit"] is not None else 0.0, "event_time": pd.Timestamp(x["ts"], unit="s"),
            }
            if pit > 0:
                state["pit"] = pit
            if x["state"] in ACTIVE:
                state |= {c: x[c] for c in PREVIOUS}
            out.append(x)
        self.before.update((state["place"], state["pit"], json.dumps(torques), *(state[c] for c in PREVIOUS if c != "ts"), state["ts"]))
        yield pd.DataFrame(out)[[*self.names, *(part.split()[0] for part in ADDED.split(", "))]]

    def close(self) -> None:
        pass


class RigProcessor(StatefulProcessor):
    """``Rig`` with its state in typed parts and its clock as a timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rig = handle, Rig()
        self.counts = handle.getValueState("counts", "n long, founder int, pit_rate int, bypass int")
        self.cool = handle.getMapState("cool", "category string", "n long, depth double, ts long")
        self.sustained = handle.getMapState("sustained", "category string", "count int, depth double, normal int")
        self.damping = handle.getValueState("damping", "began long, cv double")
        self.critical = handle.getValueState("critical", "ts long")
        self.rates = handle.getMapState("rates", "parameter string", "ts long, value double")
        self.announced = handle.getMapState("announced", "formation string", "ts long")
        self.summary = handle.getValueState("summary", "since long, n long, rop double, mse double, top double, tickets long")

    def loaded(self) -> dict[str, Any]:
        s = self.rig.start()
        if n := self.counts.get():
            s["gate"] |= {"n": n[0], "run": {"founder": n[1], "pit_rate": n[2]}, "bypass": n[3]}
        s["gate"]["cool"] = {k[0]: list(v) for k, v in self.cool.iterator()}
        s["gate"]["sustained"] = {k[0]: {"count": v[0], "depth": v[1], "normal": v[2]} for k, v in self.sustained.iterator()}
        if d := self.damping.get():
            s["damping"] = {"began": d[0], "cv": d[1]}
        if c := self.critical.get():
            s["critical"] = {"ts": c[0]}
        s["rates"] = {k[0]: {"ts": v[0], "value": v[1]} for k, v in self.rates.iterator()}
        s["announced"] = {k[0]: v[0] for k, v in self.announced.iterator()}
        if m := self.summary.get():
            s["summary"] = dict(zip(("since", "n", "rop", "mse", "top", "tickets"), m, strict=True))
        return s

    def stored(self, s: dict[str, Any]) -> None:
        gate = s["gate"]
        self.counts.update((gate["n"], gate["run"].get("founder", 0), gate["run"].get("pit_rate", 0), gate["bypass"]))
        for k, v in gate["cool"].items():
            self.cool.updateValue((k,), tuple(v))
        for k, v in gate["sustained"].items():
            self.sustained.updateValue((k,), (v["count"], v["depth"], v["normal"]))
        self.damping.update((s["damping"]["began"], s["damping"]["cv"]))
        self.critical.update((s["critical"]["ts"],))
        for k, v in s["rates"].items():
            self.rates.updateValue((k,), (v["ts"], float(v["value"])))
        for k, v in s["announced"].items():
            self.announced.updateValue((k,), (v,))
        m = s["summary"]
        self.summary.update((m["since"], m["n"], float(m["rop"]), float(m["mse"]), float(m["top"]), int(m["tickets"])))
        if (at := self.rig.next_due(s)) is not None:
            self.handle.registerTimer(int(at) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        s, out = self.loaded(), []
        # what comes at once is in order already, but for how Spark laid it out
        frame = pd.concat(list(rows)).sort_values("place", ignore_index=True)
        for x in packets_of(frame):
            out += [(key[0], *e) for e in self.rig.step(s, x)]
        self.stored(s)
        yield frame_of(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        s = self.loaded()
        out = [(key[0], *e) for e in self.rig.due(s, expiredTimerInfo.getExpiryTimeInMs() // 1000 + 1)]
        if out:
            self.stored(s)
        yield frame_of(out)

    def close(self) -> None:
        pass


def judged(packets: DataFrame) -> DataFrame:
    """What ``Rig`` reads, from metrics: the ticket's base severity beside the cascade's word; no intervals and nets, whose rules then pass."""
    parts = {"category": "category", "flow_balance": "flow_balance", "pit_rate": "pit_rate", "ecd_margin": "ecd_margin", "spp_delta": "spp_delta", "torque_delta": "torque_delta", "efficiency": "mse_efficiency"}
    severity = tickets.base_severity({k: F.col(v) for k, v in parts.items()})[0]
    out = packets.withColumnRenamed("severity", "cascade_severity").withColumn("severity", severity)
    missing = {"outlier": F.lit(None).cast("boolean"), "net_ok": F.lit(True), "learning": F.lit(False), "next_formation": F.lit(None).cast("string"), "minutes": F.lit(None).cast("double")}
    return out.withColumns({k: v for k, v in missing.items() if k not in out.columns})


def in_order(packets: DataFrame, late: str = "30 seconds") -> DataFrame:
    """A stream of packets (``well_id``, ``ts``, ``seq`` and channels) in order, with what the packets before them add."""
    timed = with_state(packets).withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", late)
    columns = [(f.name, f.dataType.simpleString()) for f in timed.schema]
    schema = ", ".join([*(f"{c} {t}" for c, t in columns), ADDED])
    return timed.groupBy("well_id").transformWithStateInPandas(Ordered(columns), schema, "append", "EventTime", eventTimeColumnName="event_time")


def rig_events(packets: DataFrame, late: str = "30 seconds") -> DataFrame:
    """All events of a stream of packets."""
    metrics = judged(derived(in_order(packets, late))).select("well_id", "event_time", "place", "seq", *READS)
    return metrics.groupBy("well_id").transformWithStateInPandas(RigProcessor(), SCHEMA, "append", "EventTime")


def to_tables(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A table for each kind of event, each micro-batch once."""
    kinds = ("ticket", "damping", "recommendation", "critical", "look_ahead", "summary")
    return live.fan_out(events, {k: (lambda batch, k=k: batch.filter(F.col("kind") == k).drop("kind"), f"{folder}/{k}") for k in kinds}, checkpoint)
