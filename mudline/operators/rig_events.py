"""What a rig's packets set off, as one list of events a well: tickets, damping, recommendations, critical advisories, look-ahead, summaries.

``Rig.step`` takes packets in order of (ts, seq); ``Rig.due`` gives what happens
by the clock alone: an advice on damping that nothing answers escalates after
120 s, and a summary is due 600 s after the last one.  Both are event time: what is
due happens after all packets up to that second and before any later one, so a
batch over sorted wells and a stream with timers give the same events.  A well
without packets since its last summary is silent until the next packet.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from mudline.operators.advisories import CriticalCooldown
from mudline.operators.kernels import DampingMonitor, RateLimiter, TicketGate, in_order, places

SCHEMA = "well_id long, at long, kind string, name string, value double, detail string"
#: Parameters whose recommendations are limited, each on its own; seconds between summaries; seconds until a damping advice escalates (fixed values).
PARAMETERS, SUMMARY, ESCALATION = ("wob", "rpm", "flow_in"), 600, 120
#: What a packet must hold besides what the gate reads.
READS = tuple(dict.fromkeys((*TicketGate.reads, "cv", *PARAMETERS, "rop", "mse", "cascade_severity", "next_formation", "minutes")))


class Rig:
    """State is a dictionary of plain values: ``gate``, ``damping``, ``critical``, ``rates`` by parameter, ``announced`` formations, ``summary``."""

    def __init__(self) -> None:
        self.gate, self.critical = TicketGate(), CriticalCooldown()
        self.damping = DampingMonitor()
        self.limits = {p: RateLimiter(p) for p in PARAMETERS}

    def start(self) -> dict[str, Any]:
        return {"gate": self.gate.start(), "damping": self.damping.start(), "critical": self.critical.start(), "rates": {}, "announced": {}, "summary": self.empty(None)}

    @staticmethod
    def empty(since: int | None) -> dict[str, Any]:
        return {"since": since, "n": 0, "rop": 0.0, "mse": 0.0, "top": 0.0, "tickets": 0}

    def next_due(self, s: dict[str, Any]) -> int | None:
        """The second at which something is due next."""
        times = []
        if s["damping"]["began"] is not None:
            times.append(s["damping"]["began"] + ESCALATION)
        if s["summary"]["n"]:
            times.append(s["summary"]["since"] + SUMMARY)
        return min(times) if times else None

    def due(self, s: dict[str, Any], until: int) -> list[tuple]:
        """What is due before ``until``, in order."""
        out = []
        while (at := self.next_due(s)) is not None and at < until:
            if s["damping"]["began"] is not None and s["damping"]["began"] + ESCALATION == at:
                out.append((at, "damping", "escalate", s["damping"]["cv"], ""))
                s["damping"] = self.damping.start()
                continue
            m = s["summary"]
            out.append((at, "summary", "rop", m["rop"] / m["n"], f"{m['n']} packets, {m['tickets']} tickets, depth {m['top']:.1f}"))
            s["summary"] = self.empty(at)
        return out

    def step(self, s: dict[str, Any], x: dict[str, Any]) -> list[tuple]:
        """What was due before this packet, then what it sets off."""
        ts = x["ts"]
        out = self.due(s, ts)
        ticket = self.gate.step(s["gate"], x)[0] == "ticket"
        if ticket:
            out.append((ts, "ticket", x["category"], x["bit_depth"], x["severity"]))
        if x["cascade_severity"] == "CRITICAL" and self.critical.step(s["critical"], x | {"severity": "CRITICAL"})[0]:
            out.append((ts, "critical", x["category"], x["bit_depth"], x["rule"]))
        # within the time the packet decides; what nothing answers is left to ``due``
        damping = self.damping.step(s["damping"], x)[0]
        if damping not in (None, "watch"):
            out.append((ts, "damping", damping, x["cv"], ""))
        for name, limit in self.limits.items():
            held = s["rates"].setdefault(name, limit.start())
            if limit.step(held, x)[0]:
                out.append((ts, "recommendation", name, x[name], ""))
        if x["next_formation"] is not None and x["minutes"] is not None and x["minutes"] <= 30 and x["next_formation"] not in s["announced"]:
            s["announced"][x["next_formation"]] = ts
            out.append((ts, "look_ahead", x["next_formation"], x["minutes"], ""))
        m = s["summary"]
        if not m["n"] and (m["since"] is None or ts > m["since"] + SUMMARY):
            m["since"] = ts
        s["summary"] = {"since": m["since"], "n": m["n"] + 1, "rop": m["rop"] + x["rop"], "mse": m["mse"] + x["mse"], "top": max(m["top"], x["bit_depth"]), "tickets": m["tickets"] + ticket}
        return out


def packets_of(frame: pd.DataFrame) -> Iterator[dict[str, Any]]:
    """Rows as dictionaries of plain values; missing texts and flags are None."""
    columns = [[None if v is pd.NA or (isinstance(v, float) and v != v) else v for v in frame[c].tolist()] for c in READS]
    for values in zip(*columns, strict=True):
        yield dict(zip(READS, values, strict=True))


def events(rows: DataFrame, until: int | None = None) -> DataFrame:
    """All events of sorted wells; ``until``: the second before which what is still due counts as happened."""
    rig = Rig()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        well, place, state = None, 0, rig.start()
        for b in batches:
            if b.empty:
                continue
            begins = set(places(b["_place"], place))
            place, out = int(b["_place"].iloc[-1]), []
            for i, (key, x) in enumerate(zip(b["well_id"].tolist(), packets_of(b), strict=True)):
                if i in begins:
                    out += [(well, *e) for e in rig.due(state, until)] if until and well is not None else []
                    well, state = key, rig.start()
                out += [(key, *e) for e in rig.step(state, x)]
            yield frame_of(out)
        if until and well is not None:
            yield frame_of([(well, *e) for e in rig.due(state, until)])

    return in_order(rows.select("well_id", "seq", *READS), "well_id", ("ts", "seq")).mapInPandas(run, SCHEMA)


def frame_of(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["well_id", "at", "kind", "name", "value", "detail"]).astype({"value": float})
