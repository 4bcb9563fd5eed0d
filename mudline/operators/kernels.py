"""Sequential rules per well: one step function each, run over sorted partitions or as stateful streams.

A kernel has a ``schema`` of what it adds, ``start()`` for a well's state (plain
JSON values) and ``step(state, row)`` for one packet.  In batch, rows stream
through tasks sorted by well and time, so memory holds one well's small state,
never a well's rows.  In a stream the same step runs under
``applyInPandasWithState`` with the state as JSON.
"""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Iterator
from typing import Any, ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plain(value: Any) -> Any:
    """State as JSON values; arrays keep their shape."""
    if isinstance(value, np.ndarray):
        return {"array": value.ravel().tolist(), "shape": list(value.shape), "kind": value.dtype.str}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value.item() if isinstance(value, np.generic) else value


def restored(value: Any) -> Any:
    if isinstance(value, dict):
        return np.array(value["array"], value["kind"]).reshape(value["shape"]) if set(value) == {"array", "shape", "kind"} else {k: restored(v) for k, v in value.items()}
    return [restored(v) for v in value] if isinstance(value, list) else value


class Kernel:
    schema: ClassVar[str] = ""
    reads: ClassVar[tuple[str, ...]] = ()

    def start(self) -> dict[str, Any]:
        return {}

    def step(self, s: dict[str, Any], x: dict[str, Any]) -> tuple:
        raise NotImplementedError


class DepthContinuity(Kernel):
    """Rejects jumps over 500 ft/hr (once the allowance exceeds a foot) and reversals over 50 ft while drilling, against the last accepted depth."""

    schema = "verdict string"
    reads = ("ts", "bit_depth", "state")

    def start(self) -> dict[str, Any]:
        return {"depth": None, "ts": None}

    def step(self, s: dict[str, Any], x: dict[str, Any]) -> tuple:
        depth, verdict = x["bit_depth"], "ok"
        if depth <= 0:
            return ("ok",)
        if s["depth"]:
            allowed = 500.0 * max(x["ts"] - s["ts"], 1) / 3600.0
            change = depth - s["depth"]
            if abs(change) > allowed and allowed > 1:
                verdict = "jump"
            elif change < -50 and x["state"] == "Drilling":
                verdict = "reversal"
        if verdict == "ok":
            s["depth"], s["ts"] = depth, x["ts"]
        return (verdict,)


class ConnectionGas(Kernel):
    """Gas before, at the peak of and after each pause in drilling; background by a slow moving mean."""

    schema = "pre_gas double, peak_gas double, post_gas double, above_background double, gas_trend double, trending boolean"
    reads = ("gas_units", "state")

    def start(self) -> dict[str, Any]:
        return {"last": 0.0, "paused": None, "background": None, "deltas": []}

    def step(self, s: dict[str, Any], x: dict[str, Any]) -> tuple:
        gas, drilling = x["gas_units"], x["state"] in ("Drilling", "Reaming")
        none = (None,) * 6
        if s["paused"] is None:
            if drilling:
                s["last"] = gas
                s["background"] = gas if s["background"] is None else 0.95 * s["background"] + 0.05 * gas
            else:
                s["paused"] = [s["last"], gas]
            return none
        if not drilling:
            s["paused"][1] = max(s["paused"][1], gas)
            return none
        pre, peak = s["paused"]
        s["paused"], s["last"] = None, gas
        s["deltas"] = [*s["deltas"], peak - pre][-10:]
        trend = slope(s["deltas"])
        return (pre, peak, gas, max(peak - (s["background"] or 0.0), 0.0), trend, len(s["deltas"]) >= 5 and trend > 0.1)


def slope(values: list[float]) -> float:
    """Least-squares slope against the place, by running means and a fused co-moment as DuckDB has it, so that slopes at a limit fall to the same side."""
    mean = moment = spread = 0.0
    for n, v in enumerate(values, 1):
        mean += (v - mean) / n
        moment = math.fma(n / 2, v - mean, moment)
        spread += n * (n - 1) / 4
    return (moment / n) / (spread / n) if len(values) > 1 else 0.0


class BitWear(Kernel):
    """Energy per 100 drilled feet over the optimum at the bucket's hardness, against the first bucket; a bucket starts anew where the formation changes."""

    schema = "wear_index double, wear_advice string"
    reads = ("bit_depth", "mse", "hardness", "formation")

    def start(self) -> dict[str, Any]:
        return {"top": None, "hardness": 0.0, "sum": 0.0, "n": 0, "reference": None, "wear": 0.0, "formation": None}

    def step(self, s: dict[str, Any], x: dict[str, Any]) -> tuple:
        if x["formation"] != s["formation"]:
            s["top"], s["formation"] = None, x["formation"]
        if x["mse"] > 0 and x["bit_depth"] > 0:
            if s["top"] is None:
                s.update(top=x["bit_depth"], hardness=x["hardness"], sum=0.0, n=0)
            s["sum"] += x["mse"]
            s["n"] += 1
            if x["bit_depth"] - s["top"] >= 100:
                level = s["sum"] / s["n"] / (5000 + s["hardness"] * 8000)
                s["reference"] = s["reference"] or level
                s["wear"] = max((level - s["reference"]) / s["reference"], 0.0)
                s["top"] = None
        w = s["wear"]
        return (w, "pull" if w > 0.8 else "inspect" if w > 0.5 else "watch" if w > 0.3 else None)


class Conformal(Kernel):
    """Adaptive conformal interval of one channel over its last 200 values, with feedback on the miss rate."""

    schema = "lower double, upper double, is_outlier boolean, deviation double, coverage double"

    def __init__(self, channel: str, window: int = 200, target: float = 0.1, gamma: float = 0.005, least: float = 0.0, floor: float | None = None):
        self.channel, self.window, self.target, self.gamma, self.least, self.floor = channel, window, target, gamma, least, floor
        self.reads = (channel,)  # type: ignore[misc]

    def start(self) -> dict[str, Any]:
        return {"values": [], "residuals": [], "by_value": [], "by_residual": [], "alpha": self.target, "hits": 0, "n": 0}

    @staticmethod
    def median(ordered: list[float]) -> float:
        n = len(ordered)
        return 0.0 if not n else ordered[n // 2] if n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) / 2

    @staticmethod
    def radius(ordered: list[float], alpha: float) -> float:
        return ordered[min(math.ceil(len(ordered) * min(max(1 - alpha, 0.01), 0.999)), len(ordered) - 1)] if ordered else 0.0

    def push(self, values: list[float], ordered: list[float], v: float) -> None:
        values.append(v)
        bisect.insort(ordered, v)
        if len(values) > self.window:
            del ordered[bisect.bisect_left(ordered, values.pop(0))]

    def step(self, s: dict[str, Any], x: dict[str, Any]) -> tuple:
        v = x[self.channel]
        residual = abs(v - self.median(s["by_value"]))
        missed = residual > self.radius(s["by_residual"], s["alpha"])
        s["alpha"] = min(max(s["alpha"] + self.gamma * (self.target - missed), 0.001), 0.5)
        s["n"] += 1
        s["hits"] += not missed
        self.push(s["values"], s["by_value"], v)
        self.push(s["residuals"], s["by_residual"], residual)
        mid, half = self.median(s["by_value"]), max(self.radius(s["by_residual"], s["alpha"]), self.least)
        away, lower = abs(v - mid), mid - half
        if self.floor is not None:
            lower = max(lower, self.floor)
        return (lower, mid + half, away > half and len(s["residuals"]) >= 10, away / half if half > 1e-10 else 0.0, s["hits"] / s["n"])


class Regimes(Kernel):
    """Online k-means: four centres from the first four distinct points, then a slow pull towards each point; ``centres``: also all of them as they stand."""

    def __init__(self, channels: tuple[str, ...], k: int = 4, rate: float = 0.01, centres: bool = False):
        self.reads, self.k, self.rate, self.centres = channels, k, rate, centres  # type: ignore[misc]
        self.schema = "regime int" + (", centres array<array<double>>" if centres else "")  # type: ignore[misc]

    def start(self) -> dict[str, Any]:
        return {"centres": []}

    def step(self, s: dict[str, Any], x: dict[str, Any]) -> tuple:
        p, c = [x[r] for r in self.reads], s["centres"]
        gap = [sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in c]
        full, best = len(c) == self.k, 0
        if not full:
            if all(g > 1e-12 for g in gap):
                c.append(p)
                gap.append(0.0)
            best = gap.index(min(gap)) if len(c) == self.k else 0
        else:
            best = gap.index(min(gap))
            c[best] = [b + self.rate * (a - b) for a, b in zip(p, c[best], strict=True)]
        return (best, [list(q) for q in c]) if self.centres else (best,)


class TransitionDetector(Kernel):
    """A formation change: three features beyond two sigmas for five packets on end, and no active advisory (``advised``)."""

    schema = "transition boolean"

    def __init__(self, features: tuple[str, ...], sigma: float = 2.0, least: int = 3, packets: int = 5):
        self.features, self.sigma, self.least, self.packets = features, sigma, least, packets
        self.reads = (*features, "advised")  # type: ignore[misc]

    def start(self) -> dict[str, Any]:
        return {"run": 0}

    def step(self, s: dict[str, Any], x: dict[str, Any]) -> tuple:
        s["run"] = s["run"] + 1 if sum(x[f] > self.sigma for f in self.features) >= self.least else 0
        fires = s["run"] >= self.packets and not x["advised"]
        if fires:
            s["run"] = 0
        return (fires,)


class TicketGate(Kernel):
    """Which anomalies become tickets: mode, state, cooldown in packets, depth and event time, progressive depth throttle, corroboration by intervals and by the nets, debounce.

    ``severity`` is the ticket's (``tickets.base_severity``, adjusted), not the
    cascade's word.  ``outlier`` says whether the trigger's own metric lies outside
    its conformal interval, ``net_ok`` whether the calibrated nets score 0.4 or
    more; NULL lets a ticket pass the interval rule and fails the net rule.  Well
    control passes both.  While a well is ``learning`` its counters run and no ticket
    is made; the throttle forgets over drilling packets alone.  After a restart the
    first ``bypass`` anomalies pass the interval rule unseen.  Time is event time, so
    replays give the same tickets.
    """

    schema = "gate string"
    reads = ("ts", "bit_depth", "state", "rule", "category", "severity", "outlier", "net_ok", "learning")

    def __init__(self, bypass: int = 0):
        self.bypass = bypass

    def start(self) -> dict[str, Any]:
        return {"n": 0, "cool": {}, "sustained": {}, "run": {}, "bypass": self.bypass}

    def step(self, s: dict[str, Any], x: dict[str, Any]) -> tuple:
        s["n"] += 1
        category, depth = x["category"], x["bit_depth"]
        for rule in ("founder", "pit_rate"):
            s["run"][rule] = s["run"].get(rule, 0) + 1 if x["rule"] == rule else 0
        cutting = x["state"] in ("Drilling", "Reaming")
        for name, t in s["sustained"].items() if cutting else ():
            t["normal"] = 0 if name == category else t["normal"] + 1
            if t["normal"] >= 500:
                t["count"] = 0
        if x["learning"]:
            return ("learning",)
        if depth <= 0:
            return ("no_depth",)
        if not cutting:
            return ("state",)
        if category == "None":
            return ("normal",)
        packets, feet, seconds = (20, 10.0, 0) if x["severity"] == "Critical" else (50, 50.0, 60)
        if last := s["cool"].get(category):
            if s["n"] - last[0] < packets and abs(depth - last[1]) < feet and x["ts"] - last[2] < max(seconds, 1):
                return ("cooldown",)
        well, sustained = category == "WellControl", s["sustained"].get(category)
        if not well and sustained and sustained["count"] >= 3 and abs(depth - sustained["depth"]) < min(feet * 2.0 ** (sustained["count"] - 3), 500.0):
            return ("throttled",)
        if s["bypass"] > 0:
            s["bypass"] -= 1
        elif not well and x["outlier"] is False:
            return ("no_interval",)
        if not well and x["net_ok"] is not True:
            return ("no_net",)
        if s["run"].get(x["rule"], 3) < 3:
            return ("debounce",)
        s["cool"][category] = [s["n"], depth, x["ts"]]
        s["sustained"][category] = {"count": (sustained["count"] if sustained else 0) + 1, "depth": depth, "normal": 0}
        return ("ticket",)


class RateLimiter(Kernel):
    """Recommendations pass after 300 s, or at once where the value moved by over 10 %."""

    schema = "allowed boolean"

    def __init__(self, channel: str, seconds: int = 300, change: float = 0.10):
        self.reads, self.channel, self.seconds, self.change = ("ts", channel), channel, seconds, change  # type: ignore[misc]

    def start(self) -> dict[str, Any]:
        return {"ts": None, "value": 0.0}

    def step(self, s: dict[str, Any], x: dict[str, Any]) -> tuple:
        v = x[self.channel]
        free = s["ts"] is None or x["ts"] - s["ts"] >= self.seconds or abs(v - s["value"]) > self.change * max(abs(s["value"]), 1e-6)
        if free:
            s["ts"], s["value"] = x["ts"], v
        return (free,)


class DampingMonitor(Kernel):
    """Follows a damping advice: success at 20 % less variation, retraction at 15 % more, escalation after 120 s."""

    schema = "damping string"
    reads = ("ts", "cv")

    def start(self) -> dict[str, Any]:
        return {"began": None, "cv": 0.0}

    def step(self, s: dict[str, Any], x: dict[str, Any]) -> tuple:
        if s["began"] is None:
            if x["cv"] > 0.15:
                s["began"], s["cv"] = x["ts"], x["cv"]
                return ("advise",)
            return (None,)
        change = (x["cv"] - s["cv"]) / s["cv"]
        out = "success" if change <= -0.20 else "retract" if change >= 0.15 else "escalate" if x["ts"] - s["began"] >= 120 else "watch"
        if out != "watch":
            s["began"] = None
        return (out,)


class Debounce(Kernel):
    """A label that changes only after three packets on end agree."""

    schema = "steady string"

    def __init__(self, channel: str, packets: int = 3):
        self.reads, self.channel, self.packets = (channel,), channel, packets  # type: ignore[misc]

    def start(self) -> dict[str, Any]:
        return {"now": None, "next": None, "run": 0}

    def step(self, s: dict[str, Any], x: dict[str, Any]) -> tuple:
        v = x[self.channel]
        if s["now"] is None:
            s["now"] = v
        if v == s["now"]:
            s["next"], s["run"] = None, 0
        else:
            s["run"] = s["run"] + 1 if v == s["next"] else 1
            s["next"] = v
            if s["run"] >= self.packets:
                s["now"], s["next"], s["run"] = v, None, 0
        return (s["now"],)


def names_of(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def over(state: dict[str, Any], kernel: Kernel, frame: pd.DataFrame) -> list[tuple]:
    columns = [frame[c].tolist() for c in kernel.reads]
    return [kernel.step(state, dict(zip(kernel.reads, values, strict=True))) for values in zip(*columns, strict=True)]


def in_order(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``_place`` (from 1) in their key's order, so that each key's rows stand side by side and sorted.

    The row number's own shuffle and sort are those of earlier windows on the key,
    so a kernel adds none.  Kernels check the places that they read.
    """
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def places(column: pd.Series | np.ndarray, before: int) -> list[int]:
    """Row places that begin a key; fails where a row does not follow the one before."""
    at = np.asarray(column)
    follows = np.append(before, at[:-1]) + 1 == at
    if not (follows | (at == 1)).all():
        raise RuntimeError("rows of a key are not in order")
    return np.flatnonzero(at == 1).tolist()


def apply(rows: DataFrame, kernel: Kernel, key: str = "well_id", order: tuple[str, ...] = ("ts", "seq"), keep: tuple[str, ...] = ()) -> DataFrame:
    """``kernel`` over each key's rows in order, rows streamed: the memory of one key's state."""
    columns = list(dict.fromkeys([key, *order, *keep, *kernel.reads]))
    added = names_of(kernel.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, state = 0, kernel.start()
        for b in batches:
            if b.empty:
                continue
            begins = places(b["_place"], place)
            place = int(b["_place"].iloc[-1])
            out: list[tuple] = []
            for a, z in zip([0, *begins], [*begins, len(b)], strict=True):
                if a in begins:
                    state = kernel.start()
                if a < z:
                    out += over(state, kernel, b.iloc[a:z])
            yield pd.concat([b.drop(columns="_place").reset_index(drop=True), pd.DataFrame(out, columns=added)], axis=1)

    picked = rows.select(*columns)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema), kernel.schema])
    return in_order(picked, key, order).mapInPandas(run, schema)


def apply_stream(rows: DataFrame, kernel: Kernel, key: str = "well_id", order: tuple[str, ...] = ("ts", "seq"), keep: tuple[str, ...] = ()) -> DataFrame:
    """The same kernel over a stream; each micro-batch is sorted per key, state lives in the state store."""
    columns = list(dict.fromkeys([key, *order, *keep, *kernel.reads]))
    added = names_of(kernel.schema)

    def run(_: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = restored(json.loads(held.get[0])) if held.exists else kernel.start()
        rows_ = pd.concat(list(frames)).sort_values(list(order), ignore_index=True)
        out = over(state, kernel, rows_)
        held.update((json.dumps(plain(state)),))
        yield pd.concat([rows_, pd.DataFrame(out, columns=added)], axis=1)

    picked = rows.select(*columns)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema), kernel.schema])
    return picked.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")
