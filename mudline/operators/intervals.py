"""Adaptive conformal intervals of many metrics and wells at once: a kernel for ``lockstep``.

The same rules as ``kernels.Conformal``, for eleven metrics of every well in step:
windows are rings in one array, sorted once a step along their last axis, and
medians and radii are places in them.
"""

from __future__ import annotations

from typing import Any, ClassVar

import numpy as np


class Intervals:
    """Conformal intervals of eleven metrics: how many lie outside, and whether the trigger of the category does.

    ``steady`` says whether there are enough values for the count to change a
    severity.  Where baselines lock (``locks``) a well's windows begin anew.
    """

    #: Metrics with the least half width of their intervals (fixed values).
    LEAST: ClassVar[dict[str, float]] = {"mse": 5.0, "d_exponent": 0.05, "dxc": 0.05, "flow_balance": 5.0, "spp": 10.0, "torque": 0.5, "rop": 1.0, "wob": 0.5, "rpm": 2.0, "ecd": 0.02, "pit_rate": 1.0}
    METRICS: ClassVar[tuple[str, ...]] = tuple(LEAST)
    #: Metrics of which one must lie outside its interval for a category's ticket (fixed values).
    TRIGGERS: ClassVar[dict[str, tuple[str, ...]]] = {"Hydraulics": ("spp", "ecd"), "Mechanical": ("torque", "wob"), "DrillingEfficiency": ("mse",), "Formation": ("d_exponent", "dxc")}
    #: Values from which metrics count as calibrated, and from which an interval can be left (fixed values).
    ENOUGH, FEWEST = 20, 10
    schema = "outliers int, steady boolean, outlier boolean"
    reads = (*METRICS, "category", "locks")

    def __init__(self, window: int = 200, target: float = 0.1, gamma: float = 0.005):
        self.window, self.target, self.gamma = window, target, gamma
        self.least = np.array(list(self.LEAST.values()))
        self.triggers = np.array([[m in names for m in self.METRICS] for names in self.TRIGGERS.values()])
        self.category = {c: i for i, c in enumerate(self.TRIGGERS)}

    def start(self, slots: int = 1) -> dict[str, Any]:
        empty = lambda: np.full((slots, len(self.METRICS), self.window), np.inf)
        return {"values": empty(), "residuals": empty(), "by_value": empty(), "by_residual": empty(), "alpha": np.full((slots, len(self.METRICS)), self.target), "n": np.zeros(slots, np.int64)}

    def median(self, ordered: np.ndarray, n: np.ndarray) -> np.ndarray:
        rows = np.arange(len(n))
        low, high = ordered[rows, :, np.maximum(n - 1, 0) // 2], ordered[rows, :, np.minimum(n // 2, self.window - 1)]
        return np.where(n[:, None] > 0, (low + high) / 2, 0.0)

    def radius(self, ordered: np.ndarray, n: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        place = np.minimum(np.ceil(n[:, None] * np.clip(1 - alpha, 0.01, 0.999)).astype(np.int64), n[:, None] - 1)
        there = np.take_along_axis(ordered, np.maximum(place, 0)[:, :, None], axis=2)[:, :, 0]
        return np.where(n[:, None] > 0, there, 0.0)

    def observe(self, s: dict[str, Any], x: np.ndarray) -> np.ndarray:
        """Which metrics of ``x`` (a row a slot) lie outside, ``x`` being in the windows."""
        rows = np.arange(len(x))
        total, alpha = s["n"][: len(x)], s["alpha"][: len(x)]
        n = np.minimum(total, self.window)
        residual = np.abs(x - self.median(s["by_value"][: len(x)], n))
        missed = residual > self.radius(s["by_residual"][: len(x)], n, alpha)
        alpha[:] = np.clip(alpha + self.gamma * (self.target - missed), 0.001, 0.5)
        s["values"][rows, :, total % self.window] = x
        s["residuals"][rows, :, total % self.window] = residual
        total += 1
        n = np.minimum(total, self.window)
        for ring, ordered in (("values", "by_value"), ("residuals", "by_residual")):
            s[ordered][: len(x)] = np.sort(s[ring][: len(x)], axis=2)
        half = np.maximum(self.radius(s["by_residual"][: len(x)], n, alpha), self.least)
        return (np.abs(x - self.median(s["by_value"][: len(x)], n)) > half) & (n[:, None] >= self.FEWEST)

    def begin_anew(self, s: dict[str, Any], slots: np.ndarray) -> None:
        for k in ("values", "residuals", "by_value", "by_residual"):
            s[k][slots] = np.inf
        s["alpha"][slots], s["n"][slots] = self.target, 0

    def step(self, s: dict[str, Any], x: dict[str, np.ndarray]) -> dict[str, Any]:
        locks = np.flatnonzero(x["locks"].astype(bool))
        if locks.size:
            self.begin_anew(s, locks)
        out = self.observe(s, np.stack([x[m] for m in self.METRICS], axis=1).astype(np.float64))
        steady = s["n"][: len(out)] >= self.ENOUGH
        kind = [self.category.get(c) for c in x["category"]]
        own = [bool((out[i] & self.triggers[c]).any()) if c is not None and steady[i] else None for i, c in enumerate(kind)]
        return {"outliers": out.sum(1), "steady": steady, "outlier": own}


class Together:
    """Lock-step kernels one after the other in one pass, each with a state of its own."""

    def __init__(self, *kernels):
        self.kernels = kernels
        self.schema = ", ".join(k.schema for k in kernels)
        self.reads = tuple(dict.fromkeys(r for k in kernels for r in k.reads))

    def start(self, slots: int = 1) -> dict[str, Any]:
        return {type(k).__name__: k.start(slots) for k in self.kernels}

    def step(self, s: dict[str, Any], x: dict[str, np.ndarray]) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for k in self.kernels:
            out |= k.step(s[type(k).__name__], x)
        return out
