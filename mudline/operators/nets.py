"""Liquid networks trained online per well, the wells of a task in lock step: one tensor a parameter, one step a packet of each.

A net has sensory, inter, command and motor neurons over a sparse random wiring.
A neuron past the sensory ones is a closed-form continuous-time cell: from its
sources s it takes tau = softplus(a), f = sigmoid(-dt tau b), g = tanh(c), each of
a, b, c a weighted sum of s, and becomes f g + (1 - f) h.  Command neurons also
see their own last values.  Every packet trains the net on what it should have
predicted, by gradients through the last ``depth`` steps (each further step
counts ``decay`` times less), clipped and applied by Adam with a falling rate.

All parameters of a well are one row of a matrix, those of all wells are one
matrix, and the parts that a product needs are views of it; so forward, backward
and Adam are batched products over all wells that have a packet at this step.
Wells are stacked longest first, so those still running are always the first rows.

A fast and a slow net run side by side and the higher surprise counts; a third
one works on depth-ahead features.  What they say goes on through the same task:
motor values to regimes, surprises to formation transitions, and transitions back
to the third net, which then forgets its state.  Seeds are this engine's own, so
values are held by properties (gradients against differences, learning, one well
alone against many in step), not by other engines' values.
"""

from __future__ import annotations

import re
from typing import Any, ClassVar

import numpy as np

#: Features of the nets, in order; the first eight feed two sensory neurons each and weigh double in the loss (fixed values).
FEATURES = ("wob", "rop", "rpm", "torque", "mse", "spp", "d_exponent", "hook_load", "ecd", "flow_balance", "pit_rate", "dxc", "pump_spm", "mud_weight_in", "gas_units", "pit_volume")
#: Features of the depth-ahead net; the other eight are zero (fixed values).
AHEAD = ("wob", "rop", "rpm", "torque", "mse", "d_exponent", "depth_into", "formation_hardness")
#: Neurons by group: sensory, inter, command, motor (fixed values).
GROUPS = (24, 20, 12, 8)
WEIGHT = np.array([2.0] * 8 + [1.0] * 8)
#: Regimes, their pull towards a point, and the squared distance from which points count as two (fixed values).
REGIMES, PULL, DISTINCT = 4, 0.01, 1e-12


def softplus(x: np.ndarray) -> np.ndarray:
    return np.where(x > 20, x, np.log1p(np.exp(np.minimum(x, 20))))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class Nets:
    """Networks of one kind, a slot a well; their state is a dictionary of arrays whose first axis is the slot.

    All slots begin alike.  A call names the slots that have a packet by their
    number n: slots 0 to n - 1.
    """

    #: Depth, decay of further steps, first rate, its factor and floor, weight of new errors, packets until calibrated (fixed values).
    KINDS: ClassVar[dict[str, tuple]] = {
        "fast": (4, 0.7, 1e-3, 0.9999, 1e-4, 0.01, 300),
        "slow": (8, 0.85, 1e-4, 0.9999, 1e-5, 0.005, 500),
        "ahead": (6, 0.75, 5e-4, 0.9999, 5e-5, 0.008, 500),
    }
    #: Slots that Adam moves at a time.
    BLOCK = 32
    PER_FEATURE: ClassVar[tuple[str, ...]] = ("errors", "squares", "last")
    PER_NET: ClassVar[tuple[str, ...]] = ("mean", "square", "rmse")

    def __init__(self, kind: str, seed: int, n_in: int = 16, groups: tuple[int, int, int, int] = GROUPS):
        self.depth, self.decay, self.rate, self.fall, self.floor, self.mix, self.calibrated = self.KINDS[kind]
        self.seed, self.n_in, self.groups = seed, n_in, groups
        self.taps = np.concatenate([np.repeat(np.arange(n_in // 2), 2), np.arange(n_in // 2, n_in)])
        self.weight = WEIGHT[:n_in] / WEIGHT[:n_in].sum()
        # where each part lies among a well's parameters; a group's three gates and their biases are one matrix
        shapes = [("in", (1, len(self.taps)))] + [(g, (3 * groups[g], groups[g - 1] + (groups[g] if g == 2 else 0) + 1)) for g in (1, 2, 3)] + [("out", (n_in, groups[3] + 1))]
        self.places, at = {}, 0
        for name, (rows, columns) in shapes:
            self.places[name] = (at, at + rows * columns, rows, columns)
            at += rows * columns
        self.n_params = at
        self.first, self.mask = self.drawn()
        # Adam keeps moments of what the wiring has, about a third of all places
        self.live = np.flatnonzero(self.mask[0])
        self.held: dict[str, np.ndarray] = {}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array to write into that is used again at the next step; its values are whatever was left there."""
        held = self.held.get(name)
        if held is None or held.shape[0] < shape[0] or held.shape[1:] != shape[1:]:
            held = self.held[name] = np.zeros(shape)
        return held[: shape[0]]

    def part(self, flat: np.ndarray, name: Any) -> np.ndarray:
        """A part of all parameters as a matrix a slot; a view."""
        a, z, rows, columns = self.places[name]
        return flat[:, a:z].reshape(len(flat), rows, columns)

    def wiring(self) -> list[np.ndarray]:
        """Which sources each group sees: 30 % of the group before, and 15 % of itself for command neurons; one at least."""
        r = np.random.default_rng(self.seed)
        out = []
        for g in (1, 2, 3):
            mask = r.random((self.groups[g], self.groups[g - 1])) < 0.3
            mask[np.arange(len(mask)), r.integers(0, mask.shape[1], len(mask))] = True
            if g == 2:
                mask = np.concatenate([mask, r.random((self.groups[2], self.groups[2])) < 0.15], axis=1)
            out.append(mask)
        return out

    def drawn(self) -> tuple[np.ndarray, np.ndarray]:
        """First parameters, and which of them there are (the wiring; biases and outputs always)."""
        r = np.random.default_rng(self.seed + 1)
        first, mask = np.zeros((1, self.n_params)), np.ones((1, self.n_params))
        self.part(first, "in")[:] = r.normal(0, 1, len(self.taps))
        for g, wired in enumerate(self.wiring(), 1):
            scale = 1 / np.sqrt(np.maximum(wired.sum(1, keepdims=True), 1))
            n = self.groups[g]
            for gate in range(3):
                self.part(first, g)[0, gate * n : (gate + 1) * n, :-1] = wired * r.normal(0, 1, wired.shape) * scale
                self.part(mask, g)[0, gate * n : (gate + 1) * n, :-1] = wired
        self.part(first, "out")[0, :, :-1] = r.normal(0, 1 / np.sqrt(self.groups[3]), (self.n_in, self.groups[3]))
        return first, mask

    def start(self, slots: int = 1) -> dict[str, Any]:
        s: dict[str, Any] = {"w": np.repeat(self.first, slots, axis=0), "m": np.zeros((slots, len(self.live))), "v": np.zeros((slots, len(self.live))), "rate": np.full(slots, self.rate)}
        s |= {k: np.zeros((slots, self.n_in)) for k in self.PER_FEATURE} | {k: np.zeros(slots) for k in self.PER_NET} | {k: np.zeros(slots, np.int64) for k in ("n", "t", "kept")}
        return s | {f"h{g}": np.zeros((slots, self.groups[g])) for g in (1, 2, 3)} | {"steps": []}

    def forward(self, s: dict[str, Any], x: np.ndarray, dt: float = 1.0) -> np.ndarray:
        """Predictions after ``x`` (a row a slot); the step is kept for training."""
        n = len(x)
        w, one = s["w"][:n], np.ones((n, 1))
        source = x[:, self.taps] * self.part(w, "in")[:, 0]
        step: dict[str, Any] = {"x": x, "dt": dt}
        hidden = []
        for g in (1, 2, 3):
            seen = np.concatenate([source, s["h2"][:n], one] if g == 2 else [source, one], axis=1)
            a, b, c = np.split(np.matmul(self.part(w, g), seen[:, :, None])[:, :, 0], 3, axis=1)
            tau = softplus(a)
            f, top, old = sigmoid(-dt * tau * b), np.tanh(c), s[f"h{g}"][:n]
            source = f * top + (1 - f) * old
            # how the value moves with a, b and c and with its last value: all that later steps ask of this one
            turn = (top - old) * f * (1 - f) * -dt
            step[f"g{g}"] = (seen, np.concatenate([turn * b * sigmoid(a), turn * tau, f * (1 - top * top)], axis=1), 1 - f)
            hidden.append(source)
        for g, h in enumerate(hidden, 1):
            s[f"h{g}"] = np.concatenate([h, s[f"h{g}"][n:]])
        step["motor"] = np.concatenate([source, one], axis=1)
        step["y"] = np.matmul(self.part(w, "out"), step["motor"][:, :, None])[:, :, 0]
        s["steps"] = [step, *s["steps"]][: self.depth]
        s["kept"][:n] = np.minimum(s["kept"][:n] + 1, self.depth)
        return step["y"]

    def gradients(self, s: dict[str, Any], target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each slot's weighted mean squared error of its last prediction, and its gradients through the steps kept."""
        grads = np.zeros((len(target), self.n_params))
        loss = self.backward(s, target, grads)
        return loss, grads * self.mask

    def backward(self, s: dict[str, Any], target: np.ndarray, grads: np.ndarray) -> np.ndarray:
        """Fills ``grads``, also where the wiring has nothing; returns the losses."""
        n = len(target)
        w, first, kept = s["w"][:n], s["steps"][0], len(s["steps"])
        e = first["y"][:n] - target
        dy = 2 * self.weight * e
        np.multiply(dy[:, :, None], first["motor"][:n, None, :], out=self.part(grads, "out"))
        # a slot that forgot has fewer steps
        scale = self.decay ** np.arange(kept) * (s["kept"][:n, None] > np.arange(kept))
        # group after group, each back through all steps: only command neurons, which see their own last values, need a product a step on the way
        down: np.ndarray | None = None
        for g in (3, 2, 1):
            sources, into, size = self.room(f"sources{g}", n, kept, self.places[g][3]), self.room(f"into{g}", n, kept, self.places[g][2]), self.groups[g]
            below = self.room("below", n, kept, self.groups[1]) if g == 2 else None
            # what the group's values owe to the steps after
            owed = np.matmul(dy[:, None, :], self.part(w, "out"))[:, 0, :-1] if g == 3 else 0.0
            for back, step in enumerate(s["steps"]):
                seen, slope, stays = (part[:n] for part in step[f"g{g}"])
                dh = owed if down is None else owed + down[:, back]
                np.multiply(slope.reshape(n, 3, size), dh[:, None, :], out=into[:, back].reshape(n, 3, size))
                sources[:, back] = seen
                owed = dh * stays
                if below is not None:
                    through = np.matmul(into[:, back, None, :], self.part(w, g))[:, 0]
                    below[:, back] = through[:, : self.groups[1]]
                    owed += through[:, self.groups[1] : -1]
            down = below if below is not None else np.matmul(into, self.part(w, g))[:, :, : self.groups[g - 1]]
            into *= scale[:, :, None]
            np.matmul(into.transpose(0, 2, 1), sources, out=self.part(grads, g))
        tapped = np.zeros((n, len(self.taps)))
        for back, step in enumerate(s["steps"]):
            tapped += scale[:, back, None] * down[:, back] * step["x"][:n, self.taps]
        self.part(grads, "in")[:, 0] = tapped
        return (self.weight * e * e).sum(1)

    def train(self, s: dict[str, Any], target: np.ndarray) -> np.ndarray:
        """One step of Adam for the slots that predicted something; returns the losses."""
        n = len(target)
        every = self.room("grads", n, self.n_params)
        loss = self.backward(s, target, every)
        live = s["kept"][:n] > 0
        which: Any = slice(0, n) if live.all() else np.flatnonzero(live)
        s["t"][which] += 1
        t = s["t"][:n]
        rate = s["rate"][:n] * np.sqrt(1 - 0.999**t) / np.maximum(1 - 0.9**t, 1e-300)
        # a few slots at a time, so that what they hold stays near the processor
        for at in range(0, n, self.BLOCK):
            block = slice(at, min(at + self.BLOCK, n))
            self.moved(s, block if live[block].all() else at + np.flatnonzero(live[block]), every, rate)
        s["rate"][which] = np.maximum(s["rate"][which] * self.fall, self.floor)
        return loss

    def moved(self, s: dict[str, Any], slots: Any, every: np.ndarray, rate: np.ndarray) -> None:
        """Adam's step for these slots (a slice or numbers), by all slots' gradients."""
        whole = isinstance(slots, slice)
        taken = lambda rows, name: np.take(rows, self.live, axis=1, out=self.room(name, len(rows), len(self.live)), mode="clip")
        grads = taken(every[slots], "live")
        norm = np.sqrt(np.einsum("ij,ij->i", grads, grads))
        grads *= np.where(norm > 5.0, 5.0 / np.maximum(norm, 1e-300), 1.0)[:, None]
        m, v = s["m"][slots], s["v"][slots]
        m *= 0.9
        m += np.multiply(grads, 0.1, out=self.room("part", *grads.shape))
        v *= 0.999
        grads *= grads
        grads *= 0.001
        v += grads
        np.sqrt(v, out=grads)
        grads += 1e-8
        np.divide(m, grads, out=grads)
        grads *= rate[slots][:, None]
        w = taken(s["w"][slots], "wired")
        w -= grads
        if whole:
            s["w"][slots][:, self.live] = w
        else:
            s["w"][slots[:, None], self.live] = w
            s["m"][slots], s["v"][slots] = m, v

    def observe(self, s: dict[str, Any], x: np.ndarray, dt: float = 1.0) -> None:
        """Learn from ``x``, then predict what follows it."""
        n = len(x)
        s["n"][:n] += 1
        if s["steps"]:
            live = s["kept"][:n] > 0
            error = s["steps"][0]["y"][:n] - x
            mixed = lambda old, new: np.where(live if old.ndim == 1 else live[:, None], (1 - self.mix) * old + self.mix * new, old)
            s["last"][:n] = np.where(live[:, None], error, s["last"][:n])
            s["errors"][:n] = mixed(s["errors"][:n], np.abs(error))
            s["squares"][:n] = mixed(s["squares"][:n], error * error)
            rmse = np.sqrt(self.train(s, x))
            s["rmse"][:n] = np.where(live, rmse, s["rmse"][:n])
            s["mean"][:n] = mixed(s["mean"][:n], rmse)
            s["square"][:n] = mixed(s["square"][:n], rmse * rmse)
        self.forward(s, x, dt)

    def score(self, s: dict[str, Any], n: int) -> np.ndarray:
        """Surprise in (0, 1); 0 until calibrated."""
        spread = np.sqrt(np.maximum(s["square"][:n] - s["mean"][:n] ** 2, 1e-12))
        return np.where((s["n"][:n] < self.calibrated) | (s["t"][:n] < 2), 0.0, sigmoid((s["rmse"][:n] - s["mean"][:n]) / spread - 2))

    def sigmas(self, s: dict[str, Any], n: int) -> np.ndarray:
        """By how many deviations each feature's last error is over its usual one; 0 in the first ten steps."""
        usual = s["errors"][:n]
        spread = np.sqrt(np.maximum(s["squares"][:n] - usual * usual, 1e-12))
        return np.where((s["t"][:n, None] < 10) | (usual <= 1e-10), 0.0, (np.abs(s["last"][:n]) - usual) / spread)

    def surprises(self, s: dict[str, Any], slot: int, names: tuple[str, ...] = FEATURES, sigmas: np.ndarray | None = None) -> list[dict[str, Any]]:
        """Features whose last error is over 1.5 times the usual one, the largest first; none in the first ten steps.  ``sigmas``: as the method gives them, for many slots at once."""
        if s["t"][slot] < 10:
            return []
        last, usual = s["last"][slot].tolist(), s["errors"][slot].tolist()
        sigma = (self.sigmas(s, slot + 1) if sigmas is None else sigmas)[slot].tolist()
        found = [(abs(last[i]), i) for i in range(len(names)) if usual[i] > 1e-10 and abs(last[i]) > 1.5 * usual[i]]
        return [{"name": names[i], "error": last[i], "magnitude": size, "sigma": sigma[i]} for size, i in sorted(found, key=lambda f: (-f[0], f[1]))]

    def forget(self, s: dict[str, Any], slots: np.ndarray) -> None:
        """Clears what these slots remember in time; what is learnt stays."""
        s["kept"][slots] = 0
        for k in (*self.PER_FEATURE, *self.PER_NET, "h1", "h2", "h3"):
            s[k][slots] = 0


class Normaliser:
    """Running z-scores a slot, the value itself included; the spread never counts as under 0.01 % of the mean."""

    def __init__(self, n: int):
        self.width = n

    def start(self, slots: int = 1) -> dict[str, Any]:
        return {"n": np.zeros(slots, np.int64), "mean": np.zeros((slots, self.width)), "m2": np.zeros((slots, self.width))}

    def observe(self, s: dict[str, Any], raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        s["n"][:n] += 1
        count = s["n"][:n, None]
        delta = raw - s["mean"][:n]
        s["mean"][:n] += delta / count
        mean = s["mean"][:n]
        s["m2"][:n] += delta * (raw - mean)
        spread = np.sqrt(s["m2"][:n] / np.maximum(count - 1, 1))
        return np.clip((raw - mean) / np.maximum(spread, np.abs(mean) * 1e-4 + 1e-8), -10, 10)


class Clusters:
    """Online k-means a slot: centres from the first distinct points, then a slow pull of the nearest one towards each point."""

    def __init__(self, width: int = GROUPS[3], k: int = REGIMES, rate: float = PULL):
        self.width, self.k, self.rate = width, k, rate

    def start(self, slots: int = 1) -> dict[str, Any]:
        return {"centres": np.zeros((slots, self.k, self.width)), "filled": np.zeros(slots, np.int64)}

    def assign(self, s: dict[str, Any], p: np.ndarray) -> np.ndarray:
        """Each slot's regime; 0 until all its centres are there."""
        n = len(p)
        centres, filled = s["centres"][:n], s["filled"][:n]
        gap = ((centres - p[:, None, :]) ** 2).sum(2)
        gap[np.arange(self.k) >= filled[:, None]] = np.inf
        full = filled == self.k
        adds = np.flatnonzero(~full & (gap.min(1) > DISTINCT))
        place = filled[adds]
        centres[adds, place] = p[adds]
        gap[adds, place] = 0.0
        filled[adds] += 1
        best = gap.argmin(1)
        pulled = np.flatnonzero(full)
        at = best[pulled]
        centres[pulled, at] += self.rate * (p[pulled] - centres[pulled, at])
        return np.where(filled == self.k, best, 0)


class Transitions:
    """A formation change a slot: three features beyond two deviations for five packets on end, and no active advisory (fixed values)."""

    sigma, least, packets = 2.0, 3, 5

    def start(self, slots: int = 1) -> dict[str, Any]:
        return {"run": np.zeros(slots, np.int64)}

    def check(self, s: dict[str, Any], sigmas: np.ndarray, advised: np.ndarray, calibrated: np.ndarray) -> np.ndarray:
        n = len(sigmas)
        run = np.where((sigmas > self.sigma).sum(1) >= self.least, s["run"][:n] + 1, 0)
        run = np.where(calibrated, run, s["run"][:n])
        fires = calibrated & (run >= self.packets) & ~advised
        s["run"][:n] = np.where(fires, 0, run)
        return fires


class TacticalNets:
    """Both nets, regimes of the fast one's motor values, transitions of the slow one's surprises, and the depth-ahead net that they reset.

    Runs in lock step (``lockstep.apply``) or for one well (``step`` with one row).
    ``asked``: the columns to give, all of ``schema`` without it; a part that none of
    them follows from is left out, as the parts hear of each other in one direction
    only: fast and slow net, regimes, transitions, depth-ahead net.  ``net_ok`` says whether calibrated nets corroborate an anomaly (0.4 or more).
    """

    schema = (
        "net_score double, net_calibrated boolean, net_ok boolean, net_surprised int, net_surprises array<struct<name:string,error:double,magnitude:double,sigma:double>>, "
        "regime int, motor array<double>, transition boolean, ahead_confidence double, ahead_calibrated boolean"
    )
    #: What is missing counts as 0 (``pump_spm`` has no channel here).
    reads = (*(f for f in FEATURES if f != "pump_spm"), "depth_into", "formation_hardness", "advised")

    #: What each part is needed for; the normaliser counts packets for all.
    FOR: ClassVar[dict[str, frozenset[str]]] = {
        "fast": frozenset({"net_score", "net_ok", "net_surprises", "regime", "motor"}), "slow": frozenset({"net_score", "net_ok", "net_surprised", "net_surprises", "transition", "ahead_confidence"}),
        "ahead": frozenset({"ahead_confidence"}), "ahead_z": frozenset({"ahead_confidence"}), "clusters": frozenset({"regime"}), "transitions": frozenset({"transition", "ahead_confidence"}),
    }

    def __init__(self, asked: tuple[str, ...] | None = None) -> None:
        self.fast, self.slow, self.ahead = Nets("fast", 42), Nets("slow", 142), Nets("ahead", 1042)
        # parts in the order of their names, all of them arrays a slot
        self.parts = {"fast": self.fast, "slow": self.slow, "ahead": self.ahead, "z": Normaliser(16), "ahead_z": Normaliser(16), "clusters": Clusters(), "transitions": Transitions()}
        kinds = {f.split()[0]: f for f in re.split(r", (?=\w+ )", self.schema)}
        self.asked = tuple(kinds) if asked is None else asked
        if asked is not None:
            self.schema = ", ".join(kinds[c] for c in asked)
            self.parts = {name: part for name, part in self.parts.items() if name not in self.FOR or self.FOR[name] & set(asked)}
            self.reads = tuple(c for c in self.reads if c in FEATURES or ("ahead" if c in AHEAD else "transitions") in self.parts)

    def start(self, slots: int = 1) -> dict[str, Any]:
        return {name: part.start(slots) for name, part in self.parts.items()}

    def step(self, s: dict[str, Any], x: dict[str, np.ndarray]) -> dict[str, Any]:
        """The next packet of the first slots: arrays of what ``reads`` names; gives arrays of what ``schema`` names."""
        n = len(x["wob"])
        zero = np.zeros(n)
        raw = np.nan_to_num(np.stack([x.get(f, zero) for f in FEATURES], axis=1).astype(np.float64))
        z = self.parts["z"].observe(s["z"], raw)
        seen = s["z"]["n"][:n]
        out: dict[str, Any] = {"net_calibrated": (seen >= self.fast.calibrated) | (seen >= self.slow.calibrated), "ahead_calibrated": seen >= self.ahead.calibrated}
        calibrated = out["net_calibrated"]
        # deviations and scores of the nets there are
        sigmas, scores = {}, {}
        for name in ("fast", "slow"):
            if name in self.parts:
                net = self.parts[name]
                net.observe(s[name], z)
                scores[name] = net.score(s[name], n)
                if name == "slow" or "net_surprises" in self.asked:
                    sigmas[name] = net.sigmas(s[name], n)
        if "fast" in self.parts:
            out["motor"] = s["fast"]["h3"][:n].copy()
        if "clusters" in self.parts:
            out["regime"] = self.parts["clusters"].assign(s["clusters"], out["motor"])
        if "ahead" in self.parts:
            ahead = np.zeros((n, 16))
            ahead[:, : len(AHEAD)] = np.nan_to_num(np.stack([x.get(f, zero) for f in AHEAD], axis=1).astype(np.float64))
            self.ahead.observe(s["ahead"], self.parts["ahead_z"].observe(s["ahead_z"], ahead))
            out["ahead_confidence"] = 1 - self.ahead.score(s["ahead"], n)
        if "transitions" in self.parts:
            fires = out["transition"] = self.parts["transitions"].check(s["transitions"], sigmas["slow"], x["advised"].astype(bool), calibrated)
            if "ahead" in self.parts and fires.any():
                self.ahead.forget(s["ahead"], np.flatnonzero(fires))
        if len(scores) == 2:
            out["net_score"] = np.maximum(scores["fast"], scores["slow"])
            out["net_ok"] = calibrated & (out["net_score"] >= 0.4)
        if "slow" in self.parts:
            out["net_surprised"] = (sigmas["slow"] > 2).sum(1)
        if "net_surprises" in self.asked:
            louder = ["fast" if f >= w else "slow" for f, w in zip(scores["fast"].tolist(), scores["slow"].tolist(), strict=True)]
            out["net_surprises"] = [self.parts[name].surprises(s[name], i, sigmas=sigmas[name]) if known else [] for i, (name, known) in enumerate(zip(louder, calibrated.tolist(), strict=True))]
        return {c: out[c] for c in self.asked}
