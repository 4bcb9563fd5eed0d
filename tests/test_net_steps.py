from __future__ import annotations

import numpy as np

from mudline.operators.nets import Nets, TacticalNets


def test_moments_are_of_the_wiring_alone():
    net = Nets("fast", 42)
    s = net.start(3)
    assert s["m"].shape == s["v"].shape == (3, int(net.mask.sum()))
    r = np.random.default_rng(1)
    for _ in range(6):
        net.observe(s, r.normal(size=(3, 16)))
    assert (s["w"][:, net.mask[0] == 0] == 0).all() and (s["w"] != net.first).any()


def test_a_step_takes_deviations_once_whatever_the_wells(monkeypatch):
    calls = []
    sigmas = Nets.sigmas
    monkeypatch.setattr(Nets, "sigmas", lambda self, s, n: calls.append(n) or sigmas(self, s, n))
    kernel, n = TacticalNets(), 12
    kernel.fast.calibrated = kernel.slow.calibrated = 15
    s, r = kernel.start(n), np.random.default_rng(2)
    for _ in range(20):
        calls.clear()
        out = kernel.step(s, {c: r.random(n) * 100 for c in kernel.reads if c != "advised"} | {"advised": np.zeros(n, bool)})
    assert calls == [n, n] and any(out["net_surprises"])


def test_only_parts_that_are_asked_for_run():
    """What is asked for is the same without the other parts, also where transitions reset the depth-ahead net."""
    r, n = np.random.default_rng(3), 9
    for asked, left_out in ((("net_score", "net_calibrated", "net_ok"), {"ahead", "ahead_z", "clusters", "transitions"}), (("ahead_confidence", "ahead_calibrated"), {"fast", "clusters"}), (("net_surprises", "regime", "transition"), {"ahead", "ahead_z"})):
        part, whole = TacticalNets(asked), TacticalNets()
        assert set(whole.parts) - set(part.parts) == left_out
        for kernel in (part, whole):
            kernel.fast.calibrated = kernel.slow.calibrated = kernel.ahead.calibrated = 15
            if "transitions" in kernel.parts:
                kernel.parts["transitions"].sigma, kernel.parts["transitions"].packets = 0.5, 2
        s, t, fired = part.start(n), whole.start(n), 0
        for _ in range(40):
            x = {c: r.random(n) * 100 for c in whole.reads if c != "advised"} | {"advised": r.random(n) < 0.5}
            few, every = part.step(s, {c: x[c] for c in part.reads}), whole.step(t, x)
            fired += every["transition"].sum()
            assert tuple(few) == asked and all(list(few[c]) == list(every[c]) for c in asked)
        assert fired


def test_adam_in_blocks_moves_every_slot_alike():
    one, many = Nets("slow", 142), Nets("slow", 142)
    one.BLOCK, many.BLOCK = 64, 3
    s, t, r = one.start(10), many.start(10), np.random.default_rng(4)
    for i in range(12):
        x = r.normal(size=(10, 16))
        one.observe(s, x), many.observe(t, x)
        if i == 5:
            one.forget(s, np.array([1, 4, 5])), many.forget(t, np.array([1, 4, 5]))
    assert all(np.allclose(s[k], t[k], rtol=0, atol=1e-13) for k in ("w", "m", "v", "t", "rate"))
