"""Replicas converge whatever the order, failures and repeats of their exchanges."""

from __future__ import annotations

import random

import pytest

from mudline.operators import replicas

SCHEMA = "id long, modified long, outcome string"


def state(replica):
    return sorted((r.id, r.modified, r.origin, r.outcome) for r in replica.rows().collect())


@pytest.mark.parametrize("seed", [1])
def test_three_replicas_converge(spark, tmp_path, seed):
    rng = random.Random(seed)
    made = [replicas.Replica(spark, str(tmp_path / n), n) for n in "abc"]
    said = []
    for _ in range(2):
        for r in rng.sample(made, 3):
            rows = [(i, rng.randrange(5), rng.choice(["Pending", "Resolved", "Escalated"])) for i in rng.sample(range(12), 6)]
            said += [(i, m, r.name, o) for i, m, o in rows]
            r.write(spark.createDataFrame(rows, SCHEMA))
        a, b = rng.sample(made, 2)
        a.pull(b)
        if rng.random() < 0.5:
            a.tidy(2)
    for a in [*rng.sample(made, 3), *made]:
        for b in rng.sample([x for x in made if x is not a], 2):
            a.pull(b)
    want = sorted(max((x for x in said if x[0] == i), key=lambda x: x[1:]) for i in {x[0] for x in said})
    assert all(state(r) == want for r in made)
    assert all(a.pull(b) == 0 for a in made for b in made if a is not b) and all(state(r) == want for r in made)


def test_pulls_read_only_what_changed_and_failures_pause(spark, tmp_path, monkeypatch):
    a, b = (replicas.Replica(spark, str(tmp_path / n), n) for n in "ab")
    b.write(spark.createDataFrame([(1, 1, "x"), (2, 1, "x")], SCHEMA))
    assert a.pull(b) == 2 and a.pull(b) == 0 and a.marks() == {"b": 1}
    b.write(spark.createDataFrame([(2, 2, "y"), (1, 0, "older")], SCHEMA))
    asked = b.rows(since=1).collect()
    assert [(r.id, r.outcome, r.changed) for r in asked] == [(2, "y", 2)]
    exchange = replicas.Exchange(a, [b])
    whole, tries = replicas.Replica.take, []

    def dies(self, rows, marks=None):
        tries.append(1)
        raise RuntimeError("lost")

    monkeypatch.setattr(replicas.Replica, "take", dies)
    first = replicas.pause(1, "b")
    assert exchange.round(0) == {"b": None} and exchange.round(first - 1) == {} and exchange.round(first) == {"b": None} and len(tries) == 2
    monkeypatch.setattr(replicas.Replica, "take", whole)
    assert exchange.round(first + replicas.pause(2, "b") - 1) == {} and exchange.round(first + replicas.pause(2, "b")) == {"b": 1}
    assert state(a) == state(b) and exchange.failures == {"b": 0}


def test_pauses():
    assert replicas.pause(0, "x") == 60 and 120 <= replicas.pause(1, "x") <= 150 and replicas.pause(60, "x") == 3600
    assert replicas.pause(2, "a") != replicas.pause(2, "zebra")
