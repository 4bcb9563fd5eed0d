"""Every registered query with SQL gives the rows that DuckDB gives; the others run and have rows."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from mudline import registry

registry.load_all()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    """A key that sorts rows alike for both engines: floats to four digits, the rest as text."""
    if v is None:
        return "~"
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 4) + 0.0:024.4f}"
    return str(v)


def same(a, b):
    if isinstance(a, float) and isinstance(b, (float, int, Decimal)):
        b = float(b)
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return plain(a) == plain(b)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf_dir, con, name):
    """Every row and value, up to the last digit that rounding leaves."""
    df = registry.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=lambda r: tuple(map(plain, r)))
    cur = con.execute(registry.ORACLES[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == names
    at = [theirs.index(c) for c in names]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=lambda r: tuple(map(plain, r)))
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want, strict=True) if not all(map(same, a, b))][:3] == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


#: Words that must occur in a column over the driver's middle tables, so that a match proves all branches.
BRANCHES = {
    "hourly_analysis": {"result": {"Success", "AllDataRejected", "InsufficientData"}, "primary_reason": {"LowWob", "TorqueInstability", None}, "part": {255, 3, None}, "rating": {"ACCEPTABLE", "GOOD efficiency", "EXCELLENT (fast and stable)", None}, "bins": {0, 2, None}},
    "ticket_gate": {"gate": {"state", "normal", "cooldown", "no_interval", "no_net", "debounce", "ticket"}},
    "dynamic_tickets": {"gate": {"learning", "state", "normal", "no_interval", "no_net", "ticket"}},
    "dynamic_modes": {"mode": {"learning", "dynamic"}, "locks": {True, False}},
    "damping_monitor": {"damping": {"advise", "watch", "success", "retract", "escalate"}},
    "shift_events": {"kind": {"ticket", "critical", "recommendation", "damping", "summary"}, "name": {"advise", "success", "retract", "escalate", "wob", "rpm", "flow_in"}},
    "template_advisories": {"category": {"WellControl", "Hydraulics", "Mechanical", "DrillingEfficiency", "Formation", "None"}},
    "report_bodies": {"severity": {"Critical", "Warning", "Watch", "odd word", None}, "trend": {"rising", None}},
    "optimiser_recommendations": {"parameter": {"wob", "rpm", "flow"}, "place": {1, 2, 3}},
    "versioned_reports": {"place": {"snapshots", "hourly", "daily", "ml", "acks"}},
    "replicas_converge": {"replica": {"a", "b", "c"}, "origin": {"a", "b", "c"}},
}


@pytest.mark.parametrize("name", sorted(BRANCHES))
def test_all_branches_occur(name):
    c = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.01/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    cur = c.execute(registry.ORACLES[name])
    columns, rows = [d[0] for d in cur.description], cur.fetchall()
    for column, words in BRANCHES[name].items():
        assert words <= {r[columns.index(column)] for r in rows}, column


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_no_match_is_vacuous(name):
    c = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.01/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    assert c.execute(registry.ORACLES[name]).fetchone() is not None
