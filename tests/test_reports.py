from __future__ import annotations

import re
from collections import Counter

from mudline.plans import history_queries


def test_a_frame_takes_each_aggregate_once(spark, sf_dir):
    """Sixty rows a packet go through each aggregate, so none is there twice."""
    plan = history_queries.strategic_reports(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    wide = Counter((f, re.sub(r"#\d+L?", "", args)) for f, args in re.findall(r"(\w+)\(([^()]*)\) windowspecdefinition\([^()]*(?:specifiedwindowframe\(RowFrame, -59)", plan))
    assert {f for f, _ in wide} >= {"avg", "regr_slope", "stddev_pop", "var_pop", "covar_pop"}
    # rows and values are counted by one function each, and rows once for the founder and once for the report
    assert all(k == 1 for (f, _), k in wide.items() if f != "count") and sum(k for (f, _), k in wide.items() if f == "count") <= 4
