"""Rows that a log reader leaves out are counted by reason; ranges of a configuration are kept."""

from __future__ import annotations

import pytest

from mudline import config
from mudline.sources import logs


def test_skipped_rows_are_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TIME,DEPTH,WOB(N)\n1705564800,200,44482.2\nnever,200,1\n1705564801,0,0\n1705564802,,\n1705564803,5,0\n")
    (tmp_path / "b.csv").write_text("TIME,DEPTH,WOB(N)\n1705564800,1,1\n")
    got = {r.file[-5:]: (r.rows, r.kept, r.no_time, r.all_zero) for r in logs.read_counts(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": (5, 2, 1, 2), "b.csv": (1, 1, 0, 0)}
    assert logs.read_log(spark, str(tmp_path)).count() == 3 and "skipped" not in logs.read_log(spark, str(tmp_path)).columns


@pytest.mark.parametrize(("section", "key", "value"), [("mse", "efficiency_poor_percent", -1.0), ("weights", "mse", 1.2), ("advisory", "cooldown_packets", 0), ("baseline", "max_outlier_percentage", 5.0), ("hydraulics", "ecd_margin_critical_ppg", -0.1)])
def test_values_out_of_range(section, key, value):
    with pytest.raises(ValueError, match=f"{section}.{key} must be between"):
        config.overlay({section: {key: value}})
    assert config.problems(config.DEFAULT) == []
