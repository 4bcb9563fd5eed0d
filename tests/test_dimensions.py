"""A new top and a new threshold take effect in the next micro-batch, and only then; a batch that runs again keeps its version."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from mudline.operators.metrics import with_previous, with_state
from mudline.operators.versions import Store
from mudline.streaming import dimensions
from mudline.telemetry import NAMES, telemetry

COLUMNS = ["well_id", "ts", "seq", *NAMES, "bit_depth", "hole_depth"]


def formations(spark, *rows):
    return spark.createDataFrame(list(rows), "formation string, top double, base double")


def test_changes_take_effect_in_the_next_batch(spark, sf_dir, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    dimensions.put_dimensions(store, formations(spark, ("A", 0.0, 1050.0), ("B", 1050.0, 9000.0)), {"well_control": {"gas_units_warning": 100.0}})
    rows = with_previous(with_state(telemetry(spark, sf_dir).select(*COLUMNS))).withColumn("gas_units", F.lit(90.0)).withColumn("flow_out", F.col("flow_in")).withColumn("pit_change", F.lit(0.0))
    parts = [rows.filter((F.col("seq") % 3) == k) for k in range(3)]
    schema = rows.schema

    def feed(part):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        dimensions.run(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()

    feed(parts[0])
    dimensions.put_dimensions(store, formations(spark, ("A", 0.0, 1020.0), ("B", 1020.0, 9000.0)))
    feed(parts[1])
    dimensions.put_dimensions(store, thresholds={"well_control": {"gas_units_warning": 80.0}})
    feed(parts[2])
    got = spark.read.parquet(str(tmp_path / "out" / "judged"))
    tops = got.join(rows.select("seq", "bit_depth"), "seq").groupBy("of").agg(F.max(F.when(F.col("formation") == "A", F.col("bit_depth"))).alias("top"), F.count_if(F.col("rule") == "gas").alias("gas"), F.max("version").alias("version"), F.min("version").alias("least"), F.count("*").alias("n")).orderBy("of").collect()
    assert [r.version for r in tops] == [1, 2, 3] == [r.least for r in tops]
    assert 1040 < tops[0].top < 1050 and all(1010 < r.top < 1020 for r in tops[1:])
    assert tops[0].gas == tops[1].gas == 0 and tops[2].gas > 0 and sum(r.n for r in tops) == rows.count()
    said = {r.batch: list(r.changes) for r in spark.read.parquet(str(tmp_path / "out" / "taken")).collect()}
    assert said[0] == [] and said[1] == ["formation A: (0.0, 1050.0) -> (0.0, 1020.0)", "formation B: (1050.0, 9000.0) -> (1020.0, 9000.0)"] and said[2] == ["well_control.gas_units_warning: 100.0 -> 80.0"]
    # the second batch's commit and results are lost, and the store has changed since: it runs again by the version that it took
    (tmp_path / "cp" / "commits" / "2").unlink()
    (tmp_path / "cp" / "commits" / ".2.crc").unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "out" / "judged" / "of=2")
    dimensions.put_dimensions(store, formations(spark, ("Z", 0.0, 9000.0)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    dimensions.run(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    again = spark.read.parquet(str(tmp_path / "out" / "judged")).filter("of = 2")
    assert {r.version for r in again.select("version").distinct().collect()} == {3} and again.filter("formation = 'Z'").count() == 0 and again.count() == tops[2].n


def test_wrong_thresholds_are_no_version(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with pytest.raises(ValueError, match="must be under"):
        dimensions.put_dimensions(store, thresholds={"well_control": {"gas_units_warning": 1e9}})
    with pytest.raises(ValueError, match="did you mean"):
        dimensions.put_dimensions(store, thresholds={"well_control": {"gas_units_warnin": 1.0}})
    assert store.versions() == []
