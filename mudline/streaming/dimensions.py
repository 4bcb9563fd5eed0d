"""A stream judged by tables that change while it runs: formations and thresholds are read anew for each micro-batch, by version.

The tables live in a versioned store.  A micro-batch takes the store's last version
when it begins and writes down which one it took, with what changed since the
batch before, ahead of its results; so a batch that runs again after a failure is
judged by the same version, whatever has been committed since, and a change takes effect
in the next batch and only then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mudline import config
from mudline.operators import joins
from mudline.operators.metrics import derived
from mudline.operators.versions import Store

TAKEN = "batch long, version long, changes array<string>"


def put_dimensions(store: Store, formations: DataFrame | None = None, thresholds: dict | None = None) -> int:
    """A new version of the formation table (``formation``, ``top``, ``base``) or of the thresholds (as in a configuration file; wrong ones raise)."""
    tables = {} if formations is None else {"formations": formations}
    if thresholds is not None:
        config.overlay(thresholds)
        rows = [(section, key, float(value)) for section, body in thresholds.items() for key, value in body.items()]
        tables["thresholds"] = store.spark.createDataFrame(rows, "section string, key string, value double")
    return store.change(lambda s, v: tables)


def thresholds_at(store: Store, version: int) -> config.Config:
    """The defaults with what the store says; whole numbers where the default is one."""
    rows = store.read("thresholds", version)
    table: dict[str, dict] = {}
    for r in rows.collect() if rows is not None else []:  # as many as there are keys
        kind = type(getattr(getattr(config.DEFAULT, r.section), r.key))
        table.setdefault(r.section, {})[r.key] = kind(r.value)
    return config.overlay(table)


def differences(store: Store, old: int, new: int) -> list[str]:
    """What changed between two versions, one line a threshold or formation."""
    out = [f"{key}: {a} -> {b}" for key, a, b in config.changes(thresholds_at(store, old), thresholds_at(store, new))]
    tables = store.manifest(old)["tables"], store.manifest(new)["tables"]
    if tables[0].get("formations") != tables[1].get("formations"):
        before, after = ({r.formation: (r.top, r.base) for r in t.collect()} if (t := store.read("formations", v)) is not None else {} for v in (old, new))  # a well plan's formations
        out += [f"formation {n}: {before.get(n)} -> {after.get(n)}" for n in sorted({*before, *after}) if before.get(n) != after.get(n)]
    return out


def taken(spark: SparkSession, folder: str, batch: int) -> int | None:
    """The version that this batch took already, if it has run before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/taken/of={batch}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(TAKEN).parquet(f"{folder}/taken/of={batch}").first().version


def judged(batch: DataFrame, store: Store, version: int) -> DataFrame:
    """Metrics and the cascade under this version's thresholds, with the formation that holds the bit."""
    rows = derived(batch, thresholds_at(store, version)).withColumn("version", F.lit(version))
    formations = store.read("formations", version)
    return rows.withColumn("formation", F.lit(None).cast("string")) if formations is None else joins.first_interval(rows, formations.select("formation", "top", "base"), "bit_depth", "top", "base").drop("top", "base")


def run(stream: DataFrame, store_folder: str, folder: str, checkpoint: str, columns: tuple[str, ...] = ("well_id", "ts", "seq", "formation", "rule", "severity", "version"), judge: Callable[[DataFrame, Store, int], DataFrame] = judged) -> StreamingQuery:
    """Each micro-batch of ``stream`` (packets in order, as ``processor.in_order`` gives them) judged by the store's last version, into ``folder``/judged by batch."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, store_folder)
        version = taken(spark, folder, number)
        if version is None:
            version = store.manifest()["version"]
            before = next((v for n in range(number - 1, max(number - 2, -1), -1) if (v := taken(spark, folder, n)) is not None), version)
            row = [(number, version, differences(store, before, version))]
            spark.createDataFrame(row, TAKEN).coalesce(1).write.mode("overwrite").parquet(f"{folder}/taken/of={number}")
        judge(batch, store, version).select(*columns).write.mode("overwrite").parquet(f"{folder}/judged/of={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
