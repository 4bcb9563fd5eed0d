"""Streams of packets: replay, deduplication within a watermark, windowed summaries, keep-latest sinks.

Sequential rules run through ``mudline.operators.kernels.apply_stream``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mudline.sources.packets import SCHEMA


def replay(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of JSON lines as a stream, some files at a time."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def from_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """JSON lines from a socket; broken lines are dropped."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return lines.select(F.from_json("value", SCHEMA).alias("p")).filter("p IS NOT NULL").select("p.*")


def timed(packets: DataFrame, at: str = "timestamp", late: str = "30 seconds", keys: tuple[str, ...] = ()) -> DataFrame:
    """``event_time``, a watermark, and no repeats of the same key within it."""
    out = packets.withColumn("event_time", F.timestamp_seconds(at)).withWatermark("event_time", late)
    return out.dropDuplicatesWithinWatermark(list(keys)) if keys else out


def summaries(packets: DataFrame, key: str, span: str = "10 minutes") -> DataFrame:
    """Tumbling summaries per key; partial sums combine before the shuffle."""
    g = packets.groupBy(F.window("event_time", span), key)
    return g.agg(F.count("*").alias("n"), F.avg("rop").alias("rop"), F.avg("wob").alias("wob"), F.max("gas_units").alias("gas")).select(F.col("window.start").alias("began"), key, "n", "rop", "wob", "gas")


def to_table(stream: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = (), mode: str = "append") -> StreamingQuery:
    """Parquet with zstd, exactly once by the checkpoint."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("compression", "zstd").outputMode(mode)
    return (w.partitionBy(*partition_by) if partition_by else w).trigger(availableNow=True).start()


def fan_out(stream: DataFrame, tables: dict[str, tuple[Callable[[DataFrame], DataFrame], str]], checkpoint: str) -> StreamingQuery:
    """Each micro-batch through several transformations, each into a table of its own, partitioned by batch.

    A batch that runs again after a failure overwrites what it wrote, so each row
    is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for transform, path in tables.values():
            transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
