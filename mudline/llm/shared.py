"""The folder that the driver and all executors share, and lineage cuts in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a grouped table is sent to every task.
FEW = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where the setting is absent, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='mudline-')}")
        own = spark.sparkContext.getCheckpointDir()
    return own


def new_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def tasks_for(df: DataFrame, task_bytes: int = 128 << 20) -> int:
    """Partitions for a shuffle of ``df``: the session's number, or more where the planner expects more than ``task_bytes`` in each.

    The planner knows the size of what is read from files; of other sources it expects about 2**63 bytes, which says nothing.
    """
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-expected // task_bytes) if expected < 1 << 60 else 1)


def written(df: DataFrame, kind: str = "step") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lost executors cost no recomputation."""
    return written_at(df, new_dir(df.sparkSession, kind))


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of ours that a later one has replaced; no DataFrame may still read it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def attach(rows: DataFrame, groups: DataFrame, key: str, few: int = FEW) -> DataFrame:
    """``rows`` left-joined to ``groups`` on the string ``key``; a null key gets nothing.

    ``groups`` is a written table with one row a key and ``n``, the rows of it; a
    key of ``rows`` that it lacks is one of few rows.  Up to ``few`` groups, counted
    here, are broadcast.  Beyond that only groups of at least 1 / ``few`` of all rows
    are, of which there cannot be more; rows of the others meet by a shuffle in which
    no key is hot, and rows that need no partner are spread over it evenly.
    """
    if groups.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(groups), key, "left")
    heavy = F.col("n") * few >= groups.agg(F.sum("n")).first()[0]
    made = [c for c in groups.columns if c != key]
    first = groups.filter(heavy).select(key, *[F.col(c).alias(f"_heavy_{c}") for c in made])
    others = groups.filter(~heavy).select(F.col(key).alias("_key"), *made)
    known = rows.join(F.broadcast(first), key, "left")
    alone = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    dealt = known.withColumn("_key", F.when(F.col(key).isNull() | F.col("_heavy_n").isNotNull(), alone).otherwise(F.col(key)))
    joined = dealt.join(others.hint("merge"), "_key", "left")
    return joined.select(key, *[c for c in rows.columns if c != key], *[F.coalesce(f"_heavy_{c}", c).alias(c) for c in made])
