"""Connected components of links, as DataFrame rounds of min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mudline.llm.shared import discard, new_dir, written, written_at


def contracted(links: DataFrame) -> DataFrame:
    """Fewer links with the same components: each node keeps its smallest neighbour below it, its other ones are linked to that neighbour.

    Where a node met one group through many buckets, its links to the group's
    members become one link each between members, mostly the same for all nodes.
    """
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    others = down.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return least.withColumnRenamed("least", "b").union(others).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node reachable) for each end of ``links`` (``a``, ``b``).

    Each round takes the smallest label among neighbours, then the label that
    this label had before, so chains shrink by half.  Rounds are written to the
    shared folder, each in place of the one before; links and labels never reach the driver.  Sums per node combine
    before the shuffle, and joins on a hub's label are plain equi-joins that Spark
    may split.
    """
    few = written(contracted(links), "contracted")
    both = few.union(few.select("b", "a")).distinct()
    spark, path = links.sparkSession, new_dir(links.sparkSession, "labels")
    labels = written_at(few.select(F.col("a").alias("node"), F.col("b").alias("label")).union(few.select("b", "b")).groupBy("node").agg(F.min("label").alias("label")), path)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        last, path = path, new_dir(spark, "labels")
        after = written_at(lower.join(jump, "label").select("node", F.least("label", "next").alias("label"), "old"), path)
        discard(spark, last)
        labels = after.select("node", "label")
        if after.filter("label <> old").isEmpty():
            return labels
