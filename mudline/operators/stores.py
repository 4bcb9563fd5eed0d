"""Stores as table functions: keep-latest upserts, retention, tiers and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(rows: DataFrame, keys: list[str], version: str, tie: str) -> DataFrame:
    """One row per key: the highest version, ties to the larger ``tie``; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(version, tie)).alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str, tie: str) -> DataFrame:
    return keep_latest(table.unionByName(changes), keys, version, tie)


def newest_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` of each group (first in, first out caps); Spark limits groups before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def retain(rows: DataFrame, at: str, now: Column, max_age: int) -> DataFrame:
    return rows.filter(F.col(at) >= now - max_age)


def tiers(rows: DataFrame, at: str, tie: str, now: Column, hot: int, max_age: int, group: list[str]) -> DataFrame:
    """``tier``: delete over ``max_age``, hot for the newest ``hot`` of a group (ties to the larger ``tie``), else cold.

    Only each group's newest rows are sorted; the last of them is the group's
    cut-off, joined back.
    """
    edge = newest_per_group(rows.select(*group, at, tie), group, [F.desc(at), F.desc(tie)], hot).groupBy(*group).agg(F.min(F.struct(at, tie)).alias("_edge"))
    newer = F.struct(at, tie) >= F.col("_edge")
    tier = F.when(F.col(at) < now - max_age, "delete").when(newer, "hot").otherwise("cold")
    return rows.join(edge, group).withColumn("tier", tier).drop("_edge")

