"""Replicas of an event table that exchange what changed, in any order, and end up alike.

Each replica is a versioned store.  A change to a row is written as a row of a
*segment*, a small table of its own, with the replica's version that brought it
(``changed``); the newest row of an id counts.  A pull reads of a peer only what
changed after the peer's version that was read last (a mark a peer, kept in the
replica's own store), keeps of it what is newer than the rows at hand, and commits
segment and mark in one version: a pull that dies has not happened, one that runs
again finds nothing new.

Which of two rows of an id is newer depends on the rows alone: by ``modified``, then
``origin``, then by all other columns; so merges commute, and the order of exchanges, lost
and repeated ones make no difference to where replicas end.  Segments are put
together once they are many.  Failed peers are left alone for a time that doubles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mudline.operators.versions import Conflict, Store

#: Segments from which they are put together.
MANY = 8
#: Doublings and seconds that a failed peer's pause has at most (fixed values).
DOUBLINGS, LONGEST = 6, 3600


def rank(columns: list[str]) -> Column:
    """What makes a row newer than another of its id."""
    return F.struct("modified", "origin", *sorted(c for c in columns if c not in ("id", "modified", "origin", "changed")))


def newest(rows: DataFrame) -> DataFrame:
    """One row an id; combined before the shuffle."""
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*rest), rank(rows.columns)).alias("_row")).select("id", *[F.col(f"_row.{c}").alias(c) for c in rest])


class Replica:
    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.name, self.store = spark, name, Store(spark, folder)

    def segments(self, version: int | None = None) -> list[str]:
        return sorted(t for t in self.store.manifest(version)["tables"] if t.startswith("segment-"))

    def rows(self, version: int | None = None, since: int = 0) -> DataFrame | None:
        """Each event as it stands, of those that changed after ``since``; ``changed`` is the version that brought it."""
        tables = [(t, self.store.manifest(version)["tables"][t]["since"]) for t in self.segments(version)]
        parts = [self.store.read(t, version) for t, last in tables if last > since]
        if not parts:
            return None
        return newest(reduce(DataFrame.unionByName, parts).filter(F.col("changed") > since))

    def marks(self, version: int | None = None) -> dict[str, int]:
        return self.store.manifest(version)["note"].get("marks", {})

    def take(self, rows: DataFrame, marks: dict[str, int] | None = None) -> int:
        """Commits what of ``rows`` is newer than what is here, with new marks; returns the version."""
        while True:
            base = self.store.manifest()["version"]
            held, kept = self.rows(base), self.marks(base)
            fresh = newest(rows)
            if held is not None:
                # of ids at hand only those that are asked about
                mine = held.join(fresh.select("id"), "id", "left_semi").select("id", rank(held.columns).alias("_mine"))
                fresh = fresh.join(mine, "id", "left").filter(F.col("_mine").isNull() | (rank(fresh.columns) > F.col("_mine"))).drop("_mine")
            fresh = fresh.withColumn("changed", F.lit(base + 1).cast("long"))
            tables = {f"segment-{base + 1:09d}": fresh.select(*sorted(fresh.columns))}
            try:
                return self.store.commit(tables, base, {"marks": kept | (marks or {})})
            except Conflict:
                continue

    def write(self, rows: DataFrame) -> int:
        """Events or outcomes of this replica's own."""
        return self.take(rows.withColumn("origin", F.lit(self.name)))

    def pull(self, peer: Replica) -> int:
        """What the peer has that is newer; returns how many rows that were."""
        mark, last = self.marks().get(peer.name, 0), peer.store.manifest()["version"]
        changes = peer.rows(last, since=mark) if last > mark else None
        if changes is None:
            return 0
        version = self.take(changes.drop("changed"), {peer.name: last})
        return self.store.read(f"segment-{version:09d}", version).count()

    def tidy(self, many: int = MANY) -> bool:
        """Puts segments together where they are many; what peers read by versions stays the same."""
        base = self.store.manifest()["version"]
        names = self.segments(base)
        if len(names) < many:
            return False
        whole = self.rows(base)
        self.store.commit({f"segment-{base + 1:09d}": whole.select(*sorted(whole.columns))}, base, {"marks": self.marks(base)}, without=names)
        return True


def pause(failures: int, peer: str, interval: int = 60) -> int:
    """Seconds until a peer is asked again: doubled by each failure, with a part that differs by peer."""
    if not failures:
        return interval
    capped = min(interval * 2 ** min(failures, DOUBLINGS), LONGEST)
    spread = reduce(lambda h, b: (h * 31 + b) % 2**64, peer.encode(), 0)
    return min(capped + spread % (capped // 4 + 1), LONGEST)


class Exchange:
    """Rounds of pulls among replicas; a peer that fails is not asked again before its pause is over."""

    def __init__(self, replica: Replica, peers: list[Replica], interval: int = 60):
        self.replica, self.peers, self.interval = replica, peers, interval
        self.failures: dict[str, int] = {}
        self.due: dict[str, int] = {}

    def round(self, now: int) -> dict[str, int | None]:
        """Rows taken from each peer that was due; None where the pull failed."""
        out: dict[str, int | None] = {}
        for peer in self.peers:
            if now < self.due.get(peer.name, 0):
                continue
            try:
                out[peer.name], self.failures[peer.name] = self.replica.pull(peer), 0
            except Exception:  # whatever made it fail, the next round tries again
                out[peer.name], self.failures[peer.name] = None, self.failures.get(peer.name, 0) + 1
            self.due[peer.name] = now + pause(self.failures[peer.name], peer.name, self.interval)
        return out
