"""Window frames over packets; functions, as a window needs a running session.

Wells are partitions; rows are ordered by (ts, seq).
"""

from __future__ import annotations

from pyspark.sql import Window, WindowSpec

KEYS = ("well_id",)
ORDER_BY = ("ts", "seq")


def ordered(*keys: str) -> WindowSpec:
    """Rows of a well in order, no frame."""
    return Window.partitionBy(*(keys or KEYS)).orderBy(*ORDER_BY)


def last_rows(n: int, *keys: str) -> WindowSpec:
    """This row and the n - 1 before it."""
    return ordered(*keys).rowsBetween(-(n - 1), 0)


def so_far(*keys: str) -> WindowSpec:
    """All rows up to this one."""
    return ordered(*keys).rowsBetween(Window.unboundedPreceding, 0)


def before(*keys: str) -> WindowSpec:
    """All rows before this one."""
    return ordered(*keys).rowsBetween(Window.unboundedPreceding, -1)
