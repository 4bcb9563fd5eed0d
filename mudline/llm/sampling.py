"""Bounded samples for fitting classifiers, and the folds that keep held-out rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes lie below this bound; shares are exact fractions of it, so none becomes 0 however many rows there are.
RANGE = 1 << 62


def fold(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of`` (null ids: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def bound(size: int, n: int) -> int:
    """The hash bound under which about ``size`` of ``n`` different rows lie."""
    return min(RANGE, -(-RANGE * size // max(n, 1)))


def per_class_sample(rows: DataFrame, class_col: str, key_cols: list[str], size: int) -> tuple[DataFrame, dict]:
    """About ``size`` different rows of each class by a hash of ``key_cols``, and the number of rows of each class.

    Rows count as one where class and keys are equal, so a repeated or missing id
    cannot fill the sample; repeats combine before the shuffle.  Classes are
    counted over all rows, different ones to a few per cent.  The sample needs no
    sort, and its bound does not depend on the number of rows.
    """
    key = F.pmod(F.xxhash64(*key_cols, F.lit("sample")), F.lit(RANGE))
    counted = rows.groupBy(class_col).agg(F.count("*").alias("n"), F.approx_count_distinct(key).alias("different")).collect()
    if not counted:
        return rows.limit(0), {}
    under = F.coalesce(*[F.when(F.col(class_col) == r[0], F.lit(bound(size, r.different))) for r in counted], F.lit(0))
    return rows.filter(key < under).dropDuplicates([class_col, *key_cols]), {r[0]: r.n for r in counted}


def lesson(text: Column, pieces: int = 32, size: int = 1000) -> Column:
    """What a sampled text teaches: all of it, or ``pieces`` spans of ``size`` characters spread over a longer one.

    It bounds what a sample weighs; texts that are scored are never cut.
    """
    n = F.length(text)
    span = lambda i: F.substring(text, (i * n / pieces).cast("int") + 1, F.lit(size))
    return F.when(n > pieces * size, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), span), "")).otherwise(text)
