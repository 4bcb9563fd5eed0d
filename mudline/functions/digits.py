"""Digits of doubles as C and DuckDB give them; Spark's own rounding reads the shortest decimal of a double instead of the double itself."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Powers of two that add up to a power of ten, the largest first, so that their products with a double are exact.
BINARY = {0: (1.0,), 1: (8.0, 2.0), 2: (64.0, 32.0, 4.0), 3: (512.0, 256.0, 128.0, 64.0, 32.0, 8.0)}
#: Splits a double in two halves whose products are exact.
SPLIT = 2.0**27 + 1
#: From here on halves may overflow.
HUGE = 1e290
#: Doubles from here on have no digits to round.
WHOLE = 1e13


def rounded(x: Column, digits: int) -> Column:
    """``x`` times a power of ten, rounded as a double (halves away from zero), and divided again."""
    return F.round(x * 10.0**digits, 0) / 10.0**digits


def fused(x: Column, y: Column, z: Column) -> Column:
    """``x * y + z`` rounded once, as a fused multiply-add gives it: the errors of product and sum are found exactly and added last."""
    split = lambda v: v * SPLIT - (v * SPLIT - v)
    product = x * y
    x1, y1 = split(x), split(y)
    x2, y2 = x - x1, y - y1
    lost = ((x1 * y1 - product) + x1 * y2 + x2 * y1) + x2 * y2
    total = product + z
    held = total - product
    exact = total + (((product - (total - held)) + (z - held)) + lost)
    return F.when((F.abs(x) < HUGE) & (F.abs(y) < HUGE) & (F.abs(total) < HUGE), exact).otherwise(total)


def printed(x: Column, digits: int) -> Column:
    """``x`` with so many digits (three at most) as printf has them: from the exact value of the double, halves to the even digit."""
    size, scale = F.abs(x), 10.0**digits
    low = F.floor(size * scale).cast("double")
    # exact: each step cancels what stands before it
    first, *others = (size * p for p in BINARY[digits])
    over = first - (low + 0.5)
    for part in others:
        over = over + part
    made = F.when((over > 0) | ((over == 0) & (low % 2 == 1)), low + 1).otherwise(low) / scale
    return F.when(size < WHOLE, F.when(x < 0, -made).otherwise(made)).otherwise(x)


def printf(text: str, *args: Column | str) -> Column:
    """``format_string`` whose ``%.Nf`` are rounded as printf does."""
    places = [s for s in re.findall(r"%%|%[-+ 0]*(?:\.\d+)?[a-z]", text) if s != "%%"]
    columns = [F.col(a) if isinstance(a, str) else a for a in args]
    return F.format_string(text, *[printed(c, int(s[s.index(".") + 1 : -1])) if s.endswith("f") else c for s, c in zip(places, columns, strict=True)])
