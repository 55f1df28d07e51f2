"""Rounding to places as Python's ``round``: by the number that a double is, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double's 53 bits in halves.
_HALVES = 134_217_729.0


def round_half_even(x: Column, places: int) -> Column:
    """``x`` to ``places`` (0 to 22) digits. 0.35 is a bit less than it reads, so it gives 0.3;
    0.25 is a tie and gives 0.2.

    ``x * 10 ** places`` is made without error, as the nearest double and the rest (by
    Dekker's product), so that what decides is exact. Numbers of which that product has 52
    bits or more stay as they are, as do null, NaN and infinities; a zero keeps its sign.
    """
    scale = float(10**places)

    def halves(v: Column) -> tuple[Column, Column]:
        big = v * _HALVES
        high = big - (big - v)
        return high, v - high

    def rounded(v: Column) -> Column:
        product = v * scale
        (a, b), (c, d) = halves(v), halves(F.lit(scale))
        rest = ((a * c - product) + a * d + b * c) + b * d
        floor = F.floor(product).cast("double")
        over = (product - floor) - 0.5
        even = F.pmod(floor, F.lit(2.0)) == 0
        up = (over > 0) | ((over == 0) & ((rest > 0) | ((rest == 0) & ~even)))
        # A product just under a whole number may have been rounded to it: the rest can't reach half.
        near = (floor + F.when(up, 1.0).otherwise(0.0)) / scale
        return F.when(near == 0, v * 0.0).otherwise(near)

    # A half of the double's range is far beyond what is rounded.
    small = F.abs(x) < float(2**52) / scale
    return F.when(small, rounded(F.when(small, x))).otherwise(x)
