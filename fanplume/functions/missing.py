"""Elementwise arithmetic in which a missing value is NULL and NaN never comes out.

Written for either setting of spark.sql.ansi.enabled: nothing here divides by zero or takes a remainder of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def num(x: Column | float | bool) -> Column:
    """A number; conditions count as 1 and 0, missing stays missing."""
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def known(x: Column) -> Column:
    """x, with NaN as missing."""
    return F.when(~F.isnan(x), x)


def divide(a, b) -> Column:
    """IEEE division: x/0 is an infinity of the sign of x, 0/0 is missing."""
    a, b = num(a), num(b)
    return F.when(b != 0, a / F.when(b != 0, b)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))


def floor_divide(a, b) -> Column:
    """The floor of a / b; missing for b = 0."""
    a, b = num(a), num(b)
    return F.when(b != 0, F.floor(a / F.when(b != 0, b)).cast("double"))


def modulo(a, b) -> Column:
    """The remainder with the sign of b, so -7 modulo 360 is 353; missing for b = 0."""
    a, b = num(a), num(b)
    return a - b * floor_divide(a, b)


def power(a, b) -> Column:
    """Float power; too large is infinity, undefined is missing."""
    return known(F.pow(num(a), num(b)))


def sqrt(x) -> Column:
    """Missing below zero."""
    x = num(x)
    return F.when(x >= 0, F.sqrt(F.abs(x)))


def hypot(a, b) -> Column:
    return F.hypot(num(a), num(b))


def maximum(a, b) -> Column:
    """The greater; missing if either is."""
    a, b = num(a), num(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def minimum(a, b) -> Column:
    """The smaller; missing if either is."""
    a, b = num(a), num(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def clip(x, low: float | None = None, high: float | None = None) -> Column:
    x = num(x)
    if high is not None:
        x = minimum(x, high)
    return x if low is None else maximum(x, low)


def round_even(x, decimals: int = 0) -> Column:
    """Rounded, halves to the even neighbour."""
    return F.bround(num(x), decimals)


def where(condition: Column, x, other=None) -> Column:
    """x where the condition holds, `other` where it doesn't, missing where it is missing."""
    out = F.when(condition, num(x))
    return out if other is None else out.when(~condition, num(other))


def angle_of(y, x) -> Column:
    """The direction of (x, y) in degrees, 0 to 360."""
    return modulo(F.degrees(F.atan2(num(y), num(x))), 360)
