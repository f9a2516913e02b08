"""Aggregates over dimensions. Missing values don't count; what has none is missing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fanplume.functions.missing import num

#: Hours that a sample stands for.
DT = "dt"
#: Levels of one array of quantiles.
MOST_LEVELS = 20


@dataclass(frozen=True)
class Aggregate:
    """`column` builds the aggregate; its argument tells whether time is among the dimensions that go."""

    column: Callable[[bool], Column]
    kind: str = ""
    of: str = ""

    def __call__(self, over_time: bool) -> Column:
        return self.column(over_time)


def _hours(x: Column) -> Column:
    return F.sum(F.when(x.isNotNull(), F.col(DT)))


def total(name: str) -> Aggregate:
    """The sum; over time the integral, each sample times its hours."""
    x = num(F.col(name))
    return Aggregate(lambda t: F.sum(x * F.col(DT)) if t else F.sum(x), "sum", name)


def mean(name: str) -> Aggregate:
    """The mean; over time weighted by hours. Of a condition: its probability."""
    x = num(F.col(name))
    return Aggregate(lambda t: F.sum(x * F.col(DT)) / F.nullif(_hours(x), F.lit(0.0)) if t else F.avg(x), "mean", name)


def median(name: str) -> Aggregate:
    return quantile(name, 0.5)


def quantile(name: str, q: float | list[float]) -> Aggregate:
    """Exact quantiles with linear interpolation, not weighted; a list of levels (different ones from 0 to 1, MOST_LEVELS at
    most) gives an array, in one pass."""
    own = q if isinstance(q, list) else [q]
    if not 1 <= len(own) <= MOST_LEVELS or len({*own}) < len(own) or not all(0 <= x <= 1 for x in own):
        raise ValueError(f"1 to {MOST_LEVELS} different levels from 0 to 1")
    levels = F.array(*map(F.lit, q)) if isinstance(q, list) else F.lit(q)
    return Aggregate(lambda t: F.percentile(num(F.col(name)), levels), "quantile", name)


def low(name: str) -> Aggregate:
    return Aggregate(lambda t: F.min(name), "min", name)


def high(name: str) -> Aggregate:
    return Aggregate(lambda t: F.max(name), "max", name)


def std(name: str) -> Aggregate:
    """Of the population, not weighted."""
    return Aggregate(lambda t: F.stddev_pop(num(F.col(name))), "std", name)


def count(name: str) -> Aggregate:
    """Of what isn't missing; false counts. Of no cells at all it is missing, like all others."""
    return Aggregate(lambda t: F.when(F.count(F.lit(1)) > 0, F.count(name)), "count", name)


def any_of(name: str) -> Aggregate:
    return Aggregate(lambda t: F.bool_or(name), "any", name)


def all_of(name: str) -> Aggregate:
    return Aggregate(lambda t: F.bool_and(name), "all", name)


BY_NAME = {"sum": total, "mean": mean, "median": median, "min": low, "max": high, "std": std, "count": count, "any": any_of, "all": all_of}
