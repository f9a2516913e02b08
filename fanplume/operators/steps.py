"""From model steps to hours: de-accumulation, interval and bracketing joins, run selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanplume.functions.missing import known, num


def deaccumulate(steps: DataFrame, value: str, keys: list[str], step: str = "step", name: str = "rate") -> DataFrame:
    """Rates between steps from totals since the start; a total that falls gives 0. The first step has no rate before
    it, and beside a missing total the rate is missing."""
    w = Window.partitionBy(*keys).orderBy(step)
    total = known(num(F.col(value)))
    change = total - F.lag(total).over(w)
    return steps.withColumn(name, F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))) / (F.col(step) - F.lag(step).over(w)))


def deaverage(steps: DataFrame, value: str, keys: list[str], step: str = "step", name: str = "rate") -> DataFrame:
    """Rates between steps from means since the start."""
    return deaccumulate(steps.withColumn("__total", num(F.col(value)) * F.col(step)), "__total", keys, step, name).drop("__total")


def brackets(steps: DataFrame, keys: list[str], step: str = "step", values: list[str] | None = None) -> DataFrame:
    """Each step with the one before it (low, low_<value>): the intervals (low, step]."""
    w = Window.partitionBy(*keys).orderBy(step)
    made = {"low": F.lag(step).over(w)} | {f"low_{v}": F.lag(v).over(w) for v in values or []}
    return steps.withColumns(made).filter(F.col("low").isNotNull())


def at_times(steps: DataFrame, keys: list[str], every: int, value: str, step: str = "step", interval: bool = False) -> DataFrame:
    """Values at each multiple of `every` that the steps span.

    An instant lies between the two steps around it, on their straight line (an exact hit takes that step's value);
    with `interval` a rate takes the value of the step whose interval holds the middle of its hours.
    Each interval unfolds its own times, so the range join needs no comparison of all times with all steps.
    """
    own = brackets(steps, keys, step, [value])
    low, high = F.col("low"), F.col(step)
    if interval:
        # the sample t stands for [t, t + every); its middle lies in (low, high]
        first, last = F.floor((low - every / 2) / every) + 1, F.floor((high - every / 2) / every)
    else:
        start = F.row_number().over(Window.partitionBy(*keys).orderBy(step)) == 1
        first, last = F.when(start, F.ceil(low / every)).otherwise(F.floor(low / every) + 1), F.floor(high / every)
    own = own.withColumns({"__first": first, "__last": last}).filter("__first <= __last")
    own = own.withColumn("__k", F.explode(F.sequence("__first", "__last"))).withColumn("t", F.col("__k") * every)
    if interval:
        return own.select(*keys, "t", F.col(value).alias("value"))
    weight = (F.col("t") - low) / (high - low)
    return own.select(*keys, "t", ((1 - weight) * F.col(f"low_{value}") + weight * F.col(value)).alias("value"))


def best_run(runs: DataFrame, first: Column, last: Column, source: str = "source", run: str = "run") -> DataFrame:
    """Of each source, the newest run that covers first to last, else the newest that covers part of it.

    `runs` has from_hour and to_hour, what each run reaches.
    """
    full = (F.col("from_hour") <= first) & (F.col("to_hour") >= last)
    part = (F.col("from_hour") < last) & (F.col("to_hour") > first)
    order = Window.partitionBy(source).orderBy(full.desc(), F.col(run).desc())
    return runs.filter(full | part).withColumn("full", full).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
