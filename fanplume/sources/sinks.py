"""What results become: tables with quantile columns, dense chart arrays, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanplume.cube import Cube


#: Rows of a table and values of a chart that somebody will look at.
MOST_ROWS, MOST_VALUES = 500, 400_000


def table_rows(cube: Cube, decimals: int = 4, most: int | None = MOST_ROWS) -> DataFrame:
    """One row per cell in the order of the dimensions, values rounded, rows where nothing is known included; more than
    `most` rows are an error. None sets no limit, and leaves out the job that counts."""
    shown = cube.rows().select(*cube.dims, *(F.round(v, decimals).alias(v) for v in cube.values))
    return shown if most is None else require_rows(shown, most)


def quantile_columns(cube: Cube, value: str, levels: list[float], decimals: int = 4) -> DataFrame:
    """The quantile dimension as columns p10, p50, ..."""
    others = [d for d in cube.dims if d != "quantile"]
    picked = [F.round(F.max(F.when(F.col("quantile") == q, F.col(value))), decimals).alias(f"p{round(q * 100):d}") for q in levels]
    return cube.df.groupBy(*others).agg(*picked)


def chart_arrays(cube: Cube, value: str, along: str, decimals: int = 3, most: int | None = MOST_VALUES) -> DataFrame:
    """A dense array of a value along one dimension, in its order, for each combination of the others; what isn't finite
    is missing. More than `most` values are an error; None sets no limit."""
    if most is not None:
        require_rows(cube.df, most)
    others = [d for d in cube.dims if d != along]
    shown = F.when(F.abs(F.col(value)) < float("inf"), F.round(value, decimals))
    cells = F.array_sort(F.collect_list(F.struct(cube.at(along).alias("at"), shown.alias("x"))))
    return cube.df.groupBy(*others).agg(F.transform(cells, lambda s: s["x"]).alias("data"))


def summary(cube: Cube, value: str) -> DataFrame:
    """The sizes of all dimensions and the least, mean and greatest of what is known, as one row."""
    sizes = [F.count_distinct(d).alias(f"n_{d}") for d in cube.dims]
    x = F.when(F.abs(F.col(value)) < float("inf"), F.col(value))
    return cube.df.agg(*sizes, F.min(x).alias("min"), F.avg(x).alias("mean"), F.max(x).alias("max"))


def require_rows(df: DataFrame, most: int) -> DataFrame:
    """`df`, or an error if it has more rows; looks at no more than one row beyond."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"the result has more than {most} rows")
    return df


def model_table(cube: Cube, start: str = "time") -> DataFrame:
    """Per model: its members and stretch of time with anything known, hours from its first sample on, and the values
    of which it has none at all, joined by commas."""
    known = {v: F.col(v).isNotNull() for v in cube.values}
    some = F.greatest(*known.values(), F.lit(False))
    absent = F.concat_ws(",", *(F.when(~F.max(k), F.lit(v)) for v, k in known.items()))
    first, last = F.min(F.when(some, F.col(start))), F.max(F.when(some, F.col(start)))
    lead = F.timestamp_diff("HOUR", first, last)
    return cube.df.groupBy("model").agg(F.count_distinct(F.when(some, F.col("member"))).alias("members"), first.alias("first"), last.alias("last"), lead.alias("lead_hours"), absent.alias("missing"))
