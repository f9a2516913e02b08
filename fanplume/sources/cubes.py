"""Cubes over tables of events, order lines, suppliers and nations."""

from __future__ import annotations

import dataclasses
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fanplume.cube import Cube
from fanplume.functions.weather import bearing, haversine_km
from fanplume.sources.axes import stored_axes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_cells(spark: SparkSession, sf_dir: str, start: datetime | None = None, stop: datetime | None = None) -> DataFrame:
    """Events by type, user and hour, of hours from `start` and before `stop`; the bounds reach the scan."""
    return _cells_of(table(spark, sf_dir, "events"), start, stop)


def _cells_of(events: DataFrame, start: datetime | None = None, stop: datetime | None = None) -> DataFrame:
    bound = lambda t: F.lit(t).cast("timestamp_ntz").cast(events.schema["ts"].dataType)
    if start is not None:
        events = events.filter(F.col("ts") >= bound(start))
    if stop is not None:  # an hour that begins before `stop` ends less than an hour behind it
        events = events.filter(F.col("ts") < bound(stop + timedelta(hours=1)))
    return events.groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 10).alias("member"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")).agg(
        F.avg("value").alias("v"), F.max("value").alias("vmax"), F.count(F.lit(1)).alias("n")
    )


def _events(spark: SparkSession, sf_dir: str, kept: str) -> Cube:
    dims = ["model", "member", "time"]
    events = table(spark, sf_dir, "events")  # once, since each read looks at the files' footers
    labels = stored_axes(spark, f"{sf_dir}/events.parquet", kept, _cells_of(events).filter(kept).select(*dims), dims)

    def within(start: datetime | None, stop: datetime | None) -> Cube:
        own, hour = labels, lambda t: F.lit(t).cast("timestamp_ntz")
        if start is not None:  # an hour that is cut by the start has lost events, and isn't selected either
            own = own.withColumn("time", F.filter("time", lambda t: t >= hour(start)))
        if stop is not None:
            own = own.withColumn("time", F.filter("time", lambda t: t < hour(stop)))
        made = Cube.over(Cube.unfolded(own, dims), _cells_of(events, start, stop).filter(kept), dims, ["v", "vmax", "n"], v="mm/h", vmax="km/h", n="")
        return dataclasses.replace(made, labels=own, known=tuple(dims))

    return dataclasses.replace(within(None, None), within=within)


def event_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """Events by type (model), user (member) and hour: mean, greatest and number of values."""
    return _events(spark, sf_dir, "true")


def padded_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """The same, but one model has half the members; the rest of its cells are there and missing."""
    return _events(spark, sf_dir, "model <> 'signup' OR member < 5")


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"), (F.col("l_linenumber") - 1).alias("member"), (F.col("l_suppkey") % 10).alias("lat_pos"), (F.col("l_partkey") % 10).alias("lon_pos"), "l_quantity", "l_shipdate"
    )


def grid_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """Order lines on a 10 x 10 grid: mean quantity by return flag (model), line number (member) and place."""
    cells = line_cells(spark, sf_dir).withColumns({"lat": F.round(50 + 0.1 * F.col("lat_pos"), 4), "lon": F.round(6 + 0.1 * F.col("lon_pos"), 4)})
    cells = cells.groupBy("model", "member", "lat", "lon").agg(F.avg("l_quantity").alias("v"))
    dims = ["model", "member", "lat", "lon"]
    labels = stored_axes(spark, f"{sf_dir}/lineitem.parquet", "grid", cells.select(*dims), dims)
    made = Cube.over(Cube.unfolded(labels, dims), cells, dims, ["v"], v="mm")
    return dataclasses.replace(made, labels=labels, known=tuple(dims))


def step_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals since the start (acc) at steps of 30 days, per return flag (model) and line number (member)."""
    step = (F.floor(F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")) / 30) * 30).alias("step")
    sums = line_cells(spark, sf_dir).groupBy("model", "member", step).agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("model", "member").orderBy("step")
    return sums.select("model", "member", "step", F.sum("q").over(w).alias("acc"))


def routes(spark: SparkSession, sf_dir: str, points_per_route: int = 50) -> DataFrame:
    """Suppliers as routes of 50 points: position, distance from the route's start, course to the next point."""
    k = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(F.floor(k / points_per_route).alias("route"), k.alias("sample"), (50 + 0.02 * k).alias("lat"), (7 + 0.01 * (k % 7)).alias("lon"), F.col("s_acctbal").alias("v"))
    w = Window.partitionBy("route").orderBy("sample")
    back, ahead = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    leg = F.coalesce(haversine_km(back("lat"), back("lon"), F.col("lat"), F.col("lon")), F.lit(0.0))
    points = points.withColumns({"leg_km": leg, "course": bearing(F.col("lat"), F.col("lon"), ahead("lat"), ahead("lon"))})
    return points.withColumn("distance_km", F.sum("leg_km").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as named points."""
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("point"), (50 + 0.03 * F.col("n_nationkey")).alias("lat"), (6 + 0.02 * F.col("n_nationkey")).alias("lon"))
