"""Registered queries that run streams, and lines simplified and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fanplume.operators.spatial import with_polylines
from fanplume.plans.cube_queries import EV, shown
from fanplume.plans.place_queries import FLAT, KEPT, LEGS, RT
from fanplume.sources.cubes import event_cells, routes
from fanplume.sources.tracks import simplify, unfold
from fanplume.streaming.hours import event_stream, hourly_cells, latest_cells, run_available


def st1_stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark has passed, from a stream over the event files."""
    return shown(run_available(hourly_cells(event_stream(spark, sf_dir)), spark))


def st2_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run replaces the cells of the hours it has; the first one stays elsewhere."""
    first = event_cells(spark, sf_dir)
    second = first.filter("time >= TIMESTAMP '2024-01-15 00:00:00'").withColumn("v", F.col("v") + 1)
    return shown(latest_cells(first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))))


def lo8_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(simplify(routes(spark, sf_dir), 0.2))


def sc15_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes as polylines and back: points rounded to five places. Those of keys above 2,000 lie off the globe; a route may
    lack some of its samples, whose numbers a polyline doesn't keep."""
    own = routes(spark, sf_dir)
    numbers = own.select(F.col("route").cast("string").alias("route"), (F.row_number().over(Window.partitionBy("route").orderBy("sample")) - 1).cast("long").alias("at"), (F.col("sample") % 50).alias("sample"))
    back = unfold(with_polylines(own, ["route"], groups=11), "route", "polyline", "polyline", on_globe=False).withColumnRenamed("sample", "at")
    return back.drop("hours").join(numbers, ["route", "at"]).select("route", "sample", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


QUERIES = {f.__name__: f for f in (st1_stream_hours, st2_latest_run, lo8_simplify, sc15_round_trip)}

ORACLE_SQL = {
    "lo8_simplify": f"WITH RECURSIVE {RT}, vl AS (SELECT route AS shape, sample, lat, lon FROM rt), {FLAT}, {LEGS} SELECT route, sample, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ({KEPT.format(0.2)})",
    "st1_stream_hours": f"WITH {EV} SELECT model, member, time, round(v, 6) AS v, round(vmax, 6) AS vmax, n FROM cells WHERE time + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR",
    "st2_latest_run": f"WITH {EV} SELECT model, member, time, round(CASE WHEN time >= TIMESTAMP '2024-01-15' THEN v + 1 ELSE v END, 6) AS v, round(vmax, 6) AS vmax, n, CASE WHEN time >= TIMESTAMP '2024-01-15' THEN 2 ELSE 1 END AS run FROM cells",
    "sc15_round_trip": "SELECT CAST(s_suppkey // 50 AS VARCHAR) AS route, s_suppkey % 50 AS sample, round(50 + 0.02 * s_suppkey, 5) AS lat, round(7 + 0.01 * (s_suppkey % 7), 5) AS lon FROM supplier",
}
