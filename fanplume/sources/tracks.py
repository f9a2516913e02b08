"""Routes from outside: GPX tracks and encoded polylines become rows (route, sample, lat, lon, hours)."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanplume.operators.shapes import significance
from fanplume.operators.spatial import with_polylines

POINTS = "route string, sample long, lat double, lon double, hours double"


_POINT = "array<struct<_lat: double, _lon: double, time: string>>"
#: What a GPX document holds of tracks and routes.
GPX = f"trk array<struct<name: string, trkseg: array<struct<trkpt: {_POINT}>>>>, rte array<struct<name: string, rtept: {_POINT}>>"


def read_gpx(spark: SparkSession, path: str, on_globe: bool = True) -> tuple[DataFrame, DataFrame]:
    """The points of all GPX documents in the files at `path`, by Spark's XML source, and the files that are refused.

    A file may hold many documents under one root; each gives its first track, of all segments, or its first route if it has no
    track. Points are (file, route, sample, lat, lon, hours): the route is the track's name, hours since the first
    point are there only if every point has a time. Points off the globe or without a place go with their whole route,
    unless `on_globe` is off: then every point stays as it is written.
    Files with a DOCTYPE are refused: nothing of them is read, and the second frame names them.
    """
    name = F.input_file_name().alias("file")
    refused = spark.read.text(path).select(name, "value").filter(F.upper("value").contains("<!DOCTYPE")).select("file").distinct()
    own = spark.read.format("xml").option("rowTag", "gpx").option("ignoreNamespace", "true").option("mode", "DROPMALFORMED").schema(GPX).load(path).select(name, "trk", "rte")
    own = own.join(refused, "file", "left_anti")
    track, route = F.try_element_at("trk", F.lit(1)), F.try_element_at("rte", F.lit(1))
    segments = F.filter(track["trkseg"], lambda s: s["trkpt"].isNotNull())
    points = F.when(track.isNotNull(), F.flatten(F.transform(segments, lambda s: s["trkpt"]))).otherwise(route["rtept"])
    own = own.select("file", F.coalesce(track["name"], route["name"]).alias("route"), points.alias("p"))
    placed = F.forall("p", lambda p: F.coalesce(F.abs(p["_lat"]) <= 90, F.lit(False)) & F.coalesce(F.abs(p["_lon"]) <= 180, F.lit(False)))
    at = lambda p: F.unix_micros(F.try_to_timestamp(F.trim(p["time"])))
    own = own.filter(F.size("p") > 0).filter(placed if on_globe else F.lit(True)).withColumns({"timed": F.forall("p", lambda p: at(p).isNotNull()), "start": at(F.element_at("p", 1))})
    rows = own.select("file", "route", "timed", "start", F.posexplode("p").alias("sample", "p"))
    hours = F.when(F.col("timed"), (at(F.col("p")) - F.col("start")) / 3.6e9)
    return rows.select("file", "route", F.col("sample").cast("long").alias("sample"), F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), hours.alias("hours")), refused


def write_gpx(points: DataFrame, path: str) -> None:
    """Routes (route, sample, lat, lon, and time where there is one) as GPX documents by Spark's XML writer, which gathers
    those of a task under one root."""
    time = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if "time" in points.columns else F.lit(None).cast("string")
    point = F.struct(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), time.alias("time"))
    own = points.groupBy(F.col("route").cast("string").alias("route")).agg(F.array_sort(F.collect_list(F.struct("sample", point.alias("p")))).alias("own"))
    segment = F.array(F.struct(F.transform("own", lambda x: x["p"]).alias("trkpt")))
    own.select(F.array(F.struct(F.col("route").alias("name"), segment.alias("trkseg"))).alias("trk")).write.format("xml").option("rootTag", "documents").option("rowTag", "gpx").save(path)


def polyline_points(text: str, on_globe: bool = True) -> list[tuple[float, float]]:
    """Decode a polyline of precision 5. Points off the globe are an error unless `on_globe` is off."""
    values, value, shift = [], 0, 0
    for c in text:
        bits = ord(c) - 63
        if not 0 <= bits < 64:
            raise ValueError("not a polyline")
        if shift > (30 if on_globe else 50):  # more than any place on the globe, or any exact one, needs
            raise ValueError("a value of the polyline is too long")
        value |= (bits & 31) << shift
        shift += 5
        if bits < 32:
            values.append(~(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    if shift or len(values) % 2:
        raise ValueError("the polyline ends early")
    places = np.cumsum(np.array(values, float).reshape(-1, 2), axis=0) / 1e5
    if on_globe and len(places) and (abs(places[:, 0]).max() > 90 or abs(places[:, 1]).max() > 180):
        raise ValueError("a point lies off the globe")
    return [tuple(p) for p in places.tolist()]


def gpx_points(text: str) -> list[tuple[float, float, float | None]]:
    """(lat, lon, hours since the first point) of the first track, or the first route without one.

    Times count only if every point has one. Documents with a DOCTYPE are refused.
    """
    if "<!DOCTYPE" in text.upper():
        raise ValueError("a GPX file needs no DOCTYPE")
    root = ET.fromstring(text)
    local = lambda e: e.tag.rpartition("}")[2]
    parent = next((e for kind in ("trk", "rte") for e in root.iter() if local(e) == kind), None)
    found = [] if parent is None else [e for e in parent.iter() if local(e) in ("trkpt", "rtept")]
    times = [next((c.text for c in e if local(c) == "time" and c.text), None) for e in found]
    hours: list[float | None] = [None] * len(found)
    if found and all(times):
        parsed = [datetime.fromisoformat(t.strip().replace("Z", "+00:00")) for t in times]
        parsed = [t if t.tzinfo else t.replace(tzinfo=timezone.utc) for t in parsed]
        hours = [(t - parsed[0]).total_seconds() / 3600 for t in parsed]
    return [(float(e.get("lat")), float(e.get("lon")), h) for e, h in zip(found, hours, strict=True)]


def unfold(files: DataFrame, name: str, text: str, form: str, on_globe: bool = True) -> DataFrame:
    """Rows of points from rows that hold one route's text each: `form` is polyline or gpx. A polyline's points off the globe
    are an error unless `on_globe` is off."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for route, own in zip(batch["route"], batch["text"], strict=True):
                points = [(*p, None) for p in polyline_points(own, on_globe)] if form == "polyline" else gpx_points(own)
                yield pd.DataFrame([(route, k, *p) for k, p in enumerate(points)], columns=["route", "sample", "lat", "lon", "hours"]).astype({"hours": float})

    return files.select(F.col(name).cast("string").alias("route"), F.col(text).alias("text")).mapInPandas(run, POINTS)


def simplified(lat: np.ndarray, lon: np.ndarray, tolerance_km: float) -> np.ndarray:
    """Which points Douglas-Peucker keeps, on a plane around the track's middle, by the distance to the line through both ends."""
    y = lat * 111.195
    x = lon * 111.195 * np.cos(np.radians(lat.mean()))
    keep = np.zeros(len(lat), bool)
    keep[[0, -1]] = True
    todo = [(0, len(lat) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        dx, dy = x[b] - x[a], y[b] - y[a]
        size = float(np.hypot(dx, dy))
        off = np.abs(px * dy - py * dx) / size if size else np.hypot(px, py)
        k = int(off.argmax())
        if off[k] > tolerance_km:
            m = a + 1 + k
            keep[m] = True
            todo += [(a, m), (m, b)]
    return keep


def simplify(points: DataFrame, tolerance_km: float = 0.05) -> DataFrame:
    """The points (route, sample, lat, lon) of each route that Douglas-Peucker keeps, those whose significance is above the
    tolerance. Long routes are split over tasks; rows whose route is null are one route."""
    named = F.coalesce(F.concat(F.lit("="), F.col("route").cast("string")), F.lit("")).alias("__route")
    found = significance(points.select(named, "sample", "lat", "lon"), ["__route"]).filter(F.col("significance") > tolerance_km)
    route = F.when(F.col("__route") != "", F.expr("substring(__route, 2)")).cast(points.schema["route"].dataType)
    return found.select(route.alias("route"), "sample", "lat", "lon")


def describe(points: DataFrame, speed_kmh: float = 20.0, tolerance_km: float = 0.05) -> DataFrame:
    """Of each route (route, sample, lat, lon, distance_km, and hours where a track has them): its length, bounds, hours
    at a speed and by its own times, and its simplified line as a polyline."""
    own = [(F.max("hours") - F.min("hours")).alias("track_hours")] if "hours" in points.columns else []
    bounds = [F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east")]
    facts = points.groupBy("route").agg(F.max("distance_km").alias("km"), *bounds, (F.max("distance_km") / speed_kmh).alias("hours"), *own)
    kept = simplify(points, tolerance_km)
    lines = with_polylines(kept, ["route"]).join(kept.groupBy("route").agg(F.count(F.lit(1)).alias("kept_points")), "route")
    return facts.join(lines, "route")
