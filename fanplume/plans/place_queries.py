"""Registered queries over steps, routes, points and grids, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanplume.functions.weather import crosswind, headwind
from fanplume.operators import spatial, steps
from fanplume.plans.cube_queries import HAVERSINE, shown
from fanplume.sources import fields
from fanplume.sources.cubes import places, routes, step_totals, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ST = """
sums AS (SELECT l_returnflag AS model, l_linenumber - 1 AS member, CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 30.0) * 30 AS BIGINT) AS step, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3),
st AS (SELECT model, member, step, sum(q) OVER (PARTITION BY model, member ORDER BY step) AS acc FROM sums)
"""
_LEG = HAVERSINE.format(a="plat", b="lat", c="plon", d="lon")
RT = f"""
pts AS (SELECT s_suppkey // 50 AS route, s_suppkey AS sample, 50 + 0.02 * s_suppkey AS lat, 7 + 0.01 * (s_suppkey % 7) AS lon, s_acctbal AS v FROM supplier),
lagged AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM pts WINDOW w AS (PARTITION BY route ORDER BY sample)),
legs AS (SELECT *, coalesce({_LEG}, 0) AS leg_km, degrees(atan2(sin(radians(nlon - lon)) * cos(radians(nlat)), cos(radians(lat)) * sin(radians(nlat)) - sin(radians(lat)) * cos(radians(nlat)) * cos(radians(nlon - lon)))) AS deg FROM lagged),
rt AS (SELECT route, sample, lat, lon, v, leg_km, deg - 360 * floor(deg / 360) AS course, sum(leg_km) OVER (PARTITION BY route ORDER BY sample) AS distance_km FROM legs)
"""
PT = "pt AS (SELECT n_name AS point, 50 + 0.03 * n_nationkey AS lat, 6 + 0.02 * n_nationkey AS lon FROM nation)"
CELLS = "cells AS (SELECT i * 10 + j AS cell, i AS lat_pos, j AS lon_pos, round(50 + 0.1 * i, 4) AS lat, round(6 + 0.1 * j, 4) AS lon FROM (SELECT unnest(range(10)) AS i) CROSS JOIN (SELECT unnest(range(10)) AS j))"
GRID = "grid AS (SELECT l_suppkey % 10 AS lat_pos, l_partkey % 10 AS lon_pos, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
RUNS = "runs AS (SELECT o_orderpriority AS source, strftime(o_orderdate, '%Y-%m-%d') AS run, min(o_custkey) AS from_hour, max(o_custkey) AS to_hour FROM orders GROUP BY 1, 2)"
KEYS = ["model", "member"]
WEIGHT = "CASE WHEN lat_pos = r THEN 1 - (fr - r) ELSE fr - r END * CASE WHEN lon_pos = c THEN 1 - (fc - c) ELSE fc - c END"
#: The weighted sum, where what was found makes up all of the weight.
GUARD = f"CASE WHEN abs(sum(CASE WHEN v IS NOT NULL THEN {WEIGHT} END) - 1) < 1e-6 THEN sum(v * {WEIGHT}) END"


#: Lines `vl` (shape, sample, lat, lon) on a plane, and their legs as Douglas-Peucker splits them, each with the tolerance up to which it is split off.
FLAT = "flat AS (SELECT shape, sample, lat, lon, lon * 111.195 * cos(radians(avg(lat) OVER (PARTITION BY shape))) AS x, lat * 111.195 AS y FROM vl)"
LEGS = """splits(shape, a, b, cap) AS (
SELECT shape, min(sample), max(sample), CAST('infinity' AS DOUBLE) FROM vl GROUP BY 1
UNION ALL SELECT shape, CASE side WHEN 0 THEN a ELSE split END, CASE side WHEN 0 THEN split ELSE b END, level FROM (
  SELECT l.shape, l.a, l.b, p.sample AS split, least(l.cap, CASE WHEN hypot > 0 THEN abs((p.x - q.x) * (r.y - q.y) - (p.y - q.y) * (r.x - q.x)) / hypot ELSE sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) END) AS level,
         row_number() OVER (PARTITION BY l.shape, l.a ORDER BY CASE WHEN hypot > 0 THEN abs((p.x - q.x) * (r.y - q.y) - (p.y - q.y) * (r.x - q.x)) / hypot ELSE sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) END DESC, p.sample) AS n
  FROM (SELECT l.*, sqrt((f.x - e.x) ** 2 + (f.y - e.y) ** 2) AS hypot FROM splits l JOIN flat e ON e.shape = l.shape AND e.sample = l.a JOIN flat f ON f.shape = l.shape AND f.sample = l.b) l
  JOIN flat q ON q.shape = l.shape AND q.sample = l.a JOIN flat r ON r.shape = l.shape AND r.sample = l.b JOIN flat p ON p.shape = l.shape AND p.sample > l.a AND p.sample < l.b
) CROSS JOIN (VALUES (0), (1)) s(side) WHERE n = 1)"""

#: The vertices that matter by more than a tolerance, in km, and the ends.
KEPT = "SELECT v.shape AS route, v.sample, v.lat, v.lon FROM vl v LEFT JOIN (SELECT shape, b, max(cap) AS s FROM splits GROUP BY 1, 2) l ON l.shape = v.shape AND l.b = v.sample WHERE s > {0} OR v.sample IN (SELECT min(sample) FROM vl GROUP BY shape)"
#: Points (route, sample, lat, lon) with the change of their rounded degrees since the point before.
DEGREES = "SELECT *, i - coalesce(lag(i) OVER w, 0) AS di, j - coalesce(lag(j) OVER w, 0) AS dj FROM (SELECT *, CAST(round(lat * 100000) AS BIGINT) AS i, CAST(round(lon * 100000) AS BIGINT) AS j FROM {0}) WINDOW w AS (PARTITION BY route ORDER BY sample)"


def polyline_sql() -> str:
    """The polyline of a group of rows of DEGREES: groups of five bits of each change, least first, as characters."""
    coded = lambda d: f"array_to_string(list_transform(range(0, 6), lambda k: CASE WHEN k = 0 OR ({d} >> (5 * k)) > 0 THEN chr(CAST(63 + (({d} >> (5 * k)) & 31) + CASE WHEN ({d} >> (5 * k + 5)) > 0 THEN 32 ELSE 0 END AS INT)) ELSE '' END), '')"
    folded = lambda d: f"(CASE WHEN {d} < 0 THEN -2 * {d} - 1 ELSE 2 * {d} END)"
    return f"string_agg({coded(folded('di'))} || {coded(folded('dj'))}, '' ORDER BY sample)"


def query(key: str, build: Callable[[SparkSession, str], DataFrame], sql: str, *ctes: str) -> None:
    QUERIES[key] = build
    if sql:
        ORACLE_SQL[key] = f"WITH {', '.join(ctes)} {sql}"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("lat_pos"), (F.col("l_partkey") % 10).alias("lon_pos")).agg(F.avg("l_quantity").alias("v"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the 10 x 10 grid that order lines lie in."""
    grid = _grid(spark, sf_dir).select("lat_pos", "lon_pos")
    return grid.select((F.col("lat_pos") * 10 + F.col("lon_pos")).alias("cell"), F.round(50 + 0.1 * F.col("lat_pos"), 4).alias("lat"), F.round(6 + 0.1 * F.col("lon_pos"), 4).alias("lon"))


def _corner_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as points on and between the lines of the grid."""
    k = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").filter(k % 46 / 5 <= 9)
    return points.select(k.alias("point"), (50 + 0.1 * (k % 18) / 2).alias("lat"), (6 + 0.1 * (k % 46) / 5).alias("lon"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a priority (source) on a day (run) reach from their least to their greatest customer."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("source"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("run")).agg(F.min("o_custkey").alias("from_hour"), F.max("o_custkey").alias("to_hour"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields as the steps of order lines: source, run (year), variable, step."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_linestatus").alias("source"), F.year("l_shipdate").alias("run"), F.col("l_returnflag").alias("variable"), F.dayofyear("l_shipdate").alias("step"))


STORED = "stored AS (SELECT l_linestatus AS source, CAST(year(l_shipdate) AS INT) AS run, l_returnflag AS variable, CAST(dayofyear(l_shipdate) AS INT) AS step FROM lineitem)"

# steps
query("de4_deaccumulate", lambda s, d: shown(steps.deaccumulate(step_totals(s, d), "acc", KEYS).select("model", "member", "step", "rate")), "SELECT model, member, step, round(greatest(acc - lag(acc) OVER w, 0) / (step - lag(step) OVER w), 6) AS rate FROM st WINDOW w AS (PARTITION BY model, member ORDER BY step)", ST)
ORACLE_SQL["de4_deaccumulate"] = ORACLE_SQL["de4_deaccumulate"].replace("round(greatest(acc - lag(acc) OVER w, 0) / (step - lag(step) OVER w), 6)", "CASE WHEN lag(acc) OVER w IS NOT NULL THEN round(greatest(acc - lag(acc) OVER w, 0) / (step - lag(step) OVER w), 6) END")
query("de5_deaverage", lambda s, d: shown(steps.deaverage(step_totals(s, d).filter("step > 0").withColumn("m", F.col("acc") / F.col("step")), "m", KEYS).select("model", "member", "step", "rate")), "SELECT model, member, step, CASE WHEN lag(acc) OVER w IS NOT NULL THEN round(greatest(acc - lag(acc) OVER w, 0) / (step - lag(step) OVER w), 6) END AS rate FROM st WHERE step > 0 WINDOW w AS (PARTITION BY model, member ORDER BY step)", ST)
# totals of which some are missing: no rate before or behind them
query("de4_missing_totals", lambda s, d: shown(steps.deaccumulate(step_totals(s, d).withColumn("acc", F.when(F.col("step") % 150 != 60, F.col("acc"))), "acc", KEYS).select("model", "member", "step", "rate")),
      "SELECT model, member, step, round(CASE WHEN acc - before < 0 THEN 0 ELSE acc - before END / (step - lag(step) OVER w), 6) AS rate FROM (SELECT *, lag(acc) OVER (PARTITION BY model, member ORDER BY step) AS before FROM (SELECT * REPLACE (CASE WHEN step % 150 <> 60 THEN acc END AS acc) FROM st)) WINDOW w AS (PARTITION BY model, member ORDER BY step)", ST)
ORACLE_SQL["de4_missing_totals"] = ORACLE_SQL["de4_missing_totals"].replace("CASE WHEN acc - before < 0 THEN 0 ELSE acc - before END", "CASE WHEN acc - before < 0 THEN 0 WHEN acc - before >= 0 THEN acc - before END")
query("de5_missing_means", lambda s, d: shown(steps.deaverage(step_totals(s, d).filter("step > 0").withColumn("m", F.when(F.col("step") % 210 != 90, F.col("acc") / F.col("step"))), "m", KEYS).select("model", "member", "step", "rate")),
      "SELECT model, member, step, round(CASE WHEN acc IS NULL OR lag(acc) OVER w IS NULL THEN NULL ELSE greatest(acc - lag(acc) OVER w, 0) / (step - lag(step) OVER w) END, 6) AS rate FROM (SELECT * REPLACE (CASE WHEN step % 210 <> 90 THEN acc END AS acc) FROM st WHERE step > 0) WINDOW w AS (PARTITION BY model, member ORDER BY step)", ST)
query("jo6_interval_join", lambda s, d: shown(steps.at_times(steps.deaccumulate(step_totals(s, d), "acc", KEYS), KEYS, 7, "rate", interval=True)),
      "SELECT model, member, t, round(rate, 6) AS value FROM (SELECT model, member, step, lag(step) OVER w AS low, greatest(acc - lag(acc) OVER w, 0) / (step - lag(step) OVER w) AS rate FROM st WINDOW w AS (PARTITION BY model, member ORDER BY step)) b JOIN (SELECT unnest(range(-70, 4000, 7)) AS t) h ON h.t + 3.5 > b.low AND h.t + 3.5 <= b.step", ST)
query("jo7_bracketing_join", lambda s, d: shown(steps.at_times(step_totals(s, d), KEYS, 7, "acc")),
      "SELECT model, member, t, round((1 - (t - low) / (step - low)) * lo + (t - low) / (step - low) * acc, 6) AS value FROM (SELECT model, member, step, acc, lag(step) OVER w AS low, lag(acc) OVER w AS lo, row_number() OVER w AS n FROM st WINDOW w AS (PARTITION BY model, member ORDER BY step)) b JOIN (SELECT unnest(range(-70, 4000, 7)) AS t) h ON (h.t > b.low OR (n = 2 AND h.t = b.low)) AND h.t <= b.step", ST)
query("jo12_best_run", lambda s, d: steps.best_run(_runs(s, d), F.lit(20), F.lit(60)), "SELECT source, run, from_hour, to_hour, \"full\" FROM (SELECT *, from_hour <= 20 AND to_hour >= 60 AS \"full\" FROM runs WHERE (from_hour <= 20 AND to_hour >= 60) OR (from_hour < 60 AND to_hour > 20)) QUALIFY row_number() OVER (PARTITION BY source ORDER BY \"full\" DESC, run DESC) = 1", RUNS)
query("sc8_partition_scan", lambda s, d: _stored(s, d).filter("source = 'F' AND variable = 'R' AND step BETWEEN 10 AND 40").groupBy("run", "step").agg(F.count(F.lit(1)).alias("n")), "SELECT run, step, count(*) AS n FROM stored WHERE source = 'F' AND variable = 'R' AND step BETWEEN 10 AND 40 GROUP BY 1, 2", STORED)
query("sc9_kept_runs", lambda s, d: fields.kept_runs(_stored(s, d)), "SELECT source, run FROM (SELECT DISTINCT source, run FROM stored) QUALIFY dense_rank() OVER (PARTITION BY source ORDER BY run DESC) <= 2", STORED)
query("sc10_cached_until", lambda s, d: fields.cached_until(_stored(s, d).filter("step > 0"), ["source", "run", "variable"], 1, 1), "SELECT source, run, variable, max(step) FILTER (step = k) AS until FROM (SELECT *, row_number() OVER (PARTITION BY source, run, variable ORDER BY step) AS k FROM (SELECT DISTINCT source, run, variable, step FROM stored)) GROUP BY 1, 2, 3", STORED)
query("jo10_missing_fields", lambda s, d: fields.missing_fields((x := _stored(s, d)).select("source", "run", "variable").distinct().withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(365)))), x), "SELECT DISTINCT w.source, w.run, w.variable, CAST(g.step AS INT) AS step FROM stored w CROSS JOIN (SELECT unnest(range(1, 366)) AS step) g EXCEPT SELECT source, run, variable, step FROM stored", STORED)
query("st5_last_twenty", lambda s, d: shown(steps_stats(s, d)), "SELECT source, run, round(avg(x) OVER w, 6) AS mean, count(x) OVER w AS n FROM (SELECT o_orderpriority AS source, strftime(o_orderdate, '%Y-%m-%d') AS run, sum(o_totalprice) AS x FROM orders GROUP BY 1, 2) WINDOW w AS (PARTITION BY source ORDER BY run ROWS 19 PRECEDING)", "one AS (SELECT 1)")


def steps_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean volume of the last twenty runs of each source."""
    from pyspark.sql import Window

    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("run")).agg(F.sum("o_totalprice").alias("x"))
    w = Window.partitionBy("source").orderBy("run").rowsBetween(-19, 0)
    return sums.select("source", "run", F.avg("x").over(w).alias("mean"), F.count("x").over(w).alias("n"))


# routes
query("de9_distance_bearing", lambda s, d: shown(routes(s, d)), "SELECT route, sample, round(lat, 6) AS lat, round(lon, 6) AS lon, v, round(leg_km, 6) AS leg_km, round(course, 6) AS course, round(distance_km, 6) AS distance_km FROM rt", RT)
query("ag15_distance_bins", lambda s, d: shown(spatial.by_distance(routes(s, d), [0.0, 20.0, 21.0, 60.0, 100.0, 300.0], ["route"], {"m": F.avg("v"), "n": F.count("v")})),
      "SELECT r.route, b.name AS distance_bin, round(avg(v), 6) AS m, CASE WHEN count(v) > 0 THEN count(v) END AS n FROM (SELECT DISTINCT route FROM rt) r CROSS JOIN (SELECT * FROM (VALUES (0, 20, '(0, 20]'), (20, 21, '(20, 21]'), (21, 60, '(21, 60]'), (60, 100, '(60, 100]'), (100, 300, '(100, 300]')) x(a, b, name)) b LEFT JOIN rt ON rt.route = r.route AND (rt.distance_km > b.a OR (b.a = 0 AND rt.distance_km = 0)) AND rt.distance_km <= b.b GROUP BY 1, 2", RT)
query("lo7_half_gaps", lambda s, d: shown(spatial.half_gaps(routes(s, d), ["route"], F.col("distance_km") / 50).select("route", "sample", "dt")), "SELECT route, sample, round((coalesce(lead(h) OVER w, h) - coalesce(lag(h) OVER w, h)) / 2, 6) AS dt FROM (SELECT route, sample, distance_km / 50 AS h FROM rt) WINDOW w AS (PARTITION BY route ORDER BY sample)", RT)
query("lo7_resampled_route", lambda s, d: shown(spatial.resample_routes(routes(s, d), 2.0, ["route"])),
      "SELECT l.route, k.k, round(k.k * gap, 6) AS at_km, round(lat + (k.k * gap - distance_km) / (to_km - distance_km) * (nlat - lat), 6) AS lat, round(lon + (k.k * gap - distance_km) / (to_km - distance_km) * (nlon - lon), 6) AS lon, round(course, 6) AS course FROM (SELECT *, lead(distance_km) OVER w AS to_km, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon, max(distance_km) OVER (PARTITION BY route) / greatest(1, ceil(max(distance_km) OVER (PARTITION BY route) / 2)) AS gap FROM rt WINDOW w AS (PARTITION BY route ORDER BY sample)) l JOIN (SELECT unnest(range(0, 20000)) AS k) k ON k.k <= floor(round(to_km / gap, 9)) AND k.k >= CASE WHEN distance_km = 0 THEN 0 ELSE floor(round(distance_km / gap, 9)) + 1 END WHERE to_km > distance_km", RT)
query("lo9_describe_route", lambda s, d: shown(routes(s, d).groupBy("route").agg(F.max("distance_km").alias("km"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.count(F.lit(1)).alias("points"))), "SELECT route, round(max(distance_km), 6) AS km, round(min(lat), 6) AS south, round(max(lat), 6) AS north, round(min(lon), 6) AS west, round(max(lon), 6) AS east, count(*) AS points FROM rt GROUP BY 1", RT)
query("sc15_polyline", lambda s, d: spatial.with_polylines(routes(s, d), ["route"]), f"SELECT route, {polyline_sql()} AS polyline FROM ({DEGREES.format('rt')}) GROUP BY route", RT)
query("jo8_route_diagonal", lambda s, d: shown(routes(s, d).select("route", "sample", "lat").join(table(s, d, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_acctbal").alias("field")), "sample")), "SELECT sample, route, round(lat, 6) AS lat, s_acctbal AS field FROM rt JOIN supplier ON s_suppkey = sample", RT)
query("de8_head_crosswind", lambda s, d: shown(routes(s, d).select("route", "sample", headwind(F.lit(20.0), F.col("v") % 360, F.col("course")).alias("head"), crosswind(F.lit(20.0), F.col("v") % 360, F.col("course")).alias("cross"))), "SELECT route, sample, round(20 * cos(radians(v % 360 - course)), 6) AS head, round(abs(20 * sin(radians(v % 360 - course))), 6) AS cross FROM rt", RT)

# points and grids
query("lo3_places", lambda s, d: shown(places(s, d)), "SELECT point, round(lat, 6) AS lat, round(lon, 6) AS lon FROM pt", PT)
query("lo5_area_grid", lambda s, d: shown(spatial.area_grid(s, 50.0, 50.9, 6.0, 6.9, 10, 10).join(_grid(s, d), ["lat_pos", "lon_pos"], "left").select("lat", "lon", "v")), "SELECT lat, lon, round(v, 6) AS v FROM cells LEFT JOIN grid USING (lat_pos, lon_pos)", CELLS, GRID)
query("lo10_bilinear", lambda s, d: shown(spatial.bilinear(places(s, d), _grid(s, d), ["v"], 50.0, 6.0, 0.1, 10, 10)),
      "SELECT point, round(CASE WHEN abs(sum(CASE WHEN v IS NOT NULL THEN CASE WHEN lat_pos = r THEN 1 - (fr - r) ELSE fr - r END * CASE WHEN lon_pos = c THEN 1 - (fc - c) ELSE fc - c END END) - 1) < 1e-6 THEN sum(v * CASE WHEN lat_pos = r THEN 1 - (fr - r) ELSE fr - r END * CASE WHEN lon_pos = c THEN 1 - (fc - c) ELSE fc - c END) END, 6) AS v FROM (SELECT point, (lat - 50) / 0.1 AS fr, (lon - 6) / 0.1 AS fc, least(floor((lat - 50) / 0.1), 8) AS r, least(floor((lon - 6) / 0.1), 8) AS c FROM pt) p JOIN grid ON lat_pos IN (r, r + 1) AND lon_pos IN (c, c + 1) WHERE fr BETWEEN 0 AND 9 AND fc BETWEEN 0 AND 9 GROUP BY point", PT, GRID)
# cells of which some aren't there (remainder 3 by 7) or have no value (5 by 11); a corner without weight doesn't matter
query("lo10_gaps", lambda s, d: shown(spatial.bilinear(_corner_points(s, d), _grid(s, d).filter("(lat_pos * 10 + lon_pos) % 7 <> 3").withColumn("v", F.when((F.col("lat_pos") * 10 + F.col("lon_pos")) % 11 != 5, F.col("v"))), ["v"], 50.0, 6.0, 0.1, 10, 10)),
      f"SELECT p.point, round(x.v, 6) AS v FROM cp p LEFT JOIN (SELECT point, {GUARD} AS v FROM (SELECT point, fr, fc, least(floor(fr), 8) AS r, least(floor(fc), 8) AS c FROM cp) q JOIN gg ON lat_pos IN (r, r + 1) AND lon_pos IN (c, c + 1) WHERE {WEIGHT} > 0 GROUP BY point) x USING (point)",
      "cp AS (SELECT s_suppkey AS point, round(s_suppkey % 18 / 2, 9) AS fr, round(s_suppkey % 46 / 5, 9) AS fc FROM supplier WHERE s_suppkey % 46 / 5 <= 9)", GRID, "gg AS (SELECT lat_pos, lon_pos, CASE WHEN (lat_pos * 10 + lon_pos) % 11 <> 5 THEN v END AS v FROM grid WHERE (lat_pos * 10 + lon_pos) % 7 <> 3)")
# cells east of 359 degrees, places west of 0: the same cells as three degrees further east
query("lo11_round_globe", lambda s, d: shown(spatial.nearest(places(s, d).withColumn("lon", F.col("lon") - 6.05), _cells(s, d).withColumn("lon", F.pmod(F.col("lon") - 6.05, F.lit(360.0))), max_km=30.0)),
      "SELECT point, cell, round(sqrt(d2) * 111.2, 6) AS km FROM (SELECT point, cell, round(pow(g.lat - p.lat, 2) + pow((g.lon - p.lon) * cos(radians(p.lat)), 2), 12) AS d2 FROM pt p CROSS JOIN (SELECT lat_pos * 10 + lon_pos AS cell, round(50 + 0.1 * lat_pos, 4) AS lat, round(6 + 0.1 * lon_pos, 4) AS lon FROM grid) g) WHERE sqrt(d2) * 111.2 <= 30 QUALIFY row_number() OVER (PARTITION BY point ORDER BY d2, cell) = 1", PT, GRID)
query("lo11_nearest_cell", lambda s, d: shown(spatial.nearest(places(s, d), _cells(s, d), max_km=30.0)),
      "SELECT point, cell, round(sqrt(d2) * 111.2, 6) AS km FROM (SELECT point, cell, round(pow(g.lat - p.lat, 2) + pow((g.lon - p.lon) * cos(radians(p.lat)), 2), 12) AS d2 FROM pt p CROSS JOIN (SELECT lat_pos * 10 + lon_pos AS cell, round(50 + 0.1 * lat_pos, 4) AS lat, round(6 + 0.1 * lon_pos, 4) AS lon FROM grid) g) WHERE sqrt(d2) * 111.2 <= 30 QUALIFY row_number() OVER (PARTITION BY point ORDER BY d2, cell) = 1", PT, GRID)
query("jo9_nearest_values", lambda s, d: shown(spatial.nearest(places(s, d), _cells(s, d)).join(_grid(s, d).withColumn("cell", F.col("lat_pos") * 10 + F.col("lon_pos")), "cell").select("point", "cell", "v")),
      "SELECT point, cell, round(v, 6) AS v FROM (SELECT point, g.lat_pos * 10 + g.lon_pos AS cell, v, round(pow(round(50 + 0.1 * lat_pos, 4) - p.lat, 2) + pow((round(6 + 0.1 * lon_pos, 4) - p.lon) * cos(radians(p.lat)), 2), 12) AS d2 FROM pt p CROSS JOIN grid g) QUALIFY row_number() OVER (PARTITION BY point ORDER BY d2, cell) = 1", PT, GRID)
query("lo12_crop", lambda s, d: shown(_cells(s, d).filter("lat BETWEEN 50.15 AND 50.75 AND lon BETWEEN 6.05 AND 6.55")), "SELECT lat_pos * 10 + lon_pos AS cell, round(50 + 0.1 * lat_pos, 4) AS lat, round(6 + 0.1 * lon_pos, 4) AS lon FROM grid WHERE round(50 + 0.1 * lat_pos, 4) BETWEEN 50.15 AND 50.75 AND round(6 + 0.1 * lon_pos, 4) BETWEEN 6.05 AND 6.55", GRID)
query("sc13_resolve_places", lambda s, d: shown(table(s, d, "supplier").select("s_suppkey", F.regexp_replace(F.lower(F.trim(F.concat(F.lit("  Nation_"), F.col("s_nationkey").cast("string"), F.lit(" ")))), r"\s+", " ").alias("name")).join(places(s, d).withColumn("name", F.lower(F.trim("point"))), "name").select("s_suppkey", "point", "lat", "lon")), "SELECT s_suppkey, point, round(lat, 6) AS lat, round(lon, 6) AS lon FROM supplier JOIN pt ON point = 'NATION_' || s_nationkey", PT)


def _grid_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_returnflag").alias("model"), (F.col("l_suppkey") % 10).alias("lat_pos"), (F.col("l_partkey") % 10).alias("lon_pos")).agg(F.avg("l_quantity").alias("v"))


GRID_BY_MODEL = "gm AS (SELECT l_returnflag AS model, l_suppkey % 10 AS lat_pos, l_partkey % 10 AS lon_pos, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"

query("lo1_point", lambda s, d: shown(spatial.bilinear(s.createDataFrame([("p", 50.23, 6.37)], "point string, lat double, lon double"), _grid_by_model(s, d), ["v"], 50.0, 6.0, 0.1, 10, 10, by=["model"])),
      "SELECT 'p' AS point, model, round(CASE WHEN abs(sum(CASE WHEN v IS NOT NULL THEN CASE lat_pos WHEN 2 THEN 0.7 ELSE 0.3 END * CASE lon_pos WHEN 3 THEN 0.3 ELSE 0.7 END END) - 1) < 1e-6 THEN sum(v * CASE lat_pos WHEN 2 THEN 0.7 ELSE 0.3 END * CASE lon_pos WHEN 3 THEN 0.3 ELSE 0.7 END) END, 6) AS v FROM gm WHERE lat_pos IN (2, 3) AND lon_pos IN (3, 4) GROUP BY model", GRID_BY_MODEL)
query("lo2_points", lambda s, d: shown(spatial.bilinear(places(s, d), _grid_by_model(s, d), ["v"], 50.0, 6.0, 0.1, 10, 10, by=["model"]).groupBy("model").agg(F.avg("v").alias("m"), F.count("v").alias("points"))),
      "SELECT model, round(avg(v), 6) AS m, count(v) AS points FROM (SELECT model, point, CASE WHEN abs(sum(CASE WHEN v IS NOT NULL THEN CASE WHEN lat_pos = r THEN 1 - (fr - r) ELSE fr - r END * CASE WHEN lon_pos = c THEN 1 - (fc - c) ELSE fc - c END END) - 1) < 1e-6 THEN sum(v * CASE WHEN lat_pos = r THEN 1 - (fr - r) ELSE fr - r END * CASE WHEN lon_pos = c THEN 1 - (fc - c) ELSE fc - c END) END AS v FROM (SELECT point, (lat - 50) / 0.1 AS fr, (lon - 6) / 0.1 AS fc, least(floor((lat - 50) / 0.1), 8) AS r, least(floor((lon - 6) / 0.1), 8) AS c FROM pt) p JOIN gm ON lat_pos IN (r, r + 1) AND lon_pos IN (c, c + 1) GROUP BY model, point) GROUP BY model", PT, GRID_BY_MODEL)
query("lo4_route_cells", lambda s, d: shown(spatial.nearest(routes(s, d).select(F.col("sample").alias("point"), "lat", "lon"), _cells(s, d), max_km=8.0).withColumnRenamed("point", "sample")),
      "SELECT sample, cell, round(sqrt(d2) * 111.2, 6) AS km FROM (SELECT sample, lat_pos * 10 + lon_pos AS cell, round(pow(round(50 + 0.1 * lat_pos, 4) - r.lat, 2) + pow((round(6 + 0.1 * lon_pos, 4) - r.lon) * cos(radians(r.lat)), 2), 12) AS d2 FROM rt r CROSS JOIN grid) WHERE sqrt(d2) * 111.2 <= 8 QUALIFY row_number() OVER (PARTITION BY sample ORDER BY d2, cell) = 1", RT, GRID)
query("ag2_route_mean", lambda s, d: shown(spatial.half_gaps(routes(s, d), ["route"], F.col("distance_km") / 50).groupBy("route").agg((F.sum(F.col("v") * F.col("dt")) / F.nullif(F.sum("dt"), F.lit(0.0))).alias("mean"), F.sum(F.col("v") * F.col("dt")).alias("total"))),
      "SELECT route, round(sum(v * dt) / nullif(sum(dt), 0), 6) AS mean, round(sum(v * dt), 6) AS total FROM (SELECT route, v, (coalesce(lead(h) OVER w, h) - coalesce(lag(h) OVER w, h)) / 2 AS dt FROM (SELECT route, sample, v, distance_km / 50 AS h FROM rt) WINDOW w AS (PARTITION BY route ORDER BY sample)) GROUP BY route", RT)
