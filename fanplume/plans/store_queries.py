"""Registered queries over the field store, routes in place and time, and places by name, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanplume.operators import spatial
from fanplume.plans.cube_queries import shown
from fanplume.plans.place_queries import DEGREES, FLAT, GRID, GUARD, KEPT, LEGS, PT, RT, STORED, _cells, _grid, _stored, polyline_sql
from fanplume.sources import fields
from fanplume.sources import places as named
from fanplume.sources.cubes import places, routes, table
from fanplume.sources.shared import new_path
from fanplume.sources.tracks import describe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, *ctes: str) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[build.__name__] = build
        if sql:
            ORACLE_SQL[build.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return build

    return register


# the store


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A store of the order lines' fields, one value for each step."""
    path = new_path(spark, "fields")
    cells = _stored(spark, sf_dir).groupBy(*fields.PARTS, "step").agg(F.count(F.lit(1)).cast("double").alias("value"))
    fields.write_fields(cells.withColumns({"member": F.lit(0), "cell": F.lit(0)}), path)
    return path


@query("SELECT run, step, CAST(count(*) AS DOUBLE) AS value FROM stored WHERE source = 'F' AND variable = 'R' AND step BETWEEN 10 AND 40 GROUP BY 1, 2", STORED)
def sc8_store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read back: source and variable choose folders, steps reach the files."""
    store = fields.read_fields(spark, _written(spark, sf_dir))
    return store.filter("source = 'F' AND variable = 'R' AND step BETWEEN 10 AND 40").select("run", "step", "value")


@query("SELECT source, run, count(*) AS n FROM (SELECT DISTINCT source, run, variable, step FROM stored) GROUP BY 1, 2 QUALIFY dense_rank() OVER (PARTITION BY source ORDER BY run DESC) <= 2", STORED)
def sc9_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left in the folders after eviction."""
    path = _written(spark, sf_dir)
    fields.evict(spark, path)
    return fields.read_fields(spark, path).groupBy("source", "run").count().withColumnRenamed("count", "n")


FAILED = "tried AS (SELECT DISTINCT o_orderpriority AS source, strftime(o_orderdate, '%Y-%m-%d') AS run FROM orders), failed AS (SELECT o_orderpriority AS source, strftime(o_orderdate, '%Y-%m-%d') AS run, o_custkey % 600 AS since FROM orders WHERE o_orderstatus = 'O')"


@query("SELECT t.source, min(run) FILTER (turn = best) AS run, CAST(min(best) - 1 AS INT) AS passed_over FROM (SELECT *, min(turn) FILTER (had) OVER (PARTITION BY source) AS best FROM (SELECT *, run IN (SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders o WHERE o.o_orderpriority = a.source AND o_totalprice > 200000) AS had FROM (SELECT source, run, row_number() OVER (PARTITION BY source ORDER BY run DESC) AS turn FROM tried WHERE (source, run) NOT IN (SELECT (source, run) FROM failed WHERE 600 - since < 300)) a WHERE turn <= 3)) t GROUP BY 1", FAILED)
def dg14_first_usable_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of open orders failed some seconds ago; those with an order of great value have fields."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("run"), (F.col("o_custkey") % 600).alias("at"), "o_orderstatus", "o_totalprice")
    turns = fields.runs_to_try(orders, orders.filter("o_orderstatus = 'O'"), now=600.0)
    return fields.first_usable(turns, orders.filter("o_totalprice > 200000"))


NEEDS = {"wind": ["A", "N"], "rain": ["R"], "heat": ["A", "R"]}
_NEEDS = "needs AS (SELECT * FROM (VALUES " + ", ".join(str((k, v)) for k, own in NEEDS.items() for v in own) + ") x(name, variable))"


@query("SELECT source, run, name, min(n) = 20 AS available, coalesce(string_agg(variable, ',' ORDER BY variable) FILTER (n < 20), '') AS lost FROM (SELECT r.source, r.run, d.name, d.variable, count(DISTINCT s.step) AS n FROM (SELECT DISTINCT source, run FROM stored) r CROSS JOIN needs d LEFT JOIN stored s ON s.source = r.source AND s.run = r.run AND s.variable = d.variable AND s.step BETWEEN 1 AND 20 GROUP BY ALL) GROUP BY ALL", STORED, _NEEDS)
def dg13_available_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.available_variables(_stored(spark, sf_dir), NEEDS, list(range(1, 21)))


@query("SELECT 'lines' AS source, count(*) AS n, CAST(NULL AS VARCHAR) AS problem FROM lineitem UNION ALL SELECT 'orders', count(*), NULL FROM orders UNION ALL SELECT 'absent', NULL, 'failed (AnalysisException)'")
def dg8_source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources answer; the third one's table isn't there."""
    rows, problems = fields.gather({
        "lines": lambda: table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")),
        "orders": lambda: table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")),
        "absent": lambda: table(spark, sf_dir, "no_such_table").select("key"),
    })
    answered = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit(None).cast("string"))
    return answered.unionByName(spark.createDataFrame([(k, None, v) for k, v in problems.items()], "source string, n long, problem string"))


# routes in place and time

SPEED, BEGIN = 20.0, 6.0
WHERE_FIELDS = dict(south=50.0, west=6.5, step=0.3, rows=10, cols=10)


def _fields_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as fields: mean quantity by grid cell and hour of a day."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy((F.col("l_suppkey") % 10).alias("lat_pos"), (F.col("l_partkey") % 10).alias("lon_pos"), (F.dayofyear("l_shipdate") % 24).cast("long").alias("hour")).agg(F.avg("l_quantity").alias("v"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.timed_samples(spatial.resample_routes(routes(spark, sf_dir), 2.0, ["route"]), ["route"], BEGIN, SPEED)


HF = "hf AS (SELECT l_suppkey % 10 AS lat_pos, l_partkey % 10 AS lon_pos, dayofyear(l_shipdate) % 24 AS hour, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"
SAMPLES = """sm AS (SELECT l.route, k.k, k.k * gap AS at_km, 6 + k.k * gap / 20 AS hours, lat + (k.k * gap - distance_km) / (to_km - distance_km) * (nlat - lat) AS lat, lon + (k.k * gap - distance_km) / (to_km - distance_km) * (nlon - lon) AS lon
FROM (SELECT *, lead(distance_km) OVER w AS to_km, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon, max(distance_km) OVER (PARTITION BY route) / greatest(1, ceil(max(distance_km) OVER (PARTITION BY route) / 2)) AS gap FROM rt WINDOW w AS (PARTITION BY route ORDER BY sample)) l
JOIN (SELECT unnest(range(0, 20000)) AS k) k ON k.k <= floor(round(to_km / gap, 9)) AND k.k >= CASE WHEN distance_km = 0 THEN 0 ELSE floor(round(distance_km / gap, 9)) + 1 END WHERE to_km > distance_km)"""
AT = "ps AS (SELECT *, round((lat - 50) / 0.3, 9) AS fr, round((lon - 6.5) / 0.3, 9) AS fc, round(hours, 9) AS h FROM sm WHERE round((lat - 50) / 0.3, 9) BETWEEN 0 AND 9 AND round((lon - 6.5) / 0.3, 9) BETWEEN 0 AND 9)"
_PARTS = "(CASE WHEN lat_pos = floor(fr) THEN 1 - (fr - floor(fr)) ELSE fr - floor(fr) END) * (CASE WHEN lon_pos = floor(fc) THEN 1 - (fc - floor(fc)) ELSE fc - floor(fc) END)"


@query("SELECT route, k, round(at_km, 6) AS at_km, round(hours, 6) AS hours, round((coalesce(lead(hours) OVER w, hours) - coalesce(lag(hours) OVER w, hours)) / 2, 6) AS dt FROM sm WINDOW w AS (PARTITION BY route ORDER BY k)", RT, SAMPLES)
def lo7_timed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_samples(spark, sf_dir).select("route", "k", "at_km", "hours", "dt"))


@query(f"SELECT p.route, p.k, round(CASE WHEN abs(sum(w) - 1) < 1e-6 THEN sum(w * v) END, 6) AS v FROM ps p LEFT JOIN (SELECT route, k, v, {_PARTS} * (CASE WHEN hour = floor(h) THEN 1 - (h - floor(h)) ELSE h - floor(h) END) AS w FROM ps JOIN hf ON lat_pos IN (floor(fr), floor(fr) + 1) AND lon_pos IN (floor(fc), floor(fc) + 1) AND hour IN (floor(h), floor(h) + 1)) f ON f.route = p.route AND f.k = p.k AND w > 0 GROUP BY 1, 2", RT, SAMPLES, HF, AT)
def lo4_route_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample reads its own place at its own hour (JO8)."""
    return shown(spatial.along(_samples(spark, sf_dir), _fields_by_hour(spark, sf_dir), ["v"], ["route", "k"], **WHERE_FIELDS))


@query(f"SELECT p.route, p.k, round(CASE WHEN abs(sum(w) - 1) < 1e-6 THEN sum(w * v) END, 6) AS v FROM ps p LEFT JOIN (SELECT route, k, v, {_PARTS} AS w FROM ps JOIN hf ON lat_pos IN (floor(fr), floor(fr) + 1) AND lon_pos IN (floor(fc), floor(fc) + 1) AND hour = ceil(h)) f ON f.route = p.route AND f.k = p.k AND w > 0 GROUP BY 1, 2", RT, SAMPLES, HF, AT)
def lo4_route_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of values that hold for the hour before theirs."""
    return shown(spatial.along(_samples(spark, sf_dir), _fields_by_hour(spark, sf_dir), ["v"], ["route", "k"], instant=False, **WHERE_FIELDS))


@query(
    f"SELECT route, round(km, 6) AS km, round(south, 6) AS south, round(west, 6) AS west, round(north, 6) AS north, round(east, 6) AS east, round(km / {SPEED}, 6) AS hours, polyline, kept_points FROM (SELECT route, max(distance_km) AS km, min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM rt GROUP BY 1) JOIN (SELECT route, {polyline_sql()} AS polyline, count(*) AS kept_points FROM ({DEGREES.format('kept')}) GROUP BY 1) USING (route)",
    "RECURSIVE " + RT.strip(), "vl AS (SELECT route AS shape, sample, lat, lon FROM rt)", FLAT, LEGS, f"kept AS ({KEPT.format(0.2)})",
)
def lo9_described_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(describe(routes(spark, sf_dir), SPEED, 0.2))


# areas

_GAP = "10 / 111.2"


@query(f"SELECT point, round({GUARD}, 6) AS v FROM (SELECT i * 6 + j AS point, round((50.1 + i * {_GAP} - 50) / 0.1, 9) AS fr, round((6.1 + j * {_GAP} / cos(radians(50.45)) - 6) / 0.1, 9) AS fc, least(floor(fr), 8) AS r, least(floor(fc), 8) AS c FROM (SELECT unnest(range(8)) AS i) CROSS JOIN (SELECT unnest(range(6)) AS j)) JOIN grid ON lat_pos IN (r, r + 1) AND lon_pos IN (c, c + 1) GROUP BY point", GRID)
def lo5_area_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of an area by the rule of 10 km, interpolated from the cells."""
    points = spatial.area_points(spark, 50.1, 50.8, 6.1, 6.85)
    return shown(spatial.bilinear(points, _grid(spark, sf_dir), ["v"], 50.0, 6.0, 0.1, 10, 10, strict=True))


@query("SELECT lat_pos * 10 + lon_pos AS cell, round(50 + 0.1 * lat_pos, 4) AS lat, round(6 + 0.1 * lon_pos, 4) AS lon FROM grid WHERE lat_pos BETWEEN 1 AND 8 AND lon_pos BETWEEN 2 AND 6", GRID)
def lo12_crop_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(spatial.crop(_cells(spark, sf_dir), 50.2, 50.7, 6.3, 6.5, step=0.1))


# places


@query("SELECT s_suppkey, CAST(pos AS INT) AS pos, name, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN n > 3 THEN 'more than 3 names' WHEN lat IS NULL THEN 'not found' END AS problem FROM (SELECT s_suppkey, pos, name, n, CASE WHEN n <= 3 THEN lat END AS lat, CASE WHEN n <= 3 THEN lon END AS lon FROM (SELECT s_suppkey, 0 AS pos, 'nation_' || s_nationkey AS name, 3 + CAST(s_suppkey % 5 = 0 AS INT) AS n FROM supplier UNION ALL SELECT s_suppkey, 1, 'Nowhere at all', 3 + CAST(s_suppkey % 5 = 0 AS INT) FROM supplier UNION ALL SELECT s_suppkey, 2, 'NATION_' || (s_nationkey + 1), 3 + CAST(s_suppkey % 5 = 0 AS INT) FROM supplier UNION ALL SELECT s_suppkey, 3, 'x', 4 FROM supplier WHERE s_suppkey % 5 = 0) LEFT JOIN pt ON point = upper(name))", PT)
def sc13_name_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_nationkey")
    text = F.concat(F.lit("  nation_"), k.cast("string"), F.lit(" ;; Nowhere \t at all;NATION_"), (k + 1).cast("string"), F.when(F.col("s_suppkey") % 5 == 0, ";x").otherwise(""))
    lists = table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text"))
    return shown(named.resolve(lists, "text", ["s_suppkey"], places(spark, sf_dir), most=3))


@query("SELECT s_suppkey, CAST(pos AS INT) AS pos, name, lat, lon, CASE WHEN pos = 2 THEN 'not Name@lat,lon' WHEN abs(lat) > 90 THEN 'off the globe' WHEN s_suppkey % 4 = 0 AND pos IN (0, 3) THEN 'name occurs twice' END AS problem FROM (SELECT s_suppkey, 0 AS pos, 'a b' AS name, CAST(s_suppkey % 100 AS DOUBLE) AS lat, -7.25 AS lon FROM supplier UNION ALL SELECT s_suppkey, 1, s_suppkey % 50 || ',8.5', CAST(s_suppkey % 50 AS DOUBLE), 8.5 FROM supplier UNION ALL SELECT s_suppkey, 2, 'c@north', NULL, NULL FROM supplier UNION ALL SELECT s_suppkey, 3, CASE WHEN s_suppkey % 4 = 0 THEN 'a b' ELSE 'd' END, 1, 2 FROM supplier)")
def lo3_place_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.concat(F.lit("a  b@"), (k % 100).cast("string"), F.lit(",-7.25; "), (k % 50).cast("string"), F.lit(",8.5;c@north; "), F.when(k % 4 == 0, "a b").otherwise("d"), F.lit(" @ 1, 2;"))
    return named.unfold_places(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")), "text", ["s_suppkey"])
