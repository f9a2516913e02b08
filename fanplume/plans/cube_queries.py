"""Registered queries over cubes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanplume.cube import Cube
from fanplume.functions import clock, missing
from fanplume.functions.missing import num
from fanplume.functions.weather import convert, feels_like, relative_humidity, wind_direction, wind_speed
from fanplume.operators import reduce as R
from fanplume.operators.spatial import distance_from
from fanplume.sources import sinks
from fanplume.sources.cubes import event_cube, grid_cube, padded_cube

#: The cubes in SQL: ev, evp (one model padded) and gr.
EV = """
cells AS (SELECT event_type AS model, user_id % 10 AS member, date_trunc('hour', ts) AS time, avg(value) AS v, max(value) AS vmax, count(*) AS n FROM events GROUP BY 1, 2, 3),
ev AS (SELECT a.model, b.member, c.time, v, vmax, n FROM (SELECT DISTINCT model FROM cells) a CROSS JOIN (SELECT DISTINCT member FROM cells) b CROSS JOIN (SELECT DISTINCT time FROM cells) c
       LEFT JOIN cells d ON d.model = a.model AND d.member = b.member AND d.time = c.time),
pcells AS (SELECT * FROM cells WHERE model <> 'signup' OR member < 5),
evp AS (SELECT a.model, b.member, c.time, v, vmax, n FROM (SELECT DISTINCT model FROM pcells) a CROSS JOIN (SELECT DISTINCT member FROM pcells) b CROSS JOIN (SELECT DISTINCT time FROM pcells) c
       LEFT JOIN pcells d ON d.model = a.model AND d.member = b.member AND d.time = c.time)
"""
GR = """
lines AS (SELECT l_returnflag AS model, l_linenumber - 1 AS member, round(50 + 0.1 * (l_suppkey % 10), 4) AS lat, round(6 + 0.1 * (l_partkey % 10), 4) AS lon, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4),
gr AS (SELECT a.model, b.member, c.lat, d.lon, v FROM (SELECT DISTINCT model FROM lines) a CROSS JOIN (SELECT DISTINCT member FROM lines) b CROSS JOIN (SELECT DISTINCT lat FROM lines) c CROSS JOIN (SELECT DISTINCT lon FROM lines) d
       LEFT JOIN lines e ON e.model = a.model AND e.member = b.member AND e.lat = c.lat AND e.lon = d.lon)
"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _register(key: str, cube, build, sql: str) -> None:
    def query(spark, sf_dir: str) -> DataFrame:
        return build(cube(spark, sf_dir))

    query.__name__ = key
    QUERIES[key] = query
    ORACLE_SQL[key] = f"WITH {GR if cube is grid_cube else EV} {sql}"


def shown(x: Cube | DataFrame, *more: str) -> DataFrame:
    """Dimensions as they are, numbers rounded to six places, against differences in the order of sums."""
    df = x.df.select(*x.dims, *x.values) if isinstance(x, Cube) else x
    return df.select(*(F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def ev(key: str, build, sql: str) -> None:
    _register(key, event_cube, build, sql)


def evp(key: str, build, sql: str) -> None:
    _register(key, padded_cube, build, sql)


def gr(key: str, build, sql: str) -> None:
    _register(key, grid_cube, build, sql)


S = "time >= TIMESTAMP '2024-01-08' AND time < TIMESTAMP '2024-01-09'"
DAY = slice("2024-01-08", "2024-01-09")
BERLIN = "Europe/Berlin"
LOCAL = "((time AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin')"


class _Columns:
    """col.v is F.col("v"), made when a query is built."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


col = _Columns()

# whole questions
ev("prob_window", lambda c: shown(c.sel(time=DAY).reduce("time", s=R.total("v")).let(p=F.col("s") < 300).reduce("member", p=R.mean("p"))), f"SELECT model, round(avg(CAST(s < 300 AS INT)), 6) AS p FROM (SELECT model, member, sum(v) AS s FROM ev WHERE {S} GROUP BY 1, 2) GROUP BY 1")
ev("rolling3_max", lambda c: shown(c.rolling(3, "sum", "v").reduce("time", m=R.high("v"))), "SELECT model, member, round(max(r), 6) AS m FROM (SELECT *, CASE WHEN count(v) OVER w = 3 THEN sum(v) OVER w END AS r FROM ev WINDOW w AS (PARTITION BY model, member ORDER BY time ROWS 2 PRECEDING)) GROUP BY 1, 2")
ev("daily_max_median", lambda c: shown(c.resample(24, "max", "v").reduce("member", m=R.median("v"))), "SELECT model, min(t0) AS time, round(quantile_cont(x, 0.5), 6) AS m FROM (SELECT model, member, date_trunc('day', time) AS d, min(time) AS t0, max(v) AS x FROM ev GROUP BY 1, 2, 3) GROUP BY model, d")
ev("hourly_quantiles", lambda c: shown(sinks.quantile_columns(c.reduce("member", q=R.quantile("v", [0.1, 0.5, 0.9])).unfold_quantiles("q", [0.1, 0.5, 0.9]), "q", [0.1, 0.5, 0.9], 6)), "SELECT model, time, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90 FROM ev GROUP BY 1, 2")
ev("best_slots", lambda c: shown(c.rolling(3, "sum", "v").let(ok=col.v < 100).reduce("member", p=R.mean("ok")).reduce("model", p=R.low("p")).top(5, "p")), "SELECT time, round(min(p), 6) AS p FROM (SELECT model, time, avg(CAST(r < 100 AS INT)) AS p FROM (SELECT *, CASE WHEN count(v) OVER w = 3 THEN sum(v) OVER w END AS r FROM ev WINDOW w AS (PARTITION BY model, member ORDER BY time ROWS 2 PRECEDING)) GROUP BY 1, 2) GROUP BY time ORDER BY p DESC NULLS LAST, time LIMIT 5")
ev("agreement", lambda c: shown(c.let(wet=col.v > 50).reduce("member", p=R.mean("wet")).let(most=F.col("p") > 0.4).reduce("model", models=R.total("most"))), "SELECT time, CAST(sum(CAST(p > 0.4 AS INT)) AS DOUBLE) AS models FROM (SELECT model, time, avg(CAST(v > 50 AS INT)) AS p FROM ev GROUP BY 1, 2) GROUP BY 1")
ev("hour_cycle", lambda c: shown(c.by_hour("mean", "v").reduce("member", m=R.median("v"))), "SELECT model, hour, round(quantile_cont(x, 0.5), 6) AS m FROM (SELECT model, member, CAST(hour(time) AS INT) AS hour, avg(v) AS x FROM ev GROUP BY 1, 2, 3) GROUP BY 1, 2")
ev("peak_time", lambda c: c.extreme_label("time", "v").df, "SELECT model, member, arg_max(time, (v, -epoch(time))) FILTER (v IS NOT NULL) AS label FROM ev GROUP BY 1, 2")
ev("anomaly", lambda c: shown(c.anomaly("member", "v").only("anomaly")), "SELECT model, member, time, round(v - avg(v) OVER (PARTITION BY model, time), 6) AS anomaly FROM ev")
ev("two_windows", lambda c: shown(c.sel(time=DAY).reduce("time", a=R.total("v")).align(c.sel(time=slice("2024-01-15", "2024-01-16")).reduce("time", b=R.total("v"))).combine("d", "a", "-", "b").only("d")), f"SELECT model, member, round(sum(v) FILTER ({S}) - sum(v) FILTER (time >= TIMESTAMP '2024-01-15' AND time < TIMESTAMP '2024-01-16'), 6) AS d FROM ev GROUP BY 1, 2")
evp("kleene", lambda c: shown(c.let(x=(col.v > 50) | (clock.hour(F.col("time")) >= 12)).reduce("member", p=R.mean("x"))), "SELECT model, time, round(avg(CAST((v > 50 OR hour(time) >= 12) AS INT)), 6) AS p FROM evp GROUP BY 1, 2")
ev("multi_answer", lambda c: shown(c.reduce("time", s=R.total("v"), k=R.count("v")).let(wet=F.col("s") >= 300).reduce("member", wet=R.mean("wet"), p90=R.quantile("s", 0.9), n=R.high("k"))), "SELECT model, round(avg(CAST(s >= 300 AS INT)), 6) AS wet, round(quantile_cont(s, 0.9), 6) AS p90, max(k) AS n FROM (SELECT model, member, sum(v) AS s, count(v) AS k FROM ev GROUP BY 1, 2) GROUP BY 1")

# scans and coordinates
ev("sc2_variable_scan", lambda c: shown(c.only("v")), "SELECT model, member, time, round(v, 6) AS v FROM ev")
ev("sc3_coordinates", lambda c: c.df.select("time").distinct().select("time", clock.hour(F.col("time")).alias("hour"), clock.day_of_week(F.col("time")).alias("weekday")), "SELECT DISTINCT time, hour(time) + minute(time) / 60.0 AS hour, CAST(isodow(time) - 1 AS INT) AS weekday FROM ev")
ev("sc16_table", lambda c: sinks.table_rows(c.only("v").reduce("member", v=R.median("v")), 6, None), "SELECT model, time, round(quantile_cont(v, 0.5), 6) AS v FROM ev GROUP BY 1, 2")
ev("sc17_chart_arrays", lambda c: sinks.chart_arrays(c.only("n"), "n", "time", most=None).select("model", "member", F.array_join(F.transform("data", lambda x: x.cast("int").cast("string")), ",", "-").alias("data")), "SELECT model, member, string_agg(coalesce(CAST(n AS VARCHAR), '-'), ',' ORDER BY time) AS data FROM ev GROUP BY 1, 2")
ev("sc18_summary", lambda c: shown(sinks.summary(c, "v")), "SELECT count(DISTINCT model) AS n_model, count(DISTINCT member) AS n_member, count(DISTINCT time) AS n_time, min(v) AS min, round(avg(v), 6) AS mean, max(v) AS max FROM ev")
ev("sc20_model_table", lambda c: c.df.filter("v IS NOT NULL").groupBy("model").agg(F.count_distinct("member").alias("members"), F.min("time").alias("first"), F.max("time").alias("last")), "SELECT model, count(DISTINCT member) AS members, min(time) AS first, max(time) AS last FROM ev WHERE v IS NOT NULL GROUP BY 1")

ev("sc20_missing_variables", lambda c: sinks.model_table(c.only("v", "vmax").let(vmax=missing.where(col.model != "view", col.vmax))), "SELECT model, count(DISTINCT member) FILTER (v IS NOT NULL) AS members, min(time) FILTER (v IS NOT NULL) AS first, max(time) FILTER (v IS NOT NULL) AS last, date_diff('hour', min(time) FILTER (v IS NOT NULL), max(time) FILTER (v IS NOT NULL)) AS lead_hours, CASE WHEN model = 'view' THEN 'vmax' ELSE '' END AS missing FROM ev GROUP BY model")

# selections, masks, projections
ev("se1_half_open_slice", lambda c: shown(c.sel(time=DAY).only("v")), f"SELECT model, member, time, round(v, 6) AS v FROM ev WHERE {S}")
ev("se2_local_day", lambda c: shown(c.sel(BERLIN, time="2024-01-08").only("v")), f"SELECT model, member, time, round(v, 6) AS v FROM ev WHERE CAST({LOCAL} AS DATE) = DATE '2024-01-08'")
ev("se3_exact_label", lambda c: shown(c.sel(time="2024-01-08T12:00").only("v")), "SELECT model, member, round(v, 6) AS v FROM ev WHERE time = TIMESTAMP '2024-01-08 12:00:00'")
ev("se4_models", lambda c: shown(c.sel(model=["view", "click", "absent"]).reduce("time", m=R.mean("v"))), "SELECT model, member, round(avg(v), 6) AS m FROM ev WHERE model IN ('view', 'click') GROUP BY 1, 2")
ev("se4_one_model", lambda c: shown(c.sel(model="view").reduce("time", m=R.mean("v"))), "SELECT member, round(avg(v), 6) AS m FROM ev WHERE model = 'view' GROUP BY 1")
ev("se5_labels", lambda c: shown(c.sel(member=[0, 3, 7]).by_hour("max", "v").sel(hour=12)), "SELECT model, member, round(max(v), 6) AS v FROM ev WHERE member IN (0, 3, 7) AND hour(time) = 12 GROUP BY 1, 2")
gr("se6_area_slice", lambda c: shown(c.sel(lat=slice(50.2, 50.5), lon=slice(6.0, 6.3))), "SELECT model, member, lat, lon, round(v, 6) AS v FROM gr WHERE lat BETWEEN 50.2 AND 50.5 AND lon BETWEEN 6.0 AND 6.3")
ev("se7_positions", lambda c: shown(c.isel(time=slice(2, 50, 5), member=[0, -1]).only("v")), "SELECT model, member, time, round(v, 6) AS v FROM (SELECT *, dense_rank() OVER (ORDER BY time) - 1 AS p, dense_rank() OVER (ORDER BY member) - 1 AS k FROM ev) WHERE p >= 2 AND p < 50 AND (p - 2) % 5 = 0 AND k IN (0, 9)")
ev("se7_last", lambda c: shown(c.isel(time=-1).only("v")), "SELECT model, member, round(v, 6) AS v FROM ev WHERE time = (SELECT max(time) FROM ev)")
ev("se8_dataset_selection", lambda c: shown(c.sel(model=["view", "error"], time=DAY).reduce("time", a=R.mean("v"), b=R.high("vmax"))), f"SELECT model, member, round(avg(v), 6) AS a, round(max(vmax), 6) AS b FROM ev WHERE model IN ('view', 'error') AND {S} GROUP BY 1, 2")
ev("se9_mask", lambda c: shown(c.only("v").where(col.v > 50)), "SELECT model, member, time, round(CASE WHEN v > 50 THEN v END, 6) AS v FROM ev")
ev("se10_where", lambda c: shown(c.let(x=missing.where(col.v > 50, col.v, col.vmax * 2)).only("x")), "SELECT model, member, time, round(CASE WHEN v > 50 THEN v WHEN v <= 50 THEN vmax * 2 END, 6) AS x FROM ev")
ev("se11_fields", lambda c: shown(c.reduce("member", low=R.low("v"), mid=R.median("v"), high=R.high("v"))), "SELECT model, time, round(min(v), 6) AS low, round(quantile_cont(v, 0.5), 6) AS mid, round(max(v), 6) AS high FROM ev GROUP BY 1, 2")
ev("se12_bindings", lambda c: shown((s := c.reduce("time", s=R.total("v"))).let(above=F.col("s") > 200, half=F.col("s") / 2).reduce("member", above=R.mean("above"), half=R.mean("half"))), "SELECT model, round(avg(CAST(s > 200 AS INT)), 6) AS above, round(avg(s / 2), 6) AS half FROM (SELECT model, member, sum(v) AS s FROM ev GROUP BY 1, 2) GROUP BY 1")
ev("se13_own_coordinates", lambda c: shown(c.let(x=col.v * clock.hour(F.col("time"), BERLIN), d=clock.day_of_week(F.col("time"), BERLIN)).only("x", "d")), f"SELECT model, member, time, round(v * hour({LOCAL}), 6) AS x, CAST(isodow({LOCAL}) - 1 AS INT) AS d FROM ev")
HAVERSINE = "2 * 6371.0088 * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))"
gr("se14_distance_from", lambda c: c.df.select("lat", "lon").distinct().select("lat", "lon", F.round(distance_from(F.col("lat"), F.col("lon"), 50.45, 6.45), 6).alias("km")), f"SELECT DISTINCT lat, lon, round({HAVERSINE.format(a='lat', b='50.45', c='lon', d='6.45')}, 6) AS km FROM gr")

# alignment
ev("jo1_shared_labels", lambda c: shown(c.sel(member=[0, 1, 2, 3]).only("v").align(c.sel(member=[2, 3, 4]).let(w=col.vmax).only("w")).combine("d", "w", "-", "v").only("d")), "SELECT model, member, time, round(vmax - v, 6) AS d FROM ev WHERE member IN (2, 3)")
ev("jo2_broadcast", lambda c: shown(c.only("v").align(c.reduce("member", m=R.mean("v"))).combine("d", "v", "-", "m").only("d")), "SELECT model, member, time, round(v - avg(v) OVER (PARTITION BY model, time), 6) AS d FROM ev")
ev("jo2_repeated", lambda c: shown(c.reduce(["time", "member"], a=R.high("v")).align(c.reduce(["time", "model"], b=R.high("v"))).combine("d", "a", "-", "b").only("d")), "SELECT a.model, b.member, round(a.x - b.x, 6) AS d FROM (SELECT model, max(v) AS x FROM ev GROUP BY 1) a CROSS JOIN (SELECT member, max(v) AS x FROM ev GROUP BY 1) b")
ev("jo3_constant", lambda c: shown(c.let(x=col.v * 2 + 1).only("x")), "SELECT model, member, time, round(v * 2 + 1, 6) AS x FROM ev")
ev("jo4_fusion", lambda c: shown(c.combine("gap", "vmax", "-", "v").combine("share", "v", "/", "vmax").only("gap", "share")), "SELECT model, member, time, round(vmax - v, 6) AS gap, round(v / vmax, 6) AS share FROM ev")
ev("jo5_record", lambda c: shown(c.sel(time=DAY).reduce("time", a=R.mean("v")).align(c.sel(member=[0, 1, 2, 3, 4]).reduce("time", b=R.high("vmax")))), f"SELECT model, member, round(avg(v) FILTER ({S}), 6) AS a, round(max(vmax), 6) AS b FROM ev WHERE member < 5 GROUP BY 1, 2")
ev("jo11_models_present", lambda c: shown(c._with(c.df.join(F.broadcast(c.df.filter(col.vmax > 400).select("model").distinct()), "model", "left_semi")).reduce("time", m=R.mean("v"))), "SELECT model, member, round(avg(v), 6) AS m FROM ev WHERE model IN (SELECT model FROM ev WHERE vmax > 400) GROUP BY 1, 2")

# reductions
for _key, _how, _sql in (
    ("ag1_sum", R.total, "sum(v)"), ("ag2_mean", R.mean, "avg(v)"), ("ag3_median", R.median, "quantile_cont(v, 0.5)"), ("ag5_std", R.std, "stddev_pop(v)"),
):
    ev(_key, lambda c, how=_how: shown(c.reduce("time", x=how("v"))), f"SELECT model, member, round({_sql}, 6) AS x FROM ev GROUP BY 1, 2")
ev("ag1_sum_members", lambda c: shown(c.reduce("member", x=R.total("v"))), "SELECT model, time, round(sum(v), 6) AS x FROM ev GROUP BY 1, 2")
ev("ag4_min_max", lambda c: shown(c.reduce("member", low=R.low("v"), high=R.high("v"))), "SELECT model, time, round(min(v), 6) AS low, round(max(v), 6) AS high FROM ev GROUP BY 1, 2")
evp("ag6_count_padded", lambda c: c.reduce("time", k=R.count("v")).df.select("model", "member", "k"), "SELECT model, member, count(v) AS k FROM evp GROUP BY 1, 2")
ev("ag7_any_all", lambda c: (x := c.let(w=col.v > 50).reduce("time", some=R.any_of("w"), every=R.all_of("w"))).df.select("model", "member", "some", "every"), "SELECT model, member, bool_or(v > 50) AS some, bool_and(v > 50) AS every FROM ev GROUP BY 1, 2")
ev("ag8_quantile", lambda c: shown(c.reduce("member", x=R.quantile("v", 0.9))), "SELECT model, time, round(quantile_cont(v, 0.9), 6) AS x FROM ev GROUP BY 1, 2")
ev("ag9_quantiles", lambda c: shown(c.reduce(["member", "time"], x=R.quantile("v", [0.05, 0.5, 0.95])).unfold_quantiles("x", [0.05, 0.5, 0.95])), "SELECT model, q AS quantile, round(CASE q WHEN 0.05 THEN a WHEN 0.5 THEN b ELSE c END, 6) AS x FROM (SELECT model, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.95) AS c FROM ev GROUP BY 1) CROSS JOIN (SELECT CAST(unnest([0.05, 0.5, 0.95]) AS DOUBLE) AS q)")
ev("ag10_probability", lambda c: shown(c.let(w=col.v > 40).reduce("member", p=R.mean("w"))), "SELECT model, time, round(avg(CAST(v > 40 AS INT)), 6) AS p FROM ev GROUP BY 1, 2")
ev("ag11_hours", lambda c: shown(c.let(w=col.v > 40).reduce("time", hours=R.total("w"))), "SELECT model, member, CAST(sum(CAST(v > 40 AS INT)) AS DOUBLE) AS hours FROM ev GROUP BY 1, 2")
gr("ag12_joint", lambda c: shown(c.reduce(["member", "lat", "lon"], x=R.high("v"), m=R.mean("v"))), "SELECT model, round(max(v), 6) AS x, round(avg(v), 6) AS m FROM gr GROUP BY 1")
ev("ag13_days", lambda c: shown(c.resample(24, "sum", "v").only("v")), "SELECT model, member, min(time) AS time, round(sum(v), 6) AS v FROM ev GROUP BY 1, 2, date_trunc('day', time)")
ev("ag13_local_days", lambda c: shown(c.resample(24, "mean", "v", zone=BERLIN).only("v")), f"SELECT model, member, min(time) AS time, round(avg(v), 6) AS v FROM ev GROUP BY 1, 2, date_trunc('day', {LOCAL})")
ev("ag13_six_hours", lambda c: shown(c.resample(6, "max", "v").only("v")), "SELECT model, member, min(time) AS time, round(max(v), 6) AS v FROM ev GROUP BY 1, 2, CAST(time AS DATE), hour(time) // 6")
ev("ag14_hours", lambda c: shown(c.by_hour("sum", "v")), "SELECT model, member, CAST(hour(time) AS INT) AS hour, round(sum(v), 6) AS v FROM ev GROUP BY 1, 2, 3")
ev("ag14_local_hours", lambda c: shown(c.by_hour("min", "v", zone=BERLIN)), f"SELECT model, member, CAST(hour({LOCAL}) AS INT) AS hour, round(min(v), 6) AS v FROM ev GROUP BY 1, 2, 3")
ev("ag17_pooled", lambda c: shown(c.reduce(["model", "member"], m=R.mean("v"), q=R.median("v"))), "SELECT time, round(avg(v), 6) AS m, round(quantile_cont(v, 0.5), 6) AS q FROM ev GROUP BY 1")

# windows and ranks
ROLL = "WINDOW w AS (PARTITION BY model, member ORDER BY time ROWS 3 PRECEDING)"
for _how, _sql in (("sum", "sum(v)"), ("mean", "avg(v)"), ("max", "max(v)"), ("min", "min(v)")):
    ev(f"wi1_rolling_{_how}", lambda c, how=_how: shown(c.rolling(4, how, "v").only("v")), f"SELECT model, member, time, round(CASE WHEN count(v) OVER w = 4 THEN {_sql} OVER w END, 6) AS v FROM ev {ROLL}")
ev("wi1_rolling_then_slice", lambda c: shown(c.only("v").rolling_between(4, "sum", *("2024-01-08", "2024-01-09"))), f"SELECT model, member, time, round(v, 6) AS v FROM (SELECT model, member, time, CASE WHEN count(v) OVER w = 4 THEN sum(v) OVER w END AS v FROM ev {ROLL}) WHERE {S}")
ev("wi2_rolling_days", lambda c: shown(c.resample(24, "sum", "v").rolling(3, "mean", "v").only("v")), "SELECT model, member, time, round(CASE WHEN count(x) OVER w = 3 THEN sum(x * h) OVER w / sum(h) OVER w END, 6) AS v FROM (SELECT model, member, min(time) AS time, sum(v) AS x, count(*) AS h FROM ev GROUP BY 1, 2, date_trunc('day', time)) WINDOW w AS (PARTITION BY model, member ORDER BY time ROWS 2 PRECEDING)")
ev("wi3_idxmax_member", lambda c: c.extreme_label("member", "v").df, "SELECT model, time, arg_max(member, (v, -member)) FILTER (v IS NOT NULL) AS label FROM ev GROUP BY 1, 2")
ev("wi3_idxmin_time", lambda c: c.extreme_label("time", "v", largest=False).df, "SELECT model, member, arg_min(time, (v, epoch(time))) FILTER (v IS NOT NULL) AS label FROM ev GROUP BY 1, 2")
ev("wi4_sortby", lambda c: shown(c.reduce(["model", "member"], m=R.mean("v")).sorted_positions("time", "m", ascending=False)), "SELECT time, round(m, 6) AS m, CAST(row_number() OVER (ORDER BY m DESC NULLS LAST, time) - 1 AS INT) AS pos FROM (SELECT time, avg(v) AS m FROM ev GROUP BY 1)")
ev("wi4_rolling_in_order", lambda c: shown((x := c.only("v").sel(time=DAY)).sortby(x.reduce(["model", "member"], m=R.mean("v")), ascending=False).rolling(3, "sum", "v")), f"SELECT model, member, e.time, round(CASE WHEN count(v) OVER w = 3 THEN sum(v) OVER w END, 6) AS v FROM ev e JOIN (SELECT time, row_number() OVER (ORDER BY avg(v) DESC NULLS LAST, time) AS pos FROM ev WHERE {S} GROUP BY 1) k ON k.time = e.time WINDOW w AS (PARTITION BY model, member ORDER BY pos ROWS 2 PRECEDING)")
ev("wi4_members_by_value", lambda c: shown((x := c.sel(member=[7, 2, 5, 0]).reduce("time", m=R.mean("v"), k=R.count("v"))).sortby(x.reduce("model", s=R.low("m"))).isel(member=[-1, 0]).reduce("model", m=R.high("m")).let(pos=F.col("member_pos"))), "SELECT member, round(max(m), 6) AS m, CASE WHEN p = 4 THEN 0 ELSE 1 END AS pos FROM (SELECT model, member, avg(v) AS m FROM ev WHERE member IN (7, 2, 5, 0) GROUP BY 1, 2) JOIN (SELECT member, row_number() OVER (ORDER BY s, CASE member WHEN 7 THEN 0 WHEN 2 THEN 1 WHEN 5 THEN 2 ELSE 3 END) AS p FROM (SELECT member, min(m) AS s FROM (SELECT model, member, avg(v) AS m FROM ev WHERE member IN (7, 2, 5, 0) GROUP BY 1, 2) GROUP BY 1)) USING (member) WHERE p IN (1, 4) GROUP BY member, p")
ev("wi5_top", lambda c: shown(c.reduce(["model", "member"], m=R.high("v")).top(10, "m")), "SELECT time, round(max(v), 6) AS m FROM ev GROUP BY 1 ORDER BY m DESC NULLS LAST, time LIMIT 10")
ev("wi5_bottom", lambda c: shown(c.reduce(["model", "member"], m=R.low("v")).top(10, "m", ascending=True)), "SELECT time, round(min(v), 6) AS m FROM ev GROUP BY 1 ORDER BY m NULLS LAST, time LIMIT 10")
ev("wi6_top_record", lambda c: shown(c.reduce(["model", "member"], m=R.high("v"), k=R.count("v")).top(7, "k")), "SELECT time, round(max(v), 6) AS m, count(v) AS k FROM ev GROUP BY 1 ORDER BY k DESC NULLS LAST, time LIMIT 7")

# elementwise
def each(key: str, sql: str, columns) -> None:
    """Values computed cell by cell; `columns` makes them, once a session is there."""
    ev(key, lambda c: shown(c.let(**columns()).only(*columns())), f"SELECT model, member, time, {sql} FROM ev")


each("el1_arithmetic", "round(v + vmax, 6) AS a, round(v - vmax * 3, 6) AS b, round(-v, 6) AS c", lambda: dict(a=num(col.v) + num(col.vmax), b=num(col.v) - num(col.vmax) * 3, c=-num(col.v)))
each("el2_divide", "round(v / vmax, 6) AS a, CASE WHEN v IS NULL THEN NULL WHEN v > 50 THEN 'Infinity'::DOUBLE WHEN v < 50 THEN '-Infinity'::DOUBLE END AS b", lambda: dict(a=missing.divide(col.v, col.vmax), b=missing.divide(col.v - 50, F.lit(0.0))))
each("el3_floor", "round(floor((v - 100) / 7), 6) AS a, round((v - 100) - 7 * floor((v - 100) / 7), 6) AS b", lambda: dict(a=missing.floor_divide(col.v - 100, 7), b=missing.modulo(col.v - 100, 7)))
each("el4_power", "round(pow(v, 1.5), 6) AS a, round(pow(v, 2), 6) AS b", lambda: dict(a=missing.power(col.v, 1.5), b=missing.power(col.v, 2)))
each("el5_compare", "CAST(v < 50 AS DOUBLE) AS a, CAST(v >= vmax AS DOUBLE) AS b, CAST(v = vmax AS DOUBLE) AS c, CAST(v <> vmax AS DOUBLE) AS d", lambda: dict(a=num(col.v < 50), b=num(col.v >= col.vmax), c=num(col.v == col.vmax), d=num(col.v != col.vmax)))
each("el6_logic", "CAST((v > 50 AND vmax > 60) AS DOUBLE) AS a, CAST((v > 50 OR hour(time) >= 12) AS DOUBLE) AS b, CAST((NOT v > 50) AS DOUBLE) AS c", lambda: dict(a=num((col.v > 50) & (col.vmax > 60)), b=num((col.v > 50) | (F.hour("time") >= 12)), c=num(~(col.v > 50))))
each("el7_abs", "round(abs(v - 50), 6) AS a", lambda: dict(a=F.abs(num(col.v) - 50)))
each("el8_max_min", "CASE WHEN v IS NULL THEN NULL ELSE greatest(v, 50) END AS a, CASE WHEN v IS NULL THEN NULL ELSE round(least(v, vmax - 1), 6) END AS b", lambda: dict(a=F.round(missing.maximum(col.v, 50), 6), b=missing.minimum(col.v, col.vmax - 1)))
ORACLE_SQL["el8_max_min"] = ORACLE_SQL["el8_max_min"].replace("greatest(v, 50) END", "round(greatest(v, 50), 6) END")
each("el9_roots", "round(CASE WHEN v >= 50 THEN sqrt(v - 50) END, 6) AS a, round(sqrt(v * v + vmax * vmax), 6) AS b", lambda: dict(a=missing.sqrt(col.v - 50), b=missing.hypot(col.v, col.vmax)))
each("el10_angles", "round(sin(radians(v)), 6) AS a, round(cos(radians(v)), 6) AS b, round(degrees(atan2(v, vmax + 1)), 6) AS c", lambda: dict(a=F.sin(F.radians(col.v)), b=F.cos(F.radians(col.v)), c=F.degrees(F.atan2(col.v, col.vmax + 1))))
each("el11_clip", "CASE WHEN v IS NULL THEN NULL ELSE round(greatest(20, least(v, 80)), 6) END AS a", lambda: dict(a=missing.clip(col.v, 20, 80)))
each("el12_round_even", "round_even(n / 2.0, 0) AS a", lambda: dict(a=missing.round_even(num(F.col("n")) / 2)))
ev("el13_vector_mean", lambda c: shown(c.let(s=F.sin(F.radians(col.vmax)), k=F.cos(F.radians(col.vmax))).reduce("member", s=R.mean("s"), k=R.mean("k")).let(x=missing.angle_of(F.col("s"), F.col("k"))).only("x")), "SELECT model, time, round(d - 360 * floor(d / 360), 6) AS x FROM (SELECT model, time, degrees(atan2(avg(sin(radians(vmax))), avg(cos(radians(vmax))))) AS d FROM ev GROUP BY 1, 2)")
each("dt1_local_hour", f"hour({LOCAL}) + minute({LOCAL}) / 60.0 AS a", lambda: dict(a=clock.hour(F.col("time"), BERLIN)))
each("dt2_weekday", "CAST(isodow(time) - 1 AS INT) AS a", lambda: dict(a=clock.day_of_week(F.col("time"))))
ev("dt3_local_slice", lambda c: shown(c.sel(BERLIN, time=slice("2024-01-08T06:30", "2024-01-09")).only("v")), f"SELECT model, member, time, round(v, 6) AS v FROM ev WHERE {LOCAL} >= TIMESTAMP '2024-01-08 06:30:00' AND {LOCAL} < TIMESTAMP '2024-01-09'")
each("dt4_labels", f"strftime({LOCAL}, '%Y-%m-%dT%H:%M') AS a, strftime({LOCAL}, '%Y-%m-%d') AS b", lambda: dict(a=clock.label(F.col("time"), BERLIN), b=clock.label(F.col("time"), BERLIN, days=True)))

# derived variables: v and vmax stand in for components, temperature and dew point
each("de1_wind", "round(sqrt(pow(v - 50, 2) + pow(vmax - 50, 2)), 6) AS a, round(degrees(atan2(-(v - 50), -(vmax - 50))) - 360 * floor(degrees(atan2(-(v - 50), -(vmax - 50))) / 360), 6) AS b", lambda: dict(a=wind_speed(col.v - 50, col.vmax - 50), b=wind_direction(col.v - 50, col.vmax - 50)))
each("de2_humidity", "round(greatest(0, least(100, 100 * exp(17.625 * ((v - 60) / 10) / (243.04 + (v - 60) / 10)) / exp(17.625 * (vmax / 10) / (243.04 + vmax / 10)))), 6) AS a", lambda: dict(a=relative_humidity(col.vmax / 10, (col.v - 60) / 10)))
ORACLE_SQL["de2_humidity"] = ORACLE_SQL["de2_humidity"].replace("SELECT model, member, time, round(", "SELECT model, member, time, CASE WHEN v IS NULL THEN NULL ELSE round(").replace(", 6) AS a FROM ev", ", 6) END AS a FROM ev")
_T, _W, _H = "(v / 4 - 5)", "(vmax / 5)", "(v / 2 + 20)"
_F = f"({_T} * 9 / 5 + 32)"
each(
    "de3_feels_like",
    f"round(CASE WHEN {_T} <= 10 AND {_W} > 4.8 THEN 13.12 + 0.6215 * {_T} - 11.37 * pow({_W}, 0.16) + 0.3965 * {_T} * pow({_W}, 0.16) "
    f"WHEN {_T} >= 27 AND {_H} >= 40 THEN ((-42.379 + 2.04901523 * {_F} + 10.14333127 * {_H} - 0.22475541 * {_F} * {_H} - 0.00683783 * {_F} * {_F} - 0.05481717 * {_H} * {_H} + 0.00122874 * {_F} * {_F} * {_H} + 0.00085282 * {_F} * {_H} * {_H} - 0.00000199 * {_F} * {_F} * {_H} * {_H}) - 32) * 5 / 9 "
    f"ELSE {_T} END, 6) AS a",
    lambda: dict(a=feels_like(col.v / 4 - 5, col.vmax / 5, col.v / 2 + 20)),
)
each("de6_sum_parameters", "round(v + vmax, 6) AS a", lambda: dict(a=num(col.v) + num(col.vmax)))
each("de7_units", "round(v - 273.15, 6) AS a, round(v * 3.6, 6) AS b, round(v * 1000, 6) AS c, round(v / 3600 * 1000, 6) AS d, round(v * 100, 6) AS e", lambda: dict(a=convert(col.v, "K", "°C"), b=convert(col.v, "m/s", "km/h"), c=convert(col.v, "m", "mm"), d=convert(col.v, "J/m²/h", "W/m²") * 1000, e=convert(col.v, "fraction", "%")))

# all values at once, coverage of models, order of results
ev("sc1_dataset_scan", lambda c: shown(c), "SELECT model, member, time, round(v, 6) AS v, round(vmax, 6) AS vmax, n FROM ev")
ev("dg7_coverage", lambda c: shown(c.reduce("member", k=R.count("v")).df.groupBy("model").agg(F.avg((F.col("k") > 0).cast("double")).alias("covered"), F.min(F.when(F.col("k") > 0, F.col("time"))).alias("first"), F.max(F.when(F.col("k") > 0, F.col("time"))).alias("last"))), "SELECT model, round(avg(CAST(k > 0 AS INT)), 6) AS covered, min(time) FILTER (k > 0) AS first, max(time) FILTER (k > 0) AS last FROM (SELECT model, time, count(v) AS k FROM ev GROUP BY 1, 2) GROUP BY model")
gr("wi8_row_order", lambda c: c.reduce(["member", "model"], m=R.high("v")).df.select("lat", "lon", "m", (F.row_number().over(Window.partitionBy("lat").orderBy("lon")) - 1).alias("pos")), "SELECT lat, lon, m, CAST(row_number() OVER (PARTITION BY lat ORDER BY lon) - 1 AS INT) AS pos FROM (SELECT lat, lon, max(v) AS m FROM gr GROUP BY 1, 2)")
# the rows of a cube whose models are in an order of their own, and sorted by the mean of each: with their place in it
ev("wi7_rows_in_order", lambda c: shown(c.sel(model=["view", "click"]).only("v").rows()), "SELECT model, member, time, round(v, 6) AS v FROM ev WHERE model IN ('view', 'click')")
ev("wi7_sorted_axis", lambda c: c.sel(time=DAY).reduce(["time", "member"], m=R.mean("v")).sorted_positions("model", "m", ascending=False).select("model", "pos"), f"SELECT model, row_number() OVER (ORDER BY m DESC NULLS LAST, model) - 1 AS pos FROM (SELECT model, avg(v) AS m FROM ev WHERE {S} GROUP BY 1)")
