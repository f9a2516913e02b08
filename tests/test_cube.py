"""Cases with closed-form answers."""

import dataclasses
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fanplume.cube import Cube
from fanplume.functions import clock, missing
from fanplume.functions.units import factors, power, product, quotient
from fanplume.functions.weather import crosswind, feels_like, haversine_km, headwind, relative_humidity, wind_direction
from fanplume.operators import reduce as R
from fanplume.operators import spatial, steps
from fanplume.sources import fields, sinks
from fanplume.sources.tracks import describe, gpx_points, polyline_points, simplified

START = datetime(2026, 10, 7)
COLUMNS = "model string, member long, time timestamp_ntz, precip double, t2m double, gust double"


def cells(spark, hours=72, models=(("a", 10, 1.0),)):
    rows = [(m, k, START + timedelta(hours=h), 0.1 * k * scale, 10 + 0.5 * k + 0.1 * h, 20 + 5.0 * k) for m, n, scale in models for k in range(n) for h in range(hours)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def cube(spark):
    return Cube.dense(cells(spark), ["model", "member", "time"], ["precip", "t2m", "gust"], precip="mm/h", t2m="°C", gust="km/h")


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_probability_ignores_padding(spark):
    c = Cube.dense(cells(spark, 48, (("a", 10, 1.0), ("b", 5, 0.5))), ["model", "member", "time"], ["precip"])
    assert c.df.filter("model = 'b' AND member = 9").count() == 48
    p = c.sel(time=slice("2026-10-08T10:00", "2026-10-08T12:00")).reduce("time", s=R.total("precip")).let(dry=F.col("s") < 0.5).reduce("member", p=R.mean("dry"))
    assert dict(values(p.df, "model", "p")) == pytest.approx({"a": 0.3, "b": 1.0})


def test_count_of_padding_is_zero_and_known_true_wins(spark):
    c = Cube.dense(cells(spark, 4, (("a", 2, 1.0), ("b", 1, 1.0))), ["model", "member", "time"], ["precip"])
    k = c.let(x=(F.col("precip") > 5) | F.lit(True), y=(F.col("precip") > 5) & F.lit(False)).reduce("time", n=R.count("precip"), x=R.mean("x"), y=R.mean("y"))
    assert values(k.df.filter("model = 'b' AND member = 1"), "n", "x", "y") == [(0, 1.0, 0.0)]


def test_record_of_summaries(cube):
    day = cube.sel(time=slice("2026-10-08T10:00", "2026-10-08T12:00"))
    s = day.reduce("time", rain=R.total("precip"), tmax=R.high("t2m"))
    out = s.let(wet=F.col("rain") >= 0.5).reduce("member", wet=R.mean("wet"), p50=R.median("rain"), p90=R.quantile("rain", 0.9), tmax=R.high("tmax"))
    assert values(out.df, "wet", "p50", "p90", "tmax")[0] == pytest.approx((0.7, 0.9, 1.62, 18.0))
    assert str(s.units["rain"]) == "mm" and str(s.units["tmax"]) == "°C"


def test_rolling_before_and_after_selection(cube):
    one = cube.sel(member=9)
    wide = one.rolling(3, "sum", "precip").sel(time=slice("2026-10-08T10:00", "2026-10-08T12:00"))
    assert [x for (x,) in values(wide.df.orderBy("time"), "precip")] == pytest.approx([2.7, 2.7])
    near = one.sel(time=slice("2026-10-08T10:00", "2026-10-08T12:00")).rolling(2, "sum", "precip")
    assert [x for (x,) in values(near.df.orderBy("time"), "precip")] == [None, pytest.approx(1.8)]
    pushed = one.only("precip").rolling_between(3, "sum", "2026-10-08T10:00", "2026-10-08T12:00")
    assert [x for (x,) in values(pushed.df.orderBy("time"), "precip")] == pytest.approx([2.7, 2.7])


def test_idxmax_takes_the_first_and_skips_missing(spark):
    rows = [("a", 0, START + timedelta(hours=h), x) for h, x in enumerate([1.0, 3.0, None, 3.0])] + [("a", 1, START, None)]
    c = Cube.dense(spark.createDataFrame(rows, "model string, member long, time timestamp_ntz, x double"), ["model", "member", "time"], ["x"])
    assert sorted(values(c.extreme_label("time", "x").df, "member", "label")) == [(0, START + timedelta(hours=1)), (1, None)]


def test_empty_selection_is_missing_not_an_error(cube):
    assert cube.sel(time=slice("2030-01-01", "2030-01-02")).reduce("time", q=R.median("t2m")).df.count() == 0


def test_local_days_over_a_change_of_clocks():
    a, b = clock.local_day("2026-10-25", "Europe/Berlin")
    assert (b - a) == timedelta(hours=25) and a == datetime(2026, 10, 24, 22)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3, 50))
    x[:, 20:] = np.where(rng.random((3, 30)) < 0.5, np.nan, x[:, 20:])
    rows = [(str(m), k, None if np.isnan(x[m, k]) else float(x[m, k])) for m in range(3) for k in range(50)]
    c = Cube.dense(spark.createDataFrame(rows, "model string, member long, x double"), ["model", "member"], ["x"])
    levels = [0.1, 0.5, 0.9]
    wide = sinks.quantile_columns(c.reduce("member", q=R.quantile("x", levels)).unfold_quantiles("q", levels), "q", levels, 9)
    got = {r["model"]: [r["p10"], r["p50"], r["p90"]] for r in wide.collect()}
    for m in range(3):
        assert got[str(m)] == pytest.approx(np.nanquantile(x[m], levels).tolist())


def test_elementwise_traps(spark):
    df = spark.createDataFrame([(7.0, 0.0), (-7.0, 0.0), (0.0, 0.0), (-7.0, 360.0), (None, 1.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    out = df.select(missing.divide(a, b).alias("d"), missing.modulo(a, b).alias("m"), missing.sqrt(a).alias("s"), missing.maximum(a, b).alias("x")).collect()
    assert [r["d"] for r in out] == [float("inf"), float("-inf"), None, pytest.approx(-7 / 360), None]
    assert [r["m"] for r in out] == [None, None, None, 353.0, None]
    assert [r["s"] for r in out][1:3] == [None, 0.0]
    assert [r["x"] for r in out] == [7.0, 0.0, 0.0, 360.0, None]
    even = spark.range(1).select(*(missing.round_even(F.lit(x)).alias(f"r{i}") for i, x in enumerate((0.5, 1.5, 2.5)))).first()
    assert tuple(even) == (0.0, 2.0, 2.0)


def test_units_and_notes(cube):
    c = cube.reduce("time", x=R.total("t2m"), r=R.total("precip"))
    assert any("state" in n for n in c.notes) and str(c.units["r"]) == "mm"
    assert any("pooled" in n for n in cube.reduce(["model", "member"], x=R.mean("gust")).notes)
    assert any("by number" in n for n in cube.reduce("model", x=R.mean("gust")).notes)
    assert not cube.reduce("member", x=R.mean("gust")).reduce("model", x=R.mean("x")).notes
    assert any("combining" in n for n in cube.combine("z", "t2m", "+", "gust").notes)
    assert str(cube.combine("z", "gust", "*", "gust").units["z"]) == "km²/h²"
    assert product("W/m²", "m²") == "W" and power("km", 0.5) == "?" and power("km/h", 2) == "km²/h²" and quotient("", "h") == "1/h"
    assert factors("J/m²/h") == {"J": 1, "m": -2, "h": -1} and product("?", "h") == "?" and quotient("mm/h", "mm/h") == ""


def test_units_over_time_and_of_replaced_values(cube):
    assert cube.rolling(3, "sum", "precip").units["precip"] == "mm" and cube.rolling(3, "mean", "precip").units["precip"] == "mm/h"
    assert cube.resample(24, "sum", "precip").units["precip"] == "mm" and cube.by_hour("sum", "precip").units["precip"] == "mm"
    assert "gust" not in cube.let(gust=F.col("gust") * F.col("gust")).units
    assert any("state" in n for n in cube.resample(24, "sum", "t2m").notes) and cube.resample(24, "count", "precip").units["precip"] == ""


def test_count_of_no_cells_is_missing(cube):
    none = cube.sel(time=slice("2030-01-01", "2030-01-02")).reduce(["model", "member", "time"], n=R.count("t2m"))
    assert values(none.df, "n") == [(None,)]


def test_strict_selections_name_what_is_absent(cube):
    with pytest.raises(ValueError, match="member has no 99"):
        cube.sel(member=[3, 99], strict=True)
    with pytest.raises(ValueError):
        cube.sel(time="2031-01-01", strict=True)
    with pytest.raises(ValueError):
        cube.sel(time=slice("2030-01-01", "2030-01-02"), strict=True)
    with pytest.raises(ValueError, match="10 labels"):
        cube.isel(member=10, strict=True)
    assert cube.sel(member=[3, 4], time="2026-10-08T10:00", strict=True).isel(member=-1, strict=True).df.count() == 1


def test_cubes_without_a_common_dimension_are_counted(cube):
    one = cube.reduce(["time", "member"], a=R.high("t2m"))
    assert one.align(cube.reduce(["time", "model"], b=R.high("t2m"))).df.count() == 10
    big = Cube(cube.df.sparkSession.range(20_000).withColumnRenamed("id", "point").withColumn("w", F.lit(1)), ("point",), ("w",))
    with pytest.raises(ValueError):
        one.align(big)


def scans(df, capsys):
    """Of each scan of events whether it has both bounds on ts."""
    df.explain("formatted")
    nodes = capsys.readouterr().out.split("\n\n")
    return ["GreaterThanOrEqual(ts" in x and "LessThan(ts" in x for x in nodes if "Scan parquet" in x and "events.parquet" in x]


def test_whole_questions_read_events_once_for_each_stretch(spark, sf, capsys):
    from fanplume.plans.cube_queries import QUERIES

    want = {"prob_window": [True], "two_windows": [True] * 2, "wi1_rolling_then_slice": [True], "se1_half_open_slice": [True], "se2_local_day": [True], "se3_exact_label": [True], "dt3_local_slice": [True], "se8_dataset_selection": [True], "jo11_models_present": None, "jo5_record": None, "se7_positions": [False], "rolling3_max": [False], "daily_max_median": [False], "ag8_quantile": [False]}
    for key, bounds in want.items():
        found = scans(QUERIES[key](spark, sf), capsys)
        assert found == bounds if bounds else len(found) == 2, (key, found)


def test_bounds_go_through_windows_and_buckets(spark, sf, capsys):
    from fanplume.sources.cubes import event_cube

    c, zone = event_cube(spark, sf), "Europe/Berlin"
    day = slice("2024-01-08", "2024-01-09")
    made = {
        "resample": lambda c: c.resample(24, "max", "v", zone=zone),
        "six hours": lambda c: c.resample(6, "sum", "v", zone=zone).let(w=F.col("v") > 10),
        "rolling": lambda c: c.rolling(5, "mean", "v"),
        "rolled buckets": lambda c: c.rolling(3, "sum", "v").resample(12, "mean", "v"),
        "reduced": lambda c: c.where(F.col("v") > 1).let(w=F.col("v") * 2).reduce("member", m=R.mean("w")).rolling(2, "max", "m"),
        "selected": lambda c: c.sel(model=["view", "click"]).isel(member=slice(0, 4)).only("v").rolling(3, "min", "v"),
    }
    for name, make in made.items():
        near = make(c).sel(zone, time=day)
        assert scans(near.df, capsys) == [True], name
        plain = make(dataclasses.replace(c, within=None)).sel(zone, time=day)
        shown = lambda x: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in x.df.select(*x.dims, *x.values).collect())
        assert shown(near) == shown(plain), name
        assert name == "selected" or near.df.count() > 0


@pytest.mark.parametrize("day", ["2024-03-31", "2024-10-27", "2024-06-01"])
def test_local_days_over_the_change_of_clocks(spark, tmp_path, capsys, day):
    from fanplume.sources.cubes import event_cube

    start = datetime.fromisoformat(day) - timedelta(days=4)
    rows = [(k, start + timedelta(minutes=40 * k), k % 3, "view" if k % 5 else "click", float(k % 17), "") for k in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    daily = lambda c: c.resample(24, "sum", "v", zone="Europe/Berlin").sel("Europe/Berlin", time=day)
    c = event_cube(spark, str(tmp_path))
    near = daily(c)
    assert scans(near.df, capsys) == [True]
    shown = lambda x: sorted(map(str, x.df.select("model", "member", "time", "v", "dt").collect()))
    assert shown(near) == shown(daily(dataclasses.replace(c, within=None)))
    assert {r["dt"] for r in near.df.collect()} == {{"2024-03-31": 23.0, "2024-10-27": 25.0}.get(day, 24.0)}


def test_stored_axes_follow_the_table(spark, tmp_path):
    from fanplume.sources.cubes import event_cube

    path, schema = str(tmp_path / "events.parquet"), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    row = lambda k, kind: (k, datetime(2024, 1, 1, k), k, kind, 1.0, "")
    spark.createDataFrame([row(1, "view"), row(2, "view")], schema).write.parquet(path)
    assert event_cube(spark, str(tmp_path)).df.count() == 4
    spark.createDataFrame([row(3, "click")], schema).write.mode("append").parquet(path)
    assert event_cube(spark, str(tmp_path)).df.count() == 2 * 3 * 3
    assert [r["pos"] for r in event_cube(spark, str(tmp_path)).axis("time").collect()] == [0, 1, 2]


def test_a_stretch_of_time_reaches_the_scan(spark, sf, capsys):
    from fanplume.sources.cubes import event_cube

    c = event_cube(spark, sf)
    for near in (c.sel(time=slice("2024-01-08", "2024-01-09")), c.only("v").rolling_between(3, "sum", "2024-01-08", "2024-01-09"), c.sel(time="2024-01-08")):
        assert scans(near.df, capsys) == [True]
    whole = c.df.filter("time >= '2024-01-08' AND time < '2024-01-09'").select("model", "member", "time", "v", "n")
    some = c.sel(time=slice("2024-01-08", "2024-01-09")).df.select(*whole.columns)
    assert sorted(map(str, whole.collect())) == sorted(map(str, some.collect())) and some.count() > 0


def plain_simplified(points, tolerance):
    """Douglas-Peucker by its definition."""
    if len(points) < 3:
        return points
    (x0, y0), (x1, y1) = points[0], points[-1]
    size = np.hypot(x1 - x0, y1 - y0)
    off = [abs((x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)) / size if size else np.hypot(x - x0, y - y0) for x, y in points[1:-1]]
    k = int(np.argmax(off)) + 1
    if off[k - 1] <= tolerance:
        return [points[0], points[-1]]
    return plain_simplified(points[: k + 1], tolerance)[:-1] + plain_simplified(points[k:], tolerance)


def test_simplified_tracks_equal_the_definition():
    rng = np.random.default_rng(3)
    for n in (2, 3, 10, 200):
        lat, lon = 50 + np.cumsum(rng.normal(0, 0.002, n)), 7 + np.cumsum(rng.normal(0, 0.002, n))
        lat[-1], lon[-1] = (lat[0], lon[0]) if n == 10 else (lat[-1], lon[-1])
        xy = list(zip(lon * 111.195 * np.cos(np.radians(lat.mean())), lat * 111.195, strict=True))
        keep = simplified(lat, lon, 0.3)
        assert [p for p, k in zip(xy, keep, strict=True) if k] == plain_simplified(xy, 0.3)


def test_crafted_polylines_end_at_once():
    with pytest.raises(ValueError):
        polyline_points("_" * 1_000_000)


def test_weather_formulas(spark):
    one = spark.range(1)
    row = one.select(
        wind_direction(0, -10).alias("north"), wind_direction(-10, 0).alias("east"), relative_humidity(20, 20).alias("full"), relative_humidity(20, 10).alias("part"),
        feels_like(F.lit(0.0), F.lit(30.0)).alias("chill"), feels_like(F.lit(20.0), F.lit(30.0)).alias("plain"), feels_like(F.lit(32.0), F.lit(5.0), F.lit(70.0)).alias("heat"),
        headwind(F.lit(10.0), F.lit(90.0), F.lit(90.0)).alias("head"), crosswind(F.lit(10.0), F.lit(0.0), F.lit(90.0)).alias("cross"), haversine_km(0, 0, 0, 1).alias("km"),
    ).first()
    assert row["north"] == pytest.approx(0) and row["east"] == pytest.approx(90) and row["full"] == pytest.approx(100) and row["part"] == pytest.approx(52.5, abs=0.5)
    assert row["chill"] == pytest.approx(-6.5, abs=0.3) and row["plain"] == 20 and row["heat"] == pytest.approx(40.5, abs=1)
    assert row["head"] == pytest.approx(10) and row["cross"] == pytest.approx(10) and row["km"] == pytest.approx(111.195, abs=0.01)


def test_steps_to_hours(spark):
    totals = spark.createDataFrame([("a", s, x) for s, x in ((0, 0.0), (3, 3.0), (6, 15.0))], "k string, step int, acc double")
    rates = steps.deaccumulate(totals, "acc", ["k"])
    hours = steps.at_times(rates, ["k"], 1, "rate", interval=True)
    assert sorted(values(hours, "t", "value")) == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 4.0), (4, 4.0), (5, 4.0)]
    assert sorted(values(steps.at_times(totals, ["k"], 2, "acc"), "t", "value")) == [(0, 0.0), (2, pytest.approx(2.0)), (4, pytest.approx(7.0)), (6, 15.0)]
    means = spark.createDataFrame([("a", 1, 490.0), ("a", 2, 500.0)], "k string, step int, m double")
    assert [x for (x,) in values(steps.deaverage(means, "m", ["k"]).orderBy("step"), "rate")] == [None, pytest.approx(510.0)]


def test_runs(spark):
    runs = spark.createDataFrame([("x", 1, 0, 48), ("x", 2, 6, 30), ("y", 1, 40, 60), ("y", 2, 90, 99)], "source string, run int, from_hour int, to_hour int")
    assert sorted(values(steps.best_run(runs, F.lit(10), F.lit(45)), "source", "run", "full")) == [("x", 1, True), ("y", 1, False)]


def test_field_store(spark, tmp_path):
    own = spark.createDataFrame([("s", r, "v", k, m, 0, float(r)) for r in (1, 2, 3) for k in (0, 1, 3) for m in (0, 1)], "source string, run int, variable string, step int, member int, cell int, value float")
    fields.write_fields(own, str(tmp_path / "f"))
    fields.write_fields(own.filter("run = 3").withColumn("value", F.lit(9.0).cast("float")), str(tmp_path / "f"))
    back = fields.read_fields(spark, str(tmp_path / "f"))
    assert back.count() == 18 and {x for (x,) in values(back.filter("run = 3"), "value")} == {9.0}
    assert sorted(values(fields.kept_runs(back), "run")) == [(2,), (3,)]
    assert {x for (x,) in values(fields.cached_until(back, ["source", "run"], 1), "until")} == {1}
    assert sorted(values(fields.missing_fields(back.select("source", "run", "variable").distinct().withColumn("step", F.lit(2)), back), "run")) == [(1,), (2,), (3,)]


def test_tracks():
    assert polyline_points("_p~iF~ps|U_ulLnnqC_mqNvxq`@") == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    gpx = "<gpx><trk><trkseg><trkpt lat='1' lon='2'><time>2026-01-01T00:00:00Z</time></trkpt><trkpt lat='1.5' lon='2'><time>2026-01-01T01:30:00Z</time></trkpt></trkseg></trk></gpx>"
    assert gpx_points(gpx) == [(1.0, 2.0, 0.0), (1.5, 2.0, 1.5)]
    with pytest.raises(ValueError):
        gpx_points("<!DOCTYPE x><gpx/>")
    with pytest.raises(ValueError):
        polyline_points("_p~")
    keep = simplified(np.array([0, 0.1, 0.2, 0.3]), np.array([0, 0.0, 0.1, 0.0]), 1.0)
    assert keep.tolist() == [True, True, True, True]


def test_area_grid_and_bilinear(spark):
    grid = spatial.area_grid(spark, 50, 50.9, 6, 6.9, 10, 10).withColumn("v", F.col("lat") * 2 + F.col("lon"))
    points = spark.createDataFrame([("p", 50.25, 6.35), ("edge", 50.9, 6.9), ("out", 49.0, 6.0)], "point string, lat double, lon double")
    got = dict(values(spatial.bilinear(points, grid, ["v"], 50.0, 6.0, 0.1, 10, 10), "point", "v"))
    assert got == {"p": pytest.approx(106.85), "edge": pytest.approx(108.7)}


def test_too_many_rows(spark):
    with pytest.raises(ValueError):
        sinks.require_rows(spark.range(11), 10)


def test_order_is_kept(spark, cube):
    c = cube.only("t2m").sel(member=[4, 1, 9])
    assert c.reduce("time", n=R.count("t2m")).rows().select("member").first()["member"] == 4
    assert [k for (k,) in values(c.isel(member=[2, 0]).reduce("time", n=R.count("t2m")).rows(), "member")] == [9, 4]
    assert values(c.isel(member=1).reduce("time", m=R.low("t2m")).df, "m") == [(pytest.approx(10.5),)]
    back = c.sortby(c.reduce(["model", "time"], m=R.mean("t2m")), ascending=False)
    assert [k for (k,) in values(back.reduce("time", m=R.mean("t2m")).rows(), "member")] == [9, 4, 1]
    level = c.let(same=F.lit(1.0)).only("same")
    assert {k for (k,) in values(level.extreme_label("member", "same").df, "label")} == {4}
    assert [k for (k,) in values(level.sel(time="2026-10-07T00:00").top(3, "same"), "member")] == [4, 1, 9]
    late = cube.only("t2m").sel(member=[0]).sortby(cube.reduce(["model", "member"], m=R.mean("t2m")), ascending=False).rolling(2, "max")
    assert late.rows().first()["t2m"] is None and late.rows().limit(2).collect()[1]["t2m"] == pytest.approx(10 + 7.1)
    with pytest.raises(ValueError):
        c.sortby(c)
    with pytest.raises(ValueError):
        cube.rolling(385, "max")


def test_arrays_follow_the_order(spark, cube):
    c = cube.only("gust").sel(member=[3, 0, 2], time="2026-10-07T00:00")
    assert sinks.chart_arrays(c, "gust", "member").first()["data"] == [35.0, 20.0, 30.0]
    with pytest.raises(ValueError):
        sinks.table_rows(cube.only("gust"))
    with pytest.raises(ValueError):
        sinks.chart_arrays(cube, "gust", "time", most=100)


def test_missing_variables_of_a_model(spark):
    c = Cube.dense(cells(spark, 6, (("a", 2, 1.0), ("b", 1, 1.0))), ["model", "member", "time"], ["precip", "t2m"])
    table = sinks.model_table(c.let(t2m=missing.where(F.col("model") != "b", F.col("t2m"))))
    assert sorted(values(table, "model", "members", "lead_hours", "missing")) == [("a", 2, 5, ""), ("b", 1, 5, "t2m")]


def test_sine_of_degrees_is_noted(cube):
    c = cube.let(angle=F.lit(0.0))
    degrees = c.combine("turn", "angle", "+", "angle")
    assert degrees.wave("x", "sin", "angle").notes == ()
    import dataclasses

    assert "degrees" in dataclasses.replace(c, units={"angle": "°"}).wave("x", "cos", "angle").notes[0]


def test_route_in_place_and_time(spark):
    rows = [(r, c, h, float(r + 10 * c + 100 * h)) for r in range(3) for c in range(3) for h in range(3)]
    grid = spark.createDataFrame(rows, "lat_pos long, lon_pos long, hour long, v double")
    own = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.5, 1.25, 0.5), (2, 2.0, 2.0, 2.0), (3, 2.5, 0.0, 0.0), (4, 0.0, 0.0, 2.5)], "k int, lat double, lon double, hours double")
    where = dict(south=0.0, west=0.0, step=1.0, rows=3, cols=3)
    got = dict(values(spatial.along(own, grid, ["v"], ["k"], **where), "k", "v"))
    assert got == {0: 0.0, 1: pytest.approx(0.5 + 12.5 + 50), 2: pytest.approx(222.0), 4: None}
    rates = dict(values(spatial.along(own.filter("k < 2"), grid, ["v"], ["k"], instant=False, **where), "k", "v"))
    assert rates == {0: 0.0, 1: pytest.approx(0.5 + 12.5 + 100)}
    with pytest.raises(ValueError):
        spatial.bilinear(own.withColumnRenamed("k", "point"), grid, ["v"], **where, strict=True)


def test_times_along_a_track(spark):
    points = spark.createDataFrame([(1, 0, 50.0, 7.0, 0.0, 9.0, 90.0), (1, 1, 50.0, 7.1, 4.0, 10.0, 90.0), (1, 2, 50.0, 7.3, 8.0, 14.0, None)], "route int, sample int, lat double, lon double, distance_km double, hours double, course double")
    samples = spatial.resample_routes(points, 2.0, ["route"])
    own = spatial.timed_samples(samples, ["route"], 6.0).orderBy("k")
    assert values(own, "hours", "dt") == [(6.0, 0.25), (6.5, 0.5), (7.0, 1.25), (9.0, 2.0), (11.0, 1.0)]
    steady = spatial.timed_samples(samples, ["route"], 1.0, speed_kmh=4.0).orderBy("k")
    assert [x for (x,) in values(steady, "hours")] == [1.0, 1.5, 2.0, 2.5, 3.0]
    with pytest.raises(ValueError):
        spatial.timed_samples(samples, ["route"], 0.0, speed_kmh=500)


def test_area_rule(spark):
    rows, cols, dlat, dlon = spatial.area_sides(50, 50.5, 6, 6.5)
    assert (rows, cols) == (6, 4) and dlat * 111.2 == pytest.approx(10) and dlon > dlat
    for south, north, west, east in ((40, 60, 0, 30), (0, 30, 0, 30), (-90, -60, 10, 11), (50, 50.01, 0, 30)):
        rows, cols, _, _ = spatial.area_sides(south, north, west, east)
        assert 1 <= rows * cols <= 500
    assert rows * cols > 200
    for wrong in ((50, 50, 6, 7), (0, 31, 0, 1), (80, 91, 0, 1)):
        with pytest.raises(ValueError):
            spatial.area_sides(*wrong)
    assert spatial.area_points(spark, 50, 50.5, 6, 6.5).count() == 24


def test_eviction_and_turns(spark, tmp_path):
    path = str(tmp_path / "f")
    own = spark.createDataFrame([(s, r, "v", 0, 0, 0, 1.0) for s in ("a b", "c") for r in ("2026-01-01", "2026-01-02", "2026-01-03", "2026-01-04")], "source string, run string, variable string, step int, member int, cell int, value double")
    fields.write_fields(own, path)
    assert len(fields.evict(spark, path, 2, [("c", "2026-01-01")])) == 3
    left = {(s, str(r)) for s, r in values(fields.read_fields(spark, path), "source", "run")}
    assert left == {("a b", "2026-01-03"), ("a b", "2026-01-04"), ("c", "2026-01-01"), ("c", "2026-01-03"), ("c", "2026-01-04")}
    assert fields.evict(spark, str(tmp_path / "none")) == []
    failures = spark.createDataFrame([("a b", "2026-01-04", 900.0), ("c", "2026-01-04", 100.0)], "source string, run string, at double")
    turns = fields.runs_to_try(own, failures, now=1000.0, tries=2)
    assert sorted(values(turns, "source", "run", "turn")) == [("a b", "2026-01-02", 2), ("a b", "2026-01-03", 1), ("c", "2026-01-03", 2), ("c", "2026-01-04", 1)]
    best = fields.first_usable(turns, own.filter("run < '2026-01-03'"))
    assert sorted(values(best, "source", "run", "passed_over")) == [("a b", "2026-01-02", 1), ("c", None, None)]


def test_sources_that_fail(spark, tmp_path):
    rows, problems = fields.gather({"good": lambda: spark.range(2), "bad": lambda: spark.read.parquet(str(tmp_path / "no"))})
    assert rows.count() == 2 and list(problems) == ["bad"]
    with pytest.raises(ValueError):
        fields.gather({"bad": lambda: spark.read.parquet(str(tmp_path / "no"))})


def test_described_route(spark):
    points = spark.createDataFrame([("r", 0, 50.0, 7.0, 0.0, 1.0), ("r", 1, 50.5, 7.0, 55.6, 2.0), ("r", 2, 51.0, 7.0, 111.2, 3.5)], "route string, sample long, lat double, lon double, distance_km double, hours double")
    row = describe(points, 20.0).first()
    assert (row["kept_points"], row["track_hours"], row["hours"]) == (2, 2.5, pytest.approx(5.56))
    assert polyline_points(row["polyline"]) == [(50.0, 7.0), (51.0, 7.0)]


def test_lines_against_a_recursive_form():
    def kept(points, tolerance):
        if len(points) < 3:
            return set(points)
        (x0, y0), (x1, y1) = points[0][1:], points[-1][1:]
        size = np.hypot(x1 - x0, y1 - y0)
        off = [abs((x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)) / size for _, x, y in points[1:-1]]
        worst = int(np.argmax(off)) + 1
        if off[worst - 1] <= tolerance:
            return {points[0], points[-1]}
        return kept(points[: worst + 1], tolerance) | kept(points[worst:], tolerance)

    rng = np.random.default_rng(5)
    lat, lon = 50 + np.cumsum(rng.normal(0, 0.01, 300)), 7 + np.cumsum(rng.normal(0.005, 0.01, 300))
    x, y = lon * 111.195 * np.cos(np.radians(lat.mean())), lat * 111.195
    for tolerance in (0.2, 1.0, 5.0):
        want = {p[0] for p in kept([*zip(range(300), x, y)], tolerance)}
        assert set(np.flatnonzero(simplified(lat, lon, tolerance))) == want


def test_models_that_cover_a_part_are_noted(spark):
    rows = cells(spark, 6, (("a", 2, 1.0), ("b", 2, 1.0), ("c", 1, 1.0))).filter("model <> 'b' OR time < TIMESTAMP_NTZ '2026-10-07 04:00:00'").withColumn("gust", F.when(F.col("model") != "c", F.col("gust")))
    notes = Cube.dense(rows, ["model", "member", "time"], ["gust"]).with_coverage("gust").notes
    assert notes == (f"b covers only {START} to {START + timedelta(hours=3)} of the selected time", "c covers none of the selected time")


def test_part_files_of_a_backlog_come_in_any_order(spark, tmp_path):
    from fanplume.streaming.hours import event_stream, hourly_cells, run_available

    for k in (3, 1, 2, 0):  # the latest hours first
        rows = [(k * 10 + i, START + timedelta(hours=6 * k + i), 1, "view", float(i), "") for i in range(6)]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = run_available(hourly_cells(event_stream(spark, str(tmp_path))), spark).collect()
    assert sorted(r["time"] for r in got) == [START + timedelta(hours=h) for h in range(21)]
