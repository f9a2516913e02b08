"""Missing values, folders named by numbers, longitudes round the globe, weights of time, units and joins of several cubes."""

import os

import pytest

from fanplume.cube import Cube
from fanplume.functions import units
from fanplume.operators import reduce as R
from fanplume.operators import spatial, steps
from fanplume.sources import fields
from pyspark.sql import functions as F


def test_missing_totals_give_missing_rates(spark):
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate([1.0, 2.0, None, 5.0, 4.0, float("nan"), 9.0, 10.0])], "id int, step int, acc double")
    rates = [r["rate"] for r in steps.deaccumulate(df, "acc", ["id"]).orderBy("step").collect()]
    assert rates == [None, 1.0, None, None, 0.0, None, None, 1.0]
    means = df.filter("step > 0").withColumn("m", F.col("acc") / F.col("step"))
    assert [r["rate"] for r in steps.deaverage(means, "m", ["id"]).orderBy("step").collect()] == [None, None, None, 0.0, None, None, 1.0]


@pytest.mark.parametrize("how", ["absent", "null", "nan"])
def test_a_missing_corner_with_weight_makes_the_value_missing(spark, how):
    cells = [(r, c, 10.0) for r in range(3) for c in range(3)]
    cells = [x for x in cells if x[:2] != (1, 1)] + ([] if how == "absent" else [(1, 1, None if how == "null" else float("nan"))])
    grid = spark.createDataFrame(cells, "lat_pos long, lon_pos long, v double")
    points = spark.createDataFrame([("inside", 50.5, 6.5), ("on a line beside it", 50.0, 6.5), ("on another cell", 50.0, 6.0), ("on it", 51.0, 7.0), ("off", 60.0, 6.0), ("a turn further", 50.0, 366.0)], "point string, lat double, lon double")
    got = {r["point"]: r["v"] for r in spatial.bilinear(points, grid, ["v"], 50.0, 6.0, 1.0, 3, 3).collect()}
    assert got == {"inside": None, "on a line beside it": 10.0, "on another cell": 10.0, "on it": None, "a turn further": 10.0}


def test_eviction_compares_runs_by_their_names(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(s, run, "t", 0, 0, 0, 1.0) for s in ("one", "2") for run in ("00", "06", "12", "2024010106")]
    fields.write_fields(spark.createDataFrame(rows, "source string, run string, variable string, step int, member int, cell int, value double"), path)
    fields.evict(spark, path, newest=2, writing=[("one", "00")])
    assert sorted(os.listdir(path + "/source=one")) == ["run=00", "run=12", "run=2024010106"]
    assert sorted(os.listdir(path + "/source=2")) == ["run=12", "run=2024010106"]
    assert fields.evict(spark, path, newest=2, writing=[("one", "00")]) == []
    assert fields.evict(spark, str(tmp_path / "nothing")) == []


def test_nearest_cells_round_the_globe(spark):
    cells = spark.createDataFrame([(1, 50.0, 359.95), (2, 50.0, 0.2), (3, 10.0, 179.95), (4, 10.0, -179.7)], "cell int, lat double, lon double")
    points = spark.createDataFrame([("a", 50.0, -0.02), ("b", 50.0, 0.11), ("c", 10.0, -179.98), ("d", 10.0, 180.2)], "point string, lat double, lon double")
    assert {r["point"]: r["cell"] for r in spatial.nearest(points, cells).collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}


def test_an_anomaly_over_time_is_weighted_by_hours(spark):
    df = spark.createDataFrame([("m", 0, 0.0, 23.0), ("m", 1, 10.0, 1.0), ("m", 2, None, 5.0)], "model string, time int, x double, dt double")
    cube = Cube(df, ("model", "time"), ("x",), {"x": "°C"})
    mean = cube.reduce("time", m=R.mean("x")).df.first()["m"]
    out = cube.anomaly("time", "x")
    got = {r["time"]: r["anomaly"] for r in out.df.collect()}
    assert got == {0: pytest.approx(-mean), 1: pytest.approx(10 - mean), 2: None} and mean == pytest.approx(10 / 24)
    assert out.units["anomaly"] == "°C"
    assert {r["time"]: r["anomaly"] for r in cube.anomaly("model", "x").df.collect()} == {0: 0.0, 1: 0.0, 2: None}


def test_units_of_any_power():
    area = units.product("m", "m")
    assert units.product(area, area) == "m^4" and units.quotient("m^4", "m") == "m³" and units.product("m^4", "m") == "m^5"
    assert units.quotient("1", "m^4") == "1/m^4" and units.quotient("kg·m^5/s^4", "m^4") == "kg·m/s^4" and units.power("m^4", 0.5) == "m²"


def test_three_cubes_in_one_call(spark):
    cube = lambda members: Cube(spark.createDataFrame([("m", k, float(k)) for k in members], "model string, member int, x double"), ("model", "member"), ("x",), {"x": "mm"})
    out = cube([1, 2, 3]).align(cube([2, 3, 4]), cube([3, 4, 5]), strict=True)
    assert out.values == ("x", "x_b", "x_c") and [tuple(r[v] for v in ("member", *out.values)) for r in out.df.collect()] == [(3, 3.0, 3.0, 3.0)]
    assert out.units == {"x": "mm", "x_b": "mm", "x_c": "mm"}
    assert cube([1]).align(cube([2])).df.count() == 0
    with pytest.raises(ValueError, match="no label"):
        cube([1, 2]).align(cube([2, 3]), cube([3]), strict=True)


@pytest.fixture()
def weather(spark):
    rows = [("m", k, h, 10.0 + h, 350.0 + 10 * k, 4.0) for k in range(2) for h in range(4)]
    cells = spark.createDataFrame(rows, "model string, member int, time int, t2m double, wind_dir double, u double")
    return Cube.dense(cells.withColumn("time", F.expr("TIMESTAMP_NTZ '2024-01-01' + make_interval(0, 0, 0, 0, time)")), ["model", "member", "time"], ["t2m", "wind_dir", "u"], t2m="°C", wind_dir="°", u="m²/s²")


def test_another_name_keeps_unit_and_traits(weather):
    x = weather.let(x=F.col("t2m"), d=F.col("wind_dir"), y=F.col("t2m") + 1)
    assert (x.units["x"], x.units["d"], x.units.get("y")) == ("°C", "°", None)
    assert "state" in x.reduce("time", s=R.total("x")).notes[0] and x.reduce("time", s=R.total("y")).notes == ()
    assert "direction" in x.sel(member=0).reduce("time", s=R.mean("d")).notes[0]
    mean = x.reduce("member", m=R.mean("x")).let(z=F.col("m"))
    assert mean.units["z"] == "°C" and "state" in mean.reduce("time", s=R.total("z")).notes[0]
    both = x.only("x").align(weather.reduce("member", x=R.low("t2m")))
    assert both.units == {"x": "°C", "x_b": "°C"} and "state" in both.reduce("time", s=R.total("x_b")).notes[0]
    assert x.rolling(2, "mean", "x").resample(24, "sum", "x").notes[0].startswith("x: a sum over time")
    replaced = x.let(t2m=F.col("u"))
    assert replaced.units["t2m"] == "m²/s²" and replaced.reduce("time", s=R.total("t2m")).notes == ()
    assert x.let(d=F.col("d") / 2).reduce("time", s=R.mean("d")).notes == ()


def test_units_of_roots_powers_and_turns(weather):
    c = weather.root("v", "u").raised("q", "v", 3).turned("back", "wind_dir", plus=180).scaled("warmer", "t2m", 2, 1).combine("mix", "warmer", "-", "t2m").turned("odd", "t2m")
    assert [c.units[n] for n in ("v", "q", "back", "warmer", "mix")] == ["m/s", "m³/s³", "°", "°C", "°C"]
    assert c.raised("no", "v", 0.5).units["no"] == "?"
    row = c.df.filter("member = 1 AND t2m = 10").first()
    assert (row["v"], row["q"], row["back"], row["warmer"]) == (2.0, 8.0, 180.0, 21.0)
    assert "direction" in c.reduce("time", m=R.mean("back")).notes[0] and c.reduce("time", m=R.mean("odd")).notes == ()
    assert "state" in c.reduce("time", m=R.total("mix")).notes[0]
    assert "degrees" in c.let(angle=F.col("back")).wave("w", "sin", "angle").notes[0]


def test_limits_of_rankings_levels_and_points(spark, weather):
    assert weather.top(100, "t2m").count() == 8
    for n in (0, 101):
        with pytest.raises(ValueError, match="ranking"):
            weather.top(n, "t2m")
    for levels in ([0.5, 0.5], [1.1], [], [k / 30 for k in range(21)]):
        with pytest.raises(ValueError, match="levels"):
            R.quantile("t2m", levels)
    points = spark.range(501)
    with pytest.raises(ValueError, match="500"):
        spatial.require_few(points)
    assert spatial.require_few(points.limit(500)).count() == 500


def test_rows_come_in_the_order_of_placed_labels(weather):
    rows = [tuple(r)[:2] for r in weather.sel(member=[1, 0]).only("t2m").rows().collect()]
    assert rows == [("m", 1)] * 4 + [("m", 0)] * 4
