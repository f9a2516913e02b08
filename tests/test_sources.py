"""Derivations, index files, listings, and stores that streams keep."""

import json
import random
from datetime import datetime, timedelta
from urllib.parse import urljoin

import pytest

from fanplume.sources import fields, listings
from fanplume.streaming import refresh
from fanplume.streaming.hours import latest_cells
from pyspark.sql import functions as F


def test_derivations_over_three_levels(spark):
    stored = spark.createDataFrame([("s", 1, "u"), ("s", 1, "v"), ("s", 1, "v"), ("s", 2, "u"), ("t", 1, None)], "source string, run int, variable string")
    ways = {"wind": [["u", "v"]], "gust": [["wind"], ["peak"]], "chill": [["gust", "wind"]], "alone": [["alone"]], "a": [["b"]], "b": [["a"]], "late": [["chill", "u"]]}
    got = {(r["source"], r["run"], r["name"]): r["level"] for r in fields.derivable(stored, ways).collect()}
    assert got == {("s", 1, "u"): 0, ("s", 1, "v"): 0, ("s", 1, "wind"): 1, ("s", 1, "gust"): 2, ("s", 1, "chill"): 3, ("s", 1, "late"): 4, ("s", 2, "u"): 0}
    assert fields.derivable(stored, {}).count() == 3 and fields.derivable(stored.filter("false"), ways).count() == 0


def merged(spans, gap):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1 + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("gap", [0, 1, 50])
def test_byte_ranges(spark, gap):
    draw = random.Random(4)
    rows, spans = [], {}
    for file in "abc":
        for _ in range(60):
            first, size = draw.randrange(2000), draw.randrange(1, 40)
            rows.append((file, json.dumps({"param": "t", "type": "pf", "number": 1, "_offset": first, "_length": size, "more": "x"})))
            spans.setdefault(file, []).append((first, first + size - 1))
    rows += [("a", "no json"), ("a", None), ("b", '{"param": "t", "_offset": -1, "_length": 5}'), ("b", '{"param": "t", "_offset": 3}'), ("d", "[]")]
    entries = listings.index_entries(spark.createDataFrame(rows, "file string, line string"), ["file"])
    assert entries.filter("problem IS NOT NULL").count() == 5
    got = listings.byte_ranges(entries, ["file"], gap).collect()
    assert {(r["file"], r["first"], r["last"]) for r in got} == {(f, a, b) for f, own in spans.items() for a, b in merged(own, gap)}
    assert sum(r["entries"] for r in got) == 180
    for r in got:
        held = {x for a, b in spans[r["file"]] if r["first"] <= a <= r["last"] for x in range(a, b + 1)}
        assert r["unused"] == r["last"] - r["first"] + 1 - len(held)


def test_members_are_told_apart(spark):
    entry = lambda p, n, kind="pf": ("f", json.dumps({"param": p, "type": kind, "number": n, "_offset": 0, "_length": 1}))
    lines = spark.createDataFrame([entry("t", 1), entry("t", 2), entry("t", 0, "cf"), entry("u", 1), entry("u", 1), entry("w", 1), entry("x", 1), entry("x", 2), entry("x", 2)], "file string, line string")
    got = {r["param"]: (r["entries"], r["members"], r["complete"]) for r in listings.incomplete(listings.index_entries(lines, ["file"]), ["file"], 2).collect()}
    assert got == {"t": (2, 2, True), "u": (2, 1, False), "w": (1, 1, False), "x": (3, 2, False)}


def test_links_are_resolved_as_by_the_standard(spark):
    bases = ["http://a.b/c/d;p?q", "https://a.b", "https://a.b/", "http://A.b:8/x/y/?z#t", "HTTP://u@h/dir/file.html"]
    links = ["g", "g/", "/g", "//h/i", "g?y", "#s", "g#s", "http://o.p/q", "mailto:x@y", "h-2/i.grib2"]
    rows = [(b, link) for b in bases for link in links]
    got = spark.createDataFrame(rows, "b string, l string").select("b", "l", listings.resolved(F.col("l"), F.col("b")).alias("a")).collect()
    for r in got:
        want = urljoin(r["b"], r["l"]).replace("http://h/", "HTTP://h/") if r["b"].startswith("HTTP") else urljoin(r["b"], r["l"])
        assert r["a"].lower() == want.lower(), (r["b"], r["l"])
    assert spark.createDataFrame([("no address", "x")], "b string, l string").select(listings.resolved(F.col("l"), F.col("b"))).first()[0] is None


def test_listings_with_sizes(spark):
    html = '<a href="../">../</a>\n<a href="PT000H00M.grib2">PT000</a>   07-Oct-2026 14:37   801357\n<A class="x" HREF="y">n</A><a\nhref="PT001H00M.grib2" >PT001</a> 07-Oct-2026 14:38 12\n<a href="">here</a>'
    rows = listings.listed(spark.createDataFrame([(1, "https://h/d/", html), (2, "https://h/", None), (3, None, "<a href='q'>x</a>")], "id int, url string, html string"), ["id"]).orderBy("pos").collect()
    assert [(r["pos"], r["address"], r["text"], r["size"]) for r in rows] == [(0, "https://h/d/../", "../", None), (1, "https://h/d/PT000H00M.grib2", "PT000", 801357), (2, "https://h/d/PT001H00M.grib2", "PT001", 12), (3, "https://h/d/", "here", None)]


WANTED = "source string, run string, variable string, step long"


def held(spark, path):
    return sorted((r["source"], r["variable"], r["step"], r["member"], r["value"]) for r in fields.read_fields(spark, path).collect())


def test_a_failing_chunk_is_told_and_tried_again(spark, tmp_path):
    path = str(tmp_path / "store")
    wanted = spark.createDataFrame([(s, "r", "t", h) for s in ("one", "two") for h in range(90, 140)], WANTED)
    broken, asked = {2}, []

    def fetch(lacking):
        steps = sorted({r["step"] for r in lacking.collect()})
        asked.append(steps)
        if {(h - 100) // 12 for h in steps} & broken:
            raise OSError("no answer")
        return lacking.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("member"), F.lit(0).alias("cell"), F.col("step").cast("double").alias("value"))

    told = refresh.refresh(wanted, path, fetch, now=100)
    assert [(c.number, c.fields, c.problem) for c in told] == [(0, 24, None), (1, 24, None), (2, 24, "OSError: no answer"), (3, 8, None)]
    assert [x[0] for x in asked] == [100, 112, 124, 136]  # soonest first, over all sources
    assert len(held(spark, path)) == 2 * 2 * 28
    broken.clear()
    assert [(c.number, c.fields, c.problem) for c in refresh.refresh(wanted, path, fetch, now=100)] == [(2, 24, None)]
    before = held(spark, path)
    assert len(before) == 2 * 2 * 40
    assert refresh.refresh(wanted, path, fetch, now=100) == [] and held(spark, path) == before
    later = refresh.refresh(wanted.unionByName(spark.createDataFrame([("one", "r", "t", 140), ("one", "r", "t", 95)], WANTED)), path, fetch, now=112)
    assert [(c.number, c.fields) for c in later] == [(2, 1)]


def test_a_stream_that_is_cut_off_goes_on(spark, tmp_path):
    folder, path, state = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "state")
    schema = "model string, member long, time timestamp_ntz, v double, vmax double"
    begin, told = datetime(2024, 1, 1), []
    cells = lambda hours: spark.createDataFrame([(m, 0, begin + timedelta(hours=h), float(h), 2.0 * h) for m in ("a", "b") for h in hours], schema)
    cells(range(0, 20)).write.parquet(folder)
    stream = lambda: spark.readStream.schema(schema).parquet(folder)

    def fall_over(number, chunks):
        raise RuntimeError("lost the driver")

    with pytest.raises(Exception, match="lost the driver"):
        refresh.keep_up(stream(), path, 473_352, state, fall_over)  # stored, but not told to the checkpoint
    refresh.keep_up(stream(), path, 473_352, state, lambda number, chunks: told.append((number, chunks)))
    assert told == [(0, [])]  # the trigger came again and found all of it stored
    cells(range(18, 30)).write.mode("append").parquet(folder)
    refresh.keep_up(stream(), path, 473_352, state, lambda number, chunks: told.append((number, [(c.number, c.fields) for c in chunks])))
    assert told[1] == (1, [(1, 2 * 2 * 4), (2, 2 * 2 * 6)])
    rows = held(spark, path)
    assert len(rows) == len(set(rows)) == 2 * 2 * 30


def test_newest_runs_whatever_the_order(spark, tmp_path):
    schema = "model string, member long, time timestamp_ntz, run long, v double, vmax double, n long"
    begin = datetime(2024, 1, 1)
    runs = {r: [("m", k, begin + timedelta(hours=h), r, float(100 * r + h), 1.0, r) for k in range(2) for h in range(3 * r, 3 * r + 12)] for r in range(4)}
    want = sorted(map(str, latest_cells(spark.createDataFrame(sum(runs.values(), []), schema)).collect()))
    for k, order in enumerate([(0, 1, 2, 3), (3, 1, 0, 2), (2, 3, 3, 0, 1)]):
        folder, path, state = (str(tmp_path / f"{x}{k}") for x in ("in", "out", "state"))
        for r in order:
            spark.createDataFrame(runs[r], schema).coalesce(1).write.mode("append").parquet(folder)
            found = refresh.keep_newest(spark.readStream.schema(schema).parquet(folder), path, state)
        columns = latest_cells(spark.createDataFrame([], schema)).columns
        assert sorted(map(str, found.select(*columns).collect())) == want


def test_gpx_documents_are_scanned(spark, tmp_path):
    from fanplume.sources.tracks import gpx_points, read_gpx, write_gpx

    head, folder = '<?xml version="1.0"?>\n', tmp_path / "gpx"
    folder.mkdir()
    point = lambda a, b, t=None: f'<trkpt lat="{a}" lon="{b}"><ele>3</ele>{f"<time>{t}</time>" if t else ""}</trkpt>'
    texts = {
        "two": f'{head}<gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1"><metadata/><trk><name>a</name><trkseg>{point(50, 7, "2024-01-01T00:00:00Z")}{point(50.5, 7.5, "2024-01-01T01:30:00Z")}</trkseg><trkseg>{point(51, 8, "2024-01-01T05:00:00+01:00")}</trkseg></trk><trk><name>b</name><trkseg>{point(1, 2)}</trkseg></trk></gpx>',
        "rte": f'{head}<gpx><rte><name>r &amp; s</name><rtept lat="1.5" lon="-2"/><rtept lat="2" lon="-2.5"><time>2024-01-01T00:00:00Z</time></rtept></rte></gpx>',
        "bad": f'{head}<!doctype gpx [<!ENTITY x "y">]>\n<gpx><trk><name>c</name><trkseg>{point(1, 2)}</trkseg></trk></gpx>',
        "off": f"{head}<gpx><trk><name>d</name><trkseg>{point(1, 2)}{point(91, 2)}</trkseg></trk></gpx>",
        "none": f"{head}<gpx><wpt lat='1' lon='2'/></gpx>",
    }
    for name, text in texts.items():
        (folder / f"{name}.gpx").write_text(text)
    points, refused = read_gpx(spark, str(folder))
    got = {}
    for r in points.orderBy("file", "sample").collect():
        got.setdefault((r["file"].rsplit("/", 1)[1], r["route"]), []).append((r["lat"], r["lon"], r["hours"]))
    assert got == {("two.gpx", "a"): gpx_points(texts["two"]), ("rte.gpx", "r & s"): gpx_points(texts["rte"])}
    assert [r["file"].rsplit("/", 1)[1] for r in refused.collect()] == ["bad.gpx"]
    again = str(tmp_path / "again")
    write_gpx(points.withColumn("time", F.lit(None).cast("timestamp")), again)
    back = read_gpx(spark, again)[0]
    assert sorted((r["route"], r["sample"], r["lat"], r["lon"], r["hours"]) for r in back.collect()) == sorted((k[1], i, p[0], p[1], None) for k, own in got.items() for i, p in enumerate(own))


def test_gpx_points_off_the_globe_stay_if_asked_for(spark, tmp_path):
    from fanplume.sources.tracks import read_gpx, write_gpx

    rows = [("a", 0, 1.0, 2.0), ("a", 1, 91.5, 2.0), ("b", 0, 3.0, None), ("c", 0, 4.0, 5.0)]
    write_gpx(spark.createDataFrame(rows, "route string, sample long, lat double, lon double"), str(tmp_path / "gpx"))
    found = lambda **how: sorted(tuple(r) for r in read_gpx(spark, str(tmp_path / "gpx"), **how)[0].select("route", "sample", "lat", "lon").collect())
    assert found(on_globe=False) == rows
    assert found() == rows[3:]
