"""Points, areas and grids: interpolation in place and time, nearest cells, distance bins, routes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fanplume.functions.missing import known, num
from fanplume.functions.weather import haversine_km

KM_PER_DEGREE = 111.2
#: Degrees that an area may span, points that it may get, and bins of distance.
MOST_DEGREES, MOST_POINTS, MOST_BINS = 30, 500, 200


def area_sides(south: float, north: float, west: float, east: float, spacing_km: float = 10.0, most: int = MOST_POINTS) -> tuple[int, int, float, float]:
    """Rows, columns and the steps in degrees of a grid over an area, from its south-western corner on.

    Points are `spacing_km` apart, or further where that would make more than `most`: (h / s + 1) (w / s + 1) = most
    for the sides h and w in km is a quadratic equation in 1 / s.
    """
    if not (-90 <= south < north <= 90 and -180 <= west < east <= 180):
        raise ValueError("an area is south < north within 90 and west < east within 180 degrees")
    if max(north - south, east - west) > MOST_DEGREES:
        raise ValueError(f"the area spans more than {MOST_DEGREES} degrees")
    per_lon = KM_PER_DEGREE * max(math.cos(math.radians((south + north) / 2)), 1e-3)
    h, w = (north - south) * KM_PER_DEGREE, (east - west) * per_lon
    densest = (math.sqrt((h + w) ** 2 + 4 * h * w * (most - 1)) - (h + w)) / (2 * h * w)
    gap = max(spacing_km, 1 / densest)
    rows, cols = (int(side / gap + 1e-9) + 1 for side in (h, w))
    return rows, cols, gap / KM_PER_DEGREE, gap / per_lon


def area_points(spark: SparkSession, south: float, north: float, west: float, east: float, spacing_km: float = 10.0, most: int = MOST_POINTS) -> DataFrame:
    """The points (point, lat, lon) of `area_sides`."""
    rows, cols, dlat, dlon = area_sides(south, north, west, east, spacing_km, most)
    return spark.range(rows * cols).select(F.col("id").alias("point"), (south + dlat * F.floor(F.col("id") / cols)).alias("lat"), (west + dlon * (F.col("id") % cols)).alias("lon"))


def crop(cells: DataFrame, south: float, north: float, west: float, east: float, step: float = 0.0) -> DataFrame:
    """The cells (lat, lon) of an area and a margin of one cell, `step` degrees wide, that interpolation needs at its edge."""
    margin = step + 1e-9
    return cells.filter(F.col("lat").between(south - margin, north + margin) & F.col("lon").between(west - margin, east + margin))


def area_grid(spark: SparkSession, south: float, north: float, west: float, east: float, rows: int, cols: int) -> DataFrame:
    """A regular grid of an area, both edges included: lat, lon (4 decimals) and their positions."""
    side = lambda low, high, n, pos: F.round(F.lit(low) + (high - low) / max(n - 1, 1) * pos, 4)
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("lat_pos"), (F.col("id") % cols).alias("lon_pos"))
    return cells.withColumns({"lat": side(south, north, rows, F.col("lat_pos")), "lon": side(west, east, cols, F.col("lon_pos"))})


def _place_on(south: float, west: float, step: float, rows: int, cols: int) -> tuple[Column, Column, Column]:
    """Positions of lat and lon on a grid, in steps, and whether they lie on it. Longitudes that differ by 360 are one."""
    fr, fc = F.round((F.col("lat") - south) / step, 9), F.round(F.pmod(F.round(F.col("lon") - west, 11), F.lit(360.0)) / step, 9)
    return fr, fc, (fr >= 0) & (fr <= rows - 1) & (fc >= 0) & (fc <= cols - 1)


def require_inside(points: DataFrame, south: float, west: float, step: float, rows: int, cols: int) -> DataFrame:
    """`points`, or an error if one lies off the grid; reads them until it finds one."""
    _, _, on = _place_on(south, west, step, rows, cols)
    if points.filter(~F.coalesce(on, F.lit(False))).limit(1).count():
        raise ValueError("a point lies outside the grid")
    return points


def require_few(points: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """`points`, or an error if there are more than `most`; reads no more than that and one."""
    if points.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} points")
    return points


def along(samples: DataFrame, fields: DataFrame, values: list[str], key: list[str], south: float, west: float, step: float, rows: int, cols: int, instant: bool = True, by: list[str] | None = None) -> DataFrame:
    """Each sample's value at its own place (lat, lon) and time (hours), from the cells around it; samples off the grid
    are left out, and one whose cells aren't all there is missing.

    `fields` has lat_pos, lon_pos, hour (whole) and the columns `by`. Instant values are interpolated between the hours
    before and after; others hold for the hour that ends at theirs. A sample unfolds the cells that have any weight for
    it, at most eight, and these meet the fields in one equi-join; no sample meets another one's place or time.
    """
    fr, fc, on = _place_on(south, west, step, rows, cols)
    h = F.round(F.col("hours"), 9)
    two = lambda x, low: F.array(F.struct(low.cast("long").alias("at"), (1 - (x - low)).alias("part")), F.struct((low + 1).cast("long").alias("at"), (x - low).alias("part")))
    one = F.array(F.struct(F.ceil(h).cast("long").alias("at"), F.lit(1.0).alias("part")))
    spread = samples.filter(on).select(*key, F.explode(two(fr, F.floor(fr))).alias("r"), fc.alias("fc"), h.alias("hours"))
    spread = spread.select(*key, "r", F.explode(two(F.col("fc"), F.floor("fc"))).alias("c"), "hours")
    spread = spread.select(*key, "r", "c", F.explode(two(F.col("hours"), F.floor("hours")) if instant else one).alias("t"))
    weighted = spread.select(*key, F.col("r.at").alias("lat_pos"), F.col("c.at").alias("lon_pos"), F.col("t.at").alias("hour"), (F.col("r.part") * F.col("c.part") * F.col("t.part")).alias("weight")).filter("weight > 0")
    met = weighted.join(fields, ["lat_pos", "lon_pos", "hour"])
    found = met.groupBy(*key, *(by or [])).agg(*(_weighted(v) for v in values))
    return found if by else samples.filter(on).select(*key).join(found, key, "left")


def _weighted(value: str) -> Column:
    """The weighted sum of what was found, if that makes up all of the weight; else missing."""
    x = known(num(F.col(value)))
    return F.when(F.abs(F.sum(F.when(x.isNotNull(), F.col("weight"))) - 1) < 1e-6, F.sum(F.col("weight") * x)).alias(value)


def bilinear(points: DataFrame, grid: DataFrame, values: list[str], south: float, west: float, step: float, rows: int, cols: int, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Each point's value from the four grid cells around it; points outside the grid are left out, or with `strict` an error.

    `grid` has lat_pos and lon_pos. A point unfolds those of its four cells that have any weight, which then join by
    position; where one of them is missing or isn't there, so is the value.
    """
    if strict:
        require_inside(points, south, west, step, rows, cols)
    fr, fc, on = _place_on(south, west, step, rows, cols)
    r, c = F.least(F.floor(fr), F.lit(rows - 2)), F.least(F.floor(fc), F.lit(cols - 2))
    inside = points.filter(on)
    wr, wc = fr - r, fc - c
    corner = lambda dr, dc: F.struct((r + dr).alias("lat_pos"), (c + dc).alias("lon_pos"), ((wr if dr else 1 - wr) * (wc if dc else 1 - wc)).alias("weight"))
    corners = inside.withColumn("__c", F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1)))).select("point", F.col("__c.lat_pos"), F.col("__c.lon_pos"), F.col("__c.weight")).filter("weight > 0")
    found = corners.join(grid, ["lat_pos", "lon_pos"]).groupBy("point", *(by or [])).agg(*map(_weighted, values))
    return found if by else inside.select("point").join(found, "point", "left")


def nearest(points: DataFrame, cells: DataFrame, bucket_deg: float = 0.25, max_km: float | None = None) -> DataFrame:
    """The cell (its id `cell`) nearest to each point, by the local plane; ties to the smaller id.

    Cells meet the points of their own and the eight neighbouring buckets in an equi-join; longitudes that differ by
    360 are one, and the buckets go round the globe. Points without a cell there, or with none within `max_km`, are left out.
    """
    row, round_globe = (lambda c: F.floor((F.col(c) + 90) / bucket_deg)), F.lit(math.ceil(360 / bucket_deg))
    col = lambda c: F.floor(F.pmod(F.round(F.col(c) + 180, 11), F.lit(360.0)) / bucket_deg)
    near = points.withColumns({"__r": F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: row("lat") + d))})
    near = near.withColumn("__c", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.pmod(col("lon") + d, round_globe))))
    own = cells.select("cell", F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon"), row("lat").alias("__r"), col("lon").alias("__c"))
    apart = F.pmod(F.col("cell_lon") - F.col("lon") + 180, F.lit(360.0)) - 180
    d2 = F.pow(F.col("cell_lat") - F.col("lat"), F.lit(2)) + F.pow(apart * F.cos(F.radians("lat")), F.lit(2))
    best = near.join(own, ["__r", "__c"]).groupBy("point").agg(F.min(F.struct(F.round(d2, 12).alias("d2"), "cell")).alias("best"))
    out = best.select("point", F.col("best.cell").alias("cell"), (F.sqrt("best.d2") * 111.2).alias("km"))
    return out if max_km is None else out.filter(F.col("km") <= max_km)


def distance_from(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    return haversine_km(lat, lon, to_lat, to_lon)


def by_distance(samples: DataFrame, edges: list[float], by: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates of samples in bins (a, b] of distance_km; the first edge belongs to the first bin; what lies outside
    goes; empty bins are kept as missing."""
    if len(edges) - 1 > MOST_BINS:
        raise ValueError(f"more than {MOST_BINS} bins")
    spark = samples.sparkSession
    names = [f"({a:g}, {b:g}]" for a, b in zip(edges, edges[1:], strict=False)]
    d = F.col("distance_km")
    pos = F.when(d == edges[0], 0)
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        pos = pos.when((d > a) & (d <= b), k)
    binned = samples.withColumn("bin_pos", pos).filter(F.col("bin_pos").isNotNull()).groupBy(*by, "bin_pos").agg(*(c.alias(n) for n, c in aggregates.items()))
    bins = spark.createDataFrame(list(enumerate(names)), "bin_pos int, distance_bin string")
    groups = samples.select(*by).distinct().withColumn("bin_pos", F.explode(F.array(*map(F.lit, range(len(names))))))
    return groups.join(binned, [*by, "bin_pos"], "left").join(F.broadcast(bins), "bin_pos").drop("bin_pos")


def half_gaps(samples: DataFrame, by: list[str], time: Column) -> DataFrame:
    """`dt`: the hours each sample stands for, half the way to its neighbours."""
    w = Window.partitionBy(*by).orderBy("sample")
    before, after = F.lag(time).over(w), F.lead(time).over(w)
    return samples.withColumn("dt", (F.coalesce(after, time) - F.coalesce(before, time)) / 2)


def resample_routes(points: DataFrame, spacing_km: float, by: list[str]) -> DataFrame:
    """Points every `spacing_km` or a little less along each route, ends included, on the straight lines between its points.

    Each leg unfolds the samples that lie on it, so a route of any length is dealt over tasks by its legs. Where points
    have `hours`, as tracks with times do, samples get theirs on the line between them too.
    """
    timed = "hours" in points.columns
    w = Window.partitionBy(*by).orderBy("sample")
    total = F.max("distance_km").over(Window.partitionBy(*by))
    if timed:
        points = points.withColumn("to_hours", F.lead("hours").over(w))
    legs = points.withColumns({"to_km": F.lead("distance_km").over(w), "to_lat": F.lead("lat").over(w), "to_lon": F.lead("lon").over(w), "total": total})
    legs = legs.filter("to_km > distance_km").withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("total") / spacing_km)))
    gap = F.col("total") / F.col("n")
    first = F.when(F.col("distance_km") == 0, F.lit(0)).otherwise(F.floor(F.round(F.col("distance_km") / gap, 9)) + 1)
    last = F.floor(F.round(F.col("to_km") / gap, 9))
    legs = legs.withColumns({"gap": gap, "__a": first, "__b": last}).filter("__a <= __b")
    out = legs.withColumn("k", F.explode(F.sequence("__a", "__b")))
    share = (F.col("k") * F.col("gap") - F.col("distance_km")) / (F.col("to_km") - F.col("distance_km"))
    return out.select(*by, F.col("k"), (F.col("k") * F.col("gap")).alias("at_km"), (F.col("lat") + share * (F.col("to_lat") - F.col("lat"))).alias("lat"), (F.col("lon") + share * (F.col("to_lon") - F.col("lon"))).alias("lon"), "course", *([(F.col("hours") + share * (F.col("to_hours") - F.col("hours"))).alias("hours")] if timed else []))


def timed_samples(samples: DataFrame, by: list[str], start: float, speed_kmh: float | None = None) -> DataFrame:
    """Samples of `resample_routes` with the `hours` they are passed at and `dt`, half the time to their neighbours.

    At a constant speed from `start` on; without one, at the track's own times, shifted so that each track begins at `start`.
    """
    if speed_kmh is not None and not 0 < speed_kmh <= 200:
        raise ValueError("a speed lies between 0 and 200 km/h")
    if speed_kmh is None and "hours" not in samples.columns:
        raise ValueError("give a speed, or points with hours")
    since = F.col("at_km") / speed_kmh if speed_kmh else F.col("hours") - F.min("hours").over(Window.partitionBy(*by))
    w = Window.partitionBy(*by).orderBy("k")
    out = samples.withColumn("hours", start + since)
    before, after = F.lag("hours").over(w), F.lead("hours").over(w)
    return out.withColumn("dt", (F.coalesce(after, F.col("hours")) - F.coalesce(before, F.col("hours"))) / 2)


def with_polylines(points: DataFrame, by: list[str], groups: int = 6) -> DataFrame:
    """Each route as an encoded polyline of precision 5: differences of rounded degrees in groups of five bits. Six groups
    hold any difference on the globe; eleven hold those of any places that a double tells apart to five digits."""
    w = Window.partitionBy(*by).orderBy("sample")
    whole = lambda c: F.round(F.col(c) * 100000).cast("long")
    change = lambda c: whole(c) - F.coalesce(F.lag(whole(c)).over(w), F.lit(0))

    def encoded(d: Column) -> Column:
        v = F.when(d < 0, -2 * d - 1).otherwise(2 * d)
        chars = [F.when((v >= 32**k) | F.lit(k == 0), F.chr(63 + (F.floor(v / 32**k) % 32) + F.when(v >= 32 ** (k + 1), 32).otherwise(0))).otherwise("") for k in range(groups)]
        return F.concat(*chars)

    parts = points.withColumns({"dlat": change("lat"), "dlon": change("lon")}).withColumn("part", F.concat(encoded(F.col("dlat")), encoded(F.col("dlon"))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample", "part"))), lambda s: s["part"]), "")
    return parts.groupBy(*by).agg(joined.alias("polyline"))
