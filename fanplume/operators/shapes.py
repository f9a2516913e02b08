"""Extended shapes: which of them a box shows, cut to it, and how much each vertex matters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanplume.functions.missing import num
from fanplume.sources.shared import stored

#: Degrees of a tile's side; points that a leg of a line may have to be finished in one task; rounds of splitting before.
TILE_DEGREES, LEG_POINTS, MOST_ROUNDS = 1.0, 10_000, 30
KM = 111.195
SIDES = ("south", "west", "north", "east")


def outlines(points: DataFrame, by: list[str], order: str = "sample", extra: list[str] = ()) -> DataFrame:
    """Points (lat, lon and the columns `extra`) as one row a shape: `points` in order, and the shape's bounds."""
    bounds = [F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east")]
    own = F.sort_array(F.collect_list(F.struct(order, "lat", "lon", *extra)))
    shapes = points.groupBy(*by).agg(own.alias("points"), *bounds)
    return shapes.withColumn("points", F.transform("points", lambda p: F.struct(*(p[n].alias(n) for n in ("lat", "lon", *extra)))))


def _tiles(df: DataFrame, degrees: float) -> DataFrame:
    """A row for each tile (tile_row, tile_col) that a row's bounds touch."""
    span = lambda low, high: F.sequence(F.floor(F.col(low) / degrees), F.floor(F.col(high) / degrees))
    return df.withColumn("tile_row", F.explode(span("south", "north"))).withColumn("tile_col", F.explode(span("west", "east")))


def shown_in(boxes: DataFrame, shapes: DataFrame, degrees: float = TILE_DEGREES) -> DataFrame:
    """The shapes that each box shows: their bounds overlap (edges count), the box's zoom is the shape's `zoom` or more,
    and the shape is at least the box's `tolerance` (degrees) across.

    `boxes` has box, south, west, north, east, zoom, tolerance; `shapes` has shape, zoom, south, west, north, east and
    whatever else goes along. Both unfold the tiles that they touch and meet by tile; a pair counts in the tile that
    holds the south-western corner of what both cover, so none is found twice and nothing has to be made distinct.
    A tile with many shapes is a join key that adaptive execution splits.
    """
    a = _tiles(boxes.select("box", *(F.col(c).alias(c) for c in SIDES), F.col("zoom").alias("box_zoom"), "tolerance"), degrees)
    a = a.select("box", "box_zoom", "tolerance", "tile_row", "tile_col", *(F.col(c).alias(f"box_{c}") for c in SIDES))
    met = a.join(_tiles(shapes, degrees), ["tile_row", "tile_col"])
    overlap = (F.col("south") <= F.col("box_north")) & (F.col("north") >= F.col("box_south")) & (F.col("west") <= F.col("box_east")) & (F.col("east") >= F.col("box_west"))
    first = (F.floor(F.greatest("south", "box_south") / degrees) == F.col("tile_row")) & (F.floor(F.greatest("west", "box_west") / degrees) == F.col("tile_col"))
    large = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west")) >= F.col("tolerance")
    return met.filter(overlap & first & large & (F.col("zoom") <= F.col("box_zoom"))).drop("tile_row", "tile_col")


def clip_rings(pairs: DataFrame, points: str = "points") -> DataFrame:
    """Rings cut to their boxes (box_south ...), side by side after Sutherland and Hodgman, by array functions alone. The
    result may run along the box's edge, so it is for filling; rings of which less than three points are left go.

    The four sides are folded, so the ring behind each is made once, whatever refers to it.
    """
    ring_type = "array<struct<lat: double, lon: double>>"
    place = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    side = lambda along, value, sign: F.struct(F.lit(along).alias("along"), num(F.col(value)).alias("at"), F.lit(sign).alias("sign"))
    sides = F.array(side("lat", "box_south", 1), side("lat", "box_north", -1), side("lon", "box_west", 1), side("lon", "box_east", -1))

    def cut(ring: Column, side: Column) -> Column:
        """Each point on the inner side, behind the crossing that leads to or away from it."""
        by_lat = side["along"] == "lat"
        depth = lambda p: (F.when(by_lat, p["lat"]).otherwise(p["lon"]) - side["at"]) * side["sign"]

        def step(p: Column, i: Column) -> Column:
            q = F.element_at(ring, F.when(i == 0, -1).otherwise(i).cast("int"))
            crosses = (depth(p) >= 0) != (depth(q) >= 0)
            part = depth(q) / F.when(crosses, depth(q) - depth(p))
            lat = F.when(by_lat, side["at"]).otherwise(q["lat"] + (p["lat"] - q["lat"]) * part)
            lon = F.when(by_lat, q["lon"] + (p["lon"] - q["lon"]) * part).otherwise(side["at"])
            return F.filter(F.array(F.when(crosses, place(lat, lon)), F.when(depth(p) >= 0, place(p["lat"], p["lon"]))), lambda x: x.isNotNull())

        return F.flatten(F.transform(ring, step)).cast(ring_type)

    whole = F.transform(points, lambda p: place(num(p["lat"]), num(p["lon"]))).cast(ring_type)
    return pairs.withColumn(points, F.aggregate(sides, whole, cut)).filter(F.size(points) >= 3)


def clip_lines(pairs: DataFrame, points: str = "points") -> DataFrame:
    """Lines as the stretches (`piece` from 0) whose segments may cross their boxes, so that they reach the edge: those
    segments whose own bounds overlap the box."""
    p = lambda k: F.element_at(points, k.cast("int"))
    high, low = (lambda n, k: F.greatest(p(k)[n], p(k + 1)[n])), (lambda n, k: F.least(p(k)[n], p(k + 1)[n]))
    near = lambda k: (low("lat", k) <= F.col("box_north")) & (high("lat", k) >= F.col("box_south")) & (low("lon", k) <= F.col("box_east")) & (high("lon", k) >= F.col("box_west"))
    out = pairs.filter(F.size(points) > 1).withColumn("__k", F.sequence(F.lit(1), F.size(points) - 1))
    out = out.withColumn("__near", F.transform("__k", near))
    at = lambda k: F.coalesce(F.try_element_at("__near", k.cast("int")), F.lit(False))
    before = lambda k: F.when(k > 1, at(F.greatest(k - 1, F.lit(1)))).otherwise(False)
    begins, ends = F.filter("__k", lambda k: at(k) & ~before(k)), F.filter("__k", lambda k: at(k) & ~at(k + 1))
    out = out.withColumn("__run", F.arrays_zip(begins.alias("a"), ends.alias("b"))).select("*", F.posexplode("__run").alias("piece", "__r"))
    return out.withColumn(points, F.slice(points, F.col("__r.a"), F.col("__r.b") - F.col("__r.a") + 2)).drop("__k", "__near", "__run", "__r")


def detail(pairs: DataFrame, points: str = "points") -> DataFrame:
    """Only the vertices that matter at the box's tolerance (those of `outlines(..., extra=["significance"])`), in km."""
    return pairs.withColumn(points, F.filter(points, lambda p: p["significance"] > F.col("tolerance") * KM))


def _legs_done(legs: DataFrame, by: list[str]) -> DataFrame:
    """The significance of all vertices of legs that one task can hold."""
    names = [*by, "sample", "lat", "lon", "significance"]

    def run(leg: pd.DataFrame) -> pd.DataFrame:
        leg = leg.sort_values("sample")
        # The leg's ends come along with every row of it; they aren't rows of their own.
        x = np.concatenate([leg["ax"].to_numpy()[:1], leg["x"].to_numpy(), leg["bx"].to_numpy()[:1]])
        y = np.concatenate([leg["ay"].to_numpy()[:1], leg["y"].to_numpy(), leg["by"].to_numpy()[:1]])
        leg["significance"] = vertex_significance(x, y, float(leg["cap"].iloc[0]))[1:-1]
        return leg[names]

    schema = T.StructType([legs.schema[c] for c in names[:-1]] + [T.StructField("significance", T.DoubleType())])
    return legs.groupBy(*by, "leg").applyInPandas(run, schema)


def vertex_significance(x: np.ndarray, y: np.ndarray, cap: float = np.inf) -> np.ndarray:
    """Of each vertex of a line on a plane the largest tolerance below which Douglas-Peucker keeps it, `cap` at most;
    both ends always stay. A vertex matters no more than the one at which the line was split before it."""
    out = np.full(len(x), np.inf)
    todo = [(0, len(x) - 1, cap)]
    while todo:
        a, b, most = todo.pop()
        if b - a < 2:
            continue
        off = _off(x[a + 1 : b], y[a + 1 : b], x[a], y[a], x[b], y[b])
        k = int(off.argmax())
        out[a + 1 + k] = most = min(most, float(off[k]))
        todo += [(a, a + 1 + k, most), (a + 1 + k, b, most)]
    return out


def _off(x: np.ndarray, y: np.ndarray, ax: float, ay: float, bx: float, by: float) -> np.ndarray:
    size = float(np.hypot(bx - ax, by - ay))
    return np.abs((x - ax) * (by - ay) - (y - ay) * (bx - ax)) / size if size else np.hypot(x - ax, y - ay)


def significance(points: DataFrame, by: list[str], leg_points: int = LEG_POINTS) -> DataFrame:
    """The points (columns `by`, sample, lat, lon) of lines with the `significance` of each vertex in km: those above a
    tolerance are what Douglas-Peucker keeps at it, for any tolerance, without simplifying again.

    Legs with more than `leg_points` vertices are split at their farthest vertex by joins and partial aggregates,
    round by round, so a long line spreads over tasks; then each leg is finished in one task. After MOST_ROUNDS legs
    that are still longer, as of a line that turns away point by point, are finished as they are.
    """
    y, middle = F.col("lat") * KM, points.groupBy(*by).agg(F.avg("lat").alias("middle"), F.min_by(F.struct("sample", "lat", "lon"), "sample").alias("a"), F.max_by(F.struct("sample", "lat", "lon"), "sample").alias("b"))
    own = points.select(*by, "sample", "lat", "lon").join(middle, by)
    across = lambda lon: lon * KM * F.cos(F.radians("middle"))
    own = own.select(
        *by, "sample", "lat", "lon", across(F.col("lon")).alias("x"), y.alias("y"), F.col("a.sample").alias("leg"), F.col("b.sample").alias("till"), F.lit(float("inf")).alias("cap"),
        across(F.col("a.lon")).alias("ax"), (F.col("a.lat") * KM).alias("ay"), across(F.col("b.lon")).alias("bx"), (F.col("b.lat") * KM).alias("by"),
    )
    ends = own.filter("sample = leg OR sample = till").select(*by, "sample", "lat", "lon", F.lit(float("inf")).alias("significance"))
    rest = stored(own.filter("sample <> leg AND sample <> till"))
    done = [ends]
    for _ in range(MOST_ROUNDS):
        size = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
        off = F.when(size > 0, F.abs((F.col("x") - F.col("ax")) * (F.col("by") - F.col("ay")) - (F.col("y") - F.col("ay")) * (F.col("bx") - F.col("ax"))) / size).otherwise(F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay")))
        far = rest.groupBy(*by, "leg").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(off.alias("off"), (-F.col("sample")).alias("first"), "x", "y", "cap", "lat", "lon")).alias("far"))
        long = stored(far.filter(F.col("n") > leg_points))
        if not long.limit(1).count():
            break
        at = long.select(*by, "leg", (-F.col("far.first")).alias("split"), F.col("far.x").alias("sx"), F.col("far.y").alias("sy"), F.least("far.off", "far.cap").alias("level"))
        done.append(long.select(*by, (-F.col("far.first")).alias("sample"), F.col("far.lat").alias("lat"), F.col("far.lon").alias("lon"), F.least("far.off", "far.cap").alias("significance")))
        cut = rest.join(at, [*by, "leg"], "left").filter("split IS NULL OR sample <> split")
        left, right = F.col("sample") < F.col("split"), F.col("sample") > F.col("split")
        changed = {
            "leg": F.when(right, F.col("split")).otherwise(F.col("leg")), "till": F.when(left, F.col("split")).otherwise(F.col("till")), "cap": F.coalesce("level", "cap"),
            "ax": F.when(right, F.col("sx")).otherwise(F.col("ax")), "ay": F.when(right, F.col("sy")).otherwise(F.col("ay")), "bx": F.when(left, F.col("sx")).otherwise(F.col("bx")), "by": F.when(left, F.col("sy")).otherwise(F.col("by")),
        }
        rest = stored(cut.select(*(changed.get(c, F.col(c)).alias(c) for c in rest.columns)))
    out = _legs_done(rest, by)
    for part in done:
        out = out.unionByName(part)
    return out


def ring_area(points: Column) -> Column:
    """The area that a ring of points (lat, lon) encloses, in square degrees."""
    terms = F.transform(points, lambda p, i: (lambda q: q["lon"] * p["lat"] - p["lon"] * q["lat"])(F.element_at(points, F.when(i == 0, -1).otherwise(i).cast("int"))))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)) / 2
