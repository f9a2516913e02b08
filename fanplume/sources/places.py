"""Places by name: lists that are looked up, and lists that bring their coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of one list that are looked up, places of one list with coordinates, and characters of a name.
MOST_NAMES, MOST_PLACES, NAME_CHARS = 10, 20, 60


def one_space(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def _listed(lists: DataFrame, text: str, key: list[str]) -> DataFrame:
    """A row for each entry of the ;-separated lists that isn't blank: key, pos from 0, entry."""
    entries = F.filter(F.transform(F.split(text, ";"), one_space), lambda e: e != "")
    return lists.select(*key, F.posexplode(entries).alias("pos", "entry"))


def resolve(lists: DataFrame, text: str, key: list[str], gazetteer: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """The places that ;-separated lists of names ask for: key, pos, name, lat, lon, problem.

    Names are compared without regard to case and repeated white space with the names (point, lat, lon) of the
    gazetteer, of several the one first in order. A name that isn't there has the problem "not found"; all names of a
    list that is too long have "more than n names" and no place.
    """
    asked = _listed(lists, text, key).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    first = gazetteer.groupBy(F.lower(one_space(F.col("point"))).alias("__name")).agg(F.min(F.struct("point", "lat", "lon")).alias("place"))
    fits = F.col("size") <= most
    found = asked.withColumn("__name", F.when(fits, F.lower("entry"))).join(first, "__name", "left")
    problem = F.when(~fits, f"more than {most} names").when(F.col("place").isNull(), "not found")
    return found.select(*key, "pos", F.col("entry").alias("name"), "place.lat", "place.lon", problem.alias("problem"))


def unfold_places(lists: DataFrame, text: str, key: list[str], most: int = MOST_PLACES) -> DataFrame:
    """The places of lists such as "Name@lat,lon; Other@lat,lon": key, pos, name, lat, lon, problem.

    A place without a name is called by its coordinates; names are cut at NAME_CHARS. A problem is said of its row:
    text that isn't a place, coordinates off the globe, unprintable characters, a name that its list has twice, a list
    that is too long.
    """
    number = r"([+-]?\d+(?:\.\d*)?)"
    form = rf"^(?:(.*)@)?\s*{number}\s*,\s*{number}$"
    part = lambda k: F.nullif(F.regexp_extract("entry", form, k), F.lit(""))
    rows = _listed(lists, text, key).withColumns({"lat": part(2).cast("double"), "lon": part(3).cast("double"), "given": one_space(part(1))})
    rows = rows.withColumn("name", F.substring(F.coalesce(F.nullif("given", F.lit("")), F.concat(part(2), F.lit(","), part(3)), F.col("entry")), 1, NAME_CHARS))
    of_list = Window.partitionBy(*key)
    twice = F.count(F.lit(1)).over(Window.partitionBy(*key, "name")) > 1
    problem = (
        F.when(F.count(F.lit(1)).over(of_list) > most, f"more than {most} places")
        .when(F.col("lat").isNull(), "not Name@lat,lon")
        .when((F.abs("lat") > 90) | (F.abs("lon") > 180), "off the globe")
        .when(F.col("name").rlike(r"\p{C}"), "name isn't printable")
        .when(twice, "name occurs twice")
    )
    return rows.select(*key, "pos", "name", "lat", "lon", problem.alias("problem"))
