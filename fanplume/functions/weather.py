"""Derived variables, unit conversions and geodesy as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fanplume.functions.missing import angle_of, clip, hypot, maximum, num

EARTH_KM = 6371.0088

#: Factor and offset from what sources deliver to the catalogue's units.
CONVERSIONS = {
    ("K", "°C"): (1.0, -273.15),
    ("m/s", "km/h"): (3.6, 0.0),
    ("m", "mm"): (1000.0, 0.0),
    ("fraction", "%"): (100.0, 0.0),
    ("J/m²/h", "W/m²"): (1 / 3600, 0.0),
}


def convert(x, source: str, target: str) -> Column:
    factor, offset = CONVERSIONS[source, target]
    return num(x) * factor + offset


def wind_speed(u, v) -> Column:
    return hypot(u, v)


def wind_direction(u, v) -> Column:
    """Degrees the wind blows from."""
    return angle_of(-num(u), -num(v))


def relative_humidity(t, td) -> Column:
    """Percent, by Magnus, from temperature and dew point in °C."""
    pressure = lambda x: F.exp(17.625 * x / (243.04 + x))
    return clip(100 * pressure(num(td)) / pressure(num(t)), 0, 100)


def feels_like(t, wind, rh=None) -> Column:
    """°C: wind chill when cold and windy, heat index when hot and humid, else the temperature."""
    t, wind = num(t), num(wind)
    blow = F.pow(maximum(wind, 0), F.lit(0.16))
    out = F.when((t <= 10) & (wind > 4.8), 13.12 + 0.6215 * t - 11.37 * blow + 0.3965 * t * blow)
    if rh is not None:
        f, h = t * 9 / 5 + 32, num(rh)
        # fixed values: coefficients of the published regression, by powers of temperature (°F) and humidity (%)
        terms = [(-42.379, 0, 0), (2.04901523, 1, 0), (10.14333127, 0, 1), (-0.22475541, 1, 1), (-6.83783e-3, 2, 0), (-5.481717e-2, 0, 2), (1.22874e-3, 2, 1), (8.5282e-4, 1, 2), (-1.99e-6, 2, 2)]
        product = lambda c, i, j: F.lit(c) * (F.lit(1.0) if not i else f if i == 1 else f * f) * (F.lit(1.0) if not j else h if j == 1 else h * h)
        index = sum((product(*x) for x in terms[1:]), product(*terms[0]))
        out = out.when((t >= 27) & (h >= 40), (index - 32) * 5 / 9)
    return out.otherwise(t)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(num(x)) for x in (lat1, lon1, lat2, lon2))
    half = F.pow(F.sin((lat2 - lat1) / 2), F.lit(2)) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(half))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial course from the first point to the second, 0 to 360."""
    lat1, lon1, lat2, lon2 = (F.radians(num(x)) for x in (lat1, lon1, lat2, lon2))
    return angle_of(F.sin(lon2 - lon1) * F.cos(lat2), F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1))


def headwind(speed, direction, course) -> Column:
    """Wind against the direction of travel; a tailwind is negative."""
    return num(speed) * F.cos(F.radians(num(direction) - num(course)))


def crosswind(speed, direction, course) -> Column:
    return F.abs(num(speed) * F.sin(F.radians(num(direction) - num(course))))
