"""Local time of UTC timestamps (TIMESTAMP_NTZ), whatever the session's zone."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def local(time: Column, zone: str = "UTC") -> Column:
    return time if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), time)


def hour(time: Column, zone: str = "UTC") -> Column:
    t = local(time, zone)
    return F.hour(t) + F.minute(t) / 60


def day_of_week(time: Column, zone: str = "UTC") -> Column:
    """Monday is 0."""
    return F.weekday(local(time, zone))


def bucket(time: Column, hours: int, zone: str = "UTC") -> Column:
    """A number that times in the same local bucket of `hours` share."""
    t = local(time, zone)
    days = F.datediff(t.cast("date"), F.lit(date(1970, 1, 1)))
    return F.floor((days * 24 + F.hour(t)) / hours)


def label(time: Column, zone: str = "UTC", days: bool = False) -> Column:
    return F.date_format(local(time, zone), "yyyy-MM-dd" if days else "yyyy-MM-dd'T'HH:mm")


def utc(text: str, zone: str = "UTC") -> datetime:
    """An ISO time or date, local to `zone` unless it has an offset, as a naive UTC time."""
    t = datetime.fromisoformat(text)
    t = t if t.tzinfo else t.replace(tzinfo=ZoneInfo(zone))
    return t.astimezone(ZoneInfo("UTC")).replace(tzinfo=None)


def local_day(text: str, zone: str = "UTC") -> tuple[datetime, datetime]:
    """The first and the next UTC time of a whole local day (23 to 25 hours)."""
    after = (date.fromisoformat(text) + timedelta(days=1)).isoformat()
    return utc(text, zone), utc(after, zone)
