"""Instants, local days and minutes. Zones are arguments; the session's zone plays no part."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: an ISO-8601 instant with a time of day and a zone.
INSTANT = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)\z"


def instant(text: Column) -> Column:
    """Epoch seconds of an ISO-8601 instant, fractions cut off; null for anything less than a whole instant.

    The guard is needed: Spark alone takes dates, times and instants without a zone.
    """
    colon = F.regexp_replace(text, r"([+-]\d\d)(\d\d)\z", "$1:$2")
    return F.when(text.rlike(INSTANT), F.unix_seconds(F.try_to_timestamp(colon)))


def local_time(epoch: Column, tz: str) -> Column:
    """The wall clock of a zone, as a timestamp without zone."""
    utc = F.timestamp_add("SECOND", epoch, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def day_key(epoch: Column, tz: str = "UTC") -> Column:
    """yyyy-MM-dd of an instant in a zone."""
    return F.date_format(local_time(epoch, tz), "yyyy-MM-dd")


def minute_of_day(epoch: Column, tz: str = "UTC") -> Column:
    """0 to 1439. On days with a change of clocks minutes repeat or are left out."""
    at = local_time(epoch, tz)
    return F.hour(at) * 60 + F.minute(at)


def month_of(day: Column) -> Column:
    return F.substring(day, 1, 7)


def day_before(day: Column) -> Column:
    return F.date_format(F.date_sub(F.to_date(day, "yyyy-MM-dd"), 1), "yyyy-MM-dd")


@dataclass(frozen=True)
class Now:
    """The local day and minute that a report is for; operators never ask the clock."""

    day: str
    minute: int

    @classmethod
    def at(cls, moment: datetime, tz: str = "UTC") -> Now:
        """``moment`` is aware, or else in UTC."""
        local = (moment if moment.tzinfo else moment.replace(tzinfo=ZoneInfo("UTC"))).astimezone(ZoneInfo(tz))
        return cls(local.strftime("%Y-%m-%d"), local.hour * 60 + local.minute)

    @property
    def month(self) -> str:
        return self.day[:7]
