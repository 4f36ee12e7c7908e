"""Timeouts, delays and the next run of daily jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MB = 1024 * 1024


def upload_timeout(size: Column) -> Column:
    """Seconds for an upload of ``size`` bytes: 60 up to 5 MB, 5 more for each whole MB beyond, 600 at most."""
    return F.when(size <= 5 * _MB, 60).otherwise(F.least(F.lit(600), 60 + 5 * F.floor(size / _MB - 5))).cast("int")


def retry_delay(base: Column, attempt: Column) -> Column:
    """The delay before an attempt (from 1): doubled each time."""
    return base * F.pow(F.lit(2), attempt - 1).cast("long")


def next_daily(now: Column, hour: int, minute: Column) -> Column:
    """The next time of day hour:minute; a day later if it is past."""
    today = F.date_trunc("day", now).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hour), minute)
    return F.when(now > today, today + F.expr("interval 1 day")).otherwise(today)


def request_id() -> Column:
    """A random identifier."""
    return F.uuid()
