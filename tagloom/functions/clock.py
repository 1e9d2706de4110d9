"""Local wall-clock columns."""

from __future__ import annotations

from datetime import time

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(ts: Column, tz: str | Column) -> Column:
    """Wall clock of an instant in ``tz``, as a zone-less timestamp.

    The detour over UTC microseconds keeps the result independent of the session
    time zone; ``convert_timezone`` applies the daylight saving rules of ``tz``.
    """
    utc = F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))
    zone = F.lit(tz) if isinstance(tz, str) else tz
    return F.convert_timezone(F.lit("UTC"), zone, utc)


def micros_of(t: time) -> int:
    return ((t.hour * 60 + t.minute) * 60 + t.second) * 1_000_000 + t.microsecond


def micros_of_day(local: Column) -> Column:
    """Microseconds since local midnight."""
    seconds = (F.hour(local) * 60 + F.minute(local)) * 60
    return (seconds.cast("bigint") * 1_000_000
            + (F.extract(F.lit("SECOND"), local) * 1_000_000).cast("bigint"))


def weekday_name(local: Column) -> Column:
    return F.date_format(local, "EEEE")


def shift_date(ts: Column, tz: str | Column, shift_start: time) -> Column:
    """Date of the local shift an instant belongs to."""
    local = local_time(ts, tz)
    date = F.to_date(local)
    return F.when(micros_of_day(local) < micros_of(shift_start), F.date_sub(date, 1)).otherwise(date)


def shift_id(ts: Column, tz: str | Column, shift_start: time) -> Column:
    """Text id of the shift: its local date and its start as hours and minutes."""
    suffix = f"_{shift_start:%H:%M}"
    return F.concat(F.date_format(shift_date(ts, tz, shift_start), "yyyy-MM-dd"), F.lit(suffix))
