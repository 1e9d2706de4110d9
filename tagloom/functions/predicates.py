"""Stateless drop tests.  Each function returns a Column that is true when the read is dropped."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import time

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .clock import local_time, micros_of, micros_of_day, weekday_name


def rssi_below(minimum: float, rssi: Column | None = None) -> Column:
    """Signal below the floor, compared in single precision; a missing signal counts as 0."""
    rssi = F.col("rssi") if rssi is None else rssi
    return F.coalesce(rssi, F.lit(0.0).cast("float")) < F.lit(minimum).cast("float")


def antenna_masked(mask: int, port: Column | None = None) -> Column:
    """Port whose bit in the 16-bit mask is off, or that has no bit."""
    port = F.col("antenna_port") if port is None else port
    enabled = [p for p in range(1, 17) if mask >> (p - 1) & 1]
    return ~F.coalesce(port.isin(enabled) if enabled else F.lit(False), F.lit(False))


def epc_shorter(minimum: int) -> Column:
    return F.char_length("epc") < minimum


def epc_longer(maximum: int) -> Column:
    return F.char_length("epc") > maximum


def epc_without_prefix(prefix: str) -> Column:
    return ~F.upper("epc").startswith(prefix.upper())


def epc_without_suffix(suffix: str) -> Column:
    return ~F.upper("epc").endswith(suffix.upper())


def check_pattern(pattern: str) -> None:
    """Refuse a pattern that the engine's regular expressions don't take; checked once a session is there to ask."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        spark.sql("SELECT '' RLIKE :pattern", args={"pattern": f"(?iu){pattern}"}).collect()
    except PySparkException as error:
        raise ValueError(f"{pattern!r} is not a valid pattern: {error.getCondition()}") from None


def epc_not_matching(pattern: str) -> Column:
    """No match anywhere in the EPC, ignoring case."""
    return ~F.col("epc").rlike(f"(?iu){pattern}")


def day_not_operating(days: Iterable[str], tz: str | Column, ts: Column | None = None) -> Column:
    ts = F.col("eval_ts") if ts is None else ts
    return ~weekday_name(local_time(ts, tz)).isin(list(days))


def outside_hours(start: time, end: time, tz: str | Column, ts: Column | None = None) -> Column:
    """Outside an inclusive time-of-day window; a start after the end spans midnight."""
    ts = F.col("eval_ts") if ts is None else ts
    now = micros_of_day(local_time(ts, tz))
    low, high = micros_of(start), micros_of(end)
    inside = (now >= low) & (now <= high) if low <= high else (now >= low) | (now <= high)
    return ~inside
