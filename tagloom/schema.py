"""Record layouts and the validated rule objects that configure the operators.

A *read* is one sighting of a tag.  ``seq`` is its arrival number: unique, and
increasing in arrival order.  ``eval_ts`` is the clock at which the read is
judged.  Every stateful operator orders by ``seq`` and measures with
``eval_ts``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import time
from urllib.parse import urlsplit

from pyspark.sql import types as T

from .functions.predicates import check_pattern

READ_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("eval_ts", T.TimestampType(), True),
    T.StructField("epc", T.StringType(), False),
    T.StructField("tid", T.StringType(), True),
    T.StructField("user_memory", T.StringType(), True),
    T.StructField("antenna_port", T.IntegerType(), False),
    T.StructField("rssi", T.FloatType(), False),
    T.StructField("read_count", T.IntegerType(), False),
    T.StructField("first_seen", T.TimestampType(), True),
    T.StructField("last_seen", T.TimestampType(), True),
    T.StructField("reader_id", T.StringType(), False),
    T.StructField("location", T.StringType(), True),
    T.StructField("extra_metadata", T.MapType(T.StringType(), T.StringType()), False),
])

REGISTRY_SCHEMA = T.StructType([
    T.StructField("ordinal", T.LongType(), False),
    T.StructField("reader_id", T.StringType(), False),
    T.StructField("provider_id", T.StringType(), False),
    T.StructField("brand_name", T.StringType(), True),
    T.StructField("ip_address", T.StringType(), True),
    T.StructField("port", T.IntegerType(), True),
    T.StructField("com_port", T.StringType(), True),
    T.StructField("baud_rate", T.IntegerType(), True),
    T.StructField("antenna_mask", T.IntegerType(), True),
    T.StructField("power_dbm", T.FloatType(), True),
    T.StructField("health_check_interval_ms", T.IntegerType(), True),
    T.StructField("extra_options", T.MapType(T.StringType(), T.StringType()), True),
])

OUTBOX_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("target_url", T.StringType(), False),
    T.StructField("http_method", T.StringType(), False),
    T.StructField("payload", T.StringType(), True),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("tag_count", T.IntegerType(), False),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("retry_count", T.IntegerType(), False),
])

# The reader connection states.
CONNECTION_STATES = ("Disconnected", "Connecting", "Connected", "Reconnecting", "Faulted")

# The scopes of a dedup key, coarsest last.
SCOPES = ("antenna", "reader", "global")

# The modes of the batch trigger.
TRIGGER_MODES = ("instant", "periodic", "count", "hybrid")

# Defaults of a decoded text or frame read.
DECODE_DEFAULT_RSSI = -50.0
DECODE_DEFAULT_ANTENNA = 1

WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def _check_scope(scope: str) -> None:
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}, not {scope!r}")


@dataclass(frozen=True)
class SlidingRule:
    """Drop a read that follows another of its key by less than the window."""

    window_seconds: float = 15.0
    scope: str = "antenna"
    name: str = "SlidingWindowFilter"

    def __post_init__(self):
        if not self.window_seconds > 0:
            raise ValueError("window_seconds must be greater than zero")
        _check_scope(self.scope)


@dataclass(frozen=True)
class DailyRule:
    """Keep the first read of a key in each local shift.

    ``rollover='shift'`` keeps one registry per shift id.  ``'arrival'`` starts
    a new registry at every change of shift id in arrival order, which differs
    only where the clock runs backwards across a shift boundary.
    """

    shift_start: time = time(0, 0)
    tz: str = "UTC"
    scope: str = "global"
    rollover: str = "shift"
    name: str = "DailyUniqueFilter"

    def __post_init__(self):
        _check_scope(self.scope)
        if self.rollover not in ("shift", "arrival"):
            raise ValueError("rollover must be 'shift' or 'arrival'")


@dataclass(frozen=True)
class MetadataRule:
    """Signal, antenna and EPC pattern checks; a field left unset is off."""

    min_rssi: float | None = None
    antenna_mask: int | None = None
    min_length: int | None = None
    max_length: int | None = None
    prefix: str | None = None
    suffix: str | None = None
    regex: str | None = None
    name: str = "MetadataFilter"

    def __post_init__(self):
        if self.antenna_mask is not None and not 0 <= self.antenna_mask <= 0xFFFF:
            raise ValueError("antenna_mask must fit 16 bits")
        if self.regex is not None and self.regex.strip():
            check_pattern(self.regex)


@dataclass(frozen=True)
class ScheduleRule:
    """Operating weekdays and an inclusive time-of-day window, local to ``tz``."""

    days: tuple[str, ...] = ()
    start: time | None = None
    end: time | None = None
    tz: str = "UTC"
    name: str = "ScheduleFilter"

    def __post_init__(self):
        unknown = [d for d in self.days if d not in WEEKDAYS]
        if unknown:
            raise ValueError(f"unknown weekdays {unknown}")


@dataclass(frozen=True)
class FilterConfig:
    """Which stages the default chain switches on; a window of 0 is off."""

    sliding_window_seconds: float = 10.0
    sliding_scope: str = "antenna"
    daily_unique: bool = False
    daily_scope: str = "global"
    shift_start: time = time(0, 0)
    min_rssi: float | None = None
    antenna_mask: int | None = None
    min_length: int | None = None
    max_length: int | None = None
    prefix: str | None = None
    suffix: str | None = None
    regex: str | None = None
    schedule_days: tuple[str, ...] = ()
    schedule_start: time | None = None
    schedule_end: time | None = None
    tz: str = "UTC"

    def __post_init__(self):
        if self.sliding_window_seconds < 0:
            raise ValueError("sliding_window_seconds cannot be negative")


# The filter settings of a freshly installed gateway.
FACTORY_FILTER = FilterConfig(sliding_window_seconds=5.0, min_rssi=-75.0)


@dataclass(frozen=True)
class DispatchConfig:
    """Where batches go and what triggers one."""

    target_url: str = "http://localhost:8080/api/v1/tags"
    http_method: str = "POST"
    headers: dict[str, str] = field(default_factory=dict)
    payload_format: str = "json"
    template: str | None = None
    trigger_mode: str = "instant"
    period_ms: int = 5000
    max_batch_size: int = 100

    def __post_init__(self):
        if self.period_ms <= 0:
            raise ValueError("period_ms must be greater than zero")
        if self.max_batch_size <= 0:
            raise ValueError("max_batch_size must be greater than zero")
        parts = urlsplit(self.target_url)
        if not (parts.scheme and parts.netloc) or re.search(r"\s", self.target_url):
            raise ValueError(f"{self.target_url!r} is not a valid absolute URL")
        if self.payload_format not in ("json", "form", "csv", "xml"):
            raise ValueError(f"unknown payload format {self.payload_format!r}")

    @property
    def mode(self) -> str:
        """Trigger mode; a name that is not a mode means instant."""
        named = self.trigger_mode.lower()
        named = "count" if named == "batchcount" else named
        return named if named in TRIGGER_MODES else "instant"
