"""Text helpers shared by decoders and renderers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_whitespace(text: Column) -> Column:
    """Trim every Unicode white-space character, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def number_text(value: Column) -> Column:
    """A number as text without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def iso_utc(ts: Column) -> Column:
    """An instant as ISO text in UTC with microseconds."""
    from .clock import local_time
    return F.date_format(local_time(ts, "UTC"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
