"""Stateful deduplication over batch DataFrames."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import shift_id
from ..schema import DailyRule, SlidingRule
from .ordering import SLICE_BITS, with_first_flag, with_previous, with_running_total


def dedup_key(scope: str) -> list[Column]:
    """Case-insensitive key columns of a dedup scope, with a stand-in for a missing part."""
    epc, reader = (F.coalesce(F.upper(c), F.lit("\0")) for c in ("epc", "reader_id"))
    return {"antenna": [epc, reader, F.coalesce("antenna_port", F.lit(-2**31))],
            "reader": [epc, reader],
            "global": [epc]}[scope]


def window_micros(seconds: float) -> int:
    return int(Decimal(str(seconds)) * 1_000_000)


def sliding_verdict(df: DataFrame, rule: SlidingRule, out: str = "gap_us", *, active: Column | None = None,
                    order: str = "seq", rescan: bool = True, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Add ``out``: microseconds since the previous read of the key when that read suppresses this one, else NULL.

    A suppressed read extends the window, so only the gap to the read directly
    before it matters.  A negative gap passes, and so does a gap equal to the
    window.
    """
    marked = with_previous(df, dedup_key(rule.scope), F.unix_micros("eval_ts"), "_before_us",
                           order=order, active=active, rescan=rescan, slice_bits=slice_bits)
    gap = F.unix_micros("eval_ts") - F.col("_before_us")
    return marked.withColumn(out, F.when((gap >= 0) & (gap < window_micros(rule.window_seconds)), gap)) \
        .drop("_before_us")


def sliding_dedup(df: DataFrame, rule: SlidingRule | None = None, *, order: str = "seq", rescan: bool = True,
                  slice_bits: int = SLICE_BITS) -> DataFrame:
    """Reads that survive the refreshing window."""
    marked = sliding_verdict(df, rule or SlidingRule(), "_gap", order=order, rescan=rescan, slice_bits=slice_bits)
    return marked.where(F.col("_gap").isNull()).drop("_gap")


def with_shift(df: DataFrame, rule: DailyRule, *, order: str = "seq", active: Column | None = None,
               rescan: bool = True, slice_bits: int = SLICE_BITS) -> tuple[DataFrame, list[str]]:
    """Add ``shift_id`` and the columns that separate one registry from the next."""
    shifted = df.withColumn("shift_id", shift_id(F.col("eval_ts"), rule.tz, rule.shift_start))
    if rule.rollover == "shift":
        return shifted, ["shift_id"]
    shifted = shifted.withColumn("_alive", F.lit(True) if active is None else active)
    marked = with_previous(shifted, [], F.col("shift_id"), "_shift_before", order=order, active=F.col("_alive"),
                           rescan=rescan, slice_bits=slice_bits)
    changed = F.col("_alive") & F.col("_shift_before").isNotNull() & (F.col("shift_id") != F.col("_shift_before"))
    runs = with_running_total(marked, [], changed.cast("bigint"), "_shift_run", order=order, slice_bits=slice_bits)
    return runs.drop("_shift_before", "_alive"), ["_shift_run"]


def daily_verdict(df: DataFrame, rule: DailyRule, out: str, *, active: Column | None = None, order: str = "seq",
                  rescan: bool = True, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Add ``shift_id`` and ``out``: whether the read is the first of its key in its shift."""
    shifted, registry = with_shift(df, rule, order=order, active=active, rescan=rescan, slice_bits=slice_bits)
    keys = [F.col(c) for c in registry] + dedup_key(rule.scope)
    return with_first_flag(shifted, keys, out, order=order, active=active, rescan=rescan and rule.rollover == "shift",
                           slice_bits=slice_bits).drop("_shift_run")


def daily_unique(df: DataFrame, rule: DailyRule | None = None, *, order: str = "seq", rescan: bool = True,
                 slice_bits: int = SLICE_BITS) -> DataFrame:
    """First read of each key per shift, with its ``shift_id``."""
    return daily_verdict(df, rule or DailyRule(), "_first", order=order, rescan=rescan, slice_bits=slice_bits) \
        .where("_first").drop("_first")


def shift_rollovers(df: DataFrame, rule: DailyRule, *, order: str = "seq", slice_bits: int = SLICE_BITS) -> DataFrame:
    """Every change of shift in arrival order: the read that triggered it, the old and the new id.

    Changes are found inside each slice; of the rest only the border rows of the
    slices meet in one window.
    """
    shifted = df.select(order, shift_id(F.col("eval_ts"), rule.tz, rule.shift_start).alias("shift_id"))
    marked = with_previous(shifted, [], F.col("shift_id"), "previous_shift_id", order=order, slice_bits=slice_bits)
    return marked.where(F.col("previous_shift_id").isNotNull() & (F.col("shift_id") != F.col("previous_shift_id")))


def active_key_counts(df: DataFrame, rule: DailyRule) -> DataFrame:
    """Registry size of every shift: its distinct dedup keys."""
    keyed = df.select(shift_id(F.col("eval_ts"), rule.tz, rule.shift_start).alias("shift_id"),
                      F.struct(*[k.alias(f"k{i}") for i, k in enumerate(dedup_key(rule.scope))]).alias("key"))
    return keyed.distinct().groupBy("shift_id").agg(F.count(F.lit(1)).alias("active_keys"))


def live_sliding_keys(df: DataFrame, rule: SlidingRule, as_of: datetime | Column) -> DataFrame:
    """One row: how many keys the refreshing window still holds at ``as_of``."""
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    keys = [k.alias(f"k{i}") for i, k in enumerate(dedup_key(rule.scope))]
    last = df.where(F.col("eval_ts") <= as_of).groupBy(*keys).agg(F.max_by("eval_ts", "seq").alias("last_ts"))
    age = F.unix_micros(as_of) - F.unix_micros("last_ts")
    return last.agg(F.count_if(age < window_micros(rule.window_seconds)).alias("active_keys"))

