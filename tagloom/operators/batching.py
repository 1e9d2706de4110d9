"""Grouping the ordered reads of a gateway into dispatch batches.

The buffer is first in, first out.  Every function adds ``batch_id`` and the
1-based ``batch_pos`` of a read in its batch.  ``keys`` names the columns that
identify a gateway; without them all reads share one buffer.  Ticks fall at
``origin_us + k * period`` for k = 1, 2, ...; a read that arrives exactly at a
tick leaves with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DispatchConfig
from .ordering import SLICE_BITS, carried, slice_of, with_row_number, with_running_minimum, with_running_total

MIN_PERIOD_MS = 100


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def tick_of(ts: Column, period_ms: int, origin_us: int = 0) -> Column:
    """Number of the first tick at or after an instant, at least 1."""
    period_us = max(MIN_PERIOD_MS, period_ms) * 1000
    since = F.unix_micros(ts) - F.lit(origin_us)
    return F.greatest(F.lit(1).cast("bigint"), _div(since + (period_us - 1), period_us))


def _size(max_size: int) -> int:
    return max(1, max_size)


def batch_instant(df: DataFrame, *, order: str = "seq") -> DataFrame:
    """Every read is a batch of its own."""
    return df.withColumns({"batch_id": F.col(order).cast("string"), "batch_pos": F.lit(1).cast("bigint")})


def queue_positions(df: DataFrame, keys: Sequence[str], *, base: DataFrame | None = None, order: str = "seq",
                    slice_bits: int = SLICE_BITS) -> DataFrame:
    """Add ``_at``: the 1-based position of a read among those of its gateway and ``tick``.

    ``base`` (keys, ``tick``, ``before``) tells how many reads stand in front of
    the first one of a tick.
    """
    by = [*keys, "tick"]
    counts = df.groupBy(*by, slice_of(order, slice_bits).alias("_ord_slice")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = carried(counts, by, "_n", "_ord_before", "sum", slice_bits=slice_bits).withColumn(
        "_ord_before", F.coalesce("_ord_before", F.lit(0)))
    if base is not None:
        offsets = offsets.join(base, by, "left").withColumn(
            "_ord_before", F.col("_ord_before") + F.coalesce("before", F.lit(0)))
    return with_row_number(df, by, "_at", order=order, offsets=offsets, slice_bits=slice_bits)


def with_tick(df: DataFrame, mode: str, period_ms: int, origin_us: int = 0) -> DataFrame:
    """Add the ``tick`` whose queue a read joins; a pure count trigger has a single queue."""
    return df.withColumn("tick", F.lit(0).cast("bigint") if mode == "count"
                         else tick_of(F.col("eval_ts"), period_ms, origin_us))


def place(queued: DataFrame, mode: str, size: int) -> DataFrame:
    """Turn the queue position ``_at`` into ``batch_id`` and ``batch_pos``.

    A full batch leaves a count queue at every ``size`` reads.  In hybrid mode
    that holds within each tick.  In periodic mode every tick takes one batch, so
    a read leaves ``(_at - 1) div size`` ticks after its own.
    """
    part = _div(F.col("_at") - 1, size)
    batch_id = {"count": part.cast("string"),
                "hybrid": F.concat_ws("-", F.col("tick"), part),
                "periodic": (F.col("tick") + part).cast("string")}[mode]
    return queued.withColumns({"batch_id": batch_id, "batch_pos": (F.col("_at") - 1) % size + 1})


def batch_count(df: DataFrame, max_size: int, *, keys: Sequence[str] = (), order: str = "seq",
                slice_bits: int = SLICE_BITS) -> DataFrame:
    """A batch per ``max_size`` reads; the remainder leaves at the end."""
    queued = queue_positions(with_tick(df, "count", 0), keys, order=order, slice_bits=slice_bits)
    return place(queued, "count", _size(max_size)).drop("_at", "tick")


def batch_hybrid(df: DataFrame, max_size: int, period_ms: int, *, origin_us: int = 0, keys: Sequence[str] = (),
                 order: str = "seq", slice_bits: int = SLICE_BITS) -> DataFrame:
    """A batch at every ``max_size`` reads and at every tick.

    Fewer than ``max_size`` reads wait at a tick, so each tick empties the
    buffer and positions restart after it.
    """
    ticked = with_tick(df, "hybrid", period_ms, origin_us)
    queued = queue_positions(ticked, keys, order=order, slice_bits=slice_bits)
    return place(queued, "hybrid", _size(max_size)).drop("_at")


def tick_backlog(counts: DataFrame, max_size: int, *, keys: Sequence[str] = (),
                 slice_bits: int = SLICE_BITS) -> DataFrame:
    """Reads still waiting when each non-empty tick interval begins.

    ``counts`` has ``tick`` and ``arrived``.  With the level of a tick defined as
    the reads that arrived before it less the ticks before it times ``max_size``,
    the backlog is the level minus its running minimum, so ticks without
    arrivals need no rows.
    """
    earlier = with_running_total(counts, keys, F.col("arrived"), "_earlier", order="tick", inclusive=False,
                                 slice_bits=slice_bits)
    levels = earlier.withColumn("_level", F.col("_earlier") - (F.col("tick") - 1) * max_size)
    floors = with_running_minimum(levels, keys, "_level", "_floor", order="tick", slice_bits=slice_bits)
    return floors.select(*keys, "tick", (F.col("_level") - F.col("_floor")).alias("before"))


def batch_periodic(df: DataFrame, max_size: int, period_ms: int, *, origin_us: int = 0, keys: Sequence[str] = (),
                   order: str = "seq", slice_bits: int = SLICE_BITS) -> DataFrame:
    """One batch per tick of at most ``max_size`` reads; what does not fit waits for later ticks.

    A read with position p in the queue at its tick leaves ``(p - 1) div
    max_size`` ticks later, whatever arrives after it.
    """
    size = _size(max_size)
    ticked = with_tick(df, "periodic", period_ms, origin_us)
    arrivals = ticked.groupBy(*keys, "tick").agg(F.count(F.lit(1)).alias("arrived"))
    waiting = tick_backlog(arrivals, size, keys=keys, slice_bits=slice_bits)
    queued = queue_positions(ticked, keys, base=waiting, order=order, slice_bits=slice_bits)
    return place(queued, "periodic", size).drop("_at")


def batch(df: DataFrame, config: DispatchConfig, *, origin_us: int = 0, keys: Sequence[str] = (),
          order: str = "seq", slice_bits: int = SLICE_BITS) -> DataFrame:
    """Batches under the trigger of a dispatch configuration."""
    options = {"keys": keys, "order": order, "slice_bits": slice_bits}
    if config.mode == "count":
        return batch_count(df, config.max_batch_size, **options)
    if config.mode == "periodic":
        return batch_periodic(df, config.max_batch_size, config.period_ms, origin_us=origin_us, **options)
    if config.mode == "hybrid":
        return batch_hybrid(df, config.max_batch_size, config.period_ms, origin_us=origin_us, **options)
    return batch_instant(df, order=order)
