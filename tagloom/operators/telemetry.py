"""Health and telemetry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import first_registration
from .ordering import SLICE_BITS, carried, slice_of, with_previous, with_running_total
from .pipeline import ALIVE


def latest_reader_status(status: DataFrame, registry: DataFrame, *, unknown_provider: str = "Unknown") -> DataFrame:
    """Last state per reader; a registered reader without events is Disconnected."""
    last = status.groupBy("reader_id").agg(F.max_by(F.struct("new_state", "ts"), "seq").alias("_last"))
    known = first_registration(registry).select("reader_id", "provider_id")
    return last.join(known, "reader_id", "full_outer").select(
        "reader_id", F.coalesce("provider_id", F.lit(unknown_provider)).alias("provider_id"),
        F.coalesce(F.col("_last.new_state"), F.lit("Disconnected")).alias("state"),
        F.col("_last.ts").alias("last_seen"))


def health_summary(statuses: DataFrame, counters: DataFrame, pending: DataFrame, *, is_running: bool = True,
                   uptime_seconds: float | None = None) -> DataFrame:
    """One row: reader counts, read counts, queue depth and the list of reader states.

    ``counters`` is the one-row result of the chain counters; ``pending`` is the
    queue.  The list has one entry per reader.
    """
    depth = pending.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    reads = counters.select(F.struct("evaluated", "passed").alias("c")).scalar()
    return statuses.agg(
        F.count_if(F.col("state") == "Connected").alias("connected_readers"),
        F.count(F.lit(1)).alias("total_readers"),
        F.array_sort(F.collect_list(F.struct("reader_id", "provider_id", "state", "last_seen"))).alias("readers"),
    ).select(F.lit(is_running).alias("is_running"), F.lit(uptime_seconds).cast("double").alias("uptime_seconds"),
             "connected_readers", "total_readers", reads["evaluated"].alias("raw_reads"),
             reads["passed"].alias("filtered_reads"),
             depth.alias("queued_batches"), "readers")


def distinct_events(status: DataFrame, *, order: str = "seq", clock: str = "ts", slice_bits: int = SLICE_BITS) -> DataFrame:
    """Status events without those that only arrive again.

    An event is a repeat when the one directly before it of the same reader has the same instant and is alike in all
    else but ``order``.  Where the table or an event has no instant nothing tells a repeat from a new event, so
    it stays.
    """
    if clock not in status.columns:
        return status
    same = F.struct(*[c for c in status.columns if c != order])
    staged = with_previous(status, [F.struct("reader_id")], same, "_before", order=order, slice_bits=slice_bits)
    repeat = F.col(clock).isNotNull() & same.eqNullSafe(F.col("_before"))
    return staged.where(~repeat).select(*status.columns)


def backoff_ms(attempt: Column, jitter: Column | None = None, *, base_ms: float = 1000.0,
               max_ms: float = 60000.0) -> Column:
    """Delay before an attempt: doubled from the base, capped, moved by the jitter fraction, at least 500 ms.

    ``jitter`` is a fraction between -0.2 and 0.2; without it there is none.
    """
    delay = F.least(F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(10))), F.lit(float(max_ms)))
    moved = delay if jitter is None else delay + delay * jitter
    return F.greatest(F.lit(500.0), moved)


def reconnect_plan(status: DataFrame, *, jitter: Column | None = None, base_ms: float = 1000.0,
                   max_ms: float = 60000.0, order: str = "seq", clock: str = "ts",
                   slice_bits: int = SLICE_BITS) -> DataFrame:
    """Reconnecting events with their ``attempt`` since the reader was last connected and the ``delay_ms``.

    Attempts are counted inside slices of the event order; one summary row per
    (reader, slice) carries the count across slices.  An event that arrives
    again right after itself counts once.
    """
    trying = F.col("new_state") == "Reconnecting"
    status = distinct_events(status, order=order, clock=clock, slice_bits=slice_bits)
    staged = status.withColumn("_slice", slice_of(order, slice_bits))
    within = Window.partitionBy("reader_id", "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = staged.withColumn("_tries", F.count_if(trying).over(within)).withColumn(
        "_reset", F.max(F.when(F.col("new_state") == "Connected", F.col("_tries"))).over(within))
    summary = counted.groupBy("reader_id", F.col("_slice").alias("_ord_slice")).agg(
        F.max("_tries").alias("_total"), F.max("_reset").alias("_last_reset"))
    tries = carried(summary, ["reader_id"], "_total", "_tries_before", "sum", slice_bits=slice_bits).withColumn(
        "_tries_before", F.coalesce("_tries_before", F.lit(0)))
    resets = tries.withColumn("_reset_at", F.col("_tries_before") + F.col("_last_reset"))
    before = carried(resets, ["reader_id"], "_reset_at", "_reset_before", "last", slice_bits=slice_bits).select(
        "reader_id", F.col("_ord_slice").alias("_slice"), "_tries_before", F.coalesce("_reset_before", F.lit(0)).alias("_reset_before"))
    joined = counted.where(trying).join(before, ["reader_id", "_slice"])
    reset = F.coalesce(F.col("_tries_before") + F.col("_reset"), F.col("_reset_before"))
    return joined.withColumn("attempt", F.col("_tries_before") + F.col("_tries") - reset) \
        .withColumn("delay_ms", backoff_ms(F.col("attempt"), jitter, base_ms=base_ms, max_ms=max_ms)) \
        .drop("_slice", "_tries", "_reset", "_tries_before", "_reset_before")


def telemetry_feed(annotated: DataFrame) -> DataFrame:
    """Every read once as ``raw``, every passing read again as ``filtered``, from one pass over the chain."""
    kinds = F.when(F.expr(ALIVE), F.array(F.lit("raw"), F.lit("filtered"))).otherwise(F.array(F.lit("raw")))
    return annotated.withColumn("feed", F.explode(kinds))


def latest_reads(df: DataFrame, n: int = 50, *, order: str = "seq") -> DataFrame:
    """The newest ``n`` reads, newest first."""
    return df.orderBy(F.desc(order)).limit(n)


def rssi_quality_pct(rssi: Column) -> Column:
    """Signal quality between 0 and 100."""
    quality = (rssi.cast("double") + 100) * 1.25
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), quality))


def throughput_per_second(df: DataFrame) -> DataFrame:
    """Reads per second of the evaluation clock."""
    return df.groupBy(F.window("eval_ts", "1 second").alias("w")).agg(F.count(F.lit(1)).alias("reads")).select(
        F.col("w.start").alias("second"), "reads")


def antenna_distribution(df: DataFrame) -> DataFrame:
    """Reads and mean signal per reader and antenna."""
    return df.groupBy("reader_id", "antenna_port").agg(F.count(F.lit(1)).alias("reads"),
                                                       F.avg("rssi").alias("avg_rssi"))


def clock_skew(df: DataFrame, *, reader_ts: str = "first_seen", ingest_ts: str = "eval_ts",
               slice_bits: int = SLICE_BITS) -> DataFrame:
    """Per reader: how far its clock is ahead of the host, in microseconds.

    The median is exact, the lower of two: values are counted first, and it is
    the least one up to which half of the reader's reads lie.
    """
    skew = (F.unix_micros(reader_ts) - F.unix_micros(ingest_ts)).alias("skew_us")
    counts = df.select("reader_id", skew).where("skew_us IS NOT NULL").groupBy("reader_id", "skew_us").agg(
        F.count(F.lit(1)).alias("_n"))
    totals = df.select("reader_id", skew).groupBy("reader_id").agg(
        F.count(F.lit(1)).alias("reads"), F.min("skew_us").alias("min_skew_us"), F.max("skew_us").alias("max_skew_us"),
        F.count("skew_us").alias("_all"))
    running = with_running_total(counts, ["reader_id"], F.col("_n"), "_upto", order="skew_us", slice_bits=slice_bits)
    half = running.join(totals.select("reader_id", "_all"), "reader_id").where(F.col("_upto") * 2 >= F.col("_all"))
    medians = half.groupBy("reader_id").agg(F.min("skew_us").alias("median_skew_us"))
    return totals.join(medians, "reader_id", "left").select("reader_id", "reads", "min_skew_us", "max_skew_us", "median_skew_us")


def regex_test(df: DataFrame, pattern: str, epc: str = "epc") -> DataFrame:
    """Add ``is_match``: whether the pattern occurs in the EPC, ignoring case."""
    return df.withColumn("is_match", F.col(epc).rlike(f"(?iu){pattern}"))
