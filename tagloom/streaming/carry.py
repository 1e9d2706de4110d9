"""Running the filter chain on micro-batches, with a small table carried from one to the next.

Every micro-batch is judged by the batch operators, so hot keys are split by
slices here as well.  What the next micro-batch must know is written to one of
two slots under the state folder, chosen by the parity of the batch id: a
micro-batch that is run again after a failure finds the slot of its predecessor
untouched and overwrites its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import shift_id
from ..operators.dedup import dedup_key, window_micros
from ..operators.ordering import SLICE_BITS
from ..operators.pipeline import ALIVE, Rule, filter_pipeline, start
from ..schema import DailyRule, SlidingRule

Sink = Callable[[DataFrame, int], None]


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's checkpoint folder; a local one where none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tagloom-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def parquet_sink(path: str) -> Sink:
    """Each micro-batch in its own folder, replaced when the micro-batch runs again."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/micro_batch={batch_id}")
    return write


class _Slots:
    """The state of one stage, by micro-batch.  A missing or foreign slot of an earlier micro-batch is an error, never no state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, batch_id: int) -> DataFrame | None:
        if batch_id <= 0:
            return None
        state = self.spark.read.parquet(f"{self.path}/slot={(batch_id - 1) % 2}")
        if state.where(F.col("_batch") == batch_id - 1).isEmpty() and not state.isEmpty():
            raise ValueError(f"{self.path} does not hold the state of micro-batch {batch_id - 1}")
        return state.drop("_batch")

    def write(self, state: DataFrame, batch_id: int) -> None:
        state.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{self.path}/slot={batch_id % 2}")


def _last_reads(df: DataFrame, rule: SlidingRule, late: float | None) -> DataFrame:
    """Last read per sliding key; with ``late`` keys idle for longer than it and the window are left out."""
    names = {"antenna": ("epc", "reader_id", "antenna_port"), "reader": ("epc", "reader_id"), "global": ("epc",)}
    keys = [k.alias(n) for k, n in zip(dedup_key(rule.scope), names[rule.scope])]
    last = df.groupBy(*keys).agg(F.max("seq").alias("seq"), F.max_by("eval_ts", "seq").alias("eval_ts"))
    if late is None:
        return last
    newest = df.agg(F.max(F.unix_micros("eval_ts")).alias("us")).select("us").scalar()
    return last.where(F.unix_micros("eval_ts") > newest - window_micros(rule.window_seconds + late))


def _shift_keys(df: DataFrame, rule: DailyRule, keep_shifts: int | None) -> DataFrame:
    """One read per key and shift, of the latest shifts if so many are named."""
    names = {"antenna": ("epc", "reader_id", "antenna_port"), "reader": ("epc", "reader_id"), "global": ("epc",)}
    keys = [k.alias(n) for k, n in zip(dedup_key(rule.scope), names[rule.scope])]
    shift = shift_id(F.col("eval_ts"), rule.tz, rule.shift_start)
    seen = df.withColumn("_shift", shift).groupBy(*keys, "_shift").agg(
        F.min("seq").alias("seq"), F.min_by("eval_ts", "seq").alias("eval_ts"))
    if keep_shifts is None:
        return seen.drop("_shift")
    newest = df.agg(F.max("eval_ts").alias("ts")).select("ts").scalar()
    oldest = shift_id(newest - F.make_dt_interval(F.lit(keep_shifts - 1)), rule.tz, rule.shift_start)
    return seen.where(F.col("_shift") >= oldest).drop("_shift")


def chain_stream(rules: Sequence[Rule], state_path: str, sink: Sink, *, keep_shifts: int | None = None,
                 late_seconds: float | None = None, slice_bits: int = SLICE_BITS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that runs the filter chain and hands the annotated reads to ``sink``.

    Before a dedup stage the carried reads join the micro-batch, and leave it
    again afterwards.  The verdicts are those of the batch chain, however late a
    read comes, since every key is kept.  Where the clock of the reads is known to
    lag by ``late_seconds`` at most, keys older than that and the window are
    forgotten, and with ``keep_shifts`` keys of older shifts; reads that come later
    than promised then count as new.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        annotated = start(batch)
        held = []
        for i, rule in enumerate(rules):
            if not isinstance(rule, (SlidingRule, DailyRule)):
                annotated = filter_pipeline(annotated, [rule], slice_bits=slice_bits)
                continue
            slots = _Slots(spark, f"{state_path}/stage={i}")
            carried = slots.read(batch_id)
            joined = annotated.withColumn("_carried", F.lit(False))
            if carried is not None:
                joined = joined.unionByName(carried.withColumn("_carried", F.lit(True)), allowMissingColumns=True)
            joined = joined.persist()
            held.append(joined)
            alive = joined.where(ALIVE)
            state = _last_reads(alive, rule, late_seconds) if isinstance(rule, SlidingRule) else _shift_keys(alive, rule, keep_shifts)
            slots.write(state, batch_id)
            annotated = filter_pipeline(joined, [rule], slice_bits=slice_bits).where("NOT _carried").drop("_carried")
        sink(annotated, batch_id)
        for joined in held:
            joined.unpersist()
    return run


def run_available(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str):
    """Process what the source holds now and stop; returns the finished query."""
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    query.awaitTermination()
    return query
