"""The whole flow as a job of three steps, each of which ends in a table.

A step reads what the step before it wrote, so a lost executor costs one step's
recomputation at most, and a step that failed is run again on its own.  The
outbox and the delivery log only grow: each run and each replay writes a folder
of its own, and ids go on from the largest that is stored.  ``compact`` sums up what they
hold, so that readers of the queue meet the newest summary and what came after it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batching import batch
from ..operators.outbox import outbox_pending, replay_send, replay_waves, spill_failed
from ..operators.payload import collect_batches, render
from ..operators.pipeline import default_pipeline, passed
from ..operators.requests import Sender, build_requests, dispatch_requests, requests_for
from ..schema import DispatchConfig, FilterConfig


@dataclass(frozen=True)
class Run:
    """The tables of one run, below a folder that all executors share.

    Runs with different ``name`` on one folder share the outbox and its log.
    """

    folder: str
    name: str = "1"

    @property
    def silver(self) -> str:
        return f"{self.folder}/silver/run={self.name}"

    @property
    def requests(self) -> str:
        return f"{self.folder}/requests/run={self.name}"

    @property
    def results(self) -> str:
        return f"{self.folder}/results/run={self.name}"

    @property
    def outbox(self) -> str:
        return f"{self.folder}/outbox"

    @property
    def delivery_log(self) -> str:
        return f"{self.folder}/delivery_log"

    @property
    def summaries(self) -> str:
        return f"{self.folder}/summaries"


def clean(reads: DataFrame, config: FilterConfig, run: Run, **options) -> DataFrame:
    """Write every read with its verdict, in one folder per drop stage so that later steps skip dropped reads."""
    default_pipeline(reads, config, **options).write.mode("overwrite").partitionBy("drop_stage").parquet(run.silver)
    return reads.sparkSession.read.parquet(run.silver)


def prepare(spark: SparkSession, registry: DataFrame, config: DispatchConfig, run: Run, *, origin_us: int = 0,
            default_brand: str = "RFID Reader", keys: Sequence[str] = ()) -> DataFrame:
    """Batch the surviving reads, one queue per gateway of ``keys``, and write one rendered request per batch."""
    survivors = passed(spark.read.parquet(run.silver))
    batched = batch(survivors, config, origin_us=origin_us, keys=keys)
    batches = collect_batches(batched, registry, default_brand=default_brand, keys=keys)
    build_requests(render(batches, config), config).drop("tags").write.mode("overwrite").parquet(run.requests)
    return spark.read.parquet(run.requests)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that may not have been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def deliver(spark: SparkSession, send: Sender, run: Run, *, partitions: int | None = None) -> DataFrame:
    """Send every request once, write the results, and append what was not delivered to the outbox.

    The first id is one more than the largest of other runs, so repeating the
    step for the same run replaces its own rows alone.
    """
    if run.name in _summary(spark, run).runs:
        raise ValueError(f"run {run.name} is summed up already and can't be delivered again")
    requests = spark.read.parquet(run.requests)
    dispatch_requests(requests, send, partitions=partitions).write.mode("overwrite").parquet(run.results)
    stored, summary = _stored(spark, run.outbox), _summary(spark, run)
    last = None
    if stored is not None:
        others = (F.col("run").cast("string") != run.name) & ~F.col("run").cast("string").isin(list(summary.runs))
        last = stored.where(others).agg(F.max("id")).first()[0]
    last = max(last or 0, summary.last_id)
    spilled = spill_failed(requests, spark.read.parquet(run.results), first_id=last + 1)
    spilled.write.mode("overwrite").parquet(f"{run.outbox}/run={run.name}")
    return spark.read.parquet(f"{run.outbox}/run={run.name}")


@dataclass(frozen=True)
class Summary:
    """What the newest whole summary of the queue tells; the one before the first is empty."""

    number: int = 0
    runs: tuple[str, ...] = ()  # whose outbox rows it covers
    attempt: int = 0  # the last replay that it covers
    last_id: int = 0  # the largest id given so far
    lowest_id: int | None = None  # of what is pending
    pending: int = 0


_HEAD = "runs array<string>, attempt long, last_id long, lowest_id long, pending long"


def _summary(spark: SparkSession, run: Run) -> Summary:
    """A summary counts from the moment its head is there, a single row that is written last."""
    heads = _stored(spark, f"{run.summaries}/heads")
    newest = None if heads is None else heads.orderBy(F.desc("number")).first()
    if newest is None:
        return Summary()
    return Summary(newest.number, tuple(newest.runs), newest.attempt, newest.last_id, newest.lowest_id, newest.pending)


def pending(spark: SparkSession, run: Run) -> DataFrame:
    """What the outbox of all runs still holds after all replays: the newest summary and what came after it."""
    summary = _summary(spark, run)
    outbox, log = spark.read.parquet(run.outbox), _stored(spark, run.delivery_log)
    outbox = outbox.withColumn("run", F.col("run").cast("string"))
    if summary.number:
        outbox = outbox.where(~F.col("run").isin(*summary.runs)) \
            .unionByName(spark.read.schema(outbox.schema).parquet(f"{run.summaries}/rows/number={summary.number}"))
    if log is None:
        return outbox
    later = outbox_pending(outbox.withColumnRenamed("retry_count", "_before"),
                           log.where(F.col("attempt") > summary.attempt).select("id", "is_success"))
    return later.withColumn("retry_count", F.col("_before") + F.col("retry_count")).select(*outbox.columns)


def compact(spark: SparkSession, run: Run) -> Summary:
    """Sum up the queue: its pending rows by id, what they cover, the largest id given and the lowest that is pending.

    The rows are written below a new number and the head after them, so a crash in between leaves the summary before
    in force, and the next call takes the same number again.  Nothing is deleted: folders of covered runs and replays
    and older summaries may go once no reader uses them.  Not to be called while a delivery or a replay is under way.
    """
    before, number = _summary(spark, run), _summary(spark, run).number + 1
    outbox, log = spark.read.parquet(run.outbox), _stored(spark, run.delivery_log)
    name = F.col("run").cast("string")
    new = outbox.where(~name.isin(*before.runs)) if before.runs else outbox
    names = [r[0] for r in new.select(name).distinct().collect()]  # a row per run
    last = max(before.last_id, new.agg(F.max("id")).first()[0] or 0)
    attempt = before.attempt if log is None else max(before.attempt, log.agg(F.max("attempt")).first()[0] or 0)
    rows = f"{run.summaries}/rows/number={number}"
    pending(spark, run).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(rows)
    lowest, held = spark.read.parquet(rows).agg(F.min("id"), F.count(F.lit(1))).first()
    head = Summary(number, (*before.runs, *names), attempt, last, lowest, held)
    spark.createDataFrame([(list(head.runs), attempt, last, lowest, held)], _HEAD).coalesce(1) \
        .write.mode("overwrite").parquet(f"{run.summaries}/heads/number={number}")
    return head


def replay(spark: SparkSession, send: Sender, run: Run, attempt: int, *, in_waves: bool = False, **options) -> DataFrame:
    """Send what is pending, oldest first per target up to its first failure; ``attempt`` numbers the replays on the folder.

    What is pending is written first, so an attempt that is repeated sends the same rows.  ``in_waves`` sends those of a
    target side by side (``replay_waves``).
    """
    if attempt <= _summary(spark, run).attempt:
        raise ValueError(f"replay {attempt} is summed up already")
    todo = f"{run.folder}/replays/attempt={attempt}"
    if _stored(spark, todo) is None:
        pending(spark, run).write.parquet(todo)
    waiting = spark.read.parquet(todo)
    again = requests_for(waiting.withColumnRenamed("created_at", "rendered_at"))
    sent = replay_waves(again, send, f"{run.folder}/waves/attempt={attempt}", **options) if in_waves \
        else replay_send(again, send, **options)
    sent.write.mode("overwrite").parquet(f"{run.delivery_log}/attempt={attempt}")
    return pending(spark, run)
