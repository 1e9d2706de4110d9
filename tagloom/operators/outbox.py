"""The queue of undelivered batches as append-only tables.

``outbox`` has one row per queued request; ``delivery_log`` has one row per
attempt, with ``id`` and ``is_success``.  Nothing is updated in place: what is
pending is the outbox without the ids that were delivered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookup import lookup
from .ordering import SLICE_BITS, with_row_number
from .requests import Sender, _attempt


def outbox_pending(outbox: DataFrame, delivery_log: DataFrame) -> DataFrame:
    """Queued rows that were never delivered, with the failed attempts as ``retry_count``."""
    attempts = delivery_log.groupBy("id").agg(F.max("is_success").alias("_done"),
                                              F.count_if(~F.col("is_success")).cast("int").alias("_failed"))
    joined = outbox.join(attempts, "id", "left")
    return joined.where(~F.coalesce("_done", F.lit(False))) \
        .withColumn("retry_count", F.coalesce("_failed", F.lit(0))).drop("_done", "_failed")


def peek(pending: DataFrame, n: int) -> DataFrame:
    """The ``n`` oldest rows."""
    return pending.orderBy("id").limit(n)


def acknowledge(outbox: DataFrame, delivered_ids: DataFrame) -> DataFrame:
    """The queue without the rows whose ``id`` was delivered."""
    return outbox.join(delivered_ids.select("id"), "id", "left_anti")


def spill_failed(requests: DataFrame, results: DataFrame, *, order: str = "first_seq", first_id: int = 1,
                 created_at: Column | None = None, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Outbox rows of the requests without a successful result, numbered in ``order`` from ``first_id``."""
    delivered = results.where("is_success").select("transaction_id").distinct()
    failed = requests.join(delivered, "transaction_id", "left_anti")
    numbered = with_row_number(failed, [], "_at", order=order, slice_bits=slice_bits)
    return numbered.select(
        (F.col("_at") + (first_id - 1)).alias("id"), "transaction_id", "target_url", "http_method", "payload",
        "headers", F.col("tag_count").cast("int").alias("tag_count"),
        (created_at if created_at is not None else F.col("rendered_at")).alias("created_at"),
        F.lit(0).alias("retry_count"))


def replay_drain(pending: DataFrame, outcomes: DataFrame, *, order_scope: str = "global") -> DataFrame:
    """Add ``replay_state`` to the queue given the outcome each row would have.

    A drain goes through the rows by ``id`` and stops at the first failure:
    rows before it are ``delivered``, the row itself is ``failed``, later rows
    are ``waiting``.  A row without an outcome counts as a failure.  With
    ``order_scope='target'`` each target URL has its own drain.
    """
    known = outcomes.groupBy("id").agg(F.max("is_success").alias("_ok"))
    tried = pending.join(known, "id", "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    failures = tried.where(~F.col("_ok"))
    if order_scope == "global":
        stop = failures.agg(F.min("id").alias("stop")).select("stop").scalar()
        stopped = tried.withColumn("_stop", stop)
    elif order_scope == "target":
        stops = failures.groupBy("target_url").agg(F.min("id").alias("_stop"))
        stopped = lookup(tried, stops, "target_url", spread="id")
    else:
        raise ValueError("order_scope must be 'global' or 'target'")
    state = F.when(F.col("_stop").isNull() | (F.col("id") < F.col("_stop")), "delivered") \
        .when(F.col("id") == F.col("_stop"), "failed").otherwise("waiting")
    return stopped.withColumn("replay_state", state).drop("_ok", "_stop")


def replay_schedule(pending: DataFrame, rate: int, *, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Add ``send_slot``: the second in which a replay of ``rate`` rows per second sends the row."""
    if rate <= 0:
        raise ValueError("rate must be greater than zero")
    numbered = with_row_number(pending, [], "_at", order="id", slice_bits=slice_bits)
    return numbered.withColumn("send_slot", F.call_function("div", F.col("_at") - 1, F.lit(rate))).drop("_at")


ATTEMPT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("is_success", T.BooleanType()),
    T.StructField("http_status", T.IntegerType()), T.StructField("error_message", T.StringType()),
    T.StructField("elapsed_ms", T.DoubleType()),
])


def replay_send(requests: DataFrame, send: Sender) -> DataFrame:
    """Send queued requests per target, oldest first, each target up to its first failure; one row per attempt.

    The order within a target is a contract, so a target is one sorted partition
    range that its task streams through in Arrow batches without holding it.
    """
    names = ["id", "transaction_id", "target_url", "http_method", "url", "request_headers", "content_type", "body"]
    ordered = requests.select(*names).repartition("target_url").sortWithinPartitions("target_url", "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = None
        for frame in frames:
            rows = []
            for request in frame.to_dict("records"):
                if request["target_url"] == stopped:
                    continue
                _, target, success, status, _, error, elapsed = _attempt(send, request)
                rows.append((request["id"], success, status, error, elapsed))
                stopped = stopped if success else target
            yield pd.DataFrame(rows, columns=ATTEMPT_SCHEMA.names)

    return ordered.mapInPandas(run, ATTEMPT_SCHEMA)


def replay_waves(requests: DataFrame, send: Sender, folder: str, *, growth: int = 8, largest: int = 1 << 17,
                 partitions: int | None = None, slice_bits: int = SLICE_BITS) -> DataFrame:
    """As ``replay_send``, with all cores on each target: its rows go in waves of 1, ``growth``, ... at most ``largest`` rows.

    The rows of a wave are sent side by side, and a target with a failure has no further wave.  What counts is each target's
    rows up to its first failure; what the last wave sent beyond it stays pending, is sent again by a later replay with
    the same transaction id, and is recognized by the receiver.  A dead target costs one attempt.  ``folder`` takes the numbered rows
    and a table per wave, so a lost executor repeats a part of one wave; a repeated call replaces them.
    """
    if growth < 2 or largest < 1:
        raise ValueError("growth must be at least 2 and largest at least 1")
    spark = requests.sparkSession
    names = ["id", "transaction_id", "target_url", "http_method", "url", "request_headers", "content_type", "body"]
    ends, size = [1], 1
    while size < largest:
        size = min(size * growth, largest)
        ends.append(ends[-1] + size)
    at = F.col("_at")
    beyond = F.greatest(F.lit(0), F.call_function("div", at - (ends[-1] + 1), F.lit(largest)) + 1)
    wave = sum(((at > end).cast("long") for end in ends[:-1]), F.when(at > ends[-1], beyond).otherwise(0))
    numbered = with_row_number(requests.select(*names), ["target_url"], "_at", order="id", slice_bits=slice_bits)
    numbered.withColumn("wave", wave).drop("_at").write.mode("overwrite").partitionBy("wave").parquet(f"{folder}/rows")
    rows = spark.read.schema(T.StructType([*requests.select(*names).schema, T.StructField("wave", T.LongType())])) \
        .parquet(f"{folder}/rows")
    last = rows.agg(F.max("wave")).first()[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sent = []
            for request in frame.to_dict("records"):
                _, target, success, status, _, error, elapsed = _attempt(send, request)
                sent.append((request["id"], success, status, error, elapsed, target))
            yield pd.DataFrame(sent, columns=schema.names)

    schema = T.StructType([*ATTEMPT_SCHEMA, T.StructField("target_url", T.StringType())])
    spread = partitions or spark.sparkContext.defaultParallelism
    done: list[str] = []
    for number in range(-1 if last is None else last + 1):
        due = rows.where(F.col("wave") == number)
        if done:
            failed = spark.read.schema(schema).parquet(*done).where("NOT is_success").select("target_url").distinct()
            due = due.join(failed, due.target_url.eqNullSafe(failed.target_url), "left_anti")
        path = f"{folder}/attempts/wave={number}"
        due.select(*names).repartition(spread, "id").mapInPandas(run, schema).write.mode("overwrite").parquet(path)
        done.append(path)
        if spark.read.schema(schema).parquet(path).isEmpty():
            break
    if not done:
        return spark.createDataFrame([], ATTEMPT_SCHEMA)
    attempts = spark.read.schema(schema).parquet(*done)
    stops = attempts.where("NOT is_success").groupBy(F.col("target_url").alias("_target")).agg(F.min("id").alias("_stop"))
    counted = attempts.join(stops, F.col("target_url").eqNullSafe(F.col("_target")), "left")
    return counted.where(F.col("_stop").isNull() | (F.col("id") <= F.col("_stop"))).select(*ATTEMPT_SCHEMA.names)


def idempotent_upsert(received: DataFrame, incoming: DataFrame, key: str = "transaction_id",
                      order: str = "id") -> DataFrame:
    """Incoming rows to append at the receiver: the first of each key that was not received before."""
    fields = [c for c in incoming.columns if c != key]
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*fields), order).alias("_row"))
    return first.join(received.select(key), key, "left_anti").select(key, "_row.*")


def first_deliveries(received: DataFrame, keep: str, *, key: str = "transaction_id",
                     received_at: str = "received_at") -> DataFrame:
    """The receiver's form for streams: the first delivery of each key, with retries within ``keep`` left out."""
    return received.withWatermark(received_at, keep).dropDuplicatesWithinWatermark([key])
