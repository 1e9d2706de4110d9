"""Dispatch batches of a live stream, on keyed state with timers.

A gateway's waiting reads are list state, its queue a value.  Reads leave when their batch is full, when a later tick is
seen, or when the gateway's timer goes off, which needs no new input.

The task of a gateway handles runs, packed tables of reads, rather than rows: they are packed before the state and taken
apart behind it by all tasks.  It sorts them outside of its memory.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.batching import MIN_PERIOD_MS, batch_instant, place, with_tick
from ..schema import DispatchConfig
from .dedup import BODY, STATE_STORE
from .sorting import PIECE_BYTES, READ, SortedReads, parts

_PACKED = "gateway_key string, reads binary, size long"
_ARROW_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
_RUNS = "gateway_key string, tick long, first_at long, bodies string"
RUN = 1024  # reads of a tick that leave a task as one row; JSON texts have no line breaks, so these part them
LAST_NO = 2**63 - 1  # the place of reads without a number
ARROW_BYTES = 8 << 20  # of a record batch; the task of a gateway holds one several times over
LONG_BYTES = 64 << 10  # from which a binary is compressed; its size is then told, else it is 0
_HELD = pa.schema([("tick", pa.int64()), ("at", pa.int64()), ("body", pa.string())])


def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The reads of a gateway in a record batch as one binary: how many, ticks, numbers, lengths of texts, texts."""
    for part in (b for b in batches if b.num_rows):
        keys = part.column(0).dictionary_encode()
        codes = keys.indices.to_numpy()
        by_key = np.argsort(codes, kind="stable")
        tick, read_no = (part.column(i).to_numpy()[by_key] for i in (1, 2))
        _, offsets, texts = part.column(3).cast(pa.string()).take(pa.array(by_key)).buffers()
        offsets, texts = np.frombuffer(offsets, "<i4", len(by_key) + 1), memoryview(texts)
        lengths, ends = np.diff(offsets), np.cumsum(np.bincount(codes)).tolist()
        runs, sizes = [], []
        for low, high in zip([0, *ends], ends):
            columns = (c[low:high].tobytes() for c in (tick, read_no, lengths))
            run = b"".join(((high - low).to_bytes(8, "little"), *columns, texts[offsets[low]:offsets[high]]))
            long = len(run) >= LONG_BYTES
            runs.append(pa.compress(run, codec="zstd", asbytes=True) if long else run)
            sizes.append(len(run) if long else 0)
        yield pa.RecordBatch.from_arrays([keys.dictionary.cast(pa.string()), pa.array(runs, pa.binary()), pa.array(sizes, pa.int64())],
                                         ["gateway_key", "reads", "size"])


def _unpacked(runs: list[bytes]) -> pa.Table:
    """The reads of some binaries, with the columns of ``READ``."""
    counts = [int.from_bytes(run[:8], "little") for run in runs]
    tick, read_no, lengths = (np.concatenate([np.frombuffer(run, kind, n, 8 + at * n) for run, n in zip(runs, counts)])
                              for kind, at in (("<i8", 0), ("<i8", 8), ("<i4", 16)))
    offsets = np.append(np.int32(0), np.cumsum(lengths, dtype=np.int32))
    texts = b"".join(memoryview(run)[8 + 20 * n:] for run, n in zip(runs, counts))
    bodies = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(texts))
    return pa.Table.from_arrays([pa.array(tick), pa.array(read_no), bodies], schema=READ)


class BatchProcessor(StatefulProcessor):
    """The queue of one gateway.

    A read joins the tick of its own clock, or the open one if that is closed.  The open tick is the latest one seen; a timer
    closes it too.  Reads come as text, so that their columns come out as they went in.
    """

    def __init__(self, mode: str, size: int, wait_ms: int):
        self.mode, self.size, self.wait_ms = mode, size, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([
            T.StructField("tick", T.LongType()), T.StructField("at", T.LongType()), T.StructField("body", T.StringType())]))
        self.queue = handle.getValueState("queue", T.StructType([
            T.StructField("tick", T.LongType()), T.StructField("taken", T.LongType()), T.StructField("timer", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # nothing was taken yet where there is no state
        tick, taken, timer = (self.queue.get() if self.queue.exists() else None) or (None, 0, 0)
        held, queued = self._held(), SortedReads()
        for frame in rows:
            for reads in self._reads(frame):
                if tick is not None:
                    reads = reads.set_column(0, "tick", pc.max_element_wise(reads["tick"], pa.scalar(tick, pa.int64())))
                queued.add(reads)
        for reads in queued.sorted():  # in order of arrival within a tick
            left, held, tick, taken = self._taken(reads, held, tick, taken)
            yield from (self._rows(key, part) for part in parts(left))
        timer = self._wait(held, timer, timerValues.getCurrentProcessingTimeInMs())
        self._keep(tick, taken, timer, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tick, taken, _ = self.queue.get()
        held = self._held()
        if self.mode == "periodic":
            left, held = self._leaving(held, [tick], [min(len(held), self.size)])
        else:
            left, held = held, held.slice(len(held))
        timer = self._wait(held, 0, timerValues.getCurrentProcessingTimeInMs())
        self._keep(tick + 1, 0, timer, held)
        yield self._rows(key, left)

    def close(self) -> None:
        pass

    def _reads(self, frame: pd.DataFrame) -> Iterator[pa.Table]:
        """Tables of ``READ`` of a frame of the input: gateway, number, tick, text."""
        yield pa.Table.from_arrays([pa.array(frame.iloc[:, i], t) for i, t in zip((2, 1, 3), READ.types)], schema=READ)

    def _rows(self, key, left: pa.Table) -> pd.DataFrame:
        """A row of output for each read that leaves."""
        tick, at = (left[c].to_numpy() for c in ("tick", "at"))
        part = (at - 1) // self.size
        names = {"count": lambda: part.astype(str), "periodic": lambda: (tick + part).astype(str),
                 "hybrid": lambda: [f"{t}-{p}" for t, p in zip(tick.tolist(), part.tolist())]}[self.mode]()
        return pd.DataFrame({"gateway_key": key[0], "body": left["body"].to_pylist(), "batch_id": names,
                             "batch_pos": (at - 1) % self.size + 1})

    def _taken(self, reads: pa.Table, held: pa.Table, tick: int | None, taken: int) -> tuple[pa.Table, pa.Table, int, int]:
        """Take reads of the open tick and later ones in; what leaves, what waits, the open tick and its number of reads.

        The reads that leave have the tick and place that name their batch.
        """
        ticks = reads["tick"].to_numpy()
        starts = np.flatnonzero(np.diff(ticks, prepend=ticks[0] - 1))
        counts = np.diff(starts, append=len(ticks))
        tick = int(ticks[0]) if tick is None else tick
        if self.mode == "count":
            at = np.arange(taken + 1, taken + len(ticks) + 1)
        else:
            first = np.zeros(len(starts), np.int64)
            first[0] = taken if ticks[0] == tick else 0
            at = np.arange(1, len(ticks) + 1) - np.repeat(starts - first, counts)
        new = pa.Table.from_arrays([reads["tick"], pa.array(at), reads["body"]], schema=_HELD)
        now, queue = int(ticks[-1]), pa.concat_tables([held, new])
        if self.mode == "periodic":
            closed, leave, waits = [], [], len(held)
            for later, count in zip(ticks[starts].tolist(), counts.tolist()):
                if later > tick and waits:
                    closed.append(tick)
                    leave.append(min(waits, (later - tick) * self.size))
                    waits -= leave[-1]
                tick, waits = later, waits + count
            return *self._leaving(queue, closed, leave), now, int(at[-1])
        full = len(queue) - int(at[-1]) % self.size
        return queue.slice(0, full), queue.slice(full), now, int(at[-1])

    @staticmethod
    def _leaving(queue: pa.Table, closed: list[int], leave: list[int]) -> tuple[pa.Table, pa.Table]:
        """The first reads of a queue, so many as of each tick that closes, and the rest."""
        leave = np.array(leave, np.int64)
        ends = np.cumsum(leave)
        total = int(ends[-1]) if len(ends) else 0
        ticks = np.repeat(np.array(closed, np.int64), leave)
        at = np.arange(1, total + 1) - np.repeat(ends - leave, leave)
        bodies = queue["body"].slice(0, total)
        return pa.Table.from_arrays([pa.array(ticks), pa.array(at), bodies], schema=_HELD), queue.slice(total)

    def _wait(self, held: pa.Table, timer: int, now: int) -> int:
        """One timer per queue that waits; 0 is none."""
        if timer and (not len(held) or self.mode == "count"):
            self.handle.deleteTimer(timer)
            return 0
        if len(held) and not timer and self.mode != "count":
            self.handle.registerTimer(now + self.wait_ms)
            return now + self.wait_ms
        return timer

    def _held(self) -> pa.Table:
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_HELD.types)], schema=_HELD)

    def _keep(self, tick: int, taken: int, timer: int, held: pa.Table) -> None:
        self.queue.update((tick, taken, timer))
        self.waiting.clear()
        if len(held):
            self.waiting.put(list(zip(*(c.to_pylist() for c in held.columns))))


class RunProcessor(BatchProcessor):
    """The same over packed reads.  What leaves are the texts of reads that follow each other in a tick, ``RUN`` at most."""

    def _reads(self, frame: pd.DataFrame) -> Iterator[pa.Table]:
        runs, held = [], 0
        for run, size in zip(frame.iloc[:, 1], frame.iloc[:, 2]):
            runs.append(pa.decompress(run, int(size), codec="zstd", asbytes=True) if size else run)
            held += len(runs[-1])
            if held >= PIECE_BYTES:
                yield _unpacked(runs)
                runs, held = [], 0
        if runs:
            yield _unpacked(runs)

    def _rows(self, key, left: pa.Table) -> pd.DataFrame:
        tick, at = (left[c].to_numpy() for c in ("tick", "at"))
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(tick) != 0) | (np.diff(at) != 1) | (at[1:] % RUN == 1)
        starts = np.flatnonzero(new)
        bodies = left["body"].combine_chunks()
        runs = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), bodies)
        return pd.DataFrame({"gateway_key": key[0], "tick": tick[starts], "first_at": at[starts],
                             "bodies": pc.binary_join(runs, "\n").to_numpy(zero_copy_only=False)})


def batch_stream(reads: DataFrame, config: DispatchConfig, *, origin_us: int = 0, gateway: str | None = None, order: str = "seq",
                 wait_ms: int | None = None) -> DataFrame:
    """Add ``batch_id`` and ``batch_pos`` to the reads of a stream as their batches close.

    Batches are those of the batch operators as far as the clocks of the reads tell the ticks: a read leaves when
    its batch is full or a later tick of its gateway is seen.  After ``wait_ms`` (by default the period) without that, a timer closes the
    open tick, and later reads of that tick join the next one; the query needs a running trigger for it.  A pure count trigger
    has no timer.  A null gateway is a gateway of its own.  The reads of a gateway go through one task in the order of
    ``order``, packed and sorted on disk, so a micro-batch may bring any number of them; what waits is at most a batch, but
    with the periodic trigger what does not fit.
    """
    if config.mode == "instant":
        return batch_instant(reads, order=order)
    spark = reads.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if _ARROW_BOUND not in spark.conf.getAll:  # a bound of the session's own stays
        spark.conf.set(_ARROW_BOUND, ARROW_BYTES)
    size = max(1, config.max_batch_size)
    wait = max(MIN_PERIOD_MS, config.period_ms) if wait_ms is None else wait_ms
    name = F.col(gateway).cast("string") if gateway else F.lit("")
    staged = with_tick(reads, config.mode, config.period_ms, origin_us).select(
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("gateway_key"), F.col("tick").alias("tick_no"),
        F.coalesce(F.col(order).cast("long"), F.lit(LAST_NO)).alias("read_no"), F.to_json(F.struct(*reads.columns), BODY).alias("body"))
    runs = staged.mapInArrow(packed, _PACKED).groupBy("gateway_key").transformWithStateInPandas(
        statefulProcessor=RunProcessor(config.mode, size, wait), outputStructType=_RUNS, outputMode="Append",
        timeMode="None" if config.mode == "count" else "ProcessingTime")
    # A read goes to the same partition however often its task runs: a run never crosses a multiple of RUN.
    dealt = runs.repartition("gateway_key", "tick", F.floor((F.col("first_at") - 1) / RUN))
    apart = dealt.select("tick", "first_at", F.posexplode(F.split("bodies", "\n")).alias("n", "body")).select(
        "tick", (F.col("first_at") + F.col("n")).alias("_at"), "body")
    return place(apart, config.mode, size).select(F.from_json("body", reads.schema, BODY).alias("r"), "batch_id", "batch_pos").select(
        "r.*", "batch_id", "batch_pos")


def run_until_drained(stream: DataFrame, out: str, checkpoint: str, *, wait_ms: int, timeout_s: float = 600.0) -> None:
    """Append a stream to a Parquet table until its source is read and its timers have gone off.

    ``wait_ms`` is the longest wait of a timer: a micro-batch that began so long after the last one with input or a timer, and had
    neither, shows that there are none left.  ``timeout_s`` bounds the time without either, not that of the work.
    """
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint) \
        .trigger(processingTime="200 milliseconds").start()
    ends, seen, since = time.monotonic() + timeout_s, -1, None
    try:
        while time.monotonic() < ends:
            if query.exception() is not None:
                raise query.exception()
            if query.status["isDataAvailable"]:  # a micro-batch with input is under way
                ends = time.monotonic() + timeout_s
            for step in query.recentProgress:
                if step["batchId"] <= seen:
                    continue
                began = datetime.fromisoformat(step["timestamp"].replace("Z", "+00:00"))
                timers = sum(int(o["customMetrics"].get("numExpiredTimers", 0)) for o in step["stateOperators"])
                quiet = step["numInputRows"] == 0 and timers == 0
                if since is not None and quiet and began > since + timedelta(milliseconds=wait_ms):
                    return
                if not quiet:
                    ends = time.monotonic() + timeout_s
                if since is None or not quiet:
                    since = began + timedelta(milliseconds=step["durationMs"]["triggerExecution"])
                seen = step["batchId"]
            time.sleep(0.2)
        raise TimeoutError(f"the stream did not end and had nothing to do for {timeout_s} s")
    finally:
        query.stop()
