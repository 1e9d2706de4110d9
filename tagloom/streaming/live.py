"""Gauges, reader states and lines of live streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import trim_whitespace
from ..operators.telemetry import throughput_per_second
from .dedup import STATE_STORE

MICRO_BATCH = "micro_batch"


def throughput_stream(reads: DataFrame, *, late: str = "10 seconds") -> DataFrame:
    """Reads per second of a stream.

    In append mode a second comes out once, when the newest read is ``late`` behind its end; in update mode it comes out with every
    change, for a sink of ``upserts``.  Either way the state holds the seconds that are still open.
    """
    return throughput_per_second(reads.withWatermark("eval_ts", late))


def reader_status_stream(status: DataFrame) -> DataFrame:
    """Last state per reader of a stream of status events, for update mode; the state is one row per reader."""
    return status.groupBy("reader_id").agg(F.max_by(F.struct("new_state", "ts"), "seq").alias("_last")).select(
        "reader_id", F.col("_last.new_state").alias("state"), F.col("_last.ts").alias("last_seen"))


def upserts(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that writes what a micro-batch changed; a repeated micro-batch replaces what it wrote."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{MICRO_BATCH}={batch_id}")
    return write


def upserted(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The table that the written changes make: of each key what the latest micro-batch said."""
    changes = spark.read.option("basePath", path).parquet(f"{path}/{MICRO_BATCH}=*")
    values = [c for c in changes.columns if c not in (*keys, MICRO_BATCH)]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*values), MICRO_BATCH).alias("_now")).select(*keys, "_now.*")


class LineProcessor(StatefulProcessor):
    """Lines of one stream of text; the state is the unfinished one."""

    def __init__(self, longest: int):
        self.longest = longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", T.StructType([
            T.StructField("line_no", T.LongType()), T.StructField("tail", T.StringType()), T.StructField("long", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = pd.concat([r.set_axis(["stream_key", "chunk_no", "data"], axis=1) for r in rows]).sort_values("chunk_no", kind="stable")
        number, tail, long = self.open.get() if self.open.exists() else (0, "", False)
        lines, numbers, quarantined = [], [], []
        for data in chunks["data"].tolist():
            first, *others = (data or "").split("\n")
            tail += first
            for piece in others:
                lines.append(tail[:self.longest])
                numbers.append(number)
                quarantined.append(long or len(tail) > self.longest)
                number, tail, long = number + 1, piece, False
            if len(tail) > self.longest:  # its beginning is kept, what follows up to the next newline is not
                tail, long = tail[:self.longest], True
        self.open.update((number, tail, long))
        yield pd.DataFrame({"stream_key": pd.Series([key[0]] * len(lines), dtype=str), "line_no": pd.Series(numbers, dtype="int64"),
                            "line": pd.Series(lines, dtype=str), "quarantined": pd.Series(quarantined, dtype=bool)})

    def close(self) -> None:
        pass


def split_lines_stream(chunks: DataFrame, *, stream: str = "stream_id", order: str = "chunk_no", data: str = "data",
                       longest: int = 1 << 20) -> DataFrame:
    """Trimmed lines ``(stream, line_no, line, quarantined)`` of chunked text that arrives in micro-batches.

    They are those of ``split_lines`` that a newline has ended, however the chunks are cut into micro-batches.  Of a line of more than
    ``longest`` characters the beginning comes out as ``quarantined``, so the state of a stream without newlines stays
    bounded.  A stream's chunks of a micro-batch go through one task; a null stream is one of its own.
    """
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    staged = chunks.select(F.coalesce(F.concat(F.lit("="), F.col(stream).cast("string")), F.lit("")).alias("stream_key"),
                           F.col(order).cast("long").alias("chunk_no"), F.col(data).alias("data"))
    lines = staged.groupBy("stream_key").transformWithStateInPandas(
        statefulProcessor=LineProcessor(longest), outputStructType="stream_key string, line_no long, line string, quarantined boolean",
        outputMode="Append", timeMode="None")
    name = F.when(F.col("stream_key") != "", F.substring("stream_key", 2, 1 << 30)).cast(chunks.schema[stream].dataType)
    return lines.select(name.alias(stream), "line_no", trim_whitespace(F.col("line")).alias("line"), "quarantined")
