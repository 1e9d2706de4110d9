"""Framing of large capture files by byte ranges.

A frame says where the next one begins, so a block in the middle of a file does not know its first frame.  But it
can tell, for every place where a frame may enter it, where the chain of frames leaves it again.  Chains that
meet go on as one, so the places where chains leave a block are few; they are the only ones at which the next blocks need to be
entered.  Three passes follow, each parallel over blocks: where chains can leave, which entry leads to which exit and over how many
messages, and, once the entries on the chain from the file's start are known, the frames themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .llrp import HEADER_BYTES, MAX_MESSAGE_BYTES, PAGE_BYTES

BLOCK_BYTES = 8 << 20
_BLOCKS = "path string, block long, begin long, end long, size long"


class _Block(InputPartition):
    def __init__(self, row: tuple):
        self.row = row


class _BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("blockbytes", BLOCK_BYTES))

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        scheme = self.path[:self.path.index(root)] if root in self.path else ""
        found = store.get_file_info(root)
        files = [found] if found.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        return [_Block((scheme + f.path, n, at, min(at + self.block, f.size), f.size))
                for f in sorted(files, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))
                for n, at in enumerate(range(0, f.size, self.block))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield partition.row


class CaptureBlocks(DataSource):
    """``format("capture_blocks")``: the byte ranges of a file or folder of captures, a partition each.

    Option ``blockBytes`` sets their size.  Rows are ``(path, block, begin, end, size)``, with the size of the whole file.
    """

    @classmethod
    def name(cls) -> str:
        return "capture_blocks"

    def schema(self) -> str:
        return _BLOCKS

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(self.options)


def _bytes(path: str, begin: int, end: int) -> bytes:
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as source:
        return source.read_at(end - begin, begin)


def _steps(path: str, begin: int, end: int, size: int) -> memoryview:
    """How far it is from each place of a block to the next header; negative where no message begins; 0 at the end of the file."""
    data = np.frombuffer(_bytes(path, begin, min(end + HEADER_BYTES, size)), np.uint8)
    padded = np.concatenate([data, np.zeros(HEADER_BYTES, np.uint8)]).astype(np.uint32)
    n = end - begin
    told = padded[2:n + 2] << 24 | padded[3:n + 3] << 16 | padded[4:n + 4] << 8 | padded[5:n + 5]
    steps = np.where((told >= HEADER_BYTES) & (told <= MAX_MESSAGE_BYTES), told, 0).astype(np.int32)
    steps[steps == 0] = -HEADER_BYTES
    steps[max(0, size - HEADER_BYTES + 1 - begin):] = 0
    return memoryview(steps)


def _leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places at which chains that enter a block anywhere leave it."""
    for batch in batches:
        for row in batch.to_pylist():
            begin, end = row["begin"], row["end"]
            steps, n = _steps(row["path"], begin, end, row["size"]), end - begin
            seen, out = bytearray(n), set()
            for at in range(min(n, MAX_MESSAGE_BYTES) if begin else 1):
                while at < n and not seen[at]:
                    seen[at] = 1
                    at += abs(steps[at]) or row["size"]
                if at >= n:
                    out.add(begin + at)
            found = sorted(x for x in out if x < row["size"])
            yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(found)), pa.array([row["size"]] * len(found), pa.int64()),
                                              pa.array(found, pa.int64())], ["path", "size", "entry"])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the chain from each entry of a block leaves it, and how many messages begin on the way."""
    for batch in batches:
        for row in batch.to_pylist():
            begin, n = row["begin"], row["end"] - row["begin"]
            steps = _steps(row["path"], begin, row["end"], row["size"])
            # of each place on a chain that was followed: where it leaves, and the messages from there on
            leaves, counts = (memoryview(np.full(n, -1, kind)) for kind in (np.int64, np.int32))
            told = []
            for entry in row["entries"]:
                at, way = entry - begin, []
                while at < n and leaves[at] < 0 and steps[at]:
                    way.append(at)
                    at += abs(steps[at])
                if at >= n:
                    leave, messages = begin + at, 0
                elif leaves[at] >= 0:
                    leave, messages = leaves[at], counts[at]
                else:
                    leave, messages = row["size"], 0
                for at in reversed(way):
                    messages += steps[at] > 0
                    leaves[at], counts[at] = leave, messages
                told.append((entry, leave, messages))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["path"]] * len(told)), pa.array([row["size"]] * len(told), pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*told))],
                ["path", "size", "entry", "exit", "messages"])


def _true_entries(chains: pd.DataFrame) -> pd.DataFrame:
    """The entries on the chain from the start of a file, with the number of the first message behind each."""
    onward = dict(zip(chains["entry"], zip(chains["exit"], chains["messages"])))
    at, number, rows = 0, 0, []
    while at in onward:
        rows.append((chains["path"].iloc[0], chains["size"].iloc[0], at, number))
        at, number = onward[at][0], number + onward[at][1]
    return pd.DataFrame(rows, columns=["path", "size", "entry", "first"])


def _frames(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def page(path: str, rows: list[tuple]) -> pa.RecordBatch:
            numbers, messages, cut = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(numbers, pa.int64()), pa.array(messages, pa.binary()),
                                               pa.array(cut)], ["path", "frame_no", "message", "truncated"])

        for batch in batches:
            for row in batch.to_pylist():
                size, entry, number = row["size"], row["entry"], row["first"]
                end = min(size, (entry // block_bytes + 1) * block_bytes)
                data = _bytes(row["path"], entry, min(size, end + MAX_MESSAGE_BYTES))
                at, rows, held = 0, [], 0
                while entry + at < end and entry + at + HEADER_BYTES <= size:
                    length = int.from_bytes(data[at + 2:at + 6], "big")
                    if not HEADER_BYTES <= length <= MAX_MESSAGE_BYTES:
                        at += HEADER_BYTES
                        continue
                    rows.append((number, data[at:at + length], entry + at + length > size))
                    held, number, at = held + length + 100, number + 1, at + length
                    if held >= PAGE_BYTES:
                        yield page(row["path"], rows)
                        rows, held = [], 0
                if rows:
                    yield page(row["path"], rows)

    return run


def split_capture_files(spark: SparkSession, path: str, *, block_bytes: int = BLOCK_BYTES, tasks: int | None = None) -> DataFrame:
    """Frames of a capture file, or of all in a folder, as ``(path, frame_no, message, truncated)``.

    They are those that ``split_llrp_capture`` finds reading from the start: a header with a bad length is skipped alone, and a last
    message that is cut short comes as it is.  A file of any size is framed by all cores, in blocks of ``block_bytes``; what
    one task sees of a whole file is a few numbers per block.  A file shorter than a header has no frames.
    """
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    spark.dataSource.register(CaptureBlocks)
    blocks = spark.read.format("capture_blocks").option("blockBytes", str(block_bytes)).load(path)
    exits = blocks.mapInArrow(_leaving, "path string, size long, entry long")
    starts = blocks.where("begin = 0").select("path", "size", F.lit(0).cast("long").alias("entry"))
    begin = F.floor(F.col("entry") / block_bytes) * block_bytes
    entered = exits.unionByName(starts).groupBy("path", "size", begin.cast("long").alias("begin")).agg(
        F.collect_set("entry").alias("entries")).withColumn("end", F.least("size", F.col("begin") + block_bytes))
    chains = entered.repartition(tasks, "path", "begin").mapInArrow(
        _chains, "path string, size long, entry long, exit long, messages long")
    true = chains.groupBy("path").applyInPandas(_true_entries, "path string, size long, entry long, first long")
    return true.repartition(tasks, "path", "entry").mapInArrow(
        _frames(block_bytes), "path string, frame_no long, message binary, truncated boolean")


def write_captures(captures: DataFrame, folder: str, *, path: str = "path", content: str = "content") -> None:
    """Write each row of captures as a file of the folder; a repeated task leaves one whole file."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns)):
                draft = f"{root}/_{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(data or b"")
                store.move(draft, f"{root}/{name}")
            yield batch.select([0])

    captures.select(path, content).mapInArrow(write, f"{path} string").count()
