"""Token ids in word-aligned files: Simple-8b.

A 64-bit word holds a selector in its upper four bits and as many ids as fit at the selector's width in the other sixty.
A value of sixty bits or more is escaped: selector 0, then the value as a word of its own.  Ids are cut in blocks that
begin with a word; the file tells where each block begins, so any of them is decoded alone, all words of a selector
at once.

File: magic, version, number of documents, ids, blocks and words of the document table (seven little-endian 64-bit
words), then the block offsets, the document table and the blocks.  The document table is coded the same way: per
document its id's zigzag difference to the one before, its count of ids, and whether the id is null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Encoder, column_bytes, open_file, put_file, returned, scratch, slices, written

#: Ids per word and bits per id by selector; fixed values of the format.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
MAGIC, VERSION = 0x4238534B4F54, 1
BLOCK_IDS = 4096
SHORT_BITS = np.frexp(np.arange(1 << 16))[1].astype(np.int8)  # bit length of a value

_MANIFEST = "file string, number long, docs long, ids long"


def _selectors(rows: np.ndarray) -> np.ndarray:
    """Per position of each row the selector of a word that begins there: the one with most ids, all of which must fit."""
    n = rows.shape[1]
    if rows.max() < len(SHORT_BITS):
        bits = SHORT_BITS[rows]
    else:  # bit length: of the upper half where it has bits, else of the lower; floats of 32 bits are exact
        high, low = rows >> np.uint64(32), rows & np.uint64(0xFFFFFFFF)
        bits = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp(low.astype(np.float64))[1]).astype(np.int8)
    choice = np.full(rows.shape, 14, dtype=np.int8)
    choice[bits > 60] = 0
    reach = {1: bits}  # reach[c][:, i]: most bits among the c values of a row from i on
    for selector in range(13, 0, -1):
        count = int(COUNTS[selector])
        if count > n or not (bits <= WIDTHS[selector]).any():
            break
        half = max(c for c in reach if c <= count)
        while half * 2 <= count:
            base = reach[half]
            reach[half * 2] = np.maximum(base[:, :-half], base[:, half:])
            half *= 2
        base = reach[half]
        most = np.maximum(base[:, :n - count + 1], base[:, count - half:count - half + n - count + 1])
        choice[:, :n - count + 1][most <= WIDTHS[selector]] = selector
    return choice


def _word_starts(jump: np.ndarray) -> np.ndarray:
    """Which positions begin a word, where a word at a position of a row ends before position ``jump``; rows go side by side."""
    count, n = jump.shape
    begins = np.zeros((count, n + 1), bool)
    if count < 16:  # few rows are followed one by one
        for row, steps in zip(begins, jump.tolist()):
            at, starts = 0, []
            while at < n:
                starts.append(at)
                at = steps[at]
            row[starts] = True
        return begins[:, :n]
    flat, base = np.append(jump, np.full((count, 1), n, jump.dtype), axis=1).ravel(), np.arange(count) * (n + 1)
    at, marks = base.copy(), begins.ravel()
    while True:  # a row at its end stays there
        marks[at] = True
        step = flat[at]
        if step.min() == n:
            return begins[:, :n]
        at = base + step


def encode_rows(rows: np.ndarray) -> list[np.ndarray]:
    """The words of each row of unsigned 64-bit values."""
    count, n = rows.shape
    if not n or not count:
        return [np.empty(0, "<u8")] * count
    choice = _selectors(rows)
    begins = _word_starts(np.arange(n, dtype=np.int32) + np.maximum(COUNTS[choice], 1).astype(np.int32))
    starts = np.flatnonzero(begins)
    values, chosen = rows.ravel(), choice.ravel()[starts]
    size = 1 + (chosen == 0)
    ends = np.cumsum(size)
    place = ends - size
    words = np.zeros(int(ends[-1]), dtype=np.uint64)
    for selector in np.unique(chosen).tolist():
        own = np.flatnonzero(chosen == selector)
        at = starts[own]
        if selector == 0:
            words[place[own] + 1] = values[at]
            continue
        width = int(WIDTHS[selector])
        word = np.full(len(own), np.uint64(selector) << np.uint64(60))
        for k in range(int(COUNTS[selector])):
            word |= values[at + k] << np.uint64(k * width)
        words[place[own]] = word
    last = np.cumsum(begins.sum(axis=1)) - 1  # every row begins a word
    return np.split(words.astype("<u8"), ends[last[:-1]])


def encode(values: np.ndarray) -> np.ndarray:
    """The words of unsigned 64-bit values."""
    return encode_rows(values.reshape(1, -1))[0]


def decode(words: np.ndarray) -> np.ndarray:
    """The values of whole words."""
    if not len(words):
        return np.empty(0, np.uint64)
    words = words.astype(np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    # What follows an escape is a value of sixty bits or more, so its upper bits never look like an escape.
    after = np.flatnonzero(selector == 0) + 1
    selector[after] = 15
    counts = np.append(COUNTS, 1)[selector]
    starts = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    for s in np.unique(selector).tolist():
        own = selector == s
        if s == 0:
            continue
        if s == 15:
            out[starts[own]] = words[own]
            continue
        width = int(WIDTHS[s])
        mask = np.uint64((1 << width) - 1)
        for k in range(int(COUNTS[s])):
            out[starts[own] + k] = (words[own] >> np.uint64(k * width)) & mask
    return out


def _zigzag(x: np.ndarray) -> np.ndarray:
    """Differences wrap modulo 2^64, so any two ids have one."""
    return (x.astype(np.uint64) << np.uint64(1)) ^ (x >> 63).astype(np.uint64)


def _unzigzag(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(1)) ^ (np.uint64(0) - (x & np.uint64(1)))).astype(np.int64)


def blocks_of(ids: np.ndarray) -> list[np.ndarray]:
    whole = len(ids) // BLOCK_IDS * BLOCK_IDS
    blocks = encode_rows(ids[:whole].reshape(-1, BLOCK_IDS))
    return blocks + [encode(ids[whole:])] if whole < len(ids) else blocks


def file_chunks(doc_ids: np.ndarray, no_id: np.ndarray, lengths: np.ndarray, blocks: list[np.ndarray]) -> Iterator[bytes]:
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    with np.errstate(over="ignore"):
        steps = np.diff(doc_ids, prepend=np.int64(0))
    table = encode(np.concatenate([_zigzag(steps), lengths.astype(np.uint64), no_id.astype(np.uint64)]))
    yield np.array([MAGIC, VERSION, len(doc_ids), int(lengths.sum()), BLOCK_IDS, len(blocks), len(table)], "<u8").tobytes()
    yield offsets.tobytes()
    yield table.tobytes()
    for block in blocks:
        yield block.tobytes()


class IdFile:
    """A file read by parts: its document table, and the ids of any range."""

    def __init__(self, uri: str):
        self.source = open_file(uri)
        head = np.frombuffer(self.source.read(56), "<u8")
        if head[0] != MAGIC or head[1] != VERSION:
            raise ValueError(f"{uri} is no id file of this version")
        _, _, self.docs, self.ids, self.block, blocks, table = (int(x) for x in head)
        self.offsets = np.frombuffer(self.source.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        told = decode(np.frombuffer(self.source.read(8 * table), "<u8"))
        self.base = 56 + 8 * (blocks + 1 + table)
        with np.errstate(over="ignore"):
            self.doc_ids = np.cumsum(_unzigzag(told[:self.docs]))
        self.lengths = told[self.docs:2 * self.docs].astype(np.int64)
        self.no_id = told[2 * self.docs:].astype(bool)

    def read(self, start: int, end: int) -> np.ndarray:
        first, last = start // self.block, -(-end // self.block)
        self.source.seek(self.base + 8 * int(self.offsets[first]))
        words = np.frombuffer(self.source.read(8 * int(self.offsets[last] - self.offsets[first])), "<u8")
        return decode(words)[start - first * self.block:end - first * self.block]


def write_ids(docs: DataFrame, folder: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1,
              keep_space: bool = False, batch_bytes: int = 4 << 20) -> DataFrame:
    """Write files of ids in ascending order of the key and return ``(file, number, docs, ids)`` in file order.

    ``tokenizer`` is the path of a tokenizers file; ``end_id`` ends each document.  A null text is empty, a null key
    comes first; rows that repeat a key follow each other in the order of a hash of their texts.  An empty table gives no file.
    """
    base = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .withColumn("tie", F.xxhash64("text"))
    parts = max(base.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = base.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(tokenizer, keep_space)
        keys, none, lengths, blocks = [], [], [], []
        rest = np.empty(0, "<u4")
        for batch in slices(batches, 4000):
            own = batch.column(0).to_pylist()
            keys += [i or 0 for i in own]
            none += [i is None for i in own]
            for _, _, ids, edges in coder.documents(column_bytes(batch.column(1)), end_id, batch_bytes):
                lengths += np.diff(edges).tolist()
                rest = np.concatenate([rest, ids.astype("<u4")])
                whole = len(rest) // BLOCK_IDS * BLOCK_IDS
                blocks += blocks_of(rest[:whole].astype(np.uint64))
                rest = rest[whole:]
        if not keys:
            return
        coder = None
        returned()
        blocks += blocks_of(rest.astype(np.uint64))
        number = TaskContext.get().partitionId()
        name = f"{folder}/part-{number:06d}.s8b"
        put_file(name, file_chunks(np.array(keys, np.int64), np.array(none), np.array(lengths, np.int64), blocks))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, number, len(keys), sum(lengths))],
                                         ["file", "number", "docs", "ids"])

    return written(ordered.mapInArrow(write, _MANIFEST), "id-manifest").orderBy("number")


def read_ids(spark: SparkSession, manifest: DataFrame, *, docs_per_read: int = 256) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""
    before, rows = 0, []
    for file, _, docs, ids in manifest.collect():  # a row per file
        rows.append((file, before, docs))
        before += ids
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.createDataFrame(rows, "file string, before long, docs long").repartition(len(rows), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before, _ in zip(*(c.to_pylist() for c in batch.columns)):
                source = IdFile(file)
                edges = np.concatenate([[0], np.cumsum(source.lengths)])
                for at in range(0, source.docs, docs_per_read):
                    to = min(at + docs_per_read, source.docs)
                    ids = source.read(int(edges[at]), int(edges[to])).astype("<u4").tobytes()
                    own = (edges[at:to + 1] - edges[at]) * 4
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(own[:-1].tolist(), own[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(source.doc_ids[at:to], pa.int64(), mask=source.no_id[at:to]), pa.array(edges[at:to] + before, pa.int64()),
                         pa.array(source.lengths[at:to], pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def id_round_trip(docs: DataFrame, tokenizer: str, *, folder: str | None = None, **options) -> DataFrame:
    """Write the ids of all documents and read them back."""
    spark = docs.sparkSession
    return read_ids(spark, write_ids(docs, folder or scratch(spark, "ids"), tokenizer, **options))
