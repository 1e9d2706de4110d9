"""Packing by Karmarkar-Karp multiway differencing.

Documents are tokenised and cut in pieces; pieces of a whole window stand alone.  The others of a shard are dealt to
windows by differencing: each piece begins as a partition of its own, and the two partitions with the largest spread are
merged so that their imbalances oppose each other, until one partition is left whose windows are nearly equal.  It
starts from the fewest windows that could hold the tokens; the count rises whenever a window exceeds the capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Encoder, column_bytes, returned, slices

_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
SEQUENCES_PER_TASK = 1 << 40  # sequence ids of a task are its own


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size, by differencing over ``windows`` partitions.

    A partition is kept as its sums in ascending order, relative to the smallest and without the zeros in front, so small
    ones are short; the spread orders the heap.  Merging adds the largest sums of one to the smallest of the other: where
    there are zeros enough, the sums of both just stand beside each other.
    """
    n = len(sizes)
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {i: sizes[i:i + 1] for i in range(n)}
    merges: list[tuple[int, int, int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        left, right = sums.pop(a), sums.pop(b)
        if len(left) + len(right) <= windows:
            both = np.concatenate([left, right])
        else:
            both = np.zeros(windows, np.int64)
            both[windows - len(left):] = left
            both[:len(right)] += right[::-1]
        order = np.argsort(both, kind="stable")
        both = both[order]
        if len(both) == windows:
            both = both - both[0]
        node = n + len(merges)
        sums[node] = both
        merges.append((a, b, len(left), len(right), order))
        heapq.heappush(heap, (-int(both[-1]), node))
    # From the last merge down: the windows in which the sums of a partition have ended up.
    window = np.zeros(n, np.int64)
    top = heap[0][1]
    place: dict[int, np.ndarray] = {top: np.arange(len(sums[top]))}
    for k in range(len(merges) - 1, -1, -1):
        a, b, left, right, order = merges[k]
        back = np.empty(len(order), np.int64)
        back[order] = place.pop(n + k)
        beside = left + right <= windows
        place[a] = back[:left] if beside else back[windows - left:]
        place[b] = back[left:] if beside else back[right - 1::-1] if right < windows else back[::-1]
    for i in range(n):
        window[i] = place[i][0]
    return window


def deal(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Window of each size and how many windows there are, none above the capacity."""
    total = int(sizes.sum())
    windows = -(-total // capacity)
    while True:
        window = difference(sizes, windows)
        if np.bincount(window, sizes, windows).max() <= capacity:
            return window, windows
        windows += 1


def _page(pieces: list[tuple], sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in zip(*pieces)]
    doc, start, length, crc, total = columns
    return pa.RecordBatch.from_arrays(
        [doc, start, length, crc, total, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = 2048,
         piece: int = 256, shard_pieces: int = 2048, end_id: int = 1, batch_bytes: int = 3 << 20) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document's ids are those of its whole text (null: none) and ``end_id``.  Of its ids, whole windows go first;
    the rest is cut in pieces of ``piece`` and what is left, and ``shard_pieces`` of them are dealt together, each task its
    own.  Small pieces of many sizes make near-equal windows possible.  Rows without an id or with a repeated one are packed like others;
    an empty table gives no rows; other columns are not read.
    """
    base = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(tokenizer, True)
        free = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        whole: list[tuple] = []
        small: list[tuple] = []

        def whole_windows() -> pa.RecordBatch:
            nonlocal free, whole
            page = _page(whole, np.arange(free, free + len(whole)), np.zeros(len(whole), np.int64))
            free, whole = free + len(whole), []
            return page

        def shard(count: int) -> pa.RecordBatch:
            nonlocal free, small
            now, small = small[:count], small[count:]
            sizes = np.array([p[2] for p in now], np.int64)
            window, windows = deal(sizes, capacity)
            order = np.argsort(window, kind="stable")
            ends = np.cumsum(sizes[order])
            begun = np.concatenate([[0], np.cumsum(np.bincount(window, sizes, windows).astype(np.int64))])
            offset = ends - sizes[order] - begun[window[order]]
            # windows that got nothing take no number
            used = np.cumsum(np.bincount(window, minlength=windows) > 0) - 1
            page = _page([now[i] for i in order], free + used[window[order]], offset)
            free += int(used[-1]) + 1
            return page

        for batch in slices(batches, 4000):
            keys = batch.column(0).to_pylist()
            for start, end, ids, edges in coder.documents(column_bytes(batch.column(1)), end_id, batch_bytes):
                flat = memoryview(ids.astype("<u4").tobytes())
                for doc, begin, n in zip(keys[start:end], edges[:-1].tolist(), np.diff(edges).tolist()):
                    coded = flat[4 * begin:4 * (begin + n)]
                    for at in range(0, n // capacity * capacity, capacity):
                        whole.append((doc, at, capacity, zlib.crc32(coded[4 * at:4 * (at + capacity)]), n))
                    first, rest = n // capacity * capacity, n % capacity
                    for a in range(first, first + rest, piece):
                        b = min(a + piece, n)
                        small.append((doc, a, b - a, zlib.crc32(coded[4 * a:4 * b]), n))
                if len(whole) >= 1000:
                    yield whole_windows()
                while len(small) >= 2 * shard_pieces:
                    yield shard(shard_pieces)
        if small:
            yield shard(len(small))
        if whole:
            yield whole_windows()
        coder = None
        returned()

    return base.mapInArrow(fill, _PIECES)
