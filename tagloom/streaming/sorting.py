"""The reads of one group of a micro-batch in order, in bounded memory.

Spark hands a group to Python in no order and piece by piece.  What a buffer does not hold is written in sorted runs to files
without a name, which go with the task; runs are read back block by block.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator
from typing import IO

import numpy as np
import pyarrow as pa

READ = pa.schema([("tick", pa.int64()), ("read_no", pa.int64()), ("body", pa.string())])

BUFFER_BYTES = 64 << 20  # held before they are written
BLOCK_BYTES = 512 << 10  # of a run that is in memory at a time
PIECE_BYTES = 4 << 20  # that leave together
FAN_IN = 128  # runs that are merged at once


def _ordered(pieces: list[pa.Table]) -> pa.Table:
    """By tick, then by number; reads that share both stay as they came.  Empties the list, so that two copies are held at most."""
    reads = pa.concat_tables(pieces).combine_chunks()
    pieces.clear()
    tick, read_no = (reads[c].to_numpy() for c in ("tick", "read_no"))
    behind = (tick[1:] < tick[:-1]) | ((tick[1:] == tick[:-1]) & (read_no[1:] < read_no[:-1]))
    return reads.take(pa.array(np.lexsort((read_no, tick)))) if behind.any() else reads


def parts(reads: pa.Table, size: int = PIECE_BYTES) -> Iterator[pa.Table]:
    """A table in parts of about so many bytes."""
    rows = _rows_of(reads, size)
    return (reads.slice(at, rows) for at in range(0, len(reads), rows))


def _rows_of(reads: pa.Table, size: int) -> int:
    return max(1, size * len(reads) // max(1, reads.nbytes))


def _scratch_file() -> IO[bytes]:
    folders = [f for f in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(f)]
    return tempfile.TemporaryFile(dir=folders[os.getpid() % len(folders)] if folders else None)


class _Front:
    """The block of a run that is being read."""

    def __init__(self, file: IO[bytes]):
        file.seek(0)
        self.file, self.blocks = file, iter(pa.ipc.open_stream(file))
        self.load()

    def load(self) -> bool:
        """Go to the next block; the file of a run without one is closed."""
        block = next(self.blocks, None)
        if block is None:
            self.file.close()
            return False
        self.reads, self.at = pa.Table.from_batches([block]), 0
        self.tick, self.read_no = (self.reads[c].to_numpy() for c in ("tick", "read_no"))
        return True

    def last(self) -> tuple[int, int]:
        return int(self.tick[-1]), int(self.read_no[-1])

    def upto(self, tick: int, read_no: int) -> pa.Table:
        """What is left of the block up to a place in the order."""
        low, high = np.searchsorted(self.tick, (tick, tick + 1))
        end = int(low + np.searchsorted(self.read_no[low:high], read_no, side="right"))
        taken = self.reads.slice(self.at, max(0, end - self.at))
        self.at = max(self.at, end)
        return taken


def _merged(files: list[IO[bytes]]) -> Iterator[pa.Table]:
    """Runs as one: of all blocks what lies up to the end of the block that ends first, again and again."""
    fronts = [_Front(f) for f in files]
    while fronts:
        upto = min(f.last() for f in fronts)
        yield _ordered([part for f in fronts if len(part := f.upto(*upto))])
        fronts = [f for f in fronts if f.at < len(f.reads) or f.load()]


def gathered(pieces: Iterable[pa.Table], least: int = PIECE_BYTES) -> Iterator[pa.Table]:
    """Pieces of so many bytes at least, but for the last."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += piece.nbytes
        if size >= least:
            yield pa.concat_tables(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.concat_tables(held).combine_chunks()


class SortedReads:
    """Takes tables of ``READ`` in any order and gives them back by tick and number."""

    def __init__(self, buffer_bytes: int = BUFFER_BYTES, block_bytes: int = BLOCK_BYTES, fan_in: int = FAN_IN):
        self.buffer_bytes, self.block_bytes, self.fan_in = buffer_bytes, block_bytes, fan_in
        self.held: list[pa.Table] = []
        self.size, self.runs = 0, [[]]  # files by the number of times their reads were merged

    def add(self, reads: pa.Table) -> None:
        self.held.append(reads)
        self.size += reads.nbytes
        if self.size >= self.buffer_bytes:
            self.size = 0
            self._write(0, [_ordered(self.held)])

    def sorted(self) -> Iterator[pa.Table]:
        """All reads, in pieces; for one time only."""
        last = [_ordered(self.held)] if self.held else []
        files = [f for level in self.runs for f in level]
        if not files:
            yield from (piece for reads in last for piece in parts(reads))
            return
        if last:
            files.append(self._run(last))
            last.clear()
        yield from gathered(_merged(files))

    def _run(self, pieces: Iterable[pa.Table]) -> IO[bytes]:
        file = _scratch_file()
        with pa.ipc.new_stream(file, READ, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            for reads in pieces:
                writer.write_table(reads, max_chunksize=_rows_of(reads, self.block_bytes))
        return file

    def _write(self, level: int, pieces: Iterable[pa.Table]) -> None:
        if level == len(self.runs):
            self.runs.append([])
        self.runs[level].append(self._run(pieces))
        if len(self.runs[level]) == self.fan_in:
            files, self.runs[level] = self.runs[level], []
            self._write(level + 1, gathered(_merged(files)))
