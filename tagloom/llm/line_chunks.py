"""Line dedup by content-defined chunks.

A rolling hash over the hashes of the last lines ends a chunk wherever its value asks for it, so the same passage is cut
in the same places whatever stands before it.  Besides the chunks, every shortest run of lines above a count of words is
looked up, from each line forth and from each line back; together those of a common passage cover it whole, so a match
needs no growing.  What occurs more than once is compared byte by byte, and all but the first is removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column_bytes, fresh, slices, written

MULTIPLIER = 0x9E3779B97F4A7C15
_RUNS = "doc long, tie long, start int, lines int, digest binary"


def split_lines(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The lines of a text, and where each begins and the last one ends, line feeds included."""
    lines = text.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    return lines, np.minimum(np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])]), len(text)).astype(np.int64)


def cut_lines(text: bytes, window: int, divisor: int, longest: int) -> list[tuple[int, int, int]]:
    """Chunks of a text: byte range and count of lines.  Ranges hold whole lines with their line feeds.

    A chunk ends behind a line where the hash over it and the lines before it, ``window`` in all, is a multiple of
    ``divisor``, at the end of the text, and after ``longest`` lines.
    """
    if not text:
        return []
    lines, at = split_lines(text)
    n = len(lines)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, n)
    rolled = np.zeros(n, np.uint64)
    for back in range(window):  # the sum of hash times multiplier to the distance, for all places at once
        if back < n:
            rolled[back:] += hashes[:n - back] * np.uint64(pow(MULTIPLIER, back, 1 << 64))
    ends = np.flatnonzero((rolled ^ (rolled >> np.uint64(29))) % np.uint64(divisor) == 0) + 1
    edges = np.unique(np.concatenate([[0], ends, [n]]))
    if (np.diff(edges) > longest).any():
        edges = np.unique(np.concatenate([np.append(np.arange(a, b, longest), b) for a, b in zip(edges[:-1], edges[1:])]))
    return [(int(at[a]), int(at[b]), int(b - a)) for a, b in zip(edges[:-1], edges[1:])]


def without(text: bytes, chunks: list[tuple[int, int, int]], gone: set[int]) -> bytes:
    """What is left of a text; it ends with a line feed only if it did before."""
    left = b"".join([text[a:b] for k, (a, b, _) in enumerate(chunks) if k not in gone])
    return left.removesuffix(b"\n") if not text.endswith(b"\n") else left


def shortest_runs(lines: list[bytes], over_words: int) -> set[tuple[int, int]]:
    """First line and count of lines of the shortest runs of more than ``over_words`` words, from each line that has
    words forth and from each back.

    They depend on the lines within alone.  If a run of lines has more words, those that lie within it cover it from its
    first line with words to the last; only lines without words between two long lines may be left.
    """
    words = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
    upto = np.concatenate([[0], np.cumsum(words)])
    own = np.flatnonzero(words)
    ends = np.searchsorted(upto, upto[own] + over_words, "right")
    starts = np.searchsorted(upto, upto[own + 1] - over_words, "left") - 1
    forth = ends <= len(lines)
    back = starts >= 0
    return {*zip(own[forth].tolist(), (ends - own)[forth].tolist()), *zip(starts[back].tolist(), (own + 1 - starts)[back].tolist())}


def taken_out(lines: list[bytes], runs: list[tuple[int, int]]) -> np.ndarray:
    """Which lines go with these runs; lines without words between two that go do too."""
    steps = np.zeros(len(lines) + 1, np.int64)
    for start, n in runs:
        steps[start] += 1
        steps[start + n] -= 1
    gone = np.cumsum(steps[:-1]) > 0
    told = np.flatnonzero(gone | np.fromiter((bool(x.split(None, 1)) for x in lines), bool, len(lines)))
    for a, b in zip(told[:-1], told[1:]):
        if b - a > 1 and gone[a] and gone[b]:
            gone[a:b] = True
    return gone


def remove_repeats(docs: DataFrame, counts: str, *, key: str = "doc_id", text: str = "text", window: int = 2,
                   divisor: int = 4, longest: int = 64, min_lines: int = 2, over_words: int | None = None,
                   digest_bytes: int = 16) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text`` and a struct column ``counts`` of ``chunks`` and ``removed``.

    A chunk of at least ``min_lines`` lines that stands in several places stays in the first, by key and place; a null
    key comes last.  With ``over_words`` so does every run of lines with more words, from its first line with words to
    its last, wherever the cuts are; a run that overlaps its first place stays.  The edges of what is removed count as
    cuts.  Rows that repeat both key and text are one document here and lose the same.  A null text stays null and an
    empty one empty.  The line feed behind a chunk is no part of the comparison.  An empty table gives no rows.

    Digests find what repeats, and the bytes behind each digest are then compared; if any differ, all is done anew with
    longer or other digests.
    """
    doc, tie, found = fresh(docs, "doc", "tie", "runs")
    marked = docs.withColumns({doc: F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)),
                               tie: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    base = marked.select(F.col(doc).alias("doc"), F.col(tie).alias("tie"), F.col(text).alias("text"))

    def digest_of(part: bytes, seed: int) -> bytes:
        return xxhash.xxh3_128_digest(part, seed)[:digest_bytes << min(seed, 4)]

    def runs_of(body: bytes) -> Iterator[tuple[int, int, bytes]]:
        lines, at = split_lines(body)
        ends = np.cumsum([n for _, _, n in cut_lines(body, window, divisor, longest)]).tolist()
        runs = {(a, b - a) for a, b in zip([0, *ends], ends) if b - a >= min_lines}
        if over_words is not None:
            runs |= shortest_runs(lines, over_words)
        for start, n in runs:
            yield start, n, body[at[start]:at[start + n]].removesuffix(b"\n")

    def finder(seed: int):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = [(d, t, start, n, digest_of(part, seed))
                        for d, t, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column_bytes(batch.column(2)))
                        for start, n, part in runs_of(body)]
                if rows:
                    yield _batch(rows, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()], ["doc", "tie", "start", "lines", "digest"])
        return find

    def bodies(seed: int):
        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 100):
                rows, size = [], 0
                for body, runs in zip(column_bytes(batch.column(0)), batch.column(1).to_pylist()):
                    _, at = split_lines(body)
                    for run in runs:
                        part = body[at[run["start"]]:at[run["start"] + run["lines"]]].removesuffix(b"\n")
                        rows.append((digest_of(part, seed), part))
                        size += len(part)
                        if size >= 8 << 20:
                            yield _batch(rows, [pa.binary(), pa.binary()], ["digest", "body"])
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, [pa.binary(), pa.binary()], ["digest", "body"])
        return tell

    place = F.struct("doc", "start", "tie")
    for seed in count():
        runs = written(base.mapInArrow(finder(seed), _RUNS), "line-runs")
        repeated = runs.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
        suspects = written(runs.join(repeated, "digest", "left_semi"), "line-suspects")
        first = suspects.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
        told = suspects.join(first.drop("last"), "digest").withColumn("again", place != F.col("first"))
        overlaps = (F.col("doc") == F.col("first.doc")) & (F.col("tie") == F.col("first.tie")) & (F.col("start") - F.col("first.start") < F.col("lines"))
        told = told.where(~(F.col("again") & overlaps)).groupBy(F.col("doc").alias(doc), F.col("tie").alias(tie)).agg(
            F.collect_set(F.struct("start", "lines", "again")).alias(found))
        joined = written(marked.join(told, [doc, tie], "left"), "line-documents")
        told_bodies = joined.where(F.col(found).isNotNull()).select(text, found).mapInArrow(bodies(seed), "digest binary, body binary")
        if told_bodies.distinct().groupBy("digest").count().where("count > 1").isEmpty():
            break
    out = joined.withColumn(counts, F.lit(None).cast("struct<chunks:long,removed:long>"))
    kind = pa.struct([("chunks", pa.int64()), ("removed", pa.int64())])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, told_at = batch.schema.get_field_index(text), batch.schema.get_field_index(counts)
            left, told = [], []
            for body, runs in zip(batch.column(at).cast(pa.large_binary()).to_pylist(), batch.column(found).to_pylist()):
                cut = cut_lines(body or b"", window, divisor, longest)
                lost = [(x["start"], x["lines"]) for x in runs or () if x["again"]]
                gone = set()
                if lost:
                    lines, starts = split_lines(body)
                    out_of = taken_out(lines, lost)
                    edges = np.union1d(np.cumsum([0, *(n for _, _, n in cut)]), np.flatnonzero(np.diff(out_of)) + 1)
                    cut = [(int(starts[a]), int(starts[b]), int(b - a)) for a, b in zip(edges[:-1], edges[1:])]
                    gone = set(np.flatnonzero(out_of[edges[:-1]]).tolist())
                left.append(without(body, cut, gone) if gone else body)
                told.append({"chunks": len(cut), "removed": len(gone)})
            batch = batch.set_column(at, text, pa.array(left, pa.large_binary()).cast(pa.large_string()).cast(batch.schema.field(at).type))
            yield batch.set_column(told_at, counts, pa.array(told, kind))

    return out.mapInArrow(strip, out.schema).drop(doc, tie, found)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
