"""Exact dedup as a tree merge of sorted digest runs.

Every partition sorts the digests of its texts into a run.  Runs meet in rounds, ``fan_in`` at a time, each round
merging them and keeping per digest the smallest id and the size of the group; a digest space cut in buckets lets every
round run on many tasks.  A partition sends one entry per distinct text however often it holds it, so a text that makes
a third of all rows weighs as much as any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ASCII_SPACE, fresh, tidy, written

KEY_BYTES = 48  # SHA-256, then length and xxHash64 of the text as verification
NO_ID = 2**63 - 1
IDS_PER_ROW = 4096
PIECE_BITS = 20  # a run's number, then the number of its piece

_BLOCK = ("bucket int, run long, piece int, keys binary, least binary, held binary, counts binary, ids binary")
_MERGED = "bucket int, run long, piece int, keys binary, least binary, held binary, counts binary"


def normalised(text: Column) -> Column:
    """Null as empty, every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " ")


def _keys(blocks: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blocks), dtype=f"S{KEY_BYTES}")


def _longs(blocks: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blocks), dtype="<i8")


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def merge_runs(keys: list[bytes], least: list[bytes], held: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Merge sorted runs, given in run order: distinct keys, smallest id, first run and piece that hold it, group size.

    Keys are compared whole, digest and verification, so texts whose digests collide stay apart.  The stable sort
    finds the runs and merges them.
    """
    key, ids, run, n = _keys(keys), _longs(least), _longs(held), _longs(counts)
    order = np.argsort(key, kind="stable")
    key, ids, run, n = key[order], ids[order], run[order], n[order]
    starts = _starts(key)
    smallest = np.minimum.reduceat(ids, starts)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
    place = np.where(ids == smallest[group], np.arange(len(ids)), len(ids))
    return key[starts], smallest, run[np.minimum.reduceat(place, starts)], np.add.reduceat(n, starts)


def _runs(buckets: int, run_rows: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, piece = TaskContext.get().partitionId(), 0
        keys: list[bytes] = []
        ids: list[np.ndarray] = []

        def blocks() -> pa.RecordBatch:
            key, each = np.array(keys, dtype=f"S{KEY_BYTES}"), np.concatenate(ids)
            order = np.lexsort((each, key))
            key, each = key[order], each[order]
            starts = _starts(key)
            counts = np.diff(np.append(starts, len(key)))
            distinct = key[starts]
            lead = np.frombuffer(distinct.tobytes(), dtype=">u4")[::KEY_BYTES // 4]
            bucket = (lead.astype(np.int64) * buckets) >> 32
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            out: list[tuple] = []
            for b in np.flatnonzero(np.diff(edges)):
                lo, hi = edges[b], edges[b + 1]
                end = starts[hi] if hi < len(starts) else len(key)
                out.append((int(b), run, piece, distinct[lo:hi].tobytes(), each[starts[lo:hi]].astype("<i8").tobytes(),
                            np.full(hi - lo, run << PIECE_BITS | piece, "<i8").tobytes(), counts[lo:hi].astype("<i8").tobytes(),
                            each[starts[lo]:end].astype("<i8").tobytes()))
            types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
            names = ["bucket", "run", "piece", "keys", "least", "held", "counts", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys += batch.column(1).to_pylist()
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            if len(keys) >= run_rows:
                yield blocks()
                keys, ids, piece = [], [], piece + 1
        if keys:
            yield blocks()

    return make


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["run", "piece"])
    merged = merge_runs(*(list(group[c]) for c in ("keys", "least", "held", "counts")))
    return pd.DataFrame([(group["bucket"].iloc[0], group["run"].iloc[0], 0, *(x.tobytes() for x in merged))],
                        columns=["bucket", "run", "piece", "keys", "least", "held", "counts"])


def _merge_last(group: pd.DataFrame) -> pd.DataFrame:
    """Entries of groups of several rows.  They are told apart here, since a task with a second Python step holds a second worker."""
    group = group.sort_values(["run", "piece"])
    key, least, held, n = merge_runs(*(list(group[c]) for c in ("keys", "least", "held", "counts")))
    many = n > 1
    return pd.DataFrame({"key": _padded(key[many]), "keep": least[many], "keep_run": held[many], "size": n[many]})


def _padded(keys: np.ndarray) -> list[bytes]:
    return [keys.tobytes()[i:i + KEY_BYTES] for i in range(0, len(keys) * KEY_BYTES, KEY_BYTES)]


def _open_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of a run with their ids, a long list in parts."""
    for batch in batches:
        for run, piece, keys, counts, ids in zip(*(batch.column(i).to_pylist() for i in range(5))):
            each, n, at, out = _longs([ids]), _longs([counts]), 0, []
            for key, count in zip(_padded(_keys([keys])), n.tolist()):
                for k in range(0, count, IDS_PER_ROW):
                    out.append((run << PIECE_BITS | piece, k == 0, key, each[at + k:at + min(count, k + IDS_PER_ROW)]))
                at += count
            types = [pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                             ["run", "head", "key", "ids"])


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", *, normalise: bool = True, fan_in: int = 8,
                min_buckets: int = 64, bucket_rows: int = 500_000, run_rows: int = 500_000,
                digest_bytes: int = 32) -> DataFrame:
    """One row per row of ``docs``: key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after normalisation (with ``normalise=False``: as they are); null counts as
    empty.  The row with the smallest id stays; a row without an id stays only where no row of its group has one, and
    has a null ``keep_id``.  Of rows that repeat both id and text exactly one is kept.  An empty table gives no rows;
    other columns are not read.  ``digest_bytes`` weakens the digest, for tests of the verification.
    """
    run, sha = F.col(key).cast("long"), F.col(text)
    norm = normalised(sha) if normalise else F.coalesce(sha, F.lit(""))
    base = docs.select(run.alias("id"), norm.alias("t"))
    digest = F.unhex(F.rpad(F.substring(F.sha2("t", 256), 1, 2 * digest_bytes), 64, "0"))
    check = F.unhex(F.concat(F.lpad(F.hex(F.octet_length("t").cast("long")), 16, "0"),
                             F.lpad(F.hex(F.xxhash64("t")), 16, "0")))
    entries = base.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), F.concat(digest, check).alias("key"))
    rows = docs.select(F.count(F.lit(1))).first()[0]
    buckets = max(min_buckets, 1 << max(0, -(-rows // bucket_rows) - 1).bit_length())
    runs = written(entries.mapInArrow(tidy(_runs(buckets, run_rows)), _BLOCK), "digest-runs")
    last = runs.agg(F.max("run")).first()[0] or 0
    span, level = 1, runs.drop("ids")
    while span * fan_in <= last:
        span *= fan_in
        level = level.groupBy("bucket", (F.col("run") / span).cast("long").alias("_g")).applyInPandas(_merge, _MERGED)
    final = level.groupBy("bucket").applyInPandas(_merge_last, "key binary, keep long, keep_run long, size long")
    opened = runs.select("run", "piece", "keys", "counts", "ids").mapInArrow(
        _open_runs, "run long, head boolean, key binary, ids array<long>")
    placed = opened.join(final, "key", "left").select(
        "key", F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("keep", F.element_at("ids", 1)).alias("keep"),
        (F.coalesce("keep_run", "run") == F.col("run")).alias("own"), "head", F.posexplode("ids").alias("at", "id"))
    blank = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return placed.select(
        blank("id").alias(key), blank("keep").alias("keep_id"), "group_size",
        (F.col("own") & F.col("head") & (F.col("at") == 0) & (F.col("id") == F.col("keep"))).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    sha, twin = fresh(docs, "sha", "twin")
    verdict = written(exact_dedup(docs, key, text, **options), "digest-verdicts")
    named = verdict.select(F.col(key).alias(twin), F.col("text_sha256").alias(f"{twin}s"), "keep_id", "kept")
    gone = named.where(~F.col("kept") & ~F.col(twin).eqNullSafe(F.col("keep_id")))
    again = named.where(~F.col("kept") & F.col(twin).eqNullSafe(F.col("keep_id"))).select(twin, f"{twin}s").distinct()
    norm = normalised(F.col(text)) if options.get("normalise", True) else F.coalesce(F.col(text), F.lit(""))
    marked = docs.withColumn(sha, F.sha2(norm, 256))
    same = lambda other: F.col(key).eqNullSafe(other[twin]) & (F.col(sha) == other[f"{twin}s"])
    left = marked.join(gone, same(gone), "left_anti")
    if not again.isEmpty():
        once = left.join(again, same(again), "left_semi").dropDuplicates([key, sha])
        left = left.join(again, same(again), "left_anti").unionByName(once)
    return left.drop(sha)
