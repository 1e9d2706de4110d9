"""Small inputs and the plain state machines that the operators are compared with."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

UTC = timezone.utc
START = datetime(2026, 7, 20, 3, 0, tzinfo=UTC)
SCHEMA = ("seq bigint, eval_ts timestamp, epc string, tid string, antenna_port int, rssi float, read_count int, "
          "reader_id string")


def read(seq: int, seconds: float = 0, epc: str = "E2801", antenna: int = 1, rssi: float = -50.0,
         reader: str = "gate", at: datetime | None = None) -> tuple:
    return (seq, at or START + timedelta(seconds=seconds), epc, None, antenna, float(rssi), 1, reader)


def reads(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def random_reads(seed: int, n: int, *, backwards: bool = True, hot: bool = True) -> list[tuple]:
    """Reads with ties and gaps; a third of them share one key, and the clock may run backwards."""
    rng = random.Random(seed)
    clock, rows = 0.0, []
    for seq in range(n):
        clock += rng.choice([0, 0.5, 1, 2, 5, 9]) - (rng.choice([0, 0, 0, 4]) if backwards else 0)
        epc = "hot" if hot and rng.random() < 0.34 else rng.choice(["a", "A", "b", "c"])
        rows.append(read(seq * rng.choice([1, 1]) + 3, clock, epc, rng.randint(1, 2), -40.0 - rng.randint(0, 40),
                         rng.choice(["r1", "R1", "r2"])))
    return rows


def scope_key(row: tuple, scope: str) -> tuple:
    epc, reader, antenna = row[2].upper(), row[7].upper(), row[4]
    return {"antenna": (epc, reader, antenna), "reader": (epc, reader), "global": (epc,)}[scope]


def sliding_survivors(rows: list[tuple], window: float, scope: str) -> list[int]:
    """A dictionary of last times, walked in arrival order."""
    last, kept = {}, []
    for row in sorted(rows):
        key = scope_key(row, scope)
        gap = (row[1] - last[key]).total_seconds() if key in last else None
        last[key] = row[1]
        if gap is None or gap < 0 or gap >= window:
            kept.append(row[0])
    return kept


def daily_survivors(rows: list[tuple], hours_ahead: float, shift_hour: int, scope: str, arrival: bool) -> list[int]:
    """A set of seen keys, per shift or cleared at every change of shift."""
    seen, current, kept = set(), None, []
    for row in sorted(rows):
        local = row[1].astimezone(UTC).replace(tzinfo=None) + timedelta(hours=hours_ahead)
        shift = (local - timedelta(hours=shift_hour)).date()
        if arrival and shift != current:
            seen, current = set(), shift
        key = scope_key(row, scope) if arrival else (shift, *scope_key(row, scope))
        if key not in seen:
            seen.add(key)
            kept.append(row[0])
    return kept


def queue_batches(rows: list[tuple], mode: str, size: int, period: float, origin: datetime) -> dict[int, tuple]:
    """seq -> (number of the emitted batch, position), from a queue that is drained tick by tick."""
    queue, out, tick, emitted = [], {}, 1, 0

    def flush(limit: int) -> None:
        nonlocal emitted
        taken, queue[:] = queue[:limit], queue[limit:]
        for position, seq in enumerate(taken, 1):
            out[seq] = (emitted, position)
        emitted += bool(taken)

    for row in sorted(rows):
        while mode != "count" and row[1] > origin + timedelta(seconds=period * tick):
            flush(size)
            tick += 1
        queue.append(row[0])
        if mode != "periodic" and len(queue) >= size:
            flush(size)
    while queue:
        flush(size)
    return out
