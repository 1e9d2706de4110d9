"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEPARATOR = "\u001f"


def tag_scan_id(epc: Column, ts: Column, antenna: Column, reader: Column) -> Column:
    """Stable hash of what was read, when, and where."""
    return F.sha2(F.concat_ws(_SEPARATOR, epc, F.unix_micros(ts).cast("string"), antenna.cast("string"), reader), 256)


def batch_transaction_id(scan_ids: Column) -> Column:
    """Stable hash of the ordered scan ids of one batch."""
    return F.sha2(F.array_join(scan_ids, _SEPARATOR), 256)
