"""Fixed-layout binary frames and already parsed vendor reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shortest valid frame, and where its fields lie (first byte is 1).
FRAME_MIN_BYTES = 16
FRAME_RSSI_AT, FRAME_ANTENNA_AT, FRAME_EPC_AT, FRAME_EPC_BYTES = 3, 4, 5, 12
FRAME_LOCATION = "Identium Gate 1"


def _byte(frame: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(frame, at, 1)), 16, 10).cast("int")


def decode_identium_frames(df: DataFrame, frame: str = "frame", *, location: str = FRAME_LOCATION) -> DataFrame:
    """Decode frames into ``epc, rssi, antenna_port, location``; a short frame yields no row."""
    raw = F.col(frame)
    return df.where(F.octet_length(raw) >= FRAME_MIN_BYTES).withColumns({
        "epc": F.hex(F.substring(raw, FRAME_EPC_AT, FRAME_EPC_BYTES)),
        "rssi": (-_byte(raw, FRAME_RSSI_AT)).cast("float"),
        "antenna_port": _byte(raw, FRAME_ANTENNA_AT),
        "location": F.lit(location),
    }).drop(frame)


def decode_vendor_reports(df: DataFrame, *, epc: str = "epc", rssi: str = "rssi", antenna: str = "antenna_port",
                          tid: str | None = "tid") -> DataFrame:
    """Map the columns of a parsed vendor report onto a read."""
    fields = {"epc": F.col(epc), "rssi": F.col(rssi).cast("float"), "antenna_port": F.col(antenna).cast("int"),
              "tid": F.col(tid) if tid in df.columns else F.lit(None).cast("string")}
    used = {epc, rssi, antenna, tid}
    return df.select(*[c for c in df.columns if c not in used and c not in fields],
                     *[column.alias(name) for name, column in fields.items()])
