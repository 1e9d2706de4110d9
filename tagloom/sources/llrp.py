"""Binary tag reports: framing of captures into messages, and decoding of report messages.

Both jobs run over a table of binaries.  Spark spreads the rows; the Python
inside a task looks at one message or capture at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Size of a message header and the range of lengths it may state.
HEADER_BYTES = 10
MAX_MESSAGE_BYTES = 1024 * 1024

PAGE_BYTES = 8 * 1024 * 1024  # of frames that leave a task together
_TAGS = "array<struct<tag_no:int,epc:string,rssi:float,antenna_port:int>>"


@dataclass(frozen=True)
class ReportCodes:
    """Numbers that identify the message and its parameters.

    The defaults are those of the readers in the field.  The public protocol
    standard assigns ``epc96=(13,)``, ``peak_rssi=6`` and ``antenna=1``.
    """

    report: int = 61
    tag: int = 240
    epc_data: int = 241
    epc96: tuple[int, ...] = (12, 13)
    peak_rssi: int = 90
    antenna: int = 93
    default_rssi: float = -50.0
    default_antenna: int = 1


class _Malformed(Exception):
    """A length field lies outside the message buffer."""


def _u16(data: bytes, at: int) -> int:
    if at + 2 > len(data):
        raise _Malformed
    return int.from_bytes(data[at:at + 2], "big")


def _parameters(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(type, body start, body end) of each length-prefixed parameter up to the first bad length."""
    while at + 4 <= end:
        size = _u16(data, at + 2)
        if size == 0 or at + size > end:
            return
        yield _u16(data, at) & 0x3FF, at + 4, at + size
        at += size


def _short_fields(codes: ReportCodes) -> dict[int, int]:
    """Body length of each one-byte-headed field."""
    return {**{code: 12 for code in codes.epc96}, codes.peak_rssi: 1, codes.antenna: 2}


def _tag(data: bytes, at: int, end: int, codes: ReportCodes, short: dict[int, int]) -> tuple[str, float, int]:
    """EPC, signal and antenna of one tag report; the last value of a field counts."""
    epc, rssi, antenna = "", codes.default_rssi, codes.default_antenna
    while at < end:
        if data[at] & 0x80:
            code = data[at] & 0x7F
            size = short.get(code)
            if size is None or at + 1 + size > end:
                at += 1
                continue
            body = data[at + 1:at + 1 + size]
            if code == codes.peak_rssi:
                rssi = float(int.from_bytes(body, "big", signed=True))
            elif code == codes.antenna:
                antenna = int.from_bytes(body, "big")
            else:
                epc = body.hex().upper()
            at += 1 + size
            continue
        found = next(_parameters(data, at, end), None)
        if found is None:
            break
        kind, start, at = found
        if kind == codes.epc_data and start < end:
            size = (_u16(data, start) + 7) // 8
            if start + 2 + size <= end:
                epc = data[start + 2:start + 2 + size].hex().upper()
    return epc, rssi, antenna


def report_tags(data: bytes | None, codes: ReportCodes) -> list[tuple[str, float, int]]:
    """Every tag of one report message, of one that is cut short those that are whole; nothing for other messages."""
    if data is None or len(data) < HEADER_BYTES:
        return []
    data = bytes(data)
    length = int.from_bytes(data[2:6], "big")
    if _u16(data, 0) & 0x3FF != codes.report:
        return []
    length = min(length, len(data))
    short = _short_fields(codes)
    try:
        tags = [_tag(data, start, end, codes, short)
                for kind, start, end in _parameters(data, HEADER_BYTES, length) if kind == codes.tag]
    except _Malformed:
        return []
    return [tag for tag in tags if tag[0]]


def decode_llrp_reports(df: DataFrame, message: str = "message", *, codes: ReportCodes | None = None) -> DataFrame:
    """One row per tag of each report message, with its position ``tag_no``; other columns are kept."""
    codes = codes or ReportCodes()

    @F.pandas_udf(_TAGS)
    def decode(messages: pd.Series) -> pd.Series:
        return messages.map(lambda m: [{"tag_no": n, "epc": epc, "rssi": rssi, "antenna_port": antenna}
                                       for n, (epc, rssi, antenna) in enumerate(report_tags(m, codes))])

    # Python sees the messages alone, so the other columns keep their values whatever their types.
    kept = [c for c in df.columns if c != message]
    return df.select(*kept, F.inline(decode(F.col(message))))


def capture_messages(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """Messages of a capture in order, and whether one is cut short; a bad length skips its header only.

    Only the last one can be cut: what is there of it comes as it is.
    """
    at = 0
    while at + HEADER_BYTES <= len(data):
        size = int.from_bytes(data[at + 2:at + 6], "big")
        if not HEADER_BYTES <= size <= MAX_MESSAGE_BYTES:
            at += HEADER_BYTES
            continue
        yield data[at:at + size], at + size > len(data)
        at += size


def split_llrp_capture(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Cut byte captures, such as ``binaryFile`` rows, into ``(path, frame_no, message, truncated)``.

    Framing is sequential within a capture, so the unit of parallelism is the
    capture file.  Frames leave the task in Arrow batches of some megabytes.  A last
    message that is cut short comes with ``truncated``; the decoder takes the
    tags that are whole in it.
    """
    schema = T.StructType([df.schema[path], T.StructField("frame_no", T.LongType()),
                           T.StructField("message", T.BinaryType()), T.StructField("truncated", T.BooleanType())])

    def frame(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [path, "frame_no", "message", "truncated"]
        for batch in batches:
            for name, data in zip(batch[path], batch[content]):
                page: list[tuple] = []
                held = 0
                for n, (message, cut) in enumerate(capture_messages(bytes(data))):
                    page.append((name, n, message, cut))
                    held += len(message) + 100
                    if held >= PAGE_BYTES:
                        yield pd.DataFrame(page, columns=names)
                        page, held = [], 0
                if page:
                    yield pd.DataFrame(page, columns=names)

    return df.select(path, content).mapInPandas(frame, schema)
