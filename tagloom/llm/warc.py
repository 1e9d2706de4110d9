"""WARC archives: a writer of one gzip member per record and a splittable reader.

The reader cuts archives in byte ranges.  A task looks for the gzip magic in its range, takes a candidate for a member
only where decoding it yields the start of a WARC record, and owns the records that start inside the range; the last
one may end beyond.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import open_file, put_file, scratch, written

MAGIC = b"\x1f\x8b\x08"
READ_BYTES = 1 << 20
DAMAGED = "damaged"  # type of rows for bytes that are no member
DATE = "2024-01-01T00:00:00Z"  # archives of equal tables are equal
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "archive string, bytes long, records long"
_RECORDS = ("archive string, at long, record_id string, type string, uri string, refers_to string, digest string, "
            "payload_bytes long, payload binary")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(text: str) -> str:
    """A header value in one line: control characters and blanks in percent form."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(name: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A record as a gzip member; a revisit keeps the HTTP head and leaves the payload out."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{name}>"),
              ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")]
    if uri is not None:
        fields.append(("WARC-Target-URI", _safe(uri)))
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html",
               min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record per row and return the manifest ``(archive, bytes, records)``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` those with the largest id are responses, the others
    revisit it; smaller payloads are always responses.  A null payload is empty, a null url is left out, a row without
    an id is a response of its own that nothing refers to.  Rows that repeat an id are records each.  An empty table
    gives no archive.
    """
    base = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"),
                        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    marked = base.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    groups = (marked.where((F.col("n") >= min_revisit_bytes) & F.col("id").isNotNull())
              .groupBy("sha", "n").agg(F.max("id").alias("kept"), F.count(F.lit(1)).alias("held"))
              .where(F.col("held") > 1).drop("held"))
    told = marked.join(groups, ["sha", "n"], "left").select(
        "id", "url", F.when(F.col("id") < F.col("kept"), F.col("kept")).alias("refers_to"), "payload")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        count = 0

        def members() -> Iterator[bytes]:
            nonlocal count
            for batch in batches:
                for row, uri, refers_to, payload in zip(*(c.to_pylist() for c in batch.columns)):
                    count += 1
                    yield record_bytes(f"none-{count}" if row is None else str(row), uri, payload,
                                       None if refers_to is None else str(refers_to))

        records = members()
        first = next(records, None)
        if first is None:
            return
        size = put_file(name, _with_first(first, records))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([count])],
                                         ["archive", "bytes", "records"])

    return written(told.mapInArrow(write, _MANIFEST), "warc-manifest")


def _with_first(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def _member(source: pa.NativeFile, at: int, size: int, probe: bool) -> tuple[bytes, int] | None:
    """The decoded member at ``at`` and where it ends, or None where none is; ``probe`` stops at a wrong start."""
    unpack, out, pos, head = zlib.decompressobj(31), [], at, b""
    while pos < size:
        source.seek(pos)
        raw = source.read(1 << 14 if pos == at else READ_BYTES)
        try:
            part = unpack.decompress(raw)
        except zlib.error:
            return None
        out.append(part)
        if probe and len(head) < 8:
            head += part[:8]
            if not b"WARC/1.".startswith(head[:7]):
                return None
        pos += len(raw)
        if unpack.eof:
            data = b"".join(out)
            return (data, pos - len(unpack.unused_data)) if data.startswith(b"WARC/1.") else None
    return None


def pieces_from(source: pa.NativeFile, start: int, end: int, size: int) -> Iterator[tuple[int, int, bytes | None]]:
    """What starts in ``[start, end)``: where, where it ends, and the decoded member, or None for bytes that are no member.

    Behind a member the next one is expected at once; bytes up to the next that decodes, or to the end of the range, are
    told as damaged.  Ahead of the first member of a range lies the end of one that another range owns, so they are not
    told there, but at the beginning of the file.
    """
    at, window, base = start, b"", start
    good = 0 if start == 0 else None  # where the next member is due
    while at < end:
        if not base <= at < base + len(window) - len(MAGIC):
            source.seek(at)
            base, window = at, source.read(min(READ_BYTES, size - at))
            if len(window) < len(MAGIC):
                break
        found = window.find(MAGIC, at - base)
        if found < 0:
            at = base + len(window) - (len(MAGIC) - 1) if base + len(window) < size else end
            continue
        at = base + found
        if at >= end:
            break
        member = _member(source, at, size, probe=True)
        if member is None:
            at += 1
            continue
        if good is not None and good < at:
            yield good, at, None
        yield at, member[1], member[0]
        at = good = member[1]
    if good is not None and good < end:
        yield good, end, None


def members_from(source: pa.NativeFile, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """The members that start in ``[start, end)``, each with its place; ``pieces_from`` also tells what is damaged."""
    return ((at, data) for at, _, data in pieces_from(source, start, end, size) if data is not None)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse_record(data: bytes) -> tuple:
    """record id, type, uri, id referred to, payload digest, payload length, payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[:int(fields.get("content-length", len(rest)))]
    http, _, body = block.partition(b"\r\n\r\n")
    name = lambda k: fields.get(k, "").removeprefix("<urn:page:").removesuffix(">") or None
    kind = fields.get("warc-type")
    told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = kind == "revisit"
    size = int(_fields(http).get("content-length", 0)) if revisit else len(body)
    return (name("warc-record-id"), kind, fields.get("warc-target-uri"), name("warc-refers-to"),
            told if revisit else payload_digest(body), size, None if revisit else body)


def read_warc(archives: DataFrame, *, split_bytes: int = 64 << 20, with_payload: bool = True) -> DataFrame:
    """The records of the archives in a table ``(archive, bytes)``, one row each.

    Digest and length of a response come from its payload as read, those of a revisit from its headers.  Bytes behind a
    member that are none are a row of type ``damaged`` with their number as ``payload_bytes``; ``checked`` refuses them.
    A member is decoded whole, so a task needs room for the longest payload.
    """
    ranges = archives.select("archive", "bytes", F.explode(
        F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                page: list[tuple] = []
                held = 0
                with open_file(archive) as source:
                    for at, stop, data in pieces_from(source, start, min(start + split_bytes, size), size):
                        row = (None, DAMAGED, None, None, None, stop - at, None) if data is None else parse_record(data)
                        page.append((archive, at, *(row if with_payload else (*row[:-1], None))))
                        held += len(data) if with_payload and data is not None else 200
                        if held >= 8 << 20:
                            yield _page(page)
                            page, held = [], 0
                if page:
                    yield _page(page)

    # A range is little to shuffle and much to read, so their number is told rather than left to sizes.
    parts = archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    spread = ranges.repartition(int(parts), "archive", "start")
    return spread.mapInArrow(scan, _RECORDS)


def _page(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
    names = ["archive", "at", "record_id", "type", "uri", "refers_to", "digest", "payload_bytes", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def checked(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """``records`` of the archives of ``manifest``, or an error if one has damaged bytes or another number of records than told.

    The comparison reads ``records`` once, so they should be a table.
    """
    bad = F.col("type") == DAMAGED
    found = records.groupBy("archive").agg(F.sum((~bad).cast("long")).alias("found"), F.sum(F.when(bad, F.col("payload_bytes")).otherwise(0)).alias("lost"))
    wrong = manifest.join(found, "archive", "left").select(
        "archive", "records", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("lost", F.lit(0)).alias("lost")) \
        .where("records != found OR lost > 0").orderBy("archive").limit(5).collect()
    if wrong:
        raise ValueError("damaged archives: " + "; ".join(f"{r.archive}: {r.found} of {r.records} records, {r.lost} bytes lost" for r in wrong))
    return records


def archive_round_trip(pages: DataFrame, *, split_bytes: int = 4 << 20, folder: str | None = None, **names) -> DataFrame:
    """Write the pages as archives and read them back: ``page_id``, length and digest of the payload, type, target.

    Archives that don't hold every record whole are an error.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    manifest = write_warc(pages, folder, **names)
    records = checked(written(read_warc(manifest, split_bytes=split_bytes, with_payload=False).drop("payload"), "warc-records"), manifest)
    return records.select(
        F.expr("try_cast(record_id AS long)").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.expr("try_cast(refers_to AS long)").alias("refers_to"))
