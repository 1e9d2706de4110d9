"""Batches as rows, and their payload text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import local_time
from ..functions.ids import batch_transaction_id, tag_scan_id
from ..functions.template import compile_template, field_text
from ..functions.text import iso_utc
from ..schema import DispatchConfig
from .lookup import enrich_with_reader

# The fields of a tag that a payload can carry.
TAG_FIELDS = ("epc", "tid", "user_memory", "antenna_port", "rssi", "read_count", "first_seen", "last_seen",
              "reader_id", "location")

# Member names of the tag documents.
JSON_NAMES = {"epc": "epc", "tid": "tid", "user_memory": "userMemory", "antenna_port": "antenna", "rssi": "rssi",
              "read_count": "readCount", "first_seen": "firstSeen", "last_seen": "lastSeen",
              "reader_id": "readerId", "location": "location"}
DEFAULT_FIELDS = ("epc", "tid", "antenna_port", "rssi", "read_count", "first_seen")

# Header and columns of the CSV payload.
CSV_COLUMNS = {"EPC": "epc", "TID": "tid", "AntennaPort": "antenna_port", "RSSI": "rssi",
               "FirstSeenTime": "first_seen"}


def scan_ids(df: DataFrame) -> DataFrame:
    """Add the stable ``scan_id`` of each read."""
    return df.withColumn("scan_id", tag_scan_id(F.col("epc"), F.col("eval_ts"), F.col("antenna_port"),
                                                F.col("reader_id")))


def collect_batches(batched: DataFrame, registry: DataFrame, *, keys: Sequence[str] = (),
                    rendered_at: Column | None = None, default_brand: str = "RFID Reader", **options) -> DataFrame:
    """One row per batch: ordered ``tags``, ``tag_count``, ``transaction_id`` and the reader of the first tag.

    A batch holds at most the configured number of reads, so the collected lists
    are short.  ``rendered_at`` defaults to the clock of the latest read.
    """
    present = [c for c in TAG_FIELDS if c in batched.columns]
    seen = {c: F.coalesce(F.col(c), F.col("eval_ts")) if c in present else F.col("eval_ts")
            for c in ("first_seen", "last_seen")}
    other = {c: F.col(c) if c in present else F.lit(None).cast("string")
             for c in TAG_FIELDS if c not in seen}
    tag = F.struct("batch_pos", "seq", *[{**seen, **other}[c].alias(c) for c in TAG_FIELDS], "scan_id")
    grouped = scan_ids(batched).groupBy(*keys, "batch_id").agg(
        F.array_sort(F.collect_list(tag)).alias("tags"), F.max("eval_ts").alias("rendered_at"))
    rows = grouped.withColumns({
        "tag_count": F.size("tags"),
        "first_seq": F.col("tags")[0]["seq"],
        "reader_id": F.col("tags")[0]["reader_id"],
        "transaction_id": batch_transaction_id(F.transform("tags", lambda t: t["scan_id"])),
    })
    if rendered_at is not None:
        rows = rows.withColumn("rendered_at", rendered_at)
    return enrich_with_reader(rows, registry, default_brand=default_brand, spread="batch_id", **options)


def select_tag_fields(fields: Sequence[str] = DEFAULT_FIELDS) -> Column:
    """The ``tags`` array reduced to the chosen fields under their payload names."""
    unknown = [f for f in fields if f not in JSON_NAMES]
    if unknown:
        raise ValueError(f"unknown tag fields {unknown}")

    def project(tag: Column) -> Column:
        values = []
        for name in fields:
            value = tag[name]
            if name in ("first_seen", "last_seen"):
                value = F.date_format(local_time(value, "UTC"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
            elif name == "tid":
                value = F.coalesce(value, F.lit(""))
            values.append(value.alias(JSON_NAMES[name]))
        return F.struct(*values)

    return F.transform("tags", project)


def _document(fields: Sequence[str]) -> Column:
    return F.struct(F.col("reader_id").alias("deviceId"), F.col("brand_name").alias("location"),
                    F.col("transaction_id").alias("transactionId"), iso_utc(F.col("rendered_at")).alias("timestamp"),
                    F.col("tag_count").alias("tagCount"), select_tag_fields(fields).alias("tags"))


def render_json_payload(batches: DataFrame, fields: Sequence[str] = DEFAULT_FIELDS) -> DataFrame:
    """Add ``payload``: one JSON document per batch."""
    return batches.withColumn("payload", F.to_json(_document(fields)))


def render_form_payload(batches: DataFrame) -> DataFrame:
    """Add ``payload``: form text of the first tag."""
    first = F.col("tags")[0]
    return batches.withColumn("payload", F.concat(
        F.lit("deviceId="), F.col("reader_id"), F.lit("&transactionId="), F.col("transaction_id"),
        F.lit("&epc="), first["epc"], F.lit("&rssi="), field_text(first, "rssi")))


def render_csv_payload(batches: DataFrame) -> DataFrame:
    """Add ``payload``: a header line and one line per tag."""
    rows = F.transform("tags", lambda t: F.concat(
        F.concat_ws(",", *[field_text(t, c) for c in CSV_COLUMNS.values()]), F.lit("\n")))
    return batches.withColumn("payload", F.concat(F.lit(",".join(CSV_COLUMNS) + "\n"), F.array_join(rows, "")))


def render_xml_payload(batches: DataFrame, fields: Sequence[str] = DEFAULT_FIELDS) -> DataFrame:
    """Add ``payload``: one XML element per batch with a ``tags`` element per tag."""
    return batches.withColumn("payload", F.to_xml(_document(fields), {"rowTag": "batch"}))


def render_template(batches: DataFrame, template: str) -> DataFrame:
    """Add ``payload`` from a user template; a blank one means the JSON document."""
    if not template.strip():
        return render_json_payload(batches)
    return batches.withColumn("payload", compile_template(template))


def render(batches: DataFrame, config: DispatchConfig) -> DataFrame:
    """Payloads in the format of a dispatch configuration."""
    if config.template is not None:
        return render_template(batches, config.template)
    return {"json": render_json_payload, "form": render_form_payload, "csv": render_csv_payload,
            "xml": render_xml_payload}[config.payload_format](batches)
