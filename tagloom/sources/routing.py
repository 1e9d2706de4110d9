"""From mixed raw messages to one normalized read table."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import READ_SCHEMA
from .frames import decode_identium_frames, decode_vendor_reports
from .llrp import decode_llrp_reports
from .text import decode_mqtt_messages, decode_text_lines

Decoder = Callable[[DataFrame], DataFrame]

_CARRIED = ("seq", "reader_id", "provider_id", "eval_ts")
_DECODED = ("epc", "tid", "rssi", "antenna_port", "location", "extra_metadata")


def _text(df: DataFrame) -> DataFrame:
    return decode_text_lines(df.select(*_carried(df), F.col("text").alias("line")))


def _mqtt(df: DataFrame) -> DataFrame:
    return decode_mqtt_messages(df.select(*_carried(df), "topic", F.col("text").alias("payload")))


def _identium(df: DataFrame) -> DataFrame:
    return decode_identium_frames(df.select(*_carried(df), F.col("body").alias("frame")))


def _llrp(df: DataFrame) -> DataFrame:
    return decode_llrp_reports(df.select(*_carried(df), F.col("body").alias("message")))


def _vendor(df: DataFrame) -> DataFrame:
    return decode_vendor_reports(df.select(*_carried(df), "report.*"))


def _carried(df: DataFrame) -> list[str]:
    return [c for c in _CARRIED if c in df.columns]


# The provider ids of the known readers.
PROVIDERS: dict[str, Decoder] = {
    "tcp-socket": _text, "udp-socket": _text, "serial-com": _text, "mqtt-broker": _mqtt,
    "llrp": _llrp, "identium": _identium, "impinj": _vendor, "zebra": _vendor,
}


def register(providers: Mapping[str, Decoder], provider_id: str, decoder: Decoder) -> dict[str, Decoder]:
    """Providers plus one more; an id that is already taken, in any case, keeps its decoder."""
    known = {p.lower() for p in providers}
    return dict(providers) if provider_id.lower() in known else {**providers, provider_id: decoder}


def route_by_provider(raw: DataFrame, providers: Mapping[str, Decoder] | None = None) -> tuple[DataFrame, DataFrame]:
    """Decode a mixed message table by its ``provider_id``, ignoring case.

    The table has ``seq, reader_id, provider_id`` and the message in ``text``,
    ``topic``, ``body`` (binary) or ``report`` (struct).  Returns the decoded
    reads and the quarantined rows of unknown providers.  Several reads of one
    message share its ``seq`` and differ in ``tag_no``: number them by both with
    ``ordering.number_reads`` ahead of the stateful operators.  Providers that share a
    decoder share a scan; a table partitioned by provider is pruned per branch.
    """
    providers = PROVIDERS if providers is None else providers
    by_decoder: dict[Decoder, list[str]] = {}
    for provider_id, decoder in providers.items():
        by_decoder.setdefault(decoder, []).append(provider_id.lower())
    provider = F.lower("provider_id")
    decoded = None
    for decoder, ids in by_decoder.items():
        branch = _conform(decoder(raw.where(provider.isin(ids))))
        decoded = branch if decoded is None else decoded.unionByName(branch)
    known = [p.lower() for p in providers]
    quarantine = raw.where(provider.isNull() | ~provider.isin(known))
    return decoded, quarantine


def _conform(df: DataFrame) -> DataFrame:
    """The decoded columns in one order, missing ones as NULL."""
    types = {f.name: f.dataType for f in READ_SCHEMA}
    fields = [F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in _DECODED]
    place = F.col("tag_no") if "tag_no" in df.columns else F.lit(0)
    return df.select(*_carried(df), *fields, place.alias("tag_no"))


def normalize_reads(df: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """Fill the read layout: missing columns and NULLs take the record's defaults."""
    now = ingest_ts if ingest_ts is not None else \
        (F.col("eval_ts") if "eval_ts" in df.columns else F.current_timestamp())
    defaults = {"eval_ts": now, "antenna_port": F.lit(1), "rssi": F.lit(0.0), "read_count": F.lit(1),
                "first_seen": now, "last_seen": now,
                "extra_metadata": F.create_map().cast("map<string,string>")}
    columns = []
    for field in READ_SCHEMA:
        column = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name in defaults:
            column = F.coalesce(column, defaults[field.name])
        columns.append(column.cast(field.dataType).alias(field.name))
    return df.select(*columns)
