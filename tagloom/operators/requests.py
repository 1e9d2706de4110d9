"""Requests that carry the payloads, and sending them."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import iso_utc
from ..schema import DispatchConfig

# The header that lets a receiver recognize a repeated delivery, and the default body type.
IDEMPOTENCY_HEADER = "X-Idempotency-Key"
DEFAULT_CONTENT_TYPE = "application/json"

_HEADERS = "map<string,string>"


def _literal(text: Column) -> Column:
    """Text that is safe as a replacement string."""
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def inject_headers(headers: Column, transaction_id: Column, now: Column) -> Column:
    """Header map with its placeholders filled and the idempotency key added if absent.

    Names ignore case: of repeated names the first spelling and the last value
    remain.
    """
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast(_HEADERS)))

    def same(name: Column) -> Column:
        return F.filter(entries, lambda e: F.lower(e["key"]) == F.lower(name))

    names = F.transform(F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"]))),
                        lambda lower: same(lower)[0]["key"])

    def fill(value: Column) -> Column:
        value = F.regexp_replace(value, F.lit(r"(?i)\{\{ timestamp_utc \}\}"), _literal(iso_utc(now)))
        return F.regexp_replace(value, F.lit(r"(?i)\{\{ transaction_id \}\}"), _literal(transaction_id))

    filled = F.map_from_entries(F.transform(
        names, lambda name: F.struct(name, fill(F.element_at(same(name), -1)["value"]))))
    missing = ~F.exists(names, lambda name: F.lower(name) == IDEMPOTENCY_HEADER.lower())
    return F.when(missing, F.map_concat(filled, F.create_map(F.lit(IDEMPOTENCY_HEADER), transaction_id))) \
        .otherwise(filled)


def _escaped(text: Column) -> Column:
    """Characters that a URL cannot hold, percent-encoded; the rest as is."""
    illegal = r"""[^\x21\x23-\x3b\x3d\x3f-\x5b\x5d\x5f\x61-\x7a\x7e]"""
    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    encoded = F.array_join(F.transform(characters, lambda c: F.when(
        c.rlike(illegal), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)), "")
    return F.when(text.rlike(illegal), encoded).otherwise(text)


def _get_url(url: Column, payload: Column) -> Column:
    """Target URL with the payload appended to its query."""
    text = F.coalesce(payload, F.lit(""))
    query = F.when(text.rlike(r"^\s*$"), F.lit("")).otherwise(_escaped(F.regexp_replace(text, r"^\?+", "")))
    stem = F.regexp_extract(url, r"^([^?#]*)", 1)
    stem = F.when(stem.rlike(r"^[^/]+://[^/]+$"), F.concat(stem, F.lit("/"))).otherwise(stem)
    old = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    joined = F.when(old == "", query).otherwise(F.concat(F.regexp_replace(old, r"^\?+", ""), F.lit("&"), query))
    return F.concat(stem, F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined)), fragment)


def build_requests(batches: DataFrame, config: DispatchConfig) -> DataFrame:
    """Add ``http_method, target_url, url, headers, content_type, body`` to rendered batches.

    ``target_url`` is the configured target; ``url`` is what is called.  A GET
    puts the payload into the query and has no body.
    """
    pairs = [F.lit(text) for pair in config.headers.items() for text in pair]
    given = F.create_map(*pairs) if pairs else F.create_map().cast(_HEADERS)
    return requests_for(batches.withColumns({
        "target_url": F.lit(config.target_url), "http_method": F.lit(config.http_method), "headers": given}))


def requests_for(rows: DataFrame) -> DataFrame:
    """Complete rows with ``target_url, http_method, payload, headers, transaction_id, rendered_at``."""
    method = F.upper("http_method")
    is_get = method == "GET"
    url = F.col("target_url")
    injected = rows.withColumns({
        "url": F.when(is_get, _get_url(url, F.col("payload"))).otherwise(url),
        "http_method": method,
        "body": F.when(~is_get, F.coalesce("payload", F.lit(""))),
        "_all": inject_headers(F.col("headers"), F.col("transaction_id"), F.col("rendered_at")),
    })
    content_types = F.map_values(F.map_filter("_all", lambda k, _: F.lower(k) == "content-type"))
    return injected.withColumns({
        "content_type": F.when(~is_get, F.coalesce(F.get(content_types, F.lit(0)), F.lit(DEFAULT_CONTENT_TYPE))),
        "request_headers": F.map_filter("_all", lambda k, _: F.lower(k) != "content-type"),
    }).drop("_all")


RESULT_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()), T.StructField("target_url", T.StringType()),
    T.StructField("is_success", T.BooleanType()), T.StructField("http_status", T.IntegerType()),
    T.StructField("response", T.StringType()), T.StructField("error_message", T.StringType()),
    T.StructField("elapsed_ms", T.DoubleType()),
])

Sender = Callable[[dict], tuple[int, str]]


SEND_TIMEOUT_S = 2.0  # fixed value: how long a delivery may take


def _within(send: Sender, request: dict, seconds: float) -> tuple[int, str]:
    """What the sender returns, or a timeout; a sender that hangs is left behind in its thread."""
    told: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            told.put((True, send(request)))
        except BaseException as error:  # noqa: BLE001 - handed to the caller
            told.put((False, error))

    threading.Thread(target=run, daemon=True).start()
    try:
        fine, outcome = told.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds:g} s") from None
    if not fine:
        raise outcome
    return outcome


def _attempt(send: Sender, request: dict, timeout_s: float = SEND_TIMEOUT_S) -> tuple:
    started = time.perf_counter()
    try:
        status, response = _within(send, request, timeout_s)
        success = 200 <= status < 300
        outcome = (success, int(status), response, None if success else f"HTTP {status}")
    except Exception as error:  # noqa: BLE001 - any failure of the sender is an outcome
        outcome = (False, 0, None, str(error))
    return request["transaction_id"], request["target_url"], *outcome, (time.perf_counter() - started) * 1000


def dispatch_requests(requests: DataFrame, send: Sender, *, partitions: int | None = None,
                      timeout_s: float = SEND_TIMEOUT_S) -> DataFrame:
    """Call ``send(request) -> (status, response)`` once per request; one result row each.

    Success is a 2xx status; an exception, or no answer within ``timeout_s``,
    becomes status 0 with its message.
    ``partitions`` spreads the requests evenly by transaction id.  A lost task is
    sent again, which receivers recognize by the idempotency key.
    """
    names = ["transaction_id", "target_url", "http_method", "url", "request_headers", "content_type", "body"]
    chosen = requests.select(*names)
    if partitions:
        chosen = chosen.repartition(partitions, "transaction_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [_attempt(send, request, timeout_s) for request in frame.to_dict("records")]
            yield pd.DataFrame(rows, columns=RESULT_SCHEMA.names)

    return chosen.mapInPandas(run, RESULT_SCHEMA)
