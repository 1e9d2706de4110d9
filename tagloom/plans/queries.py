"""One query per operator over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.clock import shift_id
from ..operators import batching as B
from ..operators import dedup as D
from ..operators import lookup as L
from ..operators import outbox as O
from ..operators import payload as Y
from ..operators import pipeline as C
from ..operators import requests as R
from ..operators import telemetry as M
from ..operators.ordering import number_reads
from ..schema import DailyRule, DispatchConfig, FilterConfig, MetadataRule, ScheduleRule, SlidingRule
from ..sources import captures as SP
from ..sources import frames as SF
from ..sources import llrp as SL
from ..sources import routing as SR
from ..sources import text as ST
from ..streaming import batches as SB
from ..streaming import carry as SC
from ..streaming import dedup as SD
from ..streaming import live as SV
from . import tables as T

Query = Callable[[SparkSession, str], DataFrame]

HOUR = 3600
ORIGIN_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
KOLKATA = "Asia/Kolkata"
BATCH_SIZE, PERIOD_MS = 20, HOUR * 1000
CHAIN = FilterConfig(sliding_window_seconds=6 * HOUR, sliding_scope="global", daily_unique=True, daily_scope="global",
                     shift_start=time(6), min_rssi=-75.0, antenna_mask=0b0111, schedule_start=time(8),
                     schedule_end=time(20), tz=KOLKATA)
METADATA = MetadataRule(min_rssi=-75.0, antenna_mask=0b1011, min_length=10, max_length=24, prefix="e280",
                        suffix="5", regex="0[0-7]5$")
SHIFT = DailyRule(time(6), KOLKATA)
TEMPLATE = """{"gate":"{{ config.deviceId }}","tx":"{{ transaction_id }}","n":{{ tags.size }},"reads":[
{% for tag in tags %}{"epc":"{{ tag.epc }}","rssi":{{ tag.RSSI }},"at":"{{ tag.firstSeenTime | date: '%Y-%m-%dT%H:%M:%SZ' }}"}\
{% unless forloop.last %},{% endunless %}{% endfor %}]}"""
HEADERS = {"Content-Type": "text/plain", "x-tx": "tx {{ TRANSACTION_ID }}", "X-TX": "id={{ transaction_id }}",
           "X-Gate": "north"}
TARGET = "https://example.org/api?site=7#top"


def micros(name: str) -> Column:
    return F.unix_micros(name).alias(name)


def rounded(name: str, digits: int = 2) -> Column:
    return F.round(F.col(name).cast("double"), digits).alias(name)


# -- sources

def decode_text_lines(spark, sf):
    return ST.decode_text_lines(T.lines(spark, sf)).select("seq", "epc", "tid", rounded("rssi"), "antenna_port")


def decode_mqtt_messages(spark, sf):
    return ST.decode_mqtt_messages(T.mqtt_messages(spark, sf)).select(
        "seq", "epc", "tid", rounded("rssi"), "antenna_port", F.col("extra_metadata")["MqttTopic"].alias("topic"))


def decode_identium_frames(spark, sf):
    return SF.decode_identium_frames(T.frames(spark, sf)).select(
        "seq", "reader_id", "epc", rounded("rssi"), "antenna_port", "location")


def decode_llrp_reports(spark, sf):
    return SL.decode_llrp_reports(T.report_messages(spark, sf)).select(
        F.col("seq").alias("message_no"), "tag_no", "epc", rounded("rssi"), "antenna_port")


def split_llrp_capture(spark, sf):
    return SL.split_llrp_capture(T.captures(spark, sf)).select("path", "frame_no", F.hex("message").alias("message_hex"))


def split_capture_files(spark, sf):
    """Captures of a thousand messages as files, each framed in many blocks."""
    folder = SC.shared_folder(spark, "captures")
    SP.write_captures(T.captures(spark, sf, 1024), folder)
    return SP.split_capture_files(spark, folder, block_bytes=16_384).select(
        F.element_at(F.split("path", "/"), -1).alias("path"), "frame_no", F.hex("message").alias("message_hex"), "truncated")


def decode_vendor_reports(spark, sf):
    return SF.decode_vendor_reports(T.vendor_reports(spark, sf)).select(
        "seq", "reader_id", "epc", rounded("rssi"), "antenna_port", "tid")


def split_lines(spark, sf):
    return ST.split_lines(T.chunks(spark, sf)).select("stream_id", "line_no", "line")


def route_by_provider(spark, sf):
    decoded, quarantine = SR.route_by_provider(T.mixed_messages(spark, sf))
    good = decoded.select("seq", "reader_id", F.lower("provider_id").alias("provider_id"), "epc", rounded("rssi"),
                          "antenna_port", F.col("extra_metadata")["MqttTopic"].alias("topic"),
                          F.lit("decoded").alias("outcome"))
    bad = quarantine.select("seq", "reader_id", "provider_id", F.lit("quarantine").alias("outcome"))
    both = good.unionByName(bad, allowMissingColumns=True)
    return both.withColumn("antenna_port", F.coalesce("antenna_port", F.lit(0)))


def normalize_reads(spark, sf):
    partial = T.reads(spark, sf).select(
        "seq", "eval_ts", "epc", "reader_id", F.when(F.col("seq") % 2 == 0, F.col("antenna_port")).alias("antenna_port"))
    return SR.normalize_reads(partial).select(
        "seq", "epc", "tid", "user_memory", "antenna_port", rounded("rssi"), "read_count", micros("first_seen"),
        micros("last_seen"), "reader_id", "location", F.size("extra_metadata").alias("metadata_size"))


# -- stateless filters

def _kept(dropped: Callable[[], Column]) -> Query:
    def query(spark, sf):
        return T.reads(spark, sf).where(~dropped()).select("seq", "epc", "antenna_port", rounded("rssi"))
    return query


def metadata_filter(spark, sf):
    return C.metadata_filter(T.reads(spark, sf), METADATA).select("seq", "drop_stage", "drop_code", "drop_reason")


def schedule_filter(spark, sf):
    rule = ScheduleRule(("Monday", "Wednesday", "Saturday"), time(22), time(6), KOLKATA)
    return C.schedule_filter(T.reads(spark, sf), rule).select("seq", "drop_code", "drop_reason")


# -- stateful dedup

def sliding_dedup(spark, sf):
    return D.sliding_dedup(T.reads(spark, sf), SlidingRule(6 * HOUR, "global")).select("seq", "epc")


def sliding_dedup_reader(spark, sf):
    return D.sliding_dedup(T.reads(spark, sf), SlidingRule(12 * HOUR, "reader")).select("seq", "epc", "reader_id")


def sliding_dedup_antenna(spark, sf):
    return D.sliding_dedup(T.reads(spark, sf), SlidingRule(48 * HOUR, "antenna")).select(
        "seq", "epc", "reader_id", "antenna_port")


def shift_ids(spark, sf):
    return T.reads(spark, sf).select("seq", shift_id(F.col("eval_ts"), KOLKATA, time(6)).alias("shift_id"))


def daily_unique(spark, sf):
    return D.daily_unique(T.reads(spark, sf), SHIFT).select("seq", "epc", "shift_id")


def decode_then_daily_unique(spark, sf):
    """From raw messages of several tags each to the first read of each tag per shift."""
    decoded, _ = SR.route_by_provider(T.tag_messages(spark, sf))
    numbered = number_reads(decoded, ["seq", "tag_no"])
    return D.daily_unique(numbered, SHIFT, rescan=False).select("seq", "epc", "shift_id")


def shift_rollovers(spark, sf):
    return D.shift_rollovers(T.reads(spark, sf), SHIFT).select("seq", "previous_shift_id", "shift_id")


def active_key_counts(spark, sf):
    return D.active_key_counts(T.reads(spark, sf), SHIFT)


def live_sliding_keys(spark, sf):
    as_of = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    return D.live_sliding_keys(T.reads(spark, sf), SlidingRule(6 * HOUR, "global"), as_of)


# -- chain

def _chain(spark, sf):
    return C.default_pipeline(T.reads(spark, sf), CHAIN)


def filter_pipeline(spark, sf):
    rules = [MetadataRule(min_rssi=-70.0), DailyRule(time(6), KOLKATA, "reader"), SlidingRule(12 * HOUR, "reader")]
    return C.filter_pipeline(T.reads(spark, sf), rules).select("seq", "drop_stage", "drop_code")


def default_pipeline(spark, sf):
    return _chain(spark, sf).select("seq", "epc", "drop_stage", "drop_code", "drop_reason")


def pipeline_counters(spark, sf):
    return C.pipeline_counters(_chain(spark, sf))


def drop_report(spark, sf):
    return C.drop_report(_chain(spark, sf))


def custom_stage(spark, sf):
    rules = [C.CustomRule("EvenReaders", F.regexp_extract("reader_id", r"(\d+)$", 1).cast("int") % 2 == 0),
             SlidingRule(6 * HOUR, "global")]
    return C.filter_pipeline(T.reads(spark, sf), rules).select("seq", "drop_stage", "drop_code")


def lineitem_shift_counts(spark, sf):
    return D.active_key_counts(T.lineitem_reads(spark, sf), DailyRule(scope="reader"))


# -- lookups

def enrich_with_reader(spark, sf):
    return L.enrich_with_reader(T.reads(spark, sf), T.registry(spark, sf)).select(
        "seq", "reader_id", "provider_id", "brand_name")


def status_with_provider(spark, sf):
    return L.status_with_provider(T.status(spark, sf).withColumn(
        "reader_id", F.when(F.col("seq") % 10 == 0, F.lit("reader-x")).otherwise(F.col("reader_id"))),
        T.registry(spark, sf)).select("seq", "reader_id", "new_state", "provider_id")


# -- batches

def batch_instant(spark, sf):
    return B.batch_instant(T.reads(spark, sf)).select("seq", "batch_id", "batch_pos")


def batch_periodic(spark, sf):
    return B.batch_periodic(T.reads(spark, sf), BATCH_SIZE, PERIOD_MS, origin_us=ORIGIN_US).select(
        "seq", "batch_id", "batch_pos")


def batch_count(spark, sf):
    return B.batch_count(T.reads(spark, sf), BATCH_SIZE).select("seq", "batch_id", "batch_pos")


def batch_hybrid(spark, sf):
    return B.batch_hybrid(T.reads(spark, sf), BATCH_SIZE, PERIOD_MS, origin_us=ORIGIN_US).select(
        "seq", "batch_id", "batch_pos")


# -- payloads

def _batches(spark, sf):
    return Y.collect_batches(B.batch_count(T.reads(spark, sf), BATCH_SIZE), T.registry(spark, sf))


def _parsed(df: DataFrame, document: Column) -> DataFrame:
    return df.select("batch_id", document.alias("d")).select(
        "batch_id", F.col("d.deviceId").alias("device_id"), F.col("d.location").alias("location"),
        F.col("d.transactionId").alias("transaction_id"), F.col("d.timestamp").alias("sent_at"),
        F.col("d.tagCount").alias("tag_count"), F.posexplode("d.tags").alias("pos", "t")).select(
        "batch_id", "device_id", "location", "transaction_id", "sent_at", "tag_count", "pos",
        F.col("t.epc").alias("epc"), F.coalesce("t.tid", F.lit("")).alias("tid"), F.col("t.antenna").alias("antenna"),
        F.round("t.rssi", 2).alias("rssi"), F.col("t.readCount").alias("read_count"),
        F.col("t.firstSeen").alias("first_seen"))


DOCUMENT = ("deviceId string, location string, transactionId string, timestamp string, tagCount int, tags array<struct<"
            "epc string, tid string, antenna int, rssi double, readCount int, firstSeen string>>")


def render_json_payload(spark, sf):
    return _parsed(Y.render_json_payload(_batches(spark, sf)), F.from_json("payload", DOCUMENT))


def render_xml_payload(spark, sf):
    options = {"rowTag": "batch", "inferSchema": "false"}
    return _parsed(Y.render_xml_payload(_batches(spark, sf)), F.from_xml("payload", DOCUMENT, options))


def render_form_payload(spark, sf):
    return Y.render_form_payload(_batches(spark, sf)).select("batch_id", "payload")


def render_csv_payload(spark, sf):
    return Y.render_csv_payload(_batches(spark, sf)).select("batch_id", "payload")


def render_template(spark, sf):
    return Y.render_template(_batches(spark, sf), TEMPLATE).select("batch_id", "payload")


def inject_headers(spark, sf):
    given = F.create_map(*[F.lit(t) for pair in HEADERS.items() for t in pair])
    rows = _batches(spark, sf).withColumn(
        "headers", R.inject_headers(given, F.col("transaction_id"), F.col("rendered_at")))
    return rows.select("batch_id", F.explode("headers").alias("name", "value"))


def _requests(spark, sf):
    rows = Y.render_form_payload(_batches(spark, sf)).withColumns({
        "target_url": F.lit(TARGET),
        "http_method": F.when(F.col("batch_id").cast("bigint") % 2 == 0, "get").otherwise("post"),
        "headers": F.create_map(*[F.lit(t) for pair in HEADERS.items() for t in pair])})
    return R.requests_for(rows)


def build_requests(spark, sf):
    return _requests(spark, sf).select("batch_id", "http_method", "url", "content_type", "body",
                                       F.size("request_headers").alias("n_headers"))


def select_tag_fields(spark, sf):
    batches = _batches(spark, sf).withColumn("chosen", Y.select_tag_fields(("epc", "reader_id", "antenna_port")))
    return batches.select("batch_id", F.posexplode("chosen").alias("pos", "t")).select(
        "batch_id", "pos", F.to_json("t").alias("tag_json"))


def tag_scan_id(spark, sf):
    return Y.scan_ids(T.reads(spark, sf)).select("seq", "scan_id")


def batch_transaction_id(spark, sf):
    return _batches(spark, sf).select("batch_id", "transaction_id")


# -- outbox

def _posts(spark, sf):
    config = DispatchConfig(target_url="https://example.org/api", headers={"X-Gate": "north"})
    return R.build_requests(Y.render_form_payload(_batches(spark, sf)), config)


def _failing_results(posts: DataFrame) -> DataFrame:
    """A server that refuses every seventh batch."""
    return posts.select("transaction_id", (F.col("batch_id").cast("bigint") % 7 != 0).alias("is_success"))


def spill_failed(spark, sf):
    posts = _posts(spark, sf)
    return O.spill_failed(posts, _failing_results(posts)).select(
        "id", "transaction_id", "http_method", "tag_count", micros("created_at"), "retry_count")


def _outbox(spark, sf):
    """One queued row per batch of reads, numbered from 1, over three targets."""
    batched = B.batch_count(T.reads(spark, sf), BATCH_SIZE)
    return batched.groupBy(F.col("batch_id").cast("bigint").alias("batch_no")).agg(
        F.count(F.lit(1)).cast("int").alias("tag_count"), F.max("eval_ts").alias("created_at")).select(
        (F.col("batch_no") + 1).alias("id"), F.concat(F.lit("tx-"), F.col("batch_no")).alias("transaction_id"),
        F.concat(F.lit("https://example.org/"), F.col("batch_no") % 3).alias("target_url"), "tag_count", "created_at")


def _delivery_log(outbox: DataFrame) -> DataFrame:
    """Up to two attempts per row, of which the second mostly succeeds; every fourth row was not tried."""
    attempts = F.when(F.col("id") % 4 == 0, F.array().cast("array<boolean>")).otherwise(
        F.array(F.lit(False), F.col("id") % 3 != 0))
    return outbox.select("id", F.explode(attempts).alias("is_success"))


def outbox_pending(spark, sf):
    outbox = _outbox(spark, sf)
    return O.outbox_pending(outbox, _delivery_log(outbox)).select(
        "id", "transaction_id", "tag_count", "retry_count", micros("created_at"))


def outbox_peek(spark, sf):
    outbox = _outbox(spark, sf)
    return O.peek(O.outbox_pending(outbox, _delivery_log(outbox)), 20).select("id", "transaction_id")


def _outcomes(outbox: DataFrame) -> DataFrame:
    return outbox.select("id", ((F.col("id") % 97 != 0) | (F.col("id") < 120)).alias("is_success"))


def replay_drain(spark, sf):
    outbox = _outbox(spark, sf)
    return O.replay_drain(outbox, _outcomes(outbox)).select("id", "replay_state")


def replay_drain_target(spark, sf):
    outbox = _outbox(spark, sf)
    return O.replay_drain(outbox, _outcomes(outbox), order_scope="target").select("id", "target_url", "replay_state")


def lossy_server(request: dict) -> tuple[int, str]:
    """In-process receiver that is busy for every 97th row from row 120 on."""
    return (503, "busy") if request["id"] % 97 == 0 and request["id"] >= 120 else (200, "ok")


def replay_waves(spark, sf):
    rows = _outbox(spark, sf).withColumnsRenamed({"created_at": "rendered_at"}).withColumns({
        "http_method": F.lit("POST"), "payload": F.lit("{}"), "headers": F.create_map().cast("map<string,string>")})
    attempts = O.replay_waves(R.requests_for(rows), lossy_server, SC.shared_folder(spark, "waves"))
    return attempts.select("id", "is_success", "http_status", "error_message")


def replay_schedule(spark, sf):
    outbox = _outbox(spark, sf)
    pending = O.outbox_pending(outbox, _delivery_log(outbox))
    return O.replay_schedule(pending, 50).select("id", "send_slot")


def refusing_server(request: dict) -> tuple[int, str]:
    """In-process receiver: some requests get 503, some break the connection."""
    first = request["transaction_id"][0]
    if first == "1":
        raise ConnectionError("connection reset")
    return (503, "busy") if first == "0" else (200, f"{len(request['body'])} bytes")


def dispatch_requests(spark, sf):
    return R.dispatch_requests(_posts(spark, sf), refusing_server).select(
        "transaction_id", "is_success", "http_status", "response", "error_message")


def idempotent_upsert(spark, sf):
    outbox = _outbox(spark, sf)
    delivered = _delivery_log(outbox).where("is_success").select("id").distinct()
    received = outbox.join(delivered, "id").select("transaction_id")
    retries = outbox.unionByName(outbox.withColumn("id", F.col("id") + 1_000_000_000))
    return O.idempotent_upsert(received, retries).select("transaction_id", "id", "tag_count")


# -- telemetry

def latest_reader_status(spark, sf):
    status = T.status(spark, sf).withColumn("reader_id", F.when(
        F.col("reader_id").isin("reader-3", "reader-4"), F.lit("reader-x")).otherwise(F.col("reader_id")))
    return M.latest_reader_status(status, T.registry(spark, sf)).select(
        "reader_id", "provider_id", "state", F.coalesce(F.unix_micros("last_seen"), F.lit(0)).alias("last_seen"))


def health_summary(spark, sf):
    statuses = M.latest_reader_status(T.status(spark, sf), T.registry(spark, sf))
    outbox = _outbox(spark, sf)
    pending = O.outbox_pending(outbox, _delivery_log(outbox))
    summary = M.health_summary(statuses, C.pipeline_counters(_chain(spark, sf)), pending)
    return summary.select("connected_readers", "total_readers", "raw_reads", "filtered_reads", "queued_batches",
                          F.size("readers").alias("listed_readers"))


def reconnect_plan(spark, sf):
    """Events of a reader clock that counts half days; every third one arrives twice."""
    status = T.status(spark, sf).withColumns({
        "ts": F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / (12 * HOUR)) * (12 * HOUR)), "seq": F.col("seq") * 2})
    again = status.where(F.col("seq") % 6 == 0).withColumn("seq", F.col("seq") + 1)
    return M.reconnect_plan(status.unionByName(again)).select("seq", "reader_id", "attempt", "delay_ms")


def telemetry_feed(spark, sf):
    return M.telemetry_feed(_chain(spark, sf)).select("seq", "feed")


def latest_reads(spark, sf):
    return M.latest_reads(T.reads(spark, sf)).select("seq", "epc", "reader_id", micros("eval_ts"))


def rssi_quality_pct(spark, sf):
    return T.reads(spark, sf).select("seq", F.round(M.rssi_quality_pct(F.col("rssi")), 1).alias("quality_pct"))


def throughput_per_second(spark, sf):
    return M.throughput_per_second(T.reads(spark, sf)).select(micros("second"), "reads")


def antenna_distribution(spark, sf):
    return M.antenna_distribution(T.reads(spark, sf)).select("reader_id", "antenna_port", "reads", rounded("avg_rssi"))


def clock_skew(spark, sf):
    ahead = ((F.col("seq") * 7919) % 20011 - 10000) * 1000
    skewed = T.reads(spark, sf).withColumn("first_seen", F.timestamp_micros(F.unix_micros("eval_ts") + ahead))
    return M.clock_skew(skewed)


def regex_test(spark, sf):
    return M.regex_test(T.reads(spark, sf).select("seq", "epc"), "0[0-4][a-c]$")


# -- streams, run over the files the source holds

def _streamed(stream: DataFrame, run) -> DataFrame:
    """Result of a ``foreachBatch`` job: ``run(state folder, sink)`` makes the function."""
    spark = stream.sparkSession
    folder = SC.shared_folder(spark, "stream")
    SC.run_available(stream, run(f"{folder}/state", SC.parquet_sink(f"{folder}/out")), f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").drop("micro_batch")


def _stored(stream: DataFrame) -> DataFrame:
    """Result of a stream appended to a table."""
    folder = SC.shared_folder(stream.sparkSession, "stream")
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out")


def sliding_dedup_stream(spark, sf):
    return _stored(SD.sliding_dedup_stream(T.reads_stream(spark, sf), SlidingRule(6 * HOUR, "global"))).select(
        "seq", "epc")


def daily_unique_stream(spark, sf):
    return _stored(SD.daily_unique_stream(T.reads_stream(spark, sf), SHIFT)).select("seq", "epc", "shift_id")


def throughput_stream(spark, sf):
    return _stored(SV.throughput_stream(T.reads_stream(spark, sf))).select(micros("second"), "reads")


def reader_status_stream(spark, sf):
    folder = SC.shared_folder(spark, "stream")
    SV.reader_status_stream(T.status_stream(spark, sf)).writeStream.outputMode("update").foreachBatch(
        SV.upserts(f"{folder}/out")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return SV.upserted(spark, f"{folder}/out", ["reader_id"]).select("reader_id", "state", micros("last_seen"))


def split_lines_stream(spark, sf):
    return _stored(SV.split_lines_stream(T.chunks_stream(spark, sf), longest=1000)).select("stream_id", "line_no", "line", "quarantined")


def filter_pipeline_stream(spark, sf):
    rules = C.default_rules(CHAIN)
    out = _streamed(T.reads_stream(spark, sf), lambda state, sink: SC.chain_stream(rules, state, sink))
    return C.drop_report(out)


def batch_stream(spark, sf):
    """Batches as later ticks close them, and the open one when its timer goes off."""
    config = DispatchConfig(trigger_mode="hybrid", max_batch_size=BATCH_SIZE, period_ms=PERIOD_MS)
    folder, wait_ms = SC.shared_folder(spark, "stream"), 2000
    SB.run_until_drained(SB.batch_stream(T.reads_stream(spark, sf), config, origin_us=ORIGIN_US, wait_ms=wait_ms),
                         f"{folder}/out", f"{folder}/checkpoint", wait_ms=wait_ms)
    return spark.read.parquet(f"{folder}/out").select("seq", "batch_id", "batch_pos")


QUERIES: dict[str, Query] = {
    "decode_text_lines": decode_text_lines,
    "decode_mqtt_messages": decode_mqtt_messages,
    "decode_identium_frames": decode_identium_frames,
    "decode_llrp_reports": decode_llrp_reports,
    "split_llrp_capture": split_llrp_capture,
    "split_capture_files": split_capture_files,
    "decode_vendor_reports": decode_vendor_reports,
    "split_lines": split_lines,
    "route_by_provider": route_by_provider,
    "normalize_reads": normalize_reads,
    "filter_min_rssi": _kept(lambda: P.rssi_below(-75.0)),
    "filter_antenna_mask": _kept(lambda: P.antenna_masked(5)),
    "filter_epc_length": _kept(lambda: P.epc_shorter(10) | P.epc_longer(24)),
    "filter_epc_prefix": _kept(lambda: P.epc_without_prefix("e280")),
    "filter_epc_suffix": _kept(lambda: P.epc_without_suffix("a")),
    "filter_epc_regex": _kept(lambda: P.epc_not_matching("0[0-7]f$")),
    "metadata_filter": metadata_filter,
    "schedule_days": _kept(lambda: P.day_not_operating(("Monday", "Wednesday", "Friday"), KOLKATA)),
    "schedule_time_window": _kept(lambda: P.outside_hours(time(8), time(18), KOLKATA)),
    "schedule_filter": schedule_filter,
    "sliding_dedup": sliding_dedup,
    "sliding_dedup_reader": sliding_dedup_reader,
    "sliding_dedup_antenna": sliding_dedup_antenna,
    "shift_id": shift_ids,
    "daily_unique": daily_unique,
    "decode_then_daily_unique": decode_then_daily_unique,
    "shift_rollovers": shift_rollovers,
    "active_key_counts": active_key_counts,
    "live_sliding_keys": live_sliding_keys,
    "lineitem_shift_counts": lineitem_shift_counts,
    "filter_pipeline": filter_pipeline,
    "default_pipeline": default_pipeline,
    "pipeline_counters": pipeline_counters,
    "drop_report": drop_report,
    "custom_stage": custom_stage,
    "enrich_with_reader": enrich_with_reader,
    "status_with_provider": status_with_provider,
    "batch_instant": batch_instant,
    "batch_periodic": batch_periodic,
    "batch_count": batch_count,
    "batch_hybrid": batch_hybrid,
    "render_json_payload": render_json_payload,
    "render_form_payload": render_form_payload,
    "render_csv_payload": render_csv_payload,
    "render_xml_payload": render_xml_payload,
    "render_template": render_template,
    "inject_headers": inject_headers,
    "build_requests": build_requests,
    "select_tag_fields": select_tag_fields,
    "tag_scan_id": tag_scan_id,
    "batch_transaction_id": batch_transaction_id,
    "outbox_pending": outbox_pending,
    "outbox_peek": outbox_peek,
    "spill_failed": spill_failed,
    "replay_drain": replay_drain,
    "replay_drain_target": replay_drain_target,
    "replay_waves": replay_waves,
    "replay_schedule": replay_schedule,
    "dispatch_requests": dispatch_requests,
    "idempotent_upsert": idempotent_upsert,
    "latest_reader_status": latest_reader_status,
    "health_summary": health_summary,
    "reconnect_plan": reconnect_plan,
    "telemetry_feed": telemetry_feed,
    "latest_reads": latest_reads,
    "rssi_quality_pct": rssi_quality_pct,
    "throughput_per_second": throughput_per_second,
    "antenna_distribution": antenna_distribution,
    "clock_skew": clock_skew,
    "regex_test": regex_test,
    "sliding_dedup_stream": sliding_dedup_stream,
    "daily_unique_stream": daily_unique_stream,
    "filter_pipeline_stream": filter_pipeline_stream,
    "batch_stream": batch_stream,
    "throughput_stream": throughput_stream,
    "reader_status_stream": reader_status_stream,
    "split_lines_stream": split_lines_stream,
}
