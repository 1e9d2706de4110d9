import random
from datetime import datetime, timedelta

import pytest
from cases import UTC, read, reads
from pyspark.sql import functions as F

from tagloom.operators.batching import batch_count
from tagloom.operators.outbox import (acknowledge, idempotent_upsert, outbox_pending, peek, replay_drain, replay_schedule,
                                      replay_send, replay_waves, spill_failed)
from tagloom.operators.payload import collect_batches, render_form_payload
from tagloom.operators.pipeline import filter_pipeline, pipeline_counters
from tagloom.operators.requests import build_requests, dispatch_requests, requests_for
from tagloom.operators.telemetry import (antenna_distribution, backoff_ms, clock_skew, health_summary, latest_reader_status,
                                         latest_reads, reconnect_plan, regex_test, rssi_quality_pct, telemetry_feed,
                                         throughput_per_second)
from tagloom.schema import DispatchConfig, MetadataRule

AT = datetime(2026, 7, 20, 8, 30, tzinfo=UTC)


def queue(spark, n, targets=1):
    return spark.range(1, n + 1).select(
        "id", F.concat(F.lit("tx-"), "id").alias("transaction_id"),
        F.concat(F.lit("https://h.org/"), F.col("id") % targets).alias("target_url"), F.lit("POST").alias("http_method"),
        F.lit("{}").alias("payload"), F.lit(1).alias("tag_count"))


def log(spark, rows):
    return spark.createDataFrame(rows, "id long, is_success boolean")


def test_pending_counts_failures_and_skips_delivered(spark):
    got = outbox_pending(queue(spark, 4), log(spark, [(1, False), (1, True), (2, False), (2, False)]))
    assert [(r.id, r.retry_count) for r in got.orderBy("id").collect()] == [(2, 2), (3, 0), (4, 0)]


def test_peek_and_acknowledge_a_thousand(spark):
    outbox = queue(spark, 1000)
    oldest = peek(outbox, 100)
    assert [r.id for r in oldest.collect()] == list(range(1, 101))
    rest = acknowledge(outbox, oldest)
    assert rest.count() == 900 and rest.agg(F.min("id")).first()[0] == 101


@pytest.mark.parametrize("scope", ["global", "target"])
def test_drain_equals_a_loop(spark, scope):
    rng = random.Random(3)
    outcomes = {i: rng.random() < 0.9 for i in range(1, 61)}
    known = {i: ok for i, ok in outcomes.items() if i != 40}
    pending = queue(spark, 60, 3)
    stopped, expected = set(), {}
    for i in range(1, 61):
        lane = i % 3 if scope == "target" else 0
        if lane in stopped:
            expected[i] = "waiting"
        elif known.get(i, False):
            expected[i] = "delivered"
        else:
            expected[i] = "failed"
            stopped.add(lane)
    got = replay_drain(pending, log(spark, list(known.items())), order_scope=scope).collect()
    assert {r.id: r.replay_state for r in got} == expected


def test_drain_without_failures_delivers_all(spark):
    got = replay_drain(queue(spark, 5), log(spark, [(i, True) for i in range(1, 6)]))
    assert {r.replay_state for r in got.collect()} == {"delivered"}


@pytest.mark.parametrize("slice_bits", [22, 2])
def test_schedule_ignores_gaps_in_ids(spark, slice_bits):
    got = replay_schedule(queue(spark, 30).where("id % 3 = 0"), 4, slice_bits=slice_bits).orderBy("id").collect()
    assert [r.send_slot for r in got] == [0] * 4 + [1] * 4 + [2] * 2


def test_outage_and_recovery(spark):
    """Five batches fail during an outage, wait in the outbox and are delivered in order afterwards."""
    registry = spark.createDataFrame([], "ordinal long, reader_id string, provider_id string, brand_name string")
    batches = collect_batches(batch_count(reads(spark, [read(i, i) for i in range(10)]), 2), registry)
    requests = build_requests(render_form_payload(batches), DispatchConfig())

    def down(_):
        raise ConnectionError("down")

    spilled = spill_failed(requests, dispatch_requests(requests, down)).persist()
    assert [(r.id, r.tag_count) for r in spilled.orderBy("id").collect()] == [(i, 2) for i in range(1, 6)]
    again = requests_for(spilled.withColumn("rendered_at", F.col("created_at")))
    attempts = replay_send(again, lambda request: (200, "ok")).persist()
    assert [r.id for r in attempts.where("is_success").orderBy("id").collect()] == [1, 2, 3, 4, 5]
    assert outbox_pending(spilled, attempts.select("id", "is_success")).count() == 0


def test_sending_stops_per_target(spark):
    rows = requests_for(queue(spark, 30, 2).withColumns({"headers": F.create_map().cast("map<string,string>"),
                                                        "rendered_at": F.lit(AT)}))
    attempts = replay_send(rows, lambda r: (500, "") if r["id"] == 7 else (200, "")).collect()
    assert sorted(a.id for a in attempts) == sorted([1, 3, 5, 7, *range(2, 31, 2)])
    assert [a.id for a in attempts if not a.is_success] == [7]


def _waiting(spark, n, targets):
    return requests_for(queue(spark, n, targets).withColumns({"headers": F.create_map().cast("map<string,string>"),
                                                             "rendered_at": F.lit(AT)}))


@pytest.mark.parametrize("largest", [5, 1 << 17])
def test_waves_count_what_one_task_would_have_sent(spark, tmp_path, largest):
    rows = _waiting(spark, 60, 3)

    def send(request):
        if request["id"] in (7, 10, 30, 33):  # 7 and 10 go to one target, 30 and 33 to another, none to the third
            raise ConnectionError("down")
        return 200, "ok"

    def told(attempts):
        return sorted((a.id, a.is_success, a.http_status, a.error_message) for a in attempts.collect())

    expected = told(replay_send(rows, send))
    assert told(replay_waves(rows, send, str(tmp_path), growth=2, largest=largest, slice_bits=3)) == expected
    assert [x[0] for x in expected if not x[1]] == [7, 30]


def test_a_dead_target_costs_one_attempt_and_a_live_one_all_cores(spark, tmp_path):
    rows = _waiting(spark, 2000, 1)

    def dead(request):
        raise ConnectionError("down")

    attempts = replay_waves(rows, dead, f"{tmp_path}/dead")
    assert [(a.id, a.is_success) for a in attempts.collect()] == [(1, False)]
    assert spark.read.parquet(f"{tmp_path}/dead/attempts").count() == 1

    def served(request):
        import os
        return 200 + os.getpid() % 100, "ok"  # tells the worker

    attempts = replay_waves(rows, served, f"{tmp_path}/live", partitions=8).collect()
    assert sorted(a.id for a in attempts) == list(range(1, 2001))
    assert len({a.http_status for a in attempts}) > 1


def test_waves_of_an_empty_queue(spark, tmp_path):
    assert replay_waves(_waiting(spark, 0, 1), lambda r: (200, ""), str(tmp_path)).collect() == []
    with pytest.raises(ValueError):
        replay_waves(_waiting(spark, 1, 1), lambda r: (200, ""), str(tmp_path), growth=1)


def test_upsert_takes_the_first_of_each_new_key(spark):
    incoming = spark.createDataFrame([(5, "a"), (3, "a"), (4, "b"), (6, "c")], "id long, transaction_id string")
    received = spark.createDataFrame([("b",)], "transaction_id string")
    assert sorted(map(tuple, idempotent_upsert(received, incoming).collect())) == [("a", 3), ("c", 6)]


def test_backoff(spark):
    n = spark.range(1, 14)
    plain = [r.d for r in n.select(backoff_ms(F.col("id")).alias("d")).collect()]
    assert plain[:8] == [1000, 2000, 4000, 8000, 16000, 32000, 60000, 60000] and plain[-1] == 60000
    low = n.select(backoff_ms(F.col("id"), F.lit(-0.2), base_ms=100).alias("d")).collect()
    assert low[0].d == 500 and low[4].d == 1280


@pytest.mark.parametrize("slice_bits", [22, 2])
def test_attempts_since_last_connection(spark, slice_bits):
    rng = random.Random(9)
    rows, attempts, expected = [], {}, {}
    for seq in range(300):
        reader = "hot" if rng.random() < 0.4 else rng.choice(["a", "b"])
        state = rng.choice(["Connected", "Reconnecting", "Reconnecting", "Faulted"])
        rows.append((seq, reader, state))
        if state == "Connected":
            attempts[reader] = 0
        elif state == "Reconnecting":
            attempts[reader] = attempts.get(reader, 0) + 1
            expected[seq] = attempts[reader]
    df = spark.createDataFrame(rows, "seq long, reader_id string, new_state string")
    assert {r.seq: r.attempt for r in reconnect_plan(df, slice_bits=slice_bits).collect()} == expected


def _events(spark, states, at=AT):
    return spark.createDataFrame([(n, at, "a", s) for n, s in enumerate(states, 1)],
                                 "seq long, ts timestamp, reader_id string, new_state string")


@pytest.mark.parametrize("slice_bits", [22, 1])
def test_events_of_one_instant_are_all_told_apart(spark, slice_bits):
    df = _events(spark, ["Reconnecting", "Faulted", "Reconnecting", "Connected", "Reconnecting"])
    assert {r.seq: r.attempt for r in reconnect_plan(df, slice_bits=slice_bits).collect()} == {1: 1, 3: 2, 5: 1}


@pytest.mark.parametrize("slice_bits", [22, 1])
def test_events_that_arrive_twice_count_once(spark, slice_bits):
    df = _events(spark, ["Reconnecting", "Reconnecting", "Faulted", "Faulted", "Reconnecting", "Reconnecting", "Connected"])
    assert {r.seq: r.attempt for r in reconnect_plan(df, slice_bits=slice_bits).collect()} == {1: 1, 5: 2}
    unknown = df.withColumn("ts", F.lit(None).cast("timestamp"))
    assert {r.seq: r.attempt for r in reconnect_plan(unknown, slice_bits=slice_bits).collect()} == {1: 1, 2: 2, 5: 3, 6: 4}


def test_health(spark):
    registry = spark.createDataFrame([(1, "a", "llrp"), (2, "b", "zebra")], "ordinal long, reader_id string, provider_id string")
    status = spark.createDataFrame([(1, AT, "a", "Faulted"), (2, AT, "a", "Connected"), (3, AT, "x", "Connected")],
                                   "seq long, ts timestamp, reader_id string, new_state string")
    latest = latest_reader_status(status, registry)
    got = {r.reader_id: (r.provider_id, r.state) for r in latest.collect()}
    assert got == {"a": ("llrp", "Connected"), "b": ("zebra", "Disconnected"), "x": ("Unknown", "Connected")}
    chain = filter_pipeline(reads(spark, [read(1, rssi=-40), read(2, rssi=-90)]), [MetadataRule(min_rssi=-60)])
    row = health_summary(latest, pipeline_counters(chain), queue(spark, 3), uptime_seconds=5).first()
    assert (row.connected_readers, row.total_readers, row.raw_reads, row.filtered_reads, row.queued_batches) == (2, 3, 2, 1, 3)
    assert [r.reader_id for r in row.readers] == ["a", "b", "x"]
    feed = [(r.seq, r.feed) for r in telemetry_feed(chain).collect()]
    assert sorted(feed) == [(1, "filtered"), (1, "raw"), (2, "raw")]


def test_gauges(spark):
    df = reads(spark, [read(1, 0.2, rssi=-100.5), read(2, 0.9, rssi=-60), read(3, 1.0, rssi=-10, antenna=2)])
    assert [r.q for r in df.orderBy("seq").select(rssi_quality_pct(F.col("rssi")).alias("q")).collect()] == [0, 50, 100]
    assert sorted(r.reads for r in throughput_per_second(df).collect()) == [1, 2]
    assert sorted((r.antenna_port, r.reads) for r in antenna_distribution(df).collect()) == [(1, 2), (2, 1)]
    assert [r.seq for r in latest_reads(df, 2).collect()] == [3, 2]
    skewed = df.withColumn("first_seen", F.col("eval_ts") + F.make_dt_interval(secs=F.col("seq")))
    assert clock_skew(skewed).first().median_skew_us == 2_000_000
    assert timedelta(microseconds=clock_skew(skewed).first().max_skew_us) == timedelta(seconds=3)


def test_regex(spark):
    df = spark.createDataFrame([("E2801234",), ("ABCD5678",), ("xe280",)], "epc string")
    assert [r.is_match for r in regex_test(df, "^e280.*").collect()] == [True, False, False]
