import json

from cases import random_reads, reads
import pytest
from pyspark.sql import functions as F

from tagloom.operators.pipeline import default_pipeline, pipeline_counters
from tagloom.operators.requests import dispatch_requests, requests_for
from tagloom.plans.delivery import Run, clean, compact, deliver, pending, prepare, replay
from tagloom.schema import DispatchConfig, FilterConfig
from tagloom.streaming.dispatch import dispatch_stream

CONFIG = FilterConfig(3, min_rssi=-75.0)


def test_outage_then_recovery(spark, tmp_path):
    """Nothing is lost between the cleaned reads and the receiver."""
    df = reads(spark, random_reads(31, 300))
    run = Run(str(tmp_path))
    registry = spark.createDataFrame([(1, "r1", "llrp", "North")],
                                     "ordinal long, reader_id string, provider_id string, brand_name string")
    clean(df, CONFIG, run)
    expected = pipeline_counters(default_pipeline(df, CONFIG)).first().passed
    dispatch = DispatchConfig(trigger_mode="count", max_batch_size=7)
    requests = prepare(spark, registry, dispatch, run)
    batches = -(-expected // 7)
    assert requests.count() == batches
    assert sum(json.loads(r.body)["tagCount"] for r in requests.collect()) == expected

    def half_down(request):
        if int(request["transaction_id"][0], 16) % 2:
            raise ConnectionError("down")
        return 200, "ok"

    spilled = deliver(spark, half_down, run)
    results = spark.read.parquet(run.results)
    assert spilled.count() == results.where("NOT is_success").count() > 0
    assert spilled.agg(F.sum("tag_count")).first()[0] + sum(
        r.tag_count for r in requests.join(results.where("is_success"), "transaction_id").collect()) == expected

    still = replay(spark, lambda request: (503, "busy"), run, 1)
    assert still.count() == spilled.count() and still.agg(F.max("retry_count")).first()[0] == 1
    assert replay(spark, lambda request: (200, "ok"), run, 2).count() == 0
    assert pending(spark, run).count() == 0


def test_a_second_run_on_a_folder_loses_nothing(spark, tmp_path):
    registry = spark.createDataFrame([(1, "r1", "llrp", "North")],
                                     "ordinal long, reader_id string, provider_id string, brand_name string")
    dispatch = DispatchConfig(trigger_mode="count", max_batch_size=7)

    def down(request):
        raise ConnectionError("down")

    counts = []
    for name, seed in (("a", 31), ("b", 32)):
        run = Run(str(tmp_path), name)
        clean(reads(spark, random_reads(seed, 100)), CONFIG, run)
        prepare(spark, registry, dispatch, run, keys=["reader_id"])
        counts.append(deliver(spark, down, run).count())
        if name == "a":
            assert replay(spark, lambda request: (200, "ok"), run, 1).count() == 0
    assert pending(spark, run).count() == counts[1] > 0
    ids = [r.id for r in spark.read.parquet(run.outbox).orderBy("id").collect()]
    assert ids == list(range(1, sum(counts) + 1))
    assert replay(spark, lambda request: (200, "ok"), run, 2).count() == 0


def test_a_sender_that_hangs_times_out(spark):
    import time
    rows = spark.createDataFrame([("t", "http://x", "POST", "http://x", {"a": "b"}, "text/plain", "b")],
                                 "transaction_id string, target_url string, http_method string, url string, "
                                 "request_headers map<string,string>, content_type string, body string")

    def hang(request):
        time.sleep(30)

    started = time.time()
    got = dispatch_requests(rows, hang, timeout_s=0.5).first()
    assert not got.is_success and got.http_status == 0 and "0.5 s" in got.error_message and time.time() - started < 25


def _requests(spark, first, n):
    rows = spark.range(first, first + n).select(
        F.concat(F.lit("tx-"), "id").alias("transaction_id"), F.lit("https://h.org/a").alias("target_url"),
        F.lit("POST").alias("http_method"), F.lit("{}").alias("payload"), F.lit(1).alias("tag_count"),
        F.col("id").alias("first_seq"), F.timestamp_seconds("id").alias("rendered_at"),
        F.create_map().cast("map<string,string>").alias("headers"))
    return requests_for(rows)


def _senders():
    """Made here, so that they travel to the workers by value: one that is always busy, one that takes even numbers."""
    def down(request):
        return 503, "busy"

    def only_even(request):
        return (200, "ok") if int(request["transaction_id"][3:]) % 2 == 0 else (503, "busy")

    return down, only_even


DOWN, ONLY_EVEN = _senders()


def _queue(df):
    return sorted((r.id, r.transaction_id, r.retry_count, r.run) for r in df.collect())


def test_a_summary_changes_nothing_but_what_is_read(spark, tmp_path):
    """Two folders get the same runs and replays, one of them is summed up in between."""
    plain, summed = str(tmp_path / "plain"), str(tmp_path / "summed")
    for name, first in (("a", 0), ("b", 20)):
        for folder in (plain, summed):
            run = Run(folder, name)
            _requests(spark, first, 10).write.parquet(run.requests)
            deliver(spark, ONLY_EVEN, run)
    for folder in (plain, summed):
        replay(spark, lambda r: (200, "") if r["id"] <= 2 else (503, ""), Run(folder), 1)
    head = compact(spark, Run(summed))
    assert (head.number, sorted(head.runs), head.attempt, head.last_id, head.lowest_id, head.pending) == (1, ["a", "b"], 1, 10, 3, 8)
    assert _queue(pending(spark, Run(summed))) == _queue(pending(spark, Run(plain)))
    for folder in (plain, summed):
        run = Run(folder, "c")
        _requests(spark, 40, 4).write.parquet(run.requests)
        deliver(spark, DOWN, run)
        again = replay(spark, DOWN, Run(folder), 2)
        assert {r.id: r.retry_count for r in again.where("id < 5").collect()} == {3: 2, 4: 0}
        replay(spark, lambda r: (200, "") if r["id"] <= 4 else (503, ""), Run(folder), 3, in_waves=True)
    expected = _queue(pending(spark, Run(plain)))
    assert _queue(pending(spark, Run(summed))) == expected and [x[0] for x in expected] == list(range(5, 15))
    assert [x[2] for x in expected] == [1] + [0] * 9
    head = compact(spark, Run(summed))
    assert (head.number, head.last_id, head.lowest_id, head.pending) == (2, 14, 5, 10)
    assert _queue(pending(spark, Run(summed))) == expected
    with pytest.raises(ValueError):
        deliver(spark, DOWN, Run(summed, "c"))
    with pytest.raises(ValueError):
        replay(spark, DOWN, Run(summed), 2)


def test_a_crash_before_the_head_loses_nothing(spark, tmp_path):
    run = Run(str(tmp_path), "a")
    _requests(spark, 0, 6).write.parquet(run.requests)
    deliver(spark, DOWN, run)
    before = _queue(pending(spark, run))
    spark.range(3).write.parquet(f"{run.summaries}/rows/number=1")  # rows of a summary without a head
    assert _queue(pending(spark, run)) == before
    assert compact(spark, run).number == 1
    assert _queue(pending(spark, run)) == before


def test_live_dispatch_spills_once_and_repeats_the_same_ids(spark, tmp_path):
    source, folder = str(tmp_path / "source"), str(tmp_path / "out")
    for at in (0, 10, 20):
        _requests(spark, at, 10).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)

    def run(checkpoint):
        query = dispatch_stream(stream, ONLY_EVEN, folder, str(tmp_path / checkpoint), availableNow=True)
        query.awaitTermination()
        return sorted((r.id, r.transaction_id) for r in pending(spark, Run(folder)).collect())

    first = run("one")
    assert [x[0] for x in first] == list(range(1, 16))
    assert sorted(x[1] for x in first) == sorted(f"tx-{i}" for i in range(1, 30, 2))
    again = run("two")  # every micro-batch again, as after a lost checkpoint
    assert sorted(x[1] for x in again) == sorted(x[1] for x in first) and len({x[0] for x in again}) == 15
    assert spark.read.parquet(f"{folder}/results").count() == 30
