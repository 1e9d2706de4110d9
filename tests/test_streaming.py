import time
from datetime import timedelta
from functools import partial

import pandas as pd
import pytest
from cases import START, random_reads, reads
from pyspark.sql import functions as F

from tagloom.operators.batching import batch
from tagloom.operators.outbox import first_deliveries
from tagloom.operators.pipeline import filter_pipeline
from tagloom.operators.telemetry import throughput_per_second
from tagloom.schema import DailyRule, DispatchConfig, MetadataRule, SlidingRule
from tagloom.operators.dedup import daily_unique
from tagloom.operators.telemetry import latest_reader_status
from tagloom.sources.text import split_lines
from tagloom.streaming.batches import BatchProcessor, batch_stream, run_until_drained
from tagloom.streaming.carry import _Slots, chain_stream, parquet_sink, run_available, shared_folder
from tagloom.streaming.dedup import daily_unique_stream, dedup_stream, late_reads, sliding_dedup_stream
from tagloom.streaming.live import reader_status_stream, split_lines_stream, throughput_stream, upserted, upserts

ORIGIN_US = int(START.timestamp() * 1_000_000)
CUTS = [0, 60, 61, 200, 320]


@pytest.fixture(scope="module")
def feed(spark):
    """The same reads as a table and as a stream of four files."""
    folder = shared_folder(spark, "feed")
    df = reads(spark, random_reads(21, 320, backwards=False)).persist()
    for low, high in zip(CUTS, CUTS[1:]):
        df.where(F.col("seq").between(low + 3, high + 2)).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)

    def stream():
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return df, stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_chain_over_micro_batches_equals_one_batch(spark, feed):
    df, stream = feed
    folder = shared_folder(spark, "chain")
    rules = [SlidingRule(4, "reader"), DailyRule(scope="antenna"), MetadataRule(min_rssi=-70)]
    run = chain_stream(rules, f"{folder}/state", parquet_sink(f"{folder}/out"))
    run_available(stream(), run, f"{folder}/checkpoint")
    columns = ["seq", "epc", "drop_stage", "drop_code", "drop_reason"]
    got = spark.read.parquet(f"{folder}/out")
    assert got.select("micro_batch").distinct().count() == 4
    assert rows(got.select(*columns)) == rows(filter_pipeline(df, rules).select(*columns))


def test_a_repeated_micro_batch_gives_the_same_result(spark, feed):
    df, _ = feed
    folder = shared_folder(spark, "again")
    rules = [SlidingRule(4, "global")]
    run = chain_stream(rules, f"{folder}/state", parquet_sink(f"{folder}/out"))
    for batch_id, (low, high) in enumerate([(0, 100), (100, 200), (100, 200), (200, 330)]):
        number = {0: 0, 1: 1, 2: 1, 3: 2}[batch_id]
        run(df.where(F.col("seq").between(low + 3, high + 2)), number)
    got = spark.read.parquet(f"{folder}/out").select("seq", "drop_code")
    assert rows(got) == rows(filter_pipeline(df, rules).select("seq", "drop_code"))


class _State:
    """Keyed state of one group in memory."""

    def __init__(self):
        self.held = None

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    put = update

    def clear(self):
        self.held = None


class _Handle:
    def __init__(self):
        self.timers, self.now = set(), 0

    def getListState(self, *_):
        return _State()

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now


@pytest.mark.parametrize("gateway", [None, "reader_id"])
@pytest.mark.parametrize("mode", ["count", "hybrid", "periodic"])
def test_batches_over_micro_batches_equal_one_batch(spark, feed, mode, gateway):
    from tagloom.operators.batching import with_tick
    df, _ = feed
    config = DispatchConfig(trigger_mode=mode, max_batch_size=3, period_ms=7000)
    expected = batch(df, config, origin_us=ORIGIN_US, keys=[gateway] if gateway else []).select("seq", "batch_id", "batch_pos")
    staged = with_tick(df, mode, 7000, ORIGIN_US).selectExpr(f"{gateway or chr(39) + chr(39)} AS g", "seq", "tick", "CAST(seq AS string) AS body").toPandas()
    got, waiting = [], 0
    for name, own in staged.sort_values("seq").groupby("g"):
        processor, handle = BatchProcessor(mode, 3, 50), _Handle()
        processor.init(handle)
        for low, high in zip(CUTS, CUTS[1:]):
            part = own[own["seq"].between(low + 3, high + 2)].sample(frac=1, random_state=1)
            if len(part):
                got += [p for p in processor.handleInputRows((name,), iter([part[:5], part[5:]]), handle)]
        while handle.timers:  # no more input: what waits leaves by timer
            handle.now = min(handle.timers)
            handle.timers.discard(handle.now)
            got += list(processor.handleExpiredTimer((name,), handle, None))
        waiting += len(processor.waiting.held or [])
    out = pd.concat(got)
    told = {(int(b), i, p) for b, i, p in zip(out["body"], out["batch_id"], out["batch_pos"])}
    want = {tuple(r) for r in expected.collect()}
    assert len(out) == len(told) and told <= want and len(want) - len(told) == waiting
    assert waiting == 0 or mode == "count"


def small():
    """Sorts with little memory; workers do not see this module, so they get it with the class."""
    from tagloom.streaming.sorting import SortedReads
    return partial(SortedReads, 3000, 300, 3)


@pytest.mark.parametrize("mode", ["count", "hybrid", "periodic"])
def test_a_gateway_holds_a_part_of_its_reads(spark, monkeypatch, mode):
    """Many pieces of one micro-batch: those taken are let go, the batches leave in small frames and are those of one batch."""
    import random
    import weakref
    from tagloom.streaming import batches as module
    monkeypatch.setattr(module, "SortedReads", small())
    pieces, size = 30, 100
    numbers = list(range(1, pieces * size + 1))
    random.Random(5).shuffle(numbers)
    given, most = [], 0

    def feed():
        nonlocal most
        for at in range(0, len(numbers), size):
            part = pd.DataFrame({"g": "", "seq": numbers[at:at + size]})
            part["tick"] = 0 if mode == "count" else part["seq"] % 9 * 50 + 1
            part["body"] = part["seq"].astype(str)
            given.append(weakref.ref(part))
            most = max(most, sum(g() is not None for g in given))
            yield part
            del part

    processor, handle = BatchProcessor(mode, 7, 50), _Handle()
    processor.init(handle)
    frames = list(processor.handleInputRows(("",), feed(), handle))
    while handle.timers:
        handle.now = min(handle.timers)
        handle.timers.discard(handle.now)
        frames += list(processor.handleExpiredTimer(("",), handle, None))
    assert most <= 4
    got = [(int(b), i, p) for f in frames for b, i, p in zip(f["body"], f["batch_id"], f["batch_pos"])]
    config = DispatchConfig(trigger_mode=mode, max_batch_size=7, period_ms=1000)
    clock = (F.col("seq") % 9 * 50 + 1).cast("double") + ORIGIN_US / 1_000_000
    table = spark.range(1, pieces * size + 1).withColumnRenamed("id", "seq").withColumn("eval_ts", F.timestamp_seconds(clock))
    want = {tuple(r) for r in batch(table, config, origin_us=ORIGIN_US).select("seq", "batch_id", "batch_pos").collect()}
    waiting = len(processor.waiting.held or [])
    assert len(got) == len(set(got)) and set(got) <= want and len(want) - len(got) == waiting and waiting < 7


def test_reads_are_sorted_outside_of_memory():
    """Runs of runs; late ticks, numbers that tie, one long text."""
    import random
    import pyarrow as pa
    from tagloom.streaming.sorting import READ
    rng, queued, want = random.Random(3), small()(), []
    for n in range(300):
        part = [(rng.randint(1, 50), rng.randint(1, 3000), "x" * (4000 if n == 7 else rng.randint(0, 40))) for _ in range(rng.randint(1, 20))]
        want += part
        queued.add(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), READ.types)], schema=READ))
    assert len(queued.runs) > 2 and all(len(level) < 3 for level in queued.runs) and sum(t.nbytes for t in queued.held) < 3000
    got = [tuple(r.values()) for piece in queued.sorted() for r in piece.to_pylist()]
    assert [r[:2] for r in got] == sorted(r[:2] for r in want) and sorted(got) == sorted(want)
    assert list(small()().sorted()) == []


@pytest.mark.parametrize("mode", ["hybrid", "count"])
def test_a_stream_of_many_reads_equals_one_batch(spark, monkeypatch, mode):
    """Reads of gateways with and without a name, more than a run in a tick, sorted on disk; texts keep their line breaks."""
    from tagloom.streaming import batches as module
    monkeypatch.setattr(module, "SortedReads", small())
    monkeypatch.setattr(module, "RUN", 16)
    folder, rows_in = shared_folder(spark, "many"), 3000
    df = spark.range(1, rows_in + 1).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("r\n"), F.col("id") % 3)).alias("reader_id"),
        F.timestamp_seconds(F.lit(ORIGIN_US / 1_000_000) + F.col("id") * 7 % 40).alias("eval_ts"))
    df.orderBy(F.rand(1)).repartition(5).write.parquet(f"{folder}/in")
    config = DispatchConfig(trigger_mode=mode, max_batch_size=7, period_ms=10_000)
    stream = batch_stream(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), config, origin_us=ORIGIN_US, gateway="reader_id", wait_ms=500)
    if mode == "count":
        stored(stream, folder)
    else:
        run_until_drained(stream, f"{folder}/out", f"{folder}/checkpoint", wait_ms=500)
    got = [tuple(r) for r in spark.read.parquet(f"{folder}/out").select("seq", "reader_id", "eval_ts", "batch_id", "batch_pos").collect()]
    named = df.withColumn("key", F.coalesce(F.concat(F.lit("="), "reader_id"), F.lit("")))
    want = {tuple(r) for r in batch(named, config, origin_us=ORIGIN_US, keys=["key"]).select("seq", "reader_id", "eval_ts", "batch_id", "batch_pos").collect()}
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(want) - len(got) == (0 if mode == "hybrid" else 3 * (rows_in // 3 % 7))


def test_a_long_micro_batch_is_no_timeout():
    """The wait for a stream ends for want of work, not for a lot of it."""
    from datetime import datetime, timezone

    class Query:
        def __init__(self):
            self.began, self.stopped = time.monotonic(), False

        def exception(self):
            return None

        def stop(self):
            self.stopped = True

        @property
        def status(self):
            return {"isDataAvailable": time.monotonic() < self.began + 1.5}

        @property
        def recentProgress(self):
            def step(n, rows_in, late):
                return {"batchId": n, "numInputRows": rows_in, "durationMs": {"triggerExecution": 0}, "stateOperators": [],
                        "timestamp": datetime.fromtimestamp(time.time() + late, timezone.utc).isoformat()}
            return [step(0, 5, 0), step(1, 0, 10)] if time.monotonic() > self.began + 1.5 else []

    class Stream:
        query = Query()
        writeStream = property(lambda self: self)
        format = option = trigger = lambda self, *_, **__: self

        def start(self):
            return self.query

    run_until_drained(Stream(), "out", "checkpoint", wait_ms=500, timeout_s=0.6)
    assert Stream.query.stopped


def test_an_idle_gateway_sends_without_new_input(spark, feed):
    """A batch that never fills leaves by its timer, with every column as it came."""
    df, _ = feed
    folder = shared_folder(spark, "idle")
    few = df.where("seq < 10").withColumn("big", F.when(F.col("seq") % 2 == 0, F.lit(2**62 + 1)))
    few.coalesce(1).write.parquet(f"{folder}/in")
    config = DispatchConfig(trigger_mode="hybrid", max_batch_size=1000, period_ms=3_600_000)
    stream = batch_stream(spark.readStream.schema(few.schema).parquet(f"{folder}/in"), config, gateway="reader_id", wait_ms=500)
    run_until_drained(stream, f"{folder}/out", f"{folder}/checkpoint", wait_ms=500)
    out = spark.read.parquet(f"{folder}/out")
    assert rows(out.select(*few.columns)) == rows(few)
    assert out.where("batch_pos = 1").count() == few.select("reader_id").distinct().count()


def test_instant_batches_are_stateless(spark, feed):
    _, stream = feed
    plan = batch_stream(stream(), DispatchConfig(trigger_mode="instant"))
    assert "TransformWithState" not in plan._jdf.queryExecution().analyzed().toString()


def stored(stream, folder):
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def test_keyed_state_equals_one_batch(spark, feed):
    df, stream = feed
    folder = shared_folder(spark, "keyed")
    sliding, daily = SlidingRule(4, "antenna"), DailyRule(scope="reader")
    stored(dedup_stream(stream(), sliding, daily), folder)
    got = spark.read.parquet(f"{folder}/out").select("seq", "dedup_stage")
    assert rows(got) == rows(filter_pipeline(df, [sliding, daily]).select("seq", "drop_code"))


def test_keyed_state_survives_a_restart(spark, feed):
    df, _ = feed
    folder = shared_folder(spark, "restart")
    for low, high in ((0, 150), (150, 330)):
        df.where(F.col("seq").between(low + 3, high + 2)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
        stored(sliding_dedup_stream(source, SlidingRule(4, "global")), folder)
    expected = filter_pipeline(df, [SlidingRule(4, "global")]).where("drop_stage IS NULL")
    assert rows(spark.read.parquet(f"{folder}/out").select("seq")) == rows(expected.select("seq"))


def test_state_goes_when_its_window_is_over(spark):
    """With a bound on lateness the state of idle tags is cleared, and the verdicts stay those of the batch form."""
    from cases import read, reads
    table, folder = [], shared_folder(spark, "expire")
    for minute in range(6):
        table += [read(100 * minute + n, 600.0 * minute + n, f"T{minute}{n // 2}") for n in range(20)]
    df = reads(spark, table)
    for minute in range(6):
        df.where(F.floor(F.col("seq") / 100) == minute).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)
    source = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    rule, held = SlidingRule(30, "global"), {}
    for name, late in (("all", None), ("late", 60)):
        query = dedup_stream(source(), rule, late_seconds=late).writeStream.format("parquet").option("path", f"{folder}/{name}").option(
            "checkpointLocation", f"{folder}/cp-{name}").trigger(availableNow=True).start()
        query.awaitTermination()
        got = spark.read.parquet(f"{folder}/{name}").select("seq", "dedup_stage")
        assert rows(got) == rows(filter_pipeline(df, [rule]).select("seq", "drop_code"))
        held[name] = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert held["late"] < held["all"] / 2


def test_daily_unique_by_the_engines_state(spark, feed):
    df, stream = feed
    folder = shared_folder(spark, "daily")
    rule = DailyRule(scope="reader")
    live = daily_unique_stream(stream(), rule)
    plan = live._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "Python" not in plan and "TransformWithState" not in plan
    stored(live, folder)
    got = spark.read.parquet(f"{folder}/out").select("seq", "shift_id")
    assert rows(got) == rows(daily_unique(df, rule).select("seq", "shift_id"))


def test_reads_of_a_closed_shift_are_left_out_and_counted(spark):
    from cases import read, reads
    folder, day = shared_folder(spark, "closed"), 86_400
    for n, at in enumerate([0, 10 * day, 10 * day + 1, 5, 10 * day + 5]):  # the watermark moves between micro-batches
        reads(spark, [read(n, at, f"A{n}")]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)
    schema = reads(spark, [read(0, 0, "A")]).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = daily_unique_stream(source).writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(f"{folder}/out").collect()) == [0, 1, 2, 4]
    assert late_reads(query) == 1 and query.lastProgress["stateOperators"][0]["numRowsTotal"] == 3


def test_lost_state_is_an_error(spark):
    folder = shared_folder(spark, "slots")
    slots = _Slots(spark, folder)
    assert slots.read(0) is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        slots.read(7)
    slots.write(spark.range(3), 4)
    assert slots.read(5).count() == 3
    with pytest.raises(ValueError):
        slots.read(7)


def test_retries_are_left_out_of_a_stream(spark):
    folder = shared_folder(spark, "receiver")
    rows_in = [("a", START), ("b", START), ("a", START)]
    for part in (rows_in[:2], rows_in[2:]):
        spark.createDataFrame(part, "transaction_id string, received_at timestamp").coalesce(1).write.mode(
            "append").parquet(f"{folder}/in")
        source = spark.readStream.schema("transaction_id string, received_at timestamp").parquet(f"{folder}/in")
        stored(first_deliveries(source, "1 hour"), folder)
    assert rows(spark.read.parquet(f"{folder}/out").select("transaction_id")) == [("a",), ("b",)]


def test_throughput_on_a_stream(spark, feed):
    """Appended seconds are final; updated ones end as those of the whole table."""
    df, stream = feed
    folder = shared_folder(spark, "gauge")
    whole = {tuple(r) for r in throughput_per_second(df).collect()}
    stored(throughput_stream(stream(), late="1 second"), folder)
    closed = {tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()}
    newest = max(second for second, _ in whole)
    assert closed <= whole and {w for w in whole if w[0] < newest - timedelta(seconds=2)} <= closed
    throughput_stream(stream(), late="1 hour").writeStream.outputMode("update").foreachBatch(upserts(f"{folder}/now")).option(
        "checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in upserted(spark, f"{folder}/now", ["second"]).collect()} == whole


def test_reader_states_on_a_stream(spark):
    folder = shared_folder(spark, "states")
    events = [(n, START + timedelta(seconds=n), f"r{n * n % 5}", ["Connected", "Faulted", "Reconnecting"][n % 3]) for n in range(60)]
    schema = "seq long, ts timestamp, reader_id string, new_state string"
    df = spark.createDataFrame(events, schema)
    for part in range(4):
        df.where(F.col("seq") % 4 == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    sink = upserts(f"{folder}/out")

    def twice(changes, batch_id):
        sink(changes, batch_id)
        sink(changes, batch_id)

    reader_status_stream(source).writeStream.outputMode("update").foreachBatch(twice).option(
        "checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    registry = spark.createDataFrame([], "ordinal long, reader_id string, provider_id string")
    assert rows(upserted(spark, f"{folder}/out", ["reader_id"])) == rows(
        latest_reader_status(df, registry).select("reader_id", "state", "last_seen"))


@pytest.mark.parametrize("files", [1, 4])
def test_lines_however_chunks_are_cut(spark, files):
    folder = shared_folder(spark, "lines")
    texts = ["one\ntw", "o", "", "\n\n  three \nfour", None, "\r\nfi", "ve\n", "tail"]
    chunks = [(f"s{k}", n, t) for k in range(3) for n, t in enumerate(texts[k:])] + [(None, n, t) for n, t in enumerate(texts)]
    schema = "stream_id string, chunk_no long, data string"
    df = spark.createDataFrame(chunks, schema)
    for part in range(files):
        df.where(F.floor(F.col("chunk_no") * files / 9) == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stored(split_lines_stream(source), folder)
    got = spark.read.parquet(f"{folder}/out")
    assert got.where("quarantined").count() == 0
    named = df.where("stream_id IS NOT NULL").fillna("", ["data"])
    assert rows(got.where("stream_id IS NOT NULL").select("stream_id", "line_no", "line")) == rows(split_lines(named, keep_tail=False))
    assert got.where("stream_id IS NULL").count() == 6


@pytest.mark.parametrize("files", [1, 3])
def test_a_line_without_end_is_bounded(spark, files):
    folder = shared_folder(spark, "long")
    chunks = [("s", 0, "abcdef"), ("s", 1, "ghij"), ("s", 2, "kl\nok\nmore than")]
    df = spark.createDataFrame(chunks, "stream_id string, chunk_no long, data string")
    for part in range(files):
        df.where(F.floor(F.col("chunk_no") * files / 3) == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stored(split_lines_stream(source, longest=4), folder)
    got = spark.read.parquet(f"{folder}/out").select("line_no", "line", "quarantined")
    assert rows(got) == [(0, "abcd", True), (1, "ok", False)]


def test_late_reads_are_judged_as_in_one_batch(spark):
    """A tag that comes back days late in an old shift, or after another tag went far ahead."""
    from cases import read, reads
    day = 86_400
    daily = [read(1, 10 * day, "A"), read(2, 13 * day, "B"), read(3, 10 * day + 5, "A")]
    sliding = [read(1, 0, "A"), read(2, 3 * day, "B"), read(3, 5, "A")]
    for rule, rows_in in ((DailyRule(), daily), (SlidingRule(10, "global"), sliding)):
        folder = shared_folder(spark, "late")
        run = chain_stream([rule], f"{folder}/state", parquet_sink(f"{folder}/out"))
        for n, row in enumerate(rows_in):
            run(reads(spark, [row]), n)
        got = spark.read.parquet(f"{folder}/out").select("seq", "drop_code")
        assert rows(got) == rows(filter_pipeline(reads(spark, rows_in), [rule]).select("seq", "drop_code"))
        assert got.where("drop_code IS NOT NULL").count() == 1
