import pytest
from cases import START, queue_batches, random_reads, read, reads
from pyspark.sql import functions as F

from tagloom.operators.batching import batch, batch_count, batch_hybrid, batch_instant, batch_periodic, tick_of
from tagloom.operators.lookup import enrich_with_reader, lookup, status_with_provider
from tagloom.operators.ordering import with_row_number, with_running_total
from tagloom.schema import DispatchConfig

ORIGIN_US = int(START.timestamp() * 1_000_000)


def groups(df):
    """Batches as lists of reads in order, without their ids."""
    found = {}
    for r in df.select("seq", "batch_id", "batch_pos").collect():
        found.setdefault(r.batch_id, []).append((r.batch_pos, r.seq))
    return sorted([seq for _, seq in sorted(members)] for members in found.values())


def expected(rows, mode, size, period=7.0):
    found = {}
    for seq, (number, position) in queue_batches(rows, mode, size, period, START).items():
        found.setdefault(number, []).append((position, seq))
    return sorted([seq for _, seq in sorted(members)] for members in found.values())


def test_count_of_three(spark):
    df = reads(spark, [read(i) for i in range(7)])
    assert groups(batch_count(df, 3)) == [[0, 1, 2], [3, 4, 5], [6]]


def test_instant(spark):
    assert groups(batch_instant(reads(spark, [read(4), read(9)]))) == [[4], [9]]


def test_arrival_at_a_tick_leaves_with_it(spark):
    df = reads(spark, [read(0, 0), read(1, 5), read(2, 5.000001), read(3, 10)])
    ticks = [r.t for r in df.orderBy("seq").select(tick_of(F.col("eval_ts"), 5000, ORIGIN_US).alias("t")).collect()]
    assert ticks == [1, 1, 2, 2]


@pytest.mark.parametrize("slice_bits", [22, 3, 0])
@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("size", [1, 3, 7])
def test_triggers_equal_a_drained_queue(spark, seed, size, slice_bits):
    rows = random_reads(seed, 250, backwards=False)
    df = reads(spark, rows).persist()
    assert groups(batch_count(df, size, slice_bits=slice_bits)) == expected(rows, "count", size)
    assert groups(batch_hybrid(df, size, 7000, origin_us=ORIGIN_US, slice_bits=slice_bits)) == \
        expected(rows, "hybrid", size)
    assert groups(batch_periodic(df, size, 7000, origin_us=ORIGIN_US, slice_bits=slice_bits)) == \
        expected(rows, "periodic", size)


def test_gateways_have_their_own_buffers(spark):
    rows = random_reads(4, 200, backwards=False)
    df = reads(spark, rows)
    for mode in ("count", "hybrid", "periodic"):
        config = DispatchConfig(trigger_mode=mode, max_batch_size=3, period_ms=7000)
        got = batch(df, config, origin_us=ORIGIN_US, keys=["reader_id"])
        for reader in ("r1", "R1", "r2"):
            own = [r for r in rows if r[7] == reader]
            assert groups(got.where(F.col("reader_id") == reader)) == expected(own, mode, 3)


@pytest.mark.parametrize("slice_bits", [22, 2])
def test_running_numbers(spark, slice_bits):
    df = spark.range(100).select(F.col("id").alias("seq"), (F.col("id") % 3 == 0).cast("int").alias("k"))
    rows = with_row_number(df, ["k"], "n", slice_bits=slice_bits)
    total = with_running_total(rows, ["k"], F.col("seq"), "s", inclusive=False, slice_bits=slice_bits).collect()
    for r in total:
        before = [i for i in range(r.seq) if (i % 3 == 0) == bool(r.k)]
        assert (r.n, r.s) == (len(before) + 1, sum(before))


REGISTRY = [(2, "gate", "late", "B"), (1, "gate", "llrp", "A"), (3, "dock", "zebra", None)]


def registry(spark):
    return spark.createDataFrame(REGISTRY, "ordinal long, reader_id string, provider_id string, brand_name string")


@pytest.mark.parametrize("salts", [None, 4])
def test_lookup_takes_first_registration_and_defaults(spark, salts):
    df = reads(spark, [read(1), read(2, reader="GATE"), read(3, reader="dock")])
    got = enrich_with_reader(df, registry(spark), salts=salts).orderBy("seq").collect()
    assert [(r.provider_id, r.brand_name) for r in got] == [("llrp", "A"), ("System", "RFID Reader"), ("zebra", None)]
    status = df.select("seq", "reader_id")
    got = status_with_provider(status, registry(spark), salts=salts).orderBy("seq").collect()
    assert [r.provider_id for r in got] == ["llrp", "Unknown", "zebra"]


def test_large_dimension_is_joined_with_salt(spark):
    facts = spark.range(5000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, 7).otherwise(
        F.col("id") % 50).alias("k"))
    dimension = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = lookup(facts, dimension, "k", spread="seq", salts=4)
    assert "_salt" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 5000 and joined.where("v <> k * 2 OR v IS NULL").count() == 0
