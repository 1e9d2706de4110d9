from datetime import datetime, time

import pytest
from cases import START, UTC, daily_survivors, random_reads, read, reads, sliding_survivors
from pyspark.sql import functions as F

from tagloom.operators.dedup import (active_key_counts, daily_unique, live_sliding_keys, shift_rollovers,
                                     sliding_dedup)
from tagloom.operators.ordering import number_reads, with_first_flag
from tagloom.operators.pipeline import plain_number
from tagloom.schema import DailyRule, MetadataRule, SlidingRule


def kept(df):
    return sorted(r.seq for r in df.select("seq").collect())


def test_window_is_refreshed_by_dropped_reads(spark):
    df = reads(spark, [read(1, 0), read(2, 3), read(3, 7), read(4, 12), read(5, 16.5)])
    assert kept(sliding_dedup(df, SlidingRule(5, "global"))) == [1, 4]


def test_gap_equal_to_window_passes_and_negative_gap_passes(spark):
    df = reads(spark, [read(1, 10), read(2, 15), read(3, 14), read(4, 18)])
    assert kept(sliding_dedup(df, SlidingRule(5, "global"))) == [1, 2, 3]


def test_scopes_and_case(spark):
    df = reads(spark, [read(1, 0, "ab", 1, reader="x"), read(2, 1, "AB", 1, reader="X"), read(3, 2, "ab", 2, reader="x"),
                       read(4, 3, "ab", 2, reader="y")])
    assert kept(sliding_dedup(df, SlidingRule(9, "antenna"))) == [1, 3, 4]
    assert kept(sliding_dedup(df, SlidingRule(9, "reader"))) == [1, 4]
    assert kept(sliding_dedup(df, SlidingRule(9, "global"))) == [1]


@pytest.mark.parametrize("rescan", [True, False])
@pytest.mark.parametrize("slice_bits", [22, 4, 0])
@pytest.mark.parametrize("scope", ["antenna", "reader", "global"])
def test_sliding_equals_state_machine(spark, scope, slice_bits, rescan):
    rows = random_reads(7, 600)
    got = sliding_dedup(reads(spark, rows), SlidingRule(6, scope), rescan=rescan, slice_bits=slice_bits)
    assert kept(got) == sliding_survivors(rows, 6, scope)


def test_missing_key_parts_are_a_key_of_their_own(spark):
    rows = [(1, START, "a", None, None, -1.0, 1, None), (2, START, "a", None, None, -1.0, 1, None),
            (3, START, "a", None, 1, -1.0, 1, None)]
    for rescan in (True, False):
        assert kept(sliding_dedup(reads(spark, rows), SlidingRule(5, "antenna"), rescan=rescan, slice_bits=0)) == [1, 3]


def test_shift_unique_in_local_time(spark):
    utc = [datetime(2026, 5, 4, 1, 0, tzinfo=UTC), datetime(2026, 5, 4, 9, 0, tzinfo=UTC),
           datetime(2026, 5, 5, 0, 20, tzinfo=UTC), datetime(2026, 5, 5, 0, 40, tzinfo=UTC)]
    df = reads(spark, [read(i, at=at) for i, at in enumerate(utc)])
    got = daily_unique(df, DailyRule(time(6), "Asia/Kolkata")).select("seq", "shift_id").collect()
    assert sorted(map(tuple, got)) == [(0, "2026-05-04_06:00"), (3, "2026-05-05_06:00")]


@pytest.mark.parametrize("slice_bits", [22, 3])
@pytest.mark.parametrize("rollover", ["shift", "arrival"])
@pytest.mark.parametrize("rescan", [True, False])
@pytest.mark.parametrize("scope", ["reader", "global"])
def test_daily_equals_state_machine(spark, scope, rollover, slice_bits, rescan):
    rows = [(r[0], datetime.fromtimestamp(r[1].timestamp() + (r[1].timestamp() % 977) * 150, UTC), *r[2:])
            for r in random_reads(11, 400)]
    rule = DailyRule(time(6), "Asia/Kolkata", scope, rollover)
    got = daily_unique(reads(spark, rows), rule, rescan=rescan, slice_bits=slice_bits)
    assert kept(got) == daily_survivors(rows, 5.5, 6, scope, rollover == "arrival")


def test_shift_start_follows_daylight_saving(spark):
    before, after = datetime(2026, 3, 7, 11, 30, tzinfo=UTC), datetime(2026, 3, 8, 10, 30, tzinfo=UTC)
    df = reads(spark, [read(1, at=before), read(2, at=after)])
    got = daily_unique(df, DailyRule(time(6), "America/New_York")).select("shift_id").collect()
    assert sorted(r.shift_id for r in got) == ["2026-03-07_06:00", "2026-03-08_06:00"]


def test_rollovers_in_arrival_order_across_slices(spark):
    days = [1, 1, 2, 1, 3, 3]
    df = reads(spark, [read(i, at=datetime(2026, 5, d, 12, tzinfo=UTC)) for i, d in enumerate(days)])
    for bits in (22, 0):
        got = shift_rollovers(df, DailyRule(), slice_bits=bits).orderBy("seq").collect()
        assert [(r.seq, r.shift_id[:10]) for r in got] == [(2, "2026-05-02"), (3, "2026-05-01"), (4, "2026-05-03")]


def test_registry_sizes(spark):
    df = reads(spark, [read(1, 0, "a"), read(2, 1, "A"), read(3, 2, "b"), read(4, 86400, "a")])
    counts = {r.shift_id: r.active_keys for r in active_key_counts(df, DailyRule()).collect()}
    assert sorted(counts.values()) == [1, 2]
    live = live_sliding_keys(df, SlidingRule(2, "global"), F.timestamp_micros(F.lit(1784516403000000)))
    assert live.first().active_keys == 1


def test_several_tags_of_a_message_are_numbered_and_deduplicated(spark):
    """Reads that share a message number get numbers of their own, and no operator makes more rows than it gets."""
    rows = [(10**12, 0, "A"), (10**12, 1, "B"), (10**12, 2, "C"), (7, 0, "A")]
    df = spark.createDataFrame(rows, "seq long, tag_no int, epc string").withColumns(
        {"eval_ts": F.timestamp_micros(F.lit(0)), "reader_id": F.lit("r"), "antenna_port": F.lit(1)})
    numbered = number_reads(df, ["seq", "tag_no"])
    assert sorted((r.seq, r.epc) for r in numbered.collect()) == [(1, "A"), (2, "A"), (3, "B"), (4, "C")]
    for rescan in (True, False):
        assert sorted(r.epc for r in daily_unique(numbered, rescan=rescan).collect()) == ["A", "B", "C"]
        assert with_first_flag(df, [F.col("epc")], "first", rescan=rescan).count() == len(rows)


def test_sparse_numbers_give_the_same_verdicts(spark):
    dense = random_reads(5, 400)
    sparse = [(r[0] * 5_000_011 - 10**9, *r[1:]) for r in dense]
    for rescan in (True, False):
        a, b = ([r.seq for r in sliding_dedup(reads(spark, x), SlidingRule(3, "global"), rescan=rescan, slice_bits=7).collect()]
                for x in (dense, sparse))
        assert sorted(s * 5_000_011 - 10**9 for s in a) == sorted(b)


def test_patterns_are_those_of_the_engine(spark):
    assert MetadataRule(regex=r"^(?<t>E280)\p{XDigit}+\z")
    with pytest.raises(ValueError):
        MetadataRule(regex="(?P<t>E280)")


def test_window_text_has_no_exponent():
    assert [plain_number(x) for x in (1209600.0, 15, 0.5, 21600.0)] == ["1209600", "15", "0.5", "21600"]
