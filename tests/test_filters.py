from datetime import datetime, time

import pytest
from cases import UTC, daily_survivors, random_reads, read, reads, sliding_survivors
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tagloom.operators.pipeline import (CustomRule, commute, default_pipeline, default_rules, drop_report,
                                        filter_pipeline, metadata_filter, observe_counters, passed, pipeline_counters, schedule_filter)
from tagloom.schema import (FACTORY_FILTER, DailyRule, DispatchConfig, FilterConfig, MetadataRule, ScheduleRule,
                            SlidingRule)


def codes(df):
    return [r.drop_code for r in df.orderBy("seq").collect()]


def test_metadata_checks_and_first_failure_wins(spark):
    df = reads(spark, [read(1, rssi=-60.5, epc="E280AA77"), read(2, rssi=-80, antenna=2, epc="x"),
                       read(3, antenna=2, epc="E280AA77"), read(4, epc="E280"), read(5, epc="E280" + "A" * 20),
                       read(6, epc="3000AA77"), read(7, epc="e280aa78"), read(8, epc="E280XY77"),
                       read(9, antenna=17, epc="E280AA77")])
    rule = MetadataRule(-65, 0b101, 8, 16, "e280", "77", "^e280[0-9a-f]+77$")
    assert codes(metadata_filter(df, rule)) == [None, "rssi", "antenna", "min_length", "max_length", "prefix",
                                                "suffix", "regex", "antenna"]


def test_threshold_is_strict_in_single_precision_and_nan_passes(spark):
    df = reads(spark, [read(1, rssi=-65.1), read(2, rssi=float("nan")), read(3, rssi=-65.2)])
    assert codes(metadata_filter(df, MetadataRule(min_rssi=-65.1))) == [None, None, "rssi"]


def test_reasons(spark):
    df = reads(spark, [read(1, rssi=-70.25), read(2, antenna=3)])
    got = metadata_filter(df, MetadataRule(min_rssi=-65, antenna_mask=3)).orderBy("seq").collect()
    assert [r.drop_reason for r in got] == ["RSSI -70.3 dBm is below threshold -65.0 dBm.",
                                            "Antenna port 3 disabled by bitmask 0x3."]


@pytest.mark.parametrize("start,end,hours,expected", [
    (time(8), time(18), [8, 14, 18, 19], [None, None, None, "hours"]),
    (time(22), time(6), [23, 4, 6, 12], [None, None, None, "hours"]),
])
def test_schedule_hours(spark, start, end, hours, expected):
    df = reads(spark, [read(i, at=datetime(2026, 7, 20, h, tzinfo=UTC)) for i, h in enumerate(hours)])
    assert codes(schedule_filter(df, ScheduleRule(start=start, end=end))) == expected


def test_schedule_is_local_and_inclusive_to_the_microsecond(spark):
    stamps = [datetime(2026, 3, 7, 23, 0, tzinfo=UTC), datetime(2026, 3, 8, 22, 0, tzinfo=UTC),
              datetime(2026, 3, 8, 22, 0, 0, 1, tzinfo=UTC)]  # 18:00 in New York before and after the change of clocks
    df = reads(spark, [read(i, at=at) for i, at in enumerate(stamps)])
    rule = ScheduleRule(start=time(8), end=time(18), tz="America/New_York")
    assert codes(schedule_filter(df, rule)) == [None, None, "hours"]


def test_schedule_days(spark):
    df = reads(spark, [read(i, at=datetime(2026, 7, d, 9, tzinfo=UTC)) for i, d in enumerate([20, 21, 22])])
    assert codes(schedule_filter(df, ScheduleRule(("Monday", "Wednesday")))) == [None, "day", None]


def test_dropped_reads_still_refresh_the_stage_before(spark):
    df = reads(spark, [read(1, 0, rssi=-90), read(2, 3, rssi=-40)])
    rules = [SlidingRule(5, "global"), MetadataRule(min_rssi=-60)]
    assert codes(filter_pipeline(df, rules)) == ["rssi", "sliding"]
    assert codes(filter_pipeline(df, rules[::-1])) == ["rssi", None]


@pytest.mark.parametrize("rescan", [True, False])
@pytest.mark.parametrize("slice_bits", [22, 3])
def test_chain_equals_state_machines(spark, slice_bits, rescan):
    rows = random_reads(5, 500)
    rules = [MetadataRule(min_rssi=-200), SlidingRule(4, "reader"), DailyRule(time(0), "UTC", "reader"), MetadataRule(min_rssi=-70)]
    survivors = set(sliding_survivors(rows, 4, "reader"))
    rest = [r for r in rows if r[0] in survivors]
    first = set(daily_survivors(rest, 0, 0, "reader", False))
    expected = sorted(r[0] for r in rest if r[0] in first and r[5] >= -70)
    got = filter_pipeline(reads(spark, rows), rules, rescan=rescan, slice_bits=slice_bits)
    assert sorted(r.seq for r in passed(got).collect()) == expected
    counts = pipeline_counters(got).first()
    assert (counts.evaluated, counts.passed, counts.dropped) == (500, len(expected), 500 - len(expected))
    assert sum(r.reads for r in drop_report(got).collect()) == counts.dropped


@pytest.mark.parametrize("slice_bits", [22, 2])
def test_reads_dropped_earlier_leave_no_trace_in_later_stages(spark, slice_bits):
    rows = random_reads(8, 300)
    alive = [r for r in rows if r[5] >= -60]
    for rule, expected in ((SlidingRule(6, "global"), sliding_survivors(alive, 6, "global")),
                           (DailyRule(), daily_survivors(alive, 0, 0, "global", False))):
        got = filter_pipeline(reads(spark, rows), [MetadataRule(min_rssi=-60), rule], slice_bits=slice_bits)
        assert sorted(r.seq for r in passed(got).collect()) == expected


@pytest.mark.parametrize("rescan", [True, False])
def test_dropped_reads_can_leave_the_chain_early(spark, rescan):
    rules = [MetadataRule(min_rssi=-75), SlidingRule(4, "reader"), DailyRule(scope="antenna"), SlidingRule(9, "global")]
    df = reads(spark, random_reads(12, 400))
    whole = passed(filter_pipeline(df, rules, rescan=rescan, slice_bits=3))
    early = filter_pipeline(df, rules, rescan=rescan, keep_dropped=False, slice_bits=3)
    assert sorted(r.seq for r in early.collect()) == sorted(r.seq for r in whole.collect())
    assert early.where("drop_stage IS NOT NULL").count() == 0


def test_custom_stages(spark):
    df = reads(spark, [read(1, antenna=1), read(2, antenna=2), read(3, antenna=3)])
    rules = [CustomRule("odd", F.expr("antenna_port % 2 = 1")),
             CustomRule("first", lambda d: d.withColumn("_keep", F.col("seq") == 1), "not the first")]
    got = filter_pipeline(df, rules).orderBy("seq").collect()
    assert [r.drop_stage for r in got] == [None, "odd", "first"]
    assert got[2].drop_reason == "not the first"


def test_moving_key_checks_ahead_keeps_the_survivors(spark):
    rows = random_reads(3, 400)
    rules = [SlidingRule(5, "antenna"), MetadataRule(min_rssi=-60, antenna_mask=1, prefix="H", max_length=3)]
    moved = commute(rules)
    assert [type(r).__name__ for r in moved] == ["MetadataRule", "SlidingRule", "MetadataRule"]
    assert moved[0].min_rssi is None and moved[0].antenna_mask == 1 and moved[2].min_rssi == -60
    df = reads(spark, rows)
    plain, fast = (sorted(r.seq for r in passed(filter_pipeline(df, rules, optimize=o)).collect()) for o in (False, True))
    assert plain == fast


def test_counters_on_the_way_through(spark):
    seen = Observation("chain")
    df = observe_counters(metadata_filter(reads(spark, [read(1), read(2, rssi=-90)]), MetadataRule(min_rssi=-60)), seen)
    assert df.count() == 2 and seen.get == {"evaluated": 2, "passed": 1, "dropped": 1}


def test_default_rules():
    assert [type(r).__name__ for r in default_rules(FilterConfig())] == ["SlidingRule"]
    assert [type(r).__name__ for r in default_rules(FACTORY_FILTER)] == ["SlidingRule", "MetadataRule"]
    config = FilterConfig(0, daily_unique=True, regex="^E2", schedule_start=time(8), schedule_end=time(9))
    assert [type(r).__name__ for r in default_rules(config)] == ["DailyRule", "MetadataRule", "ScheduleRule"]


def test_default_pipeline_without_stages_passes_everything(spark):
    df = reads(spark, [read(1), read(2)])
    assert codes(default_pipeline(df, FilterConfig(0))) == [None, None]


@pytest.mark.parametrize("make", [
    lambda: SlidingRule(0), lambda: SlidingRule(5, "room"), lambda: FilterConfig(-1), lambda: DispatchConfig(period_ms=0),
    lambda: DispatchConfig(max_batch_size=0), lambda: DispatchConfig(target_url="not a url"),
    lambda: DispatchConfig(payload_format="yaml"), lambda: ScheduleRule(("Funday",)), lambda: MetadataRule(regex="("),
    lambda: MetadataRule(antenna_mask=1 << 16), lambda: DailyRule(rollover="never")])
def test_rules_are_validated(make):
    with pytest.raises(Exception):
        make()


def test_unknown_trigger_mode_means_instant():
    assert DispatchConfig(trigger_mode="later").mode == "instant"
    assert DispatchConfig(trigger_mode="BatchCount").mode == "count"
