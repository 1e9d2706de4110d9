"""The physical plans are the ones we want."""

import re
from datetime import time

import pytest
from cases import random_reads, reads
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import predicates as P
from tagloom.operators import ordering
from tagloom.operators.ordering import with_previous, with_row_number
from tagloom.operators.pipeline import default_pipeline, pipeline_counters
from tagloom.plans import tables
from tagloom.plans.queries import CHAIN, QUERIES
from tagloom.schema import FilterConfig

SF = "/root/testdata/sf0.001"


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return executed(df).split("== Initial Plan ==")[0]


def test_no_query_uses_a_cross_join_or_a_row_udf(spark):
    streams = {name for name in QUERIES if name.endswith("_stream")}
    for name in sorted(set(QUERIES) - streams):
        plan = executed(QUERIES[name](spark, SF))
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan), name


def test_columns_are_pruned_at_the_scan(spark):
    plan = executed(QUERIES["daily_unique"](spark, SF))
    assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan)) == {
        "struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>"}


def test_stateless_filters_are_pushed_to_the_scan(spark, tmp_path):
    reads(spark, random_reads(1, 50)).write.parquet(str(tmp_path / "reads"))
    table = spark.read.parquet(str(tmp_path / "reads"))
    plan = executed(table.where(~P.rssi_below(-60) & ~P.antenna_masked(1)).where("reader_id = 'r1'").select("epc"))
    assert "PushedFilters: [" in plan and "EqualTo(reader_id,r1)" in plan and "antenna_port" in plan
    assert "tid" not in re.search(r"ReadSchema: (.*)", plan).group(1)


def test_the_first_dedup_stage_scans_again_only_for_key_and_clock(spark):
    df = tables.reads(spark, SF).withColumn("note", F.concat("epc", "tid"))
    plan = final_plan(default_pipeline(df, FilterConfig(5, sliding_scope="global")))
    schemas = sorted(re.findall(r"ReadSchema: (struct<.*?>)(?:\n|$)", plan), key=len)
    assert len(schemas) == 2 and schemas[0] == "struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>"


def test_later_dedup_stages_do_not_repeat_the_earlier_ones(spark):
    """Both halves of the second stage read one shuffle, so the first stage runs once."""
    two = final_plan(pipeline_counters(default_pipeline(tables.reads(spark, SF), CHAIN)))
    assert two.count("ReusedExchange") >= 1 and two.count("FileScan") == 2
    once = final_plan(pipeline_counters(default_pipeline(tables.reads(spark, SF), CHAIN, rescan=False)))
    assert once.count("FileScan") == 1


def test_filters_on_the_key_reach_below_the_shuffle(spark):
    config = FilterConfig(5, sliding_scope="antenna", prefix="E28", antenna_mask=7, min_rssi=-70.0,
                          schedule_start=time(1), schedule_end=time(2))
    df = tables.reads(spark, SF)
    plain, moved = (pipeline_counters(default_pipeline(df, config, optimize=o, keep_dropped=False)) for o in (False, True))
    assert plain.first().passed == moved.first().passed
    assert "StartsWith" not in _below_exchanges(executed(plain)) and "StartsWith" in _below_exchanges(executed(moved))


def _below_exchanges(plan: str) -> str:
    """The lines of a plan from the last exchange down to a scan."""
    return "\n".join(part for part in re.split(r"Exchange hashpartitioning.*", plan)[1:])


@pytest.mark.parametrize("slice_bits", [6, 22])
def test_no_window_group_exceeds_its_slice(spark, slice_bits):
    """With all reads on one key, a task still gets at most one slice of them."""
    df = spark.range(1000).select(
        F.col("id").alias("seq"), F.timestamp_micros(F.col("id") * 500_000).alias("eval_ts"), F.lit("hot").alias("epc"),
        F.lit("r").alias("reader_id"), F.lit(1).alias("antenna_port"), F.lit(-50.0).cast("float").alias("rssi"))
    out = default_pipeline(df, FilterConfig(0.5, sliding_scope="global"), slice_bits=slice_bits)
    assert pipeline_counters(out).first().passed == 1000


def _largest_window(spark, df, limit: int) -> int:
    """The most rows that share the partition of a window: each window spec of the plan counts its groups on its own input."""
    found = []
    stack = [df._jdf.queryExecution().optimizedPlan()]
    while stack:
        node = stack.pop()
        stack += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Window":
            names = [node.partitionSpec().apply(i).sql() for i in range(node.partitionSpec().size())]
            child = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node.child())
            frame = DataFrame(child, spark)
            keys = [c for c in frame.columns if any(f"{c}`" in n or n.endswith(c) for n in names)]
            found.append(frame.groupBy(*keys).count().agg(F.max("count")).first()[0] if keys else frame.count())
    assert found
    return max(x or 0 for x in found)


@pytest.mark.parametrize("step", [1, 5_000_000])
def test_no_window_holds_more_than_a_slice_of_dense_or_sparse_numbers(spark, step, monkeypatch):
    """All reads on one key: the look back and the running number stay within the bound at every level."""
    monkeypatch.setattr(ordering, "LEAST_LEVEL_BITS", 8)
    df = spark.range(3000).select((F.col("id") * step).alias("seq"), F.lit("hot").alias("k"), F.col("id").alias("v"))
    back = with_previous(df, [F.col("k")], F.col("v"), "before", slice_bits=8)
    assert back.where("before <> v - 1 OR (before IS NULL AND v > 0)").count() == 0
    numbered = with_row_number(df, [], "n", slice_bits=8)
    assert numbered.where("n <> v + 1").count() == 0
    for out in (back, numbered):
        assert _largest_window(spark, out, 256) <= 512


def test_lookup_starts_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    QUERIES["enrich_with_reader"](spark, SF)
    files = 2 + 1  # schemas of nation, region and events are read by jobs of their own
    assert len(tracker.getJobIdsForGroup(None)) - before <= files
