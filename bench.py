"""Times the headline queries and the filter chain on a generated tag storm; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores and
``BENCH_STORM_ROWS`` the sizes of the storm (comma separated).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tagloom.operators.pipeline import filter_pipeline, pipeline_counters  # noqa: E402
from tagloom.plans.queries import QUERIES  # noqa: E402
from tagloom.schema import MetadataRule, SlidingRule  # noqa: E402

HEADLINES = [
    "default_pipeline", "drop_report", "pipeline_counters", "sliding_dedup", "sliding_dedup_reader",
    "sliding_dedup_antenna", "daily_unique", "lineitem_shift_counts", "decode_text_lines", "decode_identium_frames",
    "decode_llrp_reports", "split_lines", "route_by_provider", "enrich_with_reader", "batch_count", "batch_periodic",
    "batch_hybrid", "render_json_payload", "render_template", "build_requests", "spill_failed", "replay_drain",
    "health_summary", "reconnect_plan", "telemetry_feed", "clock_skew",
]


def storm(spark: SparkSession, rows: int) -> DataFrame:
    """The read pattern of the throughput floor: 500 tags over 4 readers, one read per millisecond."""
    i = F.col("id")
    return spark.range(rows).select(
        i.alias("seq"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + i * 1000).alias("eval_ts"),
        F.concat(F.lit("E280"), F.lpad(F.hex(i % 500), 8, "0")).alias("epc"),
        F.concat(F.lit("reader-"), i % 4 + 1).alias("reader_id"), (i % 4 + 1).cast("int").alias("antenna_port"),
        (-50 - i % 15).cast("float").alias("rssi"))


def parked_tag_storm(spark: SparkSession, rows: int) -> DataFrame:
    """The same storm with one tag parked at an antenna that makes a third of all reads."""
    parked = F.col("seq") % 3 == 0
    return storm(spark, rows).withColumns({
        "epc": F.when(parked, F.lit("E280PARKED")).otherwise(F.col("epc")),
        "reader_id": F.when(parked, F.lit("reader-1")).otherwise(F.col("reader_id")),
        "antenna_port": F.when(parked, F.lit(1)).otherwise(F.col("antenna_port"))})


def seconds(df: DataFrame) -> float:
    started = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sizes = [int(n) for n in os.environ.get("BENCH_STORM_ROWS", "50000,10000000").split(",") if n]
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds(QUERIES["drop_report"](spark, sf_dir))  # warm-up, as session start is not measured
    timings = {}
    for name in HEADLINES:
        started = time.perf_counter()
        seconds(QUERIES[name](spark, sf_dir))
        timings[name] = round(time.perf_counter() - started, 3)
    rates = {}
    rules = [MetadataRule(min_rssi=-70.0, prefix="E280"), SlidingRule(15.0, "antenna")]
    for rows in sizes:
        took = seconds(pipeline_counters(filter_pipeline(storm(spark, rows), rules)))
        timings[f"storm_{rows}"] = round(took, 3)
        rates[f"storm_{rows}"] = round(rows / took)
        took = seconds(pipeline_counters(filter_pipeline(parked_tag_storm(spark, rows), rules)))
        timings[f"parked_tag_storm_{rows}"] = round(took, 3)
        rates[f"parked_tag_storm_{rows}"] = round(rows / took)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "reads_per_sec": rates, "cores": int(cpus),
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
