"""The given star-schema tables seen as reads, registry rows, status events and raw messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READS_SQL = """
SELECT event_id AS seq,
       concat('E280', lpad(hex(user_id), 20, '0')) AS epc,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('T', event_id) END AS tid,
       CAST(CAST(floor(event_id / 2) AS BIGINT) % 4 + 1 AS INT) AS antenna_port,
       CAST(-40 - round(value % 40, 2) AS FLOAT) AS rssi,
       1 AS read_count,
       ts AS eval_ts,
       concat('reader-', (user_id + event_id % 2) % 30) AS reader_id
FROM events"""

REGISTRY_SQL = """
SELECT n_nationkey AS ordinal,
       concat('reader-', n_nationkey) AS reader_id,
       CASE n_regionkey WHEN 0 THEN 'llrp' WHEN 1 THEN 'identium' WHEN 2 THEN 'impinj'
                        WHEN 3 THEN 'zebra' ELSE 'tcp-socket' END AS provider_id,
       n_name AS brand_name, r_name AS location
FROM nation JOIN region ON n_regionkey = r_regionkey"""

STATUS_SQL = """
SELECT event_id AS seq, ts, concat('reader-', user_id % 25) AS reader_id,
       CASE event_type WHEN 'signup' THEN 'Connecting' WHEN 'view' THEN 'Connected'
                       WHEN 'purchase' THEN 'Reconnecting' WHEN 'error' THEN 'Faulted'
                       ELSE 'Disconnected' END AS new_state
FROM events"""

LINES_SQL = """
SELECT event_id AS seq, CASE event_id % 8
  WHEN 0 THEN concat('{"epc":"E', user_id, '","tid":"T1","rssi":-61.5,"antenna":2}')
  WHEN 1 THEN concat('{"epc":"E', user_id, '"}')
  WHEN 2 THEN concat('  E', user_id, ' ')
  WHEN 3 THEN concat('{"epc":"E', user_id, '",}')
  WHEN 4 THEN '   '
  WHEN 5 THEN '{"rssi":-50}'
  WHEN 6 THEN concat('{"epc":"E', user_id, '","rssi":"-5"}')
  ELSE concat('{"epc":"E', user_id, '","antenna":2.0}') END AS line
FROM events"""

# The large table as reads.  Its dates tie often, so it serves order-free queries.
LINEITEM_READS_SQL = """
SELECT upper(concat('E280', lpad(hex(l_partkey), 20, '0'))) AS epc,
       concat('reader-', l_suppkey) AS reader_id,
       CAST(l_linenumber AS INT) AS antenna_port,
       CAST(-30 - l_quantity AS FLOAT) AS rssi,
       l_shipdate AS eval_ts
FROM lineitem"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _derive(spark: SparkSession, sf_dir: str, sql: str, *names: str, source=table) -> DataFrame:
    """Run a derivation over the given tables without registering views in the session."""
    frames = {name: source(spark, sf_dir, name) for name in names}
    for name in names:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(sql.replace("{\"", "{{\"").replace("}'", "}}'"), **frames)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instants(_derive(spark, sf_dir, READS_SQL, "events"))


def reads_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instants(_derive(spark, sf_dir, READS_SQL, "events", source=table_stream))


def lineitem_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instants(_derive(spark, sf_dir, LINEITEM_READS_SQL, "lineitem"))


def _instants(df: DataFrame) -> DataFrame:
    return df.withColumn("eval_ts", F.col("eval_ts").cast("timestamp"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, REGISTRY_SQL, "nation", "region")


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, STATUS_SQL, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, STATUS_SQL, "events", source=table_stream).withColumn("ts", F.col("ts").cast("timestamp"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, LINES_SQL, "events")


def vendor_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("seq", "reader_id", "epc", "rssi", "antenna_port", "tid")


def mqtt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(
        "seq", F.concat(F.lit("gate/"), F.col("seq") % 5).alias("topic"), F.col("line").alias("payload"))


def _byte_hex(value: Column) -> Column:
    return F.lpad(F.hex(value), 2, "0")


def _signal(rssi: str = "rssi") -> Column:
    """Signal strength without its sign, as a whole number."""
    return F.floor(-F.col(rssi)).cast("bigint")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-layout frames; every eleventh is cut short."""
    whole = F.unhex(F.concat(F.lit("AA55"), _byte_hex(_signal()), _byte_hex(F.col("antenna_port").cast("bigint")),
                             F.col("epc")))
    return reads(spark, sf_dir).select(
        "seq", "reader_id", F.when(F.col("seq") % 11 == 0, F.substring(whole, 1, 15)).otherwise(whole).alias("frame"))


def _report_hex() -> Column:
    """One tag report: every fifth read states its EPC in the long form."""
    antenna = F.lpad(F.hex(F.col("antenna_port").cast("bigint")), 4, "0")
    tail = F.concat(F.lit("DA"), _byte_hex(256 - _signal()), F.lit("DD"), antenna)
    return F.when(F.col("seq") % 5 == 0, F.concat(F.lit("00F0001B" + "00F100120060"), F.col("epc"), tail)) \
        .otherwise(F.concat(F.lit("00F000168D"), F.col("epc"), tail))


def _as_report(parts: Column, message_no: Column) -> Column:
    body = F.array_join(F.transform(F.array_sort(parts), lambda p: p["part"]), "")
    size = F.lpad(F.hex((F.length(body) / 2 + 10).cast("bigint")), 8, "0")
    return F.concat(F.lit("043D"), size, F.lpad(F.hex(message_no), 8, "0"), body)


def report_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report messages of four reads each; ``seq`` is the number of the message."""
    parts = reads(spark, sf_dir).select(F.floor(F.col("seq") / 4).alias("message_no"),
                                        F.struct("seq", _report_hex().alias("part")).alias("p"))
    return parts.groupBy("message_no").agg(F.collect_list("p").alias("parts")).select(
        F.col("message_no").alias("seq"), F.unhex(_as_report(F.col("parts"), F.col("message_no"))).alias("message"))


def tag_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages of one dock: reports of four tags each, judged at the time of the last."""
    clock = reads(spark, sf_dir).groupBy(F.floor(F.col("seq") / 4).alias("seq")).agg(F.max("eval_ts").alias("eval_ts"))
    none = F.lit(None).cast("string")
    return report_messages(spark, sf_dir).join(clock, "seq").select(
        "seq", F.lit("dock-1").alias("reader_id"), "eval_ts", F.lit("LLRP").alias("provider_id"), none.alias("text"), none.alias("topic"),
        F.col("message").alias("body"),
        F.lit(None).cast("struct<epc:string,rssi:float,antenna_port:int,tid:string>").alias("report"))


def captures(spark: SparkSession, sf_dir: str, messages: int = 16) -> DataFrame:
    """Captures of so many messages each, behind ten bytes of noise."""
    part = F.struct("seq", F.hex("message").alias("part"))
    grouped = report_messages(spark, sf_dir).groupBy(F.floor(F.col("seq") / messages).alias("n")).agg(
        F.array_sort(F.collect_list(part)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "")
    return grouped.select(F.concat(F.lit("capture-"), F.col("n")).alias("path"),
                          F.unhex(F.concat(F.lit("FF" * 10), text)).alias("content"))


CHUNKS_SQL = """
SELECT CASE WHEN event_id % 3 = 0 THEN 'port-0' ELSE concat('port-', event_id % 5) END AS stream_id,
       event_id AS chunk_no,
       CASE event_id % 4 WHEN 0 THEN concat(user_id, '.') WHEN 1 THEN concat(user_id, chr(10), ' TAG')
                         WHEN 2 THEN concat(user_id, chr(10), event_id, chr(10), 'X')
                         ELSE concat(user_id, ' ', chr(10)) END AS data
FROM events"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, CHUNKS_SQL, "events")


def chunks_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, CHUNKS_SQL, "events", source=table_stream)


def mixed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages of several providers in one table, with ids in mixed case."""
    kind = F.col("seq") % 6
    frame = F.unhex(F.concat(F.lit("AA55"), _byte_hex(_signal()), _byte_hex(F.col("antenna_port").cast("bigint")),
                             F.col("epc")))
    report = F.unhex(_as_report(F.array(F.struct("seq", _report_hex().alias("part"))), F.col("seq")))
    json = F.to_json(F.struct("epc", F.col("antenna_port").alias("antenna")))
    return reads(spark, sf_dir).select(
        "seq", "reader_id", "eval_ts",
        F.element_at(F.array(*map(F.lit, ("TCP-Socket", "mqtt-broker", "Identium", "LLRP", "zebra", "no-such"))),
                     (kind + 1).cast("int")).alias("provider_id"),
        F.when(kind == 0, F.col("epc")).when(kind == 1, json).alias("text"),
        F.when(kind == 1, F.concat(F.lit("gate/"), F.col("seq") % 5)).alias("topic"),
        F.when(kind == 2, frame).when(kind == 3, report).alias("body"),
        F.when(kind == 4, F.struct("epc", "rssi", "antenna_port", "tid")).alias("report"))
