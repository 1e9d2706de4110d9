import random

import pytest
from pyspark.sql import functions as F

from tagloom.sources.frames import decode_identium_frames, decode_vendor_reports
from tagloom.sources.llrp import (ReportCodes, capture_messages, decode_llrp_reports, report_tags, split_llrp_capture)
from tagloom.sources.routing import PROVIDERS, normalize_reads, register, route_by_provider
from tagloom.sources.text import decode_mqtt_messages, decode_text_lines, split_lines

PLAIN = "plain"  # the whole text becomes the EPC
CASES = [
    ("  E1\t", ("E1", None, -50.0, 1)),
    (" E1 ", ("E1", None, -50.0, 1)),
    ("   ", None), ("", None), (None, None),
    ('{"epc":"A","tid":"T","rssi":-61.5,"antenna":3}', ("A", "T", -61.5, 3)),
    ('  {"epc":"A"} ', ("A", None, -50.0, 1)),
    ('{"epc":"A","tid":null}', ("A", None, -50.0, 1)),
    ('{"epc":""}', None), ('{"epc":null}', None), ("{}", None), ('{"EPC":"A"}', None),
    ('{"epc":7}', PLAIN), ('{"epc":"A","tid":[]}', PLAIN), ('{"epc":"A","rssi":"-5"}', PLAIN),
    ('{"epc":"A","rssi":null}', PLAIN), ('{"epc":"A","antenna":true}', PLAIN), ('{"rssi":"x"}', PLAIN),
    ('{"epc":"A","antenna":2.0}', ("A", None, -50.0, 1)), ('{"epc":"A","antenna":1e2}', ("A", None, -50.0, 1)),
    ('{"epc":"A","antenna":3000000000}', ("A", None, -50.0, 1)), ('{"epc":"A","antenna":-4}', ("A", None, -50.0, -4)),
    ('{"epc":"A",}', PLAIN), ('{"epc":"A"} x', PLAIN), ("{'epc':'A'}", PLAIN), ('{"epc":"A","rssi":NaN}', PLAIN),
    ('{"epc":"A"},{"epc":"B"}', PLAIN), ('{"epc":"A","epc":"B"}', ("B", None, -50.0, 1)),
]


def test_text_messages(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)], "seq long, line string")
    got = {r.seq: (r.epc, r.tid, r.rssi, r.antenna_port) for r in decode_text_lines(df).collect()}
    for i, (text, expected) in enumerate(CASES):
        assert got.get(i) == ((text.strip(), None, -50.0, 1) if expected == PLAIN else expected), text


def test_keys_may_ignore_case(spark):
    df = spark.createDataFrame([('{"ePC" :"A","Rssi":-1.5}',), ('{"EPC":"\\"TID\\":"}',)], "line string")
    got = decode_text_lines(df, case_insensitive_keys=True).collect()
    assert sorted((r.epc, r.rssi) for r in got) == [('"TID":', -50.0), ("A", -1.5)]
    assert decode_text_lines(df).count() == 0


def test_decoders_run_on_streams(spark, tmp_path):
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "a.txt").write_text('{"epc":"A","antenna":2}\n\n B \n')
    stream = spark.readStream.text(str(tmp_path / "text")).withColumnRenamed("value", "line")
    decode_text_lines(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.epc, r.antenna_port) for r in got) == [("A", 2), ("B", 1)]
    spark.createDataFrame([(1, bytearray(REPORTS[4][0]))], "seq long, message binary").write.parquet(str(tmp_path / "msg"))
    binary = spark.readStream.schema("seq long, message binary").parquet(str(tmp_path / "msg"))
    decode_llrp_reports(binary).writeStream.format("parquet").option("path", str(tmp_path / "tags")).option(
        "checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "tags")).count() == 2


def test_mqtt_topic_is_kept(spark):
    df = spark.createDataFrame([("gate/1", '{"epc":"A"}')], "topic string, payload string")
    row = decode_mqtt_messages(df).first()
    assert (row.epc, row.extra_metadata) == ("A", {"MqttTopic": "gate/1"})


@pytest.mark.parametrize("slice_bits", [22, 1])
def test_split_lines_equals_split_of_the_whole_text(spark, slice_bits):
    rng = random.Random(2)
    texts = {s: "".join(rng.choice(["a", "b", " ", "\n", "\r\n"]) for _ in range(300)) for s in ("x", "y")}
    texts["z"] = "no end"
    chunks = []
    for stream, text in texts.items():
        at, n = 0, 0
        while at < len(text):
            size = rng.randint(1, 9)
            chunks.append((stream, n, text[at:at + size]))
            at, n = at + size, n + 1
    df = spark.createDataFrame(chunks, "stream_id string, chunk_no long, data string")
    for keep_tail in (True, False):
        expected = []
        for stream, text in texts.items():
            *whole, tail = text.split("\n")
            whole += [tail] if keep_tail and tail else []
            expected += [(stream, i, line.strip()) for i, line in enumerate(whole)]
        got = split_lines(df, keep_tail=keep_tail, slice_bits=slice_bits).collect()
        assert sorted(map(tuple, got)) == sorted(expected)


def test_lone_returns_can_end_lines(spark):
    df = spark.createDataFrame([("s", 0, "a\rb\r"), ("s", 1, "\nc")], "stream_id string, chunk_no long, data string")
    got = split_lines(df, split_returns=True).orderBy("line_no", "part_no").collect()
    assert [r.line for r in got] == ["a", "b", "c"]


def test_frames(spark):
    epc = bytes(range(12))
    df = spark.createDataFrame([(1, bytes([0, 0, 61, 3]) + epc), (2, bytes(15)), (3, bytes([0, 0, 255, 200]) + epc + b"x")],
                               "seq long, frame binary")
    got = sorted((r.seq, r.epc, r.rssi, r.antenna_port) for r in decode_identium_frames(df).collect())
    assert got == [(1, epc.hex().upper(), -61.0, 3), (3, epc.hex().upper(), -255.0, 200)]


def test_vendor_reports(spark):
    df = spark.createDataFrame([(1, "r", "A", -3.5, 2)], "seq long, reader_id string, epc string, rssi double, antenna_port int")
    row = decode_vendor_reports(df).first()
    assert (row.epc, row.rssi, row.antenna_port, row.tid, row.reader_id) == ("A", -3.5, 2, None, "r")


def tlv(kind: int, body: bytes) -> bytes:
    return kind.to_bytes(2, "big") + (len(body) + 4).to_bytes(2, "big") + body


def message(*params: bytes, kind: int = 61) -> bytes:
    body = b"".join(params)
    return (0x0400 | kind).to_bytes(2, "big") + (10 + len(body)).to_bytes(4, "big") + bytes(4) + body


EPC = bytes.fromhex("E28000112233445566778899")
CODES = ReportCodes()
REPORTS = [
    (message(tlv(240, b"\x8d" + EPC)), [(EPC.hex().upper(), -50.0, 1)]),
    (message(tlv(240, b"\x8c" + EPC + b"\xda\xc6\xdd\x00\x03")), [(EPC.hex().upper(), -58.0, 3)]),
    (message(tlv(240, tlv(241, b"\x00\x14\xab\xcd\xe0"))), [("ABCDE0", -50.0, 1)]),
    (message(tlv(240, b"\xda\xc6")), []),
    (message(tlv(240, b"\x8d" + EPC), tlv(99, b"?"), tlv(240, b"\x8c" + EPC[::-1])),
     [(EPC.hex().upper(), -50.0, 1), (EPC[::-1].hex().upper(), -50.0, 1)]),
    (message(tlv(240, b"\x8d" + EPC), b"\x00\xf0\x00\x00"), [(EPC.hex().upper(), -50.0, 1)]),
    (message(tlv(240, b"\xff\x8d" + EPC + b"\x8d\x00")), [(EPC.hex().upper(), -50.0, 1)]),
    (message(tlv(240, b"\x8d" + EPC), kind=62), []),
    (message(tlv(240, b"\x8d" + EPC))[:-1], []),
    (message(tlv(240, b"\x8d" + EPC)) + b"tail", [(EPC.hex().upper(), -50.0, 1)]),
    (b"short", []), (None, []),
]


@pytest.mark.parametrize("data,tags", REPORTS)
def test_report_tags(data, tags):
    assert report_tags(data, CODES) == tags


def test_report_codes_of_the_standard():
    data = message(tlv(240, b"\x8d" + EPC + b"\x86\xc6\x81\x00\x04"))
    assert report_tags(data, ReportCodes(epc96=(13,), peak_rssi=6, antenna=1)) == [(EPC.hex().upper(), -58.0, 4)]


def test_report_job(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(REPORTS)], "seq long, message binary")
    got = sorted((r.seq, r.tag_no, r.epc, r.rssi, r.antenna_port) for r in decode_llrp_reports(df).collect())
    assert got == sorted((i, n, *tag) for i, (_, tags) in enumerate(REPORTS) for n, tag in enumerate(tags))


def test_capture_framing(spark):
    a, b = message(tlv(240, b"\x8d" + EPC)), message()
    noise = bytes([0, 61]) + (5).to_bytes(4, "big") + bytes(4)
    data = a + noise + b + a[:-3]
    assert list(capture_messages(data)) == [(a, False), (b, False), (a[:-3], True)]
    df = spark.createDataFrame([("f", data), ("empty", b"")], "path string, content binary")
    assert [(r.path, r.frame_no, bytes(r.message), r.truncated) for r in split_llrp_capture(df).collect()] == [
        ("f", 0, a, False), ("f", 1, b, False), ("f", 2, a[:-3], True)]


def test_whole_tags_of_a_cut_message_are_decoded(spark):
    tag = tlv(240, b"\x8d" + EPC)
    cut = message(tag + tag)[:-4]
    assert len(report_tags(cut, ReportCodes())) == 1
    frames = split_llrp_capture(spark.createDataFrame([("f", cut)], "path string, content binary"))
    assert [r.epc for r in decode_llrp_reports(frames).collect()] == [EPC.hex().upper()]


def test_passengers_of_a_report_keep_their_values(spark):
    """An instant in the hour that a zone repeats, and an integer that doubles cannot hold."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(1, None, message(tlv(240, b"\x8d" + EPC))), (2, 9007199254740993, message(tlv(240, b"\x8d" + EPC)))],
                                   "seq long, big long, message binary").withColumn("at", F.timestamp_micros(F.lit(1730610000000000)))
        got = decode_llrp_reports(df).select("seq", "big", F.unix_micros("at").alias("us")).orderBy("seq").collect()
        assert [tuple(r) for r in got] == [(1, None, 1730610000000000), (2, 9007199254740993, 1730610000000000)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_capture_files(spark, tmp_path):
    (tmp_path / "one.bin").write_bytes(message(tlv(240, b"\x8d" + EPC)) * 3)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    tags = decode_llrp_reports(split_llrp_capture(files))
    assert [(r.frame_no, r.epc) for r in tags.orderBy("frame_no").collect()] == [(i, EPC.hex().upper()) for i in range(3)]


def test_routing_ignores_case_and_quarantines(spark):
    schema = ("seq long, reader_id string, provider_id string, text string, topic string, body binary, "
              "report struct<epc:string,rssi:float,antenna_port:int,tid:string>")
    rows = [(1, "r", "TCP-socket", "A", None, None, None), (2, "r", "mqtt-BROKER", "B", "t", None, None),
            (3, "r", "llrp", None, None, bytearray(message(tlv(240, b"\x8d" + EPC))), None),
            (4, "r", "Impinj", None, None, None, ("D", -1.0, 2, None)), (5, "r", "other", "F", None, None, None),
            (6, "r", None, "G", None, None, None)]
    decoded, quarantine = route_by_provider(spark.createDataFrame(rows, schema))
    assert {r.seq: r.epc for r in decoded.collect()} == {1: "A", 2: "B", 3: EPC.hex().upper(), 4: "D"}
    assert sorted(r.seq for r in quarantine.collect()) == [5, 6]
    assert normalize_reads(decoded).count() == 4


def test_first_registration_of_a_provider_wins():
    again = register(PROVIDERS, "LLRP", lambda df: df)
    assert again == PROVIDERS and "new" in register(PROVIDERS, "new", lambda df: df)


def test_normalized_defaults(spark):
    row = normalize_reads(spark.createDataFrame([(1, "A", "r")], "seq long, epc string, reader_id string")).first()
    assert (row.antenna_port, row.read_count, row.rssi, row.extra_metadata) == (1, 1, 0.0, {})
    assert row.first_seen == row.last_seen == row.eval_ts
