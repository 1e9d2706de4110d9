import json
from datetime import datetime

import pytest
from cases import UTC, read, reads
from pyspark.sql import functions as F

from tagloom.functions.template import compile_template
from tagloom.operators.batching import batch_count
from tagloom.operators.payload import (collect_batches, render, render_csv_payload, render_form_payload,
                                       render_json_payload, render_template, render_xml_payload, select_tag_fields)
from tagloom.operators.requests import build_requests, dispatch_requests, inject_headers, requests_for
from tagloom.schema import DispatchConfig

AT = datetime(2026, 7, 20, 8, 30, 5, tzinfo=UTC)


@pytest.fixture(scope="module")
def batches(spark):
    rows = [(1, AT, "E1\"", "T1", 1, -42.0, 1, "gate"), (2, AT, "E2", None, 2, -60.5, 3, "dock"),
            (3, AT, "E3", "T3", 4, -70.25, 1, "yard")]
    registry = spark.createDataFrame([(1, "gate", "llrp", "North")],
                                     "ordinal long, reader_id string, provider_id string, brand_name string")
    df = collect_batches(batch_count(reads(spark, rows), 2), registry)
    return df.withColumn("transaction_id", F.concat(F.lit("tx-"), "batch_id")).persist()


def payloads(df):
    return [r.payload for r in df.orderBy("batch_id").collect()]


def test_json(batches):
    first, second = map(json.loads, payloads(render_json_payload(batches)))
    assert first == {"deviceId": "gate", "location": "North", "transactionId": "tx-0",
                     "timestamp": "2026-07-20T08:30:05.000000Z", "tagCount": 2, "tags": [
                         {"epc": "E1\"", "tid": "T1", "antenna": 1, "rssi": -42.0, "readCount": 1,
                          "firstSeen": "2026-07-20T08:30:05Z"},
                         {"epc": "E2", "tid": "", "antenna": 2, "rssi": -60.5, "readCount": 3,
                          "firstSeen": "2026-07-20T08:30:05Z"}]}
    assert (second["location"], second["tagCount"]) == ("RFID Reader", 1)


def test_form_and_csv(batches):
    assert payloads(render_form_payload(batches))[0] == "deviceId=gate&transactionId=tx-0&epc=E1\"&rssi=-42"
    assert payloads(render_csv_payload(batches))[1] == (
        "EPC,TID,AntennaPort,RSSI,FirstSeenTime\nE3,T3,4,-70.25,2026-07-20 08:30:05Z\n")


def test_xml_and_field_choice(batches):
    xml = payloads(render_xml_payload(batches, ("epc", "reader_id")))[1]
    assert "<epc>E3</epc>" in xml and "<readerId>yard</readerId>" in xml and "rssi" not in xml
    tags = batches.orderBy("batch_id").select(select_tag_fields(("antenna_port",)).alias("t")).first().t
    assert [t.asDict() for t in tags] == [{"antenna": 1}, {"antenna": 2}]
    with pytest.raises(ValueError):
        select_tag_fields(("colour",))


def test_format_follows_configuration(batches):
    form = render(batches, DispatchConfig(payload_format="form"))
    assert payloads(form)[0].startswith("deviceId=")
    assert payloads(render(batches, DispatchConfig(template="{{ tags.size }}"))) == ["2", "1"]


@pytest.mark.parametrize("template,text", [
    ("plain", "plain"),
    ("{{ config.ReaderId }}/{{config.location}}/{{ CONFIG.deviceid }}", "gate/North/gate"),
    ("{{ tags.size }} {{ tags[1].EPC }} {{ tags[9].epc }}|", "2 E2 |"),
    ("{% for t in tags %}{{ t.rssi }}{% unless forloop.last %},{% endunless %}{% endfor %}", "-42,-60.5"),
    ("{% for t in tags %}{% if forloop.first %}<{% endif %}{{ forloop.index }}{% if not forloop.last %} {% endif %}{% endfor %}",
     "<1 2"),
    ("{% for t in tags %}[{{ t.TID }}]{% endfor %}", "[T1][]"),
    ("{{ tags[0].firstSeenTime | date: '%d.%m.%Y at %H:%M' }}", "20.07.2026 at 08:30"),
    ("{{ tags[0].lastSeenTime }}", "2026-07-20 08:30:05Z"),
    ("{{ current_utc_iso }} {{ transaction_id }}", "2026-07-20T08:30:05.000000Z tx-0"),
    ("a {%- for t in tags -%} x {%- endfor -%} b", "axxb"),
    ("   ", None),
])
def test_templates(batches, template, text):
    got = payloads(render_template(batches, template))[0]
    assert got == text if text is not None else json.loads(got)["tagCount"] == 2


@pytest.mark.parametrize("template", [
    "{{ nothing }}", "{% for t in tags %}", "{% for t in rows %}{% endfor %}", "{{ tags[0].epc | upcase }}", "{{ open",
    "{% if true %}{% endif %}", "{{ tag.epc }}", "{{ tags[0].epc | date: '%Y' }}", "{% endfor %}",
    "{{ tags[0].firstSeenTime | date: '%Q' }}"])
def test_templates_outside_the_subset_are_refused(spark, template):
    with pytest.raises(ValueError):
        compile_template(template)


def test_headers(spark):
    pairs = [("A", "x {{ Transaction_Id }}"), ("a", "$1 {{ timestamp_utc }}"), ("B", "{{transaction_id}}")]
    given = F.create_map(*[F.lit(text) for pair in pairs for text in pair])
    own = F.create_map(F.lit("x-idempotency-key"), F.lit("own"))
    none = F.lit(None).cast("map<string,string>")
    row = spark.createDataFrame([(r"t$1\2", AT)], "tx string, now timestamp").select(
        *[inject_headers(h, F.col("tx"), F.col("now")).alias(n) for h, n in ((given, "a"), (none, "b"), (own, "c"))]).first()
    assert row.a == {"A": "$1 2026-07-20T08:30:05.000000Z", "B": "{{transaction_id}}", "X-Idempotency-Key": r"t$1\2"}
    assert (row.b, row.c) == ({"X-Idempotency-Key": r"t$1\2"}, {"x-idempotency-key": "own"})


@pytest.mark.parametrize("url,payload,expected", [
    ("https://h.org/a", "x=1", "https://h.org/a?x=1"), ("https://h.org/a?b=2", "??x=1", "https://h.org/a?b=2&x=1"),
    ("https://h.org", "x=1", "https://h.org/?x=1"), ("https://h.org/a#f", "x=1", "https://h.org/a?x=1#f"),
    ("https://h.org/a", "  ", "https://h.org/a"), ("https://h.org/a", None, "https://h.org/a"),
    ("https://h.org/a?b", "", "https://h.org/a?b&"), ("https://h.org/a", "q=a b+é\"", "https://h.org/a?q=a%20b+%C3%A9%22"),
])
def test_get_puts_the_payload_into_the_query(spark, url, payload, expected):
    df = spark.createDataFrame([("t", url, "get", payload, None, AT)], (
        "transaction_id string, target_url string, http_method string, payload string, headers map<string,string>, "
        "rendered_at timestamp"))
    row = requests_for(df).first()
    assert (row.http_method, row.url, row.body, row.content_type) == ("GET", expected, None, None)


def test_post_has_a_body_and_a_content_type(batches):
    row = build_requests(render_form_payload(batches), DispatchConfig()).orderBy("batch_id").first()
    assert row.body == row.payload and row.content_type == "application/json" and row.url == row.target_url
    config = DispatchConfig(http_method="put", headers={"content-TYPE": "text/csv", "K": "v"})
    row = build_requests(render_form_payload(batches), config).first()
    assert row.http_method == "PUT" and row.content_type == "text/csv"
    assert set(row.request_headers) == {"K", "X-Idempotency-Key"}


def test_dispatch_outcomes(batches):
    def send(request):
        if request["transaction_id"] == "tx-0":
            raise TimeoutError("too slow")
        return 404, "gone"

    rows = {r.transaction_id: r for r in dispatch_requests(
        build_requests(render_form_payload(batches), DispatchConfig()), send, partitions=2).collect()}
    assert (rows["tx-0"].is_success, rows["tx-0"].http_status, rows["tx-0"].error_message) == (False, 0, "too slow")
    assert (rows["tx-1"].http_status, rows["tx-1"].response, rows["tx-1"].error_message) == (404, "gone", "HTTP 404")
    assert all(r.elapsed_ms >= 0 for r in rows.values())


def test_ids_are_stable_and_distinct(spark):
    rows = [read(i, i, epc) for i, epc in enumerate(["a", "a", "b", "a"])]
    empty = spark.createDataFrame([], "ordinal long, reader_id string, provider_id string, brand_name string")
    ids = [sorted(r.transaction_id for r in collect_batches(batch_count(reads(spark, order), 2), empty).collect())
           for order in (rows, rows[::-1])]
    assert ids[0] == ids[1] and len(set(ids[0])) == 2
