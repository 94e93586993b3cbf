"""The decoder against hostile texts: nothing throws, poison is quarantined."""

import pytest
from pyspark.sql import functions as F

from keyfold.functions.ids import uuid_valid
from keyfold.operators.deadletter import classify_dead_letters, quarantine_route
from keyfold.session import conf_override
from keyfold.sources.messages import parse_batch, parse_requests, parse_status, rfc3339_to_ntz

ID = "00000000-0000-4000-8000-00000000000a"
GOOD = f'{{"rid":"{ID}","ts":"2024-02-29T23:59:59.123456789+23:59"}}'
BAD_REQUESTS = [
    '{"ts":"2024-02-30T00:00:00Z"}', '{"ts":"2024-01-01T00:00:00+25:00"}', '{"ts":"2024-01-01T24:00:00Z"}', '{"ts":"2024-01-01 00:00:00Z"}',
    '{"ts":"2024-01-01T00:00:00"}', '{"ts":5}', '{"sid":123}', '{"cid":{"a":1}}', '{"org":["x"]}', '{"rid":"xyz"}', '{"rid":7}', "{} {}", "{}, {}", "{}]", "{}],[{}",
    '{}, "w": 1', "{}}", "hello", "", "[]", "3", '"x"', "{'rid':1}", '{"rid":"a",}', None,
]


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq int, value string")


def test_poison_requests_are_malformed(spark):
    got = parse_requests(texts(spark, BAD_REQUESTS)).orderBy("seq").collect()
    assert [r.value for r in got if not r.malformed] == []
    assert all(r.rid is None and r.ts is None for r in got)
    routes = quarantine_route(parse_requests(texts(spark, BAD_REQUESTS))).select("route").distinct().collect()
    assert [r.route for r in routes] == ["quarantine"]


def test_valid_requests(spark):
    nil = "00000000-0000-0000-0000-000000000000"
    rows = [GOOD, "{}", "null", '{"rid":null,"sid":null,"ts":null}', f'\n {{\n"rid": "{ID.upper()}",\n "sid":"a\\nb", "x":[1,{{}}]\n}}\n',
            f'{{"rid":"urn:uuid:{ID}"}}', f'{{"rid":"{{{ID}}}"}}', f'{{"rid":"{ID.replace("-", "")}"}}', '{"crt":"2024-01-01T00:00:00.5-00:30"}']
    got = parse_requests(texts(spark, rows)).orderBy("seq").select("*", F.col("ts").cast("string").alias("t"), F.col("crt").cast("string").alias("c")).collect()
    assert not any(r.malformed for r in got)
    assert [r.rid for r in got] == [ID, nil, nil, nil, ID, ID, ID, ID, nil]
    assert got[0].t == "2024-02-29 00:00:59.123456" and got[1].t == "0001-01-01 00:00:00" and got[8].c == "2024-01-01 00:30:00.5"
    assert got[4].stream_id == "a\nb" and got[3].stream_id == ""


@pytest.mark.parametrize("value,want", [('{"sts":5}', 5), ('{"sts":0}', 0), ('{"sts":255}', 255), ("{}", 0), ('{"sts":null}', 0), ('{"sts":"5"}', None), ('{"sts":5.0}', None),
                                        ('{"sts":256}', None), ('{"sts":-1}', None), ('{"sts":1e1}', None), ('{"sts":true}', None), ('{"sts":99999999999999999999}', None), ('{"sts":5} 1', None)])
def test_status_numbers(spark, value, want):
    r = parse_status(texts(spark, [value])).first()
    assert (r.malformed, r.sts) == (want is None, want)


def test_line_breaks_count(spark):
    """A line break at the end of an id or a time is another text."""
    rows = [f'{{"rid":"{ID}\\n"}}', '{"ts":"2024-01-01T00:00:00Z\\n"}', f'{{"rid":"{ID}\\r"}}', f'{{"rid":" {ID}"}}', '{"crt":"2024-01-01T00:00:00Z\\u2028"}']
    assert all(r.malformed for r in parse_requests(texts(spark, rows)).collect())
    ids = texts(spark, [ID, ID + "\n", ID.upper(), f"{{{ID}}}", ID.replace("-", ""), "URN:UUID:" + ID, f"{{{ID}", ID[:-1], "", None, "0" * 32, ID + "\u2028"])
    valid = [r.v for r in ids.orderBy("seq").select(uuid_valid(F.col("value")).alias("v")).collect()]
    assert valid == [True, False, True, True, True, True, False, False, False, False, False, False]


def test_keys_in_any_case(spark):
    rows = [f'{{"RID":"{ID}","Sid":"s","oRG":"o","TS":"2024-01-01T00:00:00Z"}}', f'{{"r\\u0049d":"{ID}","\u017fid":"s"}}', f'{{"rid":"{ID}","RID":"{ID}"}}', f'{{"rid":"{ID}","rid":"{ID}"}}',
            '{"RID":5}', '{"rid ":5,"":1}', f'{{"x":{{"RID":5}},"rid":"{ID}"}}']
    got = parse_requests(texts(spark, rows)).orderBy("seq").collect()
    assert [r.malformed for r in got] == [False, False, True, True, True, False, False]
    assert (got[0].rid, got[0].stream_id, got[0].origin, str(got[0].ts)) == (ID, "s", "o", "2024-01-01 00:00:00")
    assert (got[1].rid, got[1].stream_id) == (ID, "s") and got[5].rid.startswith("00000000-0000-0000") and got[6].rid == ID
    assert parse_status(texts(spark, [f'{{"Rid":"{ID}","STS":5}}'])).first().sts == 5
    got = [(r.msg_type, r.msg_id) for r in classify_dead_letters(texts(spark, [f'{{"BID":"{ID}","Rids":["{ID}"]}}', f'{{"Bid":"{ID}","RIDS":["x"]}}'])).orderBy("seq").collect()]
    assert got == [("Batch request", ID), ("Unknown", "Unknown")]


def test_a_text_that_closes_the_array(spark):
    """Two values, and texts that end the array that the decoder parses in."""
    tag = spark.range(1).select(F.xxhash64(F.lit("{}")).alias("h")).first().h
    rows = ["{},{}", "{}],[{}", f"{{}},{tag}", f"{{}},{tag}],[{{}}", "{},1]", "{}]", "{}\n{}", "null null", "{} //x"]
    assert all(r.malformed for r in parse_requests(texts(spark, rows)).collect())


def test_times(spark):
    rows = ["2024-02-29T00:00:00Z", "2023-02-29T00:00:00Z", "0001-01-01T00:00:00Z", "9999-12-31T23:59:59.999999999Z", "0000-01-01T00:00:00Z", "2024-01-01T00:00:00.1234567890123-23:59",
            "1582-10-10T00:00:00+01:00", "2024-03-31T02:30:00Z", "+2024-01-01T00:00:00Z", "2024-13-01T00:00:00Z"]
    for zone in ("UTC", "America/New_York"):
        with conf_override(spark, {"spark.sql.session.timeZone": zone}):
            got = [r.t for r in texts(spark, rows).orderBy("seq").select(rfc3339_to_ntz(F.col("value")).cast("string").alias("t")).collect()]
        assert got == ["2024-02-29 00:00:00", None, "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999", "0000-01-01 00:00:00", "2024-01-01 23:59:00.123456", "1582-10-09 23:00:00",
                       "2024-03-31 02:30:00", None, None]


def test_batches_and_dead_letters(spark):
    rows = [f'{{"bid":"{ID}","rids":["{ID}"]}}', f'{{"bid":"{ID}","rids":[]}}', f'{{"bid":"{ID}","rids":["x"]}}', f'{{"bid":"{ID}","rids":[1]}}', f'{{"bid":"{ID}","rids":"x"}}',
            f'{{"bid":"{ID}","rids":[null]}}', f'{{"rid":"{ID}"}}', f'{{"rid":"{ID}","ts":"2024-02-30T00:00:00Z"}}', "junk"]
    assert [r.malformed for r in parse_batch(texts(spark, rows)).orderBy("seq").collect()] == [False, False, True, True, True, False, False, False, True]
    got = [r.msg_type for r in classify_dead_letters(texts(spark, rows)).orderBy("seq").collect()]
    assert got == ["Batch request", "Batch request", "Unknown", "Unknown", "Unknown", "Batch request", "Anchor request", "Unknown", "Unknown"]


def test_a_stream_decodes(spark, tmp_path):
    texts(spark, [*BAD_REQUESTS, GOOD]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq int, value string").parquet(str(tmp_path / "in"))
    parsed = parse_requests(stream)
    q = parsed.select("seq", "malformed", "rid").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("NOT malformed").count() == 1
