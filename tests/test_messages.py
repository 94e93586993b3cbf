from keyfold.operators.deadletter import classify_dead_letters, redrive_split
from keyfold.sources.messages import parse_requests, parse_status

U = "00000000-0000-4000-8000-000000000001"


def test_dead_letter_classes(spark):
    texts = [
        (1, '{"rid":"%s","sid":"s","ts":"2024-01-01T00:00:00Z"}' % U),
        (2, '{"rid":"%s","sts":5}' % U),
        (3, '{"bid":"%s","rids":[]}' % U),
        (4, '{"rid":"%s","ts":"bad"}' % U),
        (5, "{}"),
        (6, "hello"),
    ]
    df = spark.createDataFrame(texts, "seq long, value string")
    got = {r.seq: (r.msg_type, r.msg_id) for r in classify_dead_letters(df).collect()}
    assert got == {1: ("Anchor request", U), 2: ("Anchor request", U), 3: ("Batch request", U),
                   4: ("Unknown", "Unknown"), 5: ("Unknown", "Unknown"), 6: ("Unknown", "Unknown")}


def test_zero_values_are_valid(spark):
    df = spark.createDataFrame([(1, "{}"), (2, "hello")], "seq long, value string")
    r = {x.seq: x for x in parse_requests(df).collect()}
    assert not r[1].malformed and r[1].stream_id == "" and r[1].rid.startswith("00000000-0000-0000")
    assert r[2].malformed


def test_status_message(spark):
    df = spark.createDataFrame([(1, '{"rid":"%s"}' % U), (2, "invalid request"), (3, '{"rid":"%s","sts":300}' % U)],
                               "seq long, value string")
    r = {x.seq: x for x in parse_status(df).collect()}
    assert r[1].sts == 0 and not r[1].malformed and r[2].malformed and r[3].malformed


def test_redrive(spark):
    d = spark.createDataFrame([("a",)] * 4 + [("b",)] * 3, "rid string")
    got = {r.rid: (r.receive_count, r.dead) for r in redrive_split(d).collect()}
    assert got == {"a": (4, True), "b": (3, False)}
