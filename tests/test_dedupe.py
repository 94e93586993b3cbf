import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folds import dedupe_fold
from keyfold.operators import dedupe as dd
from keyfold.sources import testdata as td
from conftest import SF0001

T = datetime(2024, 1, 1, 12, 0, 0)
DCOLS = "rid string, stream_id string, origin string, cid string, ts timestamp_ntz, crt timestamp_ntz, arrival_seq long"
TCOLS = "stream_id string, origin string, rid string, cid string, ts timestamp_ntz, crt timestamp_ntz"
CCOLS = "stream_id string, cid string, crt timestamp_ntz"


def run(spark, rows, tips=None, cids=None):
    d = spark.createDataFrame(rows, DCOLS)
    t = spark.createDataFrame(tips, TCOLS) if tips is not None else None
    c = spark.createDataFrame(cids, CCOLS) if cids is not None else None
    r = dd.dedupe_requests(d, t, c)
    return sorted((o.arrival_seq, o.event, o.target_rid, o.reason) for o in r.outcomes.collect()), r


def msg(rid, cid, ts, seq=0):
    return (rid, "s", "o", cid, ts, ts, seq)


# The service's own examples: seeded tip / cid state, one input.
def test_new_tip(spark):
    out, _ = run(spark, [msg("A", "cid", T)], [], [])
    assert out == [(0, "READY", "A", "new")]


def test_replaces_old_tip(spark):
    out, _ = run(spark, [msg("B", "newCid", T + timedelta(milliseconds=1))],
                 [("s", "o", "A", "cid", T, T)], [("s", "cid", T)])
    assert out == [(0, "READY", "B", "new"), (0, "REPLACED", "A", "replaced_tip")]


def test_older_than_tip(spark):
    out, _ = run(spark, [msg("B", "newCid", T - timedelta(milliseconds=1))],
                 [("s", "o", "A", "cid", T, T)], [("s", "cid", T)])
    assert out == [(0, "REPLACED", "B", "stale")]


def test_reprocessed_with_and_without_cid(spark):
    out, _ = run(spark, [msg("A", "cid", T)], [("s", "o", "A", "cid", T, T)], [("s", "cid", T)])
    assert out == [(0, "READY", "A", "reprocessed")]
    out, _ = run(spark, [msg("A", "cid", T)], [("s", "o", "A", "cid", T, T)], [])
    assert out == [(0, "READY", "A", "reprocessed")]


def test_cid_exists(spark):
    out, _ = run(spark, [msg("A", "cid", T)], [], [("s", "cid", T)])
    assert out == [(0, "REPLACED", "A", "duplicate_cid")]


def test_duplicate_cid_replaces_both(spark):
    out, _ = run(spark, [msg("B", "cid", T + timedelta(milliseconds=1))],
                 [("s", "o", "A", "cid", T, T)], [("s", "cid", T)])
    assert out == [(0, "REPLACED", "A", "replaced_tip"), (0, "REPLACED", "B", "duplicate_cid")]


def _random_rows(rng, n):
    rows = []
    for seq in rng.sample(range(10 * n), n):
        ts = T + timedelta(seconds=rng.randint(0, 6))
        rows.append((f"r{rng.randint(0, n // 2)}", f"s{rng.randint(0, 2)}", f"o{rng.randint(0, 1)}",
                     f"c{rng.randint(0, 4)}", ts, ts, seq))
    return rows


def test_random_sequences_match_fold(spark):
    rng = random.Random(7)
    for _ in range(4):
        rows = _random_rows(rng, 60)
        got, _ = run(spark, rows)
        exp, _, _ = dedupe_fold([dict(zip(["rid", "stream_id", "origin", "cid", "ts", "crt", "arrival_seq"], r))
                                 for r in rows])
        assert got == sorted(exp)


def test_split_run_equals_single_run(spark):
    rng = random.Random(11)
    rows = _random_rows(rng, 80)
    full, _ = run(spark, rows)
    cut = sorted(r[6] for r in rows)[40]
    first = [r for r in rows if r[6] < cut]
    second = [r for r in rows if r[6] >= cut]
    o1, r1 = run(spark, first)
    d2 = spark.createDataFrame(second, DCOLS)
    r2 = dd.dedupe_requests(d2, r1.tips, r1.cids)
    o2 = sorted((o.arrival_seq, o.event, o.target_rid, o.reason) for o in r2.outcomes.collect())
    assert sorted(o1 + o2) == full


def test_golden_counts_sf0001(spark):
    r = dd.dedupe_requests(td.deliveries(spark, SF0001))
    c = {(x.event, x.reason): x["count"] for x in r.outcomes.groupBy("event", "reason").count().collect()}
    assert c == {("READY", "new"): 613, ("READY", "reprocessed"): 116, ("REPLACED", "stale"): 267,
                 ("REPLACED", "duplicate_cid"): 172, ("REPLACED", "replaced_tip"): 710}
    assert r.tips.count() == 75 and r.cids.count() == 613
    ids = r.outcomes.groupBy("event").agg(F.countDistinct("target_rid").alias("n")).collect()
    assert {x.event: x.n for x in ids} == {"READY": 635, "REPLACED": 954}
