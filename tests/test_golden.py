"""Golden values of FIXTURES §4 on sf0.001 / sf0.01 (computed by sequential folds)."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF0001, SF001


def q(spark, key, sf):
    return entry.queries()[key](spark, sf)


def test_status_fold_golden(spark):
    for sf, exp in [(SF0001, [1, 4, 2, 2, 5, 1]), (SF001, [6, 29, 28, 32, 30, 25])]:
        c = {r.status: r["count"] for r in q(spark, "status_fold", sf).groupBy("status").count().collect()}
        assert [c.get(s, 0) for s in range(6)] == exp


def test_update_status_golden(spark):
    r = q(spark, "update_status", SF0001)
    assert r.filter("changed").count() == 161
    assert r.filter("status = 0").count() == 6
    assert q(spark, "pending_count", SF0001).first()[0] == 167


def test_poll_and_checkpoint_golden(spark):
    assert q(spark, "scan_requests", SF0001).count() == 7
    assert q(spark, "scan_requests", SF001).count() == 85
    acc = q(spark, "checkpoint_accept", SF0001)
    assert acc.filter("accepted").count() == 136
    for sf, exp in [(SF0001, {"all": 19, "first": 1, "later": 10}), (SF001, {"first": 1, "later": 29})]:
        got = {r.outcome: r["count"] for r in q(spark, "sent_prefix_checkpoint", sf).groupBy("outcome").count().collect()}
        assert got == exp


def test_dead_letter_golden(spark):
    got = {r.msg_type: r["count"] for r in q(spark, "classify_dead_letter", SF0001).groupBy("msg_type").count().collect()}
    assert got == {"Anchor request": 400, "Batch request": 200, "Unknown": 400}


def test_capacity_golden(spark):
    for sf, n, unl, mx in [(SF0001, 531, 642, 691), (SF001, 720, 5170, 370)]:
        p = q(spark, "capacity_plan", sf)
        r = p.agg(F.count(F.lit(1)), F.sum("create"), F.sum("create_max3")).first()
        assert (r[0], r[1], r[2]) == (n, unl, mx)


def test_allowlist_golden(spark):
    r = q(spark, "anchor_authorised_asof", SF0001)
    got = {(x.kind, x.valid): x["count"] for x in r.groupBy("kind", "valid").count().collect()}
    assert got == {("add", True): 93, ("add", False): 106, ("remove", True): 111, ("remove", False): 90,
                   ("anchor", True): 405, ("anchor", False): 195}
    members = sorted(x.addr for x in q(spark, "allowlist_state", SF0001).filter("allowed").collect())
    assert members == [1, 2, 3, 4, 6, 7, 8]
    assert [x.addr for x in q(spark, "allowlist_state", SF001).filter("allowed").collect()] == [1]
