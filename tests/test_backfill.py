from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keyfold.operators import backfill as bf
from keyfold.session import scratch_path
from keyfold.streaming.epochs import EpochStore

C = datetime(2024, 1, 10)
RCOLS = "request_id long, status smallint, created_at timestamp_ntz, stream_id long"


def _requests(spark, rows):
    return spark.createDataFrame(rows, RCOLS)


def _meta(spark):
    return spark.createDataFrame([(1, "m")], "stream_id long, metadata string")


def test_limit_cuts_ties_unless_tie_safe(spark):
    t1 = C + timedelta(minutes=1)
    req = _requests(spark, [(1, 0, t1, 1), (2, 0, t1, 1), (3, 0, C + timedelta(minutes=2), 1)])
    lo, hi = bf.ntz_lit(C), bf.ntz_lit(C + timedelta(hours=1))
    plain = bf.scan_requests(req, _meta(spark), 0, lo, hi, limit=1)
    safe = bf.scan_requests(req, _meta(spark), 0, lo, hi, limit=1, tie_safe=True)
    assert plain.count() == 1
    assert sorted(r.request_id for r in safe.collect()) == [1, 2]


def test_open_interval_is_strict(spark):
    req = _requests(spark, [(1, 0, C, 1), (2, 0, C + timedelta(minutes=1), 1), (3, 0, C + timedelta(minutes=2), 1)])
    got = bf.filter_open_interval(req, bf.ntz_lit(C), bf.ntz_lit(C + timedelta(minutes=2)))
    assert [r.request_id for r in got.collect()] == [2]


def test_sent_prefix_first_failure(spark):
    rows = [(1, 0, C + timedelta(minutes=1), 1), (2, 0, C + timedelta(minutes=2), 1)]
    df = _requests(spark, rows).withColumn("poll", F.lit(0))
    first_fails = bf.sent_prefix_checkpoint(df, "poll", F.col("request_id") == 1).first()
    assert first_fails.outcome == "first" and first_fails.n_sent == 0
    assert first_fails.next_checkpoint == C + timedelta(minutes=1) - timedelta(milliseconds=1)
    second_fails = bf.sent_prefix_checkpoint(df, "poll", F.col("request_id") == 2).first()
    assert second_fails.next_checkpoint == C + timedelta(minutes=1) and second_fails.n_sent == 1
    none_fail = bf.sent_prefix_checkpoint(df, "poll", F.lit(False)).first()
    assert none_fail.next_checkpoint == C + timedelta(minutes=2) and none_fail.outcome == "all"


def test_sent_prefix_tells_tied_rows_apart(spark):
    t = C + timedelta(minutes=1)
    rows = [(1, 0, C, 1), (2, 0, t, 1), (3, 0, t, 1)]
    df = _requests(spark, rows).withColumn("poll", F.lit(0))
    got = bf.sent_prefix_checkpoint(df, "poll", F.col("request_id") == 3).first()
    assert (got.n_sent, got.next_checkpoint, got.outcome) == (2, t, "later")


def test_tie_safe_limit_in_another_time_zone(spark):
    t1 = C + timedelta(minutes=1)
    req = _requests(spark, [(1, 0, t1, 1), (2, 0, t1, 1), (3, 0, C + timedelta(minutes=2), 1)])
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        safe = bf.scan_requests(req, _meta(spark), 0, bf.ntz_lit(C), bf.ntz_lit(C + timedelta(hours=1)), limit=1, tie_safe=True)
        assert sorted(r.request_id for r in safe.collect()) == [1, 2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


PCOLS = "request_id long, status smallint, created_at timestamp_ntz, stream_id long, cid string, origin string, ts timestamp_ntz"


def _pending(spark, times):
    return spark.createDataFrame([(i + 1, 0, t, 1, "c", "o", t) for i, t in enumerate(times)], PCOLS)


def _poll_all(spark, req, ticks, fail, limit=100):
    store = EpochStore(spark, scratch_path(spark, "t-poll"))
    out = bf.incremental_backfill(req, ticks, store, fail, limit, min_age=timedelta(hours=12))
    return store, sorted((r.tick, r.checkpoint, r.n_rows, r.n_sent, r.next_checkpoint) for r in out.collect())


def test_poller_publishes_alerts_and_advances(spark):
    """Two rows a poll: all sent, the first fails, the second fails."""
    minute = lambda k: C + timedelta(minutes=k)
    req = _pending(spark, [minute(1), minute(2), minute(3), minute(4)])
    ticks = [C + timedelta(days=1, hours=k) for k in range(3)]
    start = ticks[0] - timedelta(hours=48)
    _, ticks_out = _poll_all(spark, req, ticks, F.lit(False), limit=2)
    assert [t[1:] for t in ticks_out] == [(start, 2, 2, minute(2)), (minute(2), 2, 2, minute(4)), (minute(4), 0, 0, minute(4))]
    store, ticks_out = _poll_all(spark, req, ticks[:1], F.col("request_id") == 1, limit=2)
    assert ticks_out[0][3:] == (0, minute(1) - timedelta(milliseconds=1))
    store, ticks_out = _poll_all(spark, req, ticks[:1], F.col("request_id") == 2, limit=2)
    assert ticks_out[0][3:] == (1, minute(1))
    assert [r.rid for r in bf.poll_messages(store).collect()] == [1]
    alert = bf.poll_alerts(store).first()
    assert alert.desc == "Unprocessed Requests" and alert.content.startswith("2 requests found since:\n2024-01-09 00:00:00 +0000 UTC")


def test_poller_resumes_after_a_stop(spark):
    times = [C + timedelta(minutes=m // 2) for m in range(40)]  # tied pairs
    req, ticks = _pending(spark, times), [C + timedelta(days=1, hours=k) for k in range(5)]
    fail = F.col("request_id") % 7 == 0
    whole, want = _poll_all(spark, req, ticks, fail, limit=6)
    part = EpochStore(spark, scratch_path(spark, "t-poll"))
    bf.incremental_backfill(req, ticks[:2], part, fail, 6)
    # the third tick stops before it is committed
    with pytest.MonkeyPatch.context() as m:
        m.setattr(part, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            bf.incremental_backfill(req, ticks, part, fail, 6)
    assert {r.tick for r in bf.poll_ticks(part).collect()} == {0, 1}  # nothing of the third is seen
    assert {r.tick for r in bf.poll_messages(part).collect()} <= {0, 1}
    out = bf.incremental_backfill(req, ticks, part, fail, 6)
    assert sorted((r.tick, r.checkpoint, r.n_rows, r.n_sent, r.next_checkpoint) for r in out.collect()) == want
    sent = lambda s: sorted((r.tick, r.rid) for r in bf.poll_messages(s).collect())
    assert sent(part) == sent(whole)


def test_two_pollers_commit_a_tick_once(spark):
    """Both poll the second tick before either commits it; requests have come in
    between, so their rows differ. One record stands, and both go on from it."""
    minute = lambda k: C + timedelta(minutes=k)
    early, late = _pending(spark, [minute(k) for k in range(1, 6)]), _pending(spark, [minute(k) for k in range(1, 9)])
    ticks = [C + timedelta(days=1, hours=k) for k in range(3)]
    root = scratch_path(spark, "t-pollers")
    slow, fast = EpochStore(spark, root), EpochStore(spark, root)
    commit, records = slow.commit, []

    def behind(name, number, record):
        if number == 1:
            bf.poll_tick(late, 1, ticks[1], minute(3), fast, F.lit(False), 3)
        records.append((record, commit(name, number, record)))
        return records[-1][1]
    slow.commit = behind
    out = bf.incremental_backfill(early, ticks, slow, F.lit(False), 3)
    assert [(r.tick, r.n_rows, r.next_checkpoint) for r in out.orderBy("tick").collect()] == [
        (0, 3, minute(3)), (1, 3, minute(6)), (2, 0, minute(6))]
    lost = [(mine["n_rows"], stands["n_rows"]) for mine, stands in records if mine != stands]
    assert lost == [(2, 3)] and {r.attempt for r in bf.poll_ticks(slow).collect()} == {s["attempt"] for _, s in records}
    assert sorted((r.tick, r.rid) for r in bf.poll_messages(slow).collect()) == [(0, 1), (0, 2), (0, 3), (1, 4), (1, 5), (1, 6)]
    assert bf.poll_alerts(slow).count() == 2
    bf.incremental_backfill(late, [*ticks, C + timedelta(days=2)], fast, F.lit(False), 3)
    assert sorted(r.rid for r in bf.poll_messages(fast).collect()) == list(range(1, 9))
