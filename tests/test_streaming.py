"""Stream equals batch: dedup, batching, status, dead letters, capacity samples."""

import random
from datetime import datetime, timedelta

import pytest

from keyfold.operators import batching as bt
from keyfold.options import BatchOptions
from keyfold.session import scratch_path
from keyfold.streaming import jobs as sj
from keyfold.streaming.epochs import EpochStore

DCOLS = "rid string, stream_id string, origin string, cid string, ts timestamp_ntz, crt timestamp_ntz, arrival_seq long"
T0 = datetime(2024, 1, 1, 12)


def deliveries(n, seed=9):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        ts = T0 + timedelta(seconds=rng.randint(0, 3))  # many equal timestamps
        rows.append((f"r{rng.randint(0, 40)}", f"s{rng.randint(0, 2)}", "o", f"c{rng.randint(0, 6)}", ts, ts, seq))
    return rows


def bursts(n, seed):
    """Arrivals in order with ties, bursts and gaps."""
    rng, rows, t = random.Random(seed), [], T0
    for seq in range(n):
        t += timedelta(seconds=rng.choice([0, 0, 0, 1, 2, 400]))
        rows.append((1000 - seq, t, seq))
    return rows


RCOLS = "rid long, ts timestamp_ntz, arrival_seq long"


def in_order(batches):
    return [(r.flush_window, r.batch_no, list(r.rids), r.reason) for r in batches.orderBy("flush_window", "batch_no").collect()]


@pytest.mark.parametrize("linger,seed", [(timedelta(minutes=5), 1), (timedelta(hours=2), 2)])
def test_batching_stream_equals_batch(spark, linger, seed):
    rows = bursts(120, seed)
    opts = BatchOptions(size=4, linger=linger, flush=timedelta(hours=1))
    want = in_order(bt.batch_requests(spark.createDataFrame(rows, RCOLS), opts))
    cuts = sorted(random.Random(seed).sample(range(1, 120), 4))
    store = EpochStore(spark, scratch_path(spark, "t-batches"))
    fn = sj.batching_batch_fn(store, opts)
    for epoch, (a, b) in enumerate(zip([0, *cuts], [*cuts, 120])):
        fn(spark.createDataFrame(rows[a:b], RCOLS), epoch)
        if epoch == 2:
            fn(spark.createDataFrame(rows[a:b], RCOLS), epoch)  # retried
    sj.drain(store, 4, opts)
    assert in_order(store.read_all("batches")) == want
    assert store.read("counts", store.newest("counts")).count() <= 2  # ended windows are not carried


def test_drain_then_resume_gives_every_request_once(spark):
    rows = bursts(40, 3)
    opts = BatchOptions(size=4, linger=timedelta(hours=1), flush=timedelta(hours=6))
    store = EpochStore(spark, scratch_path(spark, "t-drain"))
    fn = sj.batching_batch_fn(store, opts)
    fn(spark.createDataFrame(rows[:18], RCOLS), 0)
    drained = sj.drain(store, 0, opts)
    assert drained.count() >= 1 and store.read("tail", store.newest("tail")).count() == 0
    assert sj.drain(store, 0, opts).count() == 0  # nothing left
    fn(spark.createDataFrame(rows[18:], RCOLS), 1)
    sj.drain(store, 1, opts)
    out = store.read_all("batches").collect()
    assert sorted(x for r in out for x in r.rids) == sorted(r[0] for r in rows)
    assert len({r.bid for r in out}) == len(out) == len({(r.flush_window, r.batch_no) for r in out})


def test_idle_batch_closes_by_time(spark):
    opts = BatchOptions(size=100, linger=timedelta(minutes=10), flush=timedelta(hours=6))
    store = EpochStore(spark, scratch_path(spark, "t-idle"))
    sj.batching_batch_fn(store, opts)(spark.createDataFrame([(1, T0, 1), (2, T0, 2)], RCOLS), 0)
    assert sj.close_due(store, 0, opts, T0 + timedelta(minutes=9)).count() == 0
    due = sj.close_due(store, 0, opts, T0 + timedelta(minutes=10)).collect()
    assert [(list(r.rids), r.reason) for r in due] == [([1, 2], "linger")]
    assert sj.close_due(store, 0, opts, T0 + timedelta(hours=9)).count() == 0
    clocked = EpochStore(spark, scratch_path(spark, "t-clock"))
    sj.batching_batch_fn(clocked, opts, now=lambda: T0 + timedelta(hours=1))(spark.createDataFrame([(1, T0, 1)], RCOLS), 0)
    assert clocked.read_all("batches").count() == 1


def test_dead_letter_poison_does_not_stop_the_stream(spark):
    store = EpochStore(spark, scratch_path(spark, "t-dlq"))
    texts = ['{"rid":"00000000-0000-4000-8000-00000000000a","ts":"2024-02-30T00:00:00Z"}', "{} {}", '{"rid":\n"00000000-0000-4000-8000-00000000000a"}']
    sj.dlq_batch_fn(store)(spark.createDataFrame(list(enumerate(texts)), "seq long, value string"), 0)
    assert [r.msg_type for r in store.read_all("alerts").orderBy("seq").collect()] == ["Unknown", "Unknown", "Anchor request"]


def test_late_capacity_samples_count(spark):
    store = EpochStore(spark, scratch_path(spark, "t-capacity"))
    fn = sj.capacity_sample_fn(store)
    cols = "ts timestamp_ntz, seq long, unprocessed long, inflight long, existing long"
    fn(spark.createDataFrame([(T0, 1, 5, 0, 0), (T0 + timedelta(seconds=29), 2, 6, 0, 0), (T0 + timedelta(days=3), 3, 9, 0, 0)], cols), 0)
    fn(spark.createDataFrame([(T0 + timedelta(seconds=29), 4, 7, 1, 1), (T0 + timedelta(seconds=3), 5, 1, 1, 1)], cols), 1)  # days late
    got = [(r.tick_start, r.unprocessed, r.inflight) for r in sj.last_samples(store).orderBy("tick_start").collect()]
    assert got == [(T0, 7, 1), (T0 + timedelta(days=3), 9, 0)]
