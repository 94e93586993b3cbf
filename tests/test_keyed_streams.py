"""Jobs on Spark's keyed state: stream equals batch, also over restarts; time to
live, timers, drain marks; streams with several outputs."""

import os
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from keyfold.operators import batching as bt
from keyfold.operators import dedupe as dd
from keyfold.operators import status as st
from keyfold.options import BatchOptions
from keyfold.session import exists, scratch_path
from keyfold.streaming import keyed as ks
from keyfold.streaming import outputs as so
from keyfold.streaming.epochs import EpochStore

from test_streaming import DCOLS, RCOLS, T0, bursts, deliveries, in_order


class Feed:
    """A file stream that is fed one append at a time. Each append, of several
    files, is run to its end and the query is gone before the next is added: every
    append also tests a restart."""

    def __init__(self, spark, name, schema, job, sink=None, fmt="parquet"):
        self.spark, self.schema, self.fmt, self.job = spark, schema, fmt, job
        self.root = scratch_path(spark, name)
        self.sink = sink or f"{self.root}/out"
        os.makedirs(f"{self.root}/in")

    def start(self, every=None):
        src = self.spark.readStream.schema(self.schema).format(self.fmt).load(f"{self.root}/in")
        stream = self.job(src)
        self.out_schema = stream.schema
        return ks.start(stream, self.sink, f"{self.root}/checkpoint", every)

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).write.mode("append").format(self.fmt).save(f"{self.root}/in")
        self.start().awaitTermination()

    def out(self):
        return self.spark.read.schema(self.out_schema).parquet(f"{self.root}/out")


FLAGS = ["arrival_seq", "rid", "stream_id", "origin", "cid", "ts", "crt", "accepted", "prev_tip_rid", "reprocessed", "new_cid"]


def test_dedupe_equals_batch_over_a_restart(spark):
    rows = deliveries(240)
    want = sorted(map(tuple, dd.dedupe_requests(spark.createDataFrame(rows, DCOLS)).flags.select(*FLAGS).collect()))
    feed = Feed(spark, "t-keyed", DCOLS, lambda s: ks.dedupe_stream(s, buckets=3))
    for i in range(4):
        feed.put(rows[i * 60:(i + 1) * 60])
    assert sorted(map(tuple, feed.out().select(*FLAGS).collect())) == want


def test_dedupe_with_nulls_and_zero_times(spark):
    zero = datetime(1, 1, 1)
    rows = [("a", "", "", None, zero, zero, 0), ("b", "", "", None, T0, zero, 1), ("a", None, "", "c", zero, zero, 2), ("a", None, "", "c", zero, zero, 3)]
    want = sorted(map(tuple, dd.dedupe_requests(spark.createDataFrame(rows, DCOLS)).flags.select(*FLAGS).collect()))
    feed = Feed(spark, "t-nulls", DCOLS, lambda s: ks.dedupe_stream(s, buckets=2))
    feed.put(rows[:3])
    feed.put(rows[3:])
    got = sorted(map(tuple, feed.out().select(*FLAGS).collect()))
    assert [r[0] for r in got] == [0, 1, 2, 3] and got[:2] == want[:2]
    assert got[3][7:] == (True, "a", True, False)  # a redelivery of the stored tip


def wait_for(query, feed, n):
    """Until the stream has written ``n`` rows (a limit keeps a fault from hanging)."""
    until = time.time() + 60
    while time.time() < until and query.isActive and not (exists(feed.spark, f"{feed.root}/out/_spark_metadata") and feed.out().count() >= n):
        time.sleep(0.5)


def test_expired_state_counts_as_absent(spark):
    """Time to live runs on the clock, so the query runs on."""
    row = lambda rid, seq: (rid, "s", "o", "c", T0, T0, seq)
    feed = Feed(spark, "t-ttl", DCOLS, lambda s: ks.dedupe_stream(s, ttl=timedelta(seconds=4), buckets=1))
    query = feed.start(every="1 second")
    for n, rid in enumerate("ac"):
        spark.createDataFrame([row(rid, n)], DCOLS).coalesce(1).write.mode("append").parquet(f"{feed.root}/in")
        wait_for(query, feed, n + 1)
        time.sleep(6)
    query.stop()
    got = {r.rid: r for r in feed.out().collect()}
    assert got["a"].new_cid and got["c"].accepted and got["c"].prev_tip_rid is None and got["c"].new_cid


def test_status_equals_fold_over_a_restart(spark):
    rng = random.Random(4)
    cols = "id long, sts smallint, seq long"
    initial = spark.createDataFrame([(i, rng.randint(0, 5)) for i in range(20)], "id long, status smallint")
    events = [(rng.randint(0, 24), rng.choice([0, 1, 2, 4, 5, 5]), seq) for seq in range(150)]
    want = {r.id: r.status for r in st.status_fold(spark.createDataFrame(events, cols), initial).collect()}
    feed = Feed(spark, "t-kstatus", cols, lambda s: ks.status_stream(s, initial, buckets=3))
    for i in range(3):
        feed.put(events[i * 50:(i + 1) * 50])
    assert {r.id: r.status for r in ks.statuses(initial, feed.out()).collect()} == want


DRAIN = RCOLS + ", drain boolean"


@pytest.mark.parametrize("linger,seed", [(timedelta(minutes=5), 1), (timedelta(hours=2), 2)])
def test_batches_equal_batch_and_drain(spark, linger, seed):
    rows = bursts(120, seed)
    opts = BatchOptions(size=4, linger=linger, flush=timedelta(hours=1))
    want = in_order(bt.batch_requests(spark.createDataFrame(rows, RCOLS), opts))
    feed = Feed(spark, "t-kbatch", DRAIN, lambda s: ks.batch_stream(s, opts))
    cuts = [0, *sorted(random.Random(seed).sample(range(1, 120), 3)), 120]
    for a, b in zip(cuts, cuts[1:]):
        feed.put([(*r, False) for r in rows[a:b]])
    feed.put([(None, None, None, True)])
    feed.put([(None, None, None, True)])  # nothing is left
    assert in_order(feed.out()) == want
    ids = {r.bid for r in bt.batch_requests(spark.createDataFrame(rows, RCOLS), opts).collect()}
    assert {r.bid for r in feed.out().collect()} == ids


def test_idle_stream_emits_its_batch(spark):
    """Live arrivals: a timer closes the open batch, no arrival does."""
    opts = BatchOptions(size=100, linger=timedelta(seconds=4), flush=timedelta(days=1))
    feed = Feed(spark, "t-idle-timer", RCOLS, lambda s: ks.batch_stream(s, opts, live=True))
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(1, now, 1), (2, now + timedelta(seconds=1), 2)], RCOLS).write.mode("append").parquet(f"{feed.root}/in")
    query = feed.start(every="1 second")
    wait_for(query, feed, 1)
    query.stop()
    got = feed.out().collect()
    assert [(r.rids, r.reason, r.batch_no) for r in got] == [([1, 2], "linger", 0)]


def test_texts_go_on_or_to_quarantine(spark):
    texts = [f'{{"rid":"00000000-0000-4000-8000-00000000000{i}"}}' for i in range(4)] + ["poison", "{", "{} {}", '{"ts":"2024-02-30T00:00:00Z"}']
    store = EpochStore(spark, scratch_path(spark, "t-ingest"))
    fn = so.ingest_batch_fn(store)
    feed = Feed(spark, "t-texts", "value string", lambda s: s, fn, "text")
    feed.put([(t,) for t in texts[:5]])
    feed.put([(t,) for t in texts[5:]])
    feed.put([("more poison",)])
    assert {r.rid[-1] for r in so.routed(store, "valid").collect()} == set("0123")
    bad = [*texts[4:], "more poison"]
    assert sorted(r.value for r in so.routed(store, "quarantine").collect()) == sorted(bad)
    assert {r.metric: r.value for r in so.ingest_counts(store).collect()} == {"validate_ingress_request": 9, "failure_message": 5}
    fn(spark.createDataFrame([(t,) for t in texts[5:]], "value string"), 1)  # the epoch again: the same two outputs
    assert so.routed(store, "valid").count() == 4 and so.routed(store, "quarantine").count() == 5
    assert {r.metric: r.value for r in so.ingest_counts(store).collect()} == {"validate_ingress_request": 9, "failure_message": 5}


def test_manifest_follows_the_store(spark, monkeypatch):
    rows = bursts(40, 5)
    opts = BatchOptions(size=4, linger=timedelta(minutes=5), flush=timedelta(hours=1))
    store = EpochStore(spark, scratch_path(spark, "t-publish"))
    fn = so.publish_batches_fn(store)
    crash = {"on": True}

    def manifest(batch, path, write=so.write_batch_manifest):
        if crash.pop("on", None):
            raise RuntimeError("lost between the steps")
        write(batch, path)
    monkeypatch.setattr(so, "write_batch_manifest", manifest)
    feed = Feed(spark, "t-pub", DRAIN, lambda s: ks.batch_stream(s, opts), fn)
    with pytest.raises(Exception, match="lost between"):
        feed.put([(*r, False) for r in rows[:20]])
    assert exists(spark, store.path("stored", 0)) and not exists(spark, store.path("manifest", 0))
    feed.put([(*r, False) for r in rows[20:]] + [(None, None, None, True)])  # the failed epoch first
    read = lambda name: spark.read.json(f"{store.root}/{name}").select("bid", F.size("rids").alias("n")).collect()
    stored, told = read("stored"), read("manifest")
    assert {r.bid for r in stored} == {r.bid for r in told} and len(stored) == len(told) and all(r.n == 0 for r in told)
    assert sum(r.n for r in stored) == 40
