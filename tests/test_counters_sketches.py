"""Counters observed on a job's own passes, receives counted on a stream, and
mergeable sketches of batch sizes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from keyfold.operators import batching as bt
from keyfold.operators import deadletter as dl
from keyfold.operators import metrics as mt
from keyfold.session import scratch_path
from keyfold.sources.messages import parse_requests
from keyfold.streaming import jobs as sj
from keyfold.streaming import keyed as ks
from keyfold.streaming.counters import StreamCounters
from keyfold.streaming.epochs import EpochStore

from test_keyed_streams import Feed


def one():
    return F.count(F.lit(1))


def test_run_counters_come_from_the_writes(spark):
    run, root = mt.RunCounters(), scratch_path(spark, "t-run")
    rows = spark.range(100)
    run.on(rows.repartition(7).filter("id % 2 = 0"), batch_stored=one()).write.parquet(f"{root}/a")
    run.on(rows.filter("id < 0"), failure_message=one(), batch_ingress_request=F.sum("id")).write.parquet(f"{root}/b")
    run.on(rows.filter("id < 3"), batch_stored=one(), batch_ingress_request=F.sum("id")).write.parquet(f"{root}/c")
    got = {r.metric: r.value for r in run.frame(spark).collect()}
    assert got == {**dict.fromkeys(mt.COUNTERS, 0), "batch_stored": 53, "batch_ingress_request": 3}
    with pytest.raises(ValueError, match="no such counters"):
        run.on(rows, batches=one())


def test_stream_counters_come_with_progress(spark):
    counters = StreamCounters()
    ingest = lambda s: counters.on(parse_requests(s), validate_ingress_request=one(), failure_message=F.count_if("malformed"))
    feed = Feed(spark, "t-listen", "value string", ingest, fmt="text")
    good = '{"rid":"00000000-0000-4000-8000-000000000001"}'
    spark.streams.addListener(counters)
    try:
        for texts in ([good, "poison"], [good] * 3, ["{", "more"]):
            feed.put([(t,) for t in texts])
        until = time.time() + 30
        while time.time() < until and counters.totals()["validate_ingress_request"] < 7:
            time.sleep(0.2)  # progress is told from a thread of its own
    finally:
        spark.streams.removeListener(counters)
    assert counters.totals() == {**dict.fromkeys(mt.COUNTERS, 0), "validate_ingress_request": 7, "failure_message": 3}


def test_a_micro_batch_that_runs_again_counts_once():
    c = StreamCounters()
    for query, number, n in (("q", 0, 5), ("q", 1, 3), ("q", 1, 4), ("r", 0, 2), ("q", 0, 9)):
        c.batch(query, number, {"batch_created": n})
    assert c.totals()["batch_created"] == 5 + 4 + 2


def test_message_goes_dead_across_micro_batches(spark):
    store = EpochStore(spark, scratch_path(spark, "t-redrive"))
    feed = Feed(spark, "t-receives", "rid string", sj.receive_counts, sj.redrive_batch_fn(store))
    feed.start = lambda every=None: ks.start(sj.receive_counts(spark.readStream.schema("rid string").parquet(f"{feed.root}/in")), feed.sink,
                                             f"{feed.root}/checkpoint", every, "update")
    rng = random.Random(3)
    appends = [["a"] * 3 + ["b"], ["a", "b", None], ["b", "a"], ["b"], ["b", None] + [rng.choice("cdefg") for _ in range(17)]]
    for ids in appends:
        feed.put([(i,) for i in ids])
    got = {r.rid: r for r in sj.redriven(store).collect()}
    assert (got["a"].dead_epoch, got["b"].dead_epoch, got[None].dead_epoch) == (1, 3, None)
    flat = spark.createDataFrame([(i,) for ids in appends for i in ids], "rid string")
    assert {(r.rid, r.receive_count, r.dead) for r in dl.redrive_split(flat).collect()} == {(r.rid, r.receive_count, r.dead) for r in got.values()}


def test_merged_sketches_keep_their_rank_error(spark):
    """Windows of very different sizes, far more values than a sketch keeps."""
    rng = random.Random(1)
    values = [(w, rng.randint(1, 10) ** rng.randint(1, 6)) for w in range(12) for _ in range(40 if w % 3 else 9_000)]
    batches = spark.createDataFrame(values, "flush_window long, n long")
    stored = bt.size_sketches(batches, 256)
    half = (F.col("flush_window") >= 6).alias("half")
    for r in bt.merged_sizes(stored, half, probabilities=(0.01, 0.5, 0.9, 0.999), k=256).collect():
        part = sorted(n for w, n in values if (w >= 6) == r.half)
        assert (r.n_batches, r.n_requests, r.min_size, r.max_size) == (len(part), sum(part), part[0], part[-1])
        for name, p in (("p1", 0.01), ("p50", 0.5), ("p90", 0.9), ("p99_9", 0.999)):
            below, upto = sum(n < r[name] for n in part) / len(part), sum(n <= r[name] for n in part) / len(part)
            assert below - 0.025 <= p <= upto + 0.025  # 256 ** -0.9 * 2.3 = 0.016 with 99 %


def test_small_sketches_are_exact(spark):
    batches = spark.createDataFrame([(0, n) for n in range(1, 101)] + [(1, 7)], "flush_window long, n long")
    r = bt.merged_sizes(bt.size_sketches(batches)).first()
    assert (r.n_batches, r.min_size, r.p50, r.p90, r.max_size) == (101, 1, 50, 90, 100)
    assert bt.merged_sizes(bt.size_sketches(batches.filter("n < 0"))).first().n_batches is None
