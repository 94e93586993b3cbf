import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folds import batch_fold
from keyfold.operators.batching import batch_requests
from keyfold.options import BatchOptions
from conftest import SF0001

T = datetime(2024, 1, 1, 12, 0, 0)


def sizes(spark, rows, opts):
    df = spark.createDataFrame(rows, "rid long, ts timestamp_ntz")
    b = batch_requests(df, opts).orderBy("flush_window", "batch_no").collect()
    return [len(x.rids) for x in b], [list(x.rids) for x in b]


def test_size_then_linger(spark):
    # size 3, linger 5 s, five requests together => [3, 2]
    rows = [(i, T + timedelta(milliseconds=i)) for i in range(5)]
    s, _ = sizes(spark, rows, BatchOptions(size=3, linger=timedelta(seconds=5), flush=timedelta(hours=1)))
    assert s == [3, 2]


def test_flush_boundary(spark):
    # size 100, linger 1 h, flush 1 s; two requests every 2 s, three times => [2, 2, 2]
    rows = [(2 * k + j, T + timedelta(seconds=2 * k, milliseconds=10 * j)) for k in range(3) for j in range(2)]
    s, _ = sizes(spark, rows, BatchOptions(size=100, linger=timedelta(hours=1), flush=timedelta(seconds=1)))
    assert s == [2, 2, 2]


def test_random_linger_matches_fold(spark):
    rng = random.Random(3)
    rows = [(i, T + timedelta(seconds=rng.randint(0, 4000))) for i in range(150)]
    opts = BatchOptions(size=4, linger=timedelta(minutes=5), flush=timedelta(minutes=30))
    _, got = sizes(spark, rows, opts)
    us = [(r, int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))) for r, t in rows]
    exp = batch_fold(us, 4, 5 * 60 * 10**6, 30 * 60 * 10**6)
    assert got == exp


def test_golden_counts_sf0001(spark):
    rows = spark.read.parquet(f"{SF0001}/events.parquet").select(F.col("event_id").alias("rid"), "ts")
    for size, linger, exp in [(16, 24, {"full": 51, "flush": 29}), (16, 1, {"linger": 398, "flush": 17}),
                              (4, 1, {"full": 66, "linger": 348, "flush": 16})]:
        b = batch_requests(rows, BatchOptions(size=size, linger=timedelta(hours=linger), flush=timedelta(days=1)))
        got = {x.reason: x["count"] for x in b.groupBy("reason").count().collect()}
        assert got == exp
        assert b.agg(F.sum("n")).first()[0] == 1000


def test_bursts_and_gaps_match_fold(spark):
    """Dense bursts (batches fill by size) separated by sparse stretches (batches
    close on linger): chains move between residue-class runs and linger hops."""
    rng = random.Random(17)
    rows, t, rid = [], 0.0, 0
    for _ in range(12):
        for _ in range(rng.randint(5, 40)):      # burst: a row every few seconds
            t += rng.uniform(0.5, 8)
            rows.append((rid, T + timedelta(seconds=t))); rid += 1
        for _ in range(rng.randint(1, 6)):       # sparse: rows minutes apart
            t += rng.uniform(60, 400)
            rows.append((rid, T + timedelta(seconds=t))); rid += 1
    opts = BatchOptions(size=5, linger=timedelta(minutes=2), flush=timedelta(hours=2))
    _, got = sizes(spark, rows, opts)
    us = [(r, int((ts - datetime(1970, 1, 1)) / timedelta(microseconds=1))) for r, ts in rows]
    assert got == batch_fold(us, 5, 2 * 60 * 10**6, 2 * 3600 * 10**6)


def test_ties_follow_arrival_and_any_flush_interval(spark):
    """Rows of one time keep arrival order; 7-day and 7-hour windows count from year 1."""
    rng = random.Random(23)
    rows = [(rng.randint(0, 10**6) * 1000 + i, T + timedelta(minutes=rng.randint(0, 300) * 5), i) for i in range(300)]
    for flush in (timedelta(days=7), timedelta(hours=7), timedelta(days=1)):
        opts = BatchOptions(size=7, linger=timedelta(minutes=20), flush=flush)
        got = batch_requests(spark.createDataFrame(rows, "rid long, ts timestamp_ntz, arrival_seq long"), opts)
        got = [list(x.rids) for x in got.orderBy("flush_window", "batch_no").collect()]
        year1 = datetime(1, 1, 1)
        us = {i: (r, (t - year1) // timedelta(microseconds=1)) for r, t, i in rows}
        exp = batch_fold([(i, u) for i, (_, u) in us.items()], 7, 20 * 60 * 10**6, flush // timedelta(microseconds=1))
        assert got == [[us[i][0] for i in b] for b in exp], flush


def test_flush_boundary_counts_from_year_one(spark):
    from keyfold.functions.timecols import epoch_micros, flush_boundary_micros, flush_window, ntz_from_micros
    df = spark.createDataFrame([(datetime(2024, 1, 10, 3),)], "ts timestamp_ntz")
    for flush, want in ((timedelta(days=7), datetime(2024, 1, 15)), (timedelta(days=1), datetime(2024, 1, 11)), (timedelta(hours=1), datetime(2024, 1, 10, 4))):
        w = flush_window(epoch_micros("ts", df.schema["ts"].dataType), flush)
        assert df.select(ntz_from_micros(flush_boundary_micros(w, flush))).first()[0] == want
    seven_hours = timedelta(hours=7)
    w = flush_window(epoch_micros("ts", df.schema["ts"].dataType), seven_hours)
    at = df.select(ntz_from_micros(flush_boundary_micros(w, seven_hours))).first()[0]
    start = datetime(1, 1, 1)
    assert at == start + ((datetime(2024, 1, 10, 3) - start) // seven_hours + 1) * seven_hours
