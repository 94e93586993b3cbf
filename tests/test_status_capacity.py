import random

from pyspark.sql import functions as F

from folds import status_fold
from keyfold.operators import capacity as cp
from keyfold.operators import status as st
from keyfold.options import CapacityOptions


def test_replaced_only_from_pending(spark):
    req = spark.createDataFrame([(1, 0, None), (2, 4, None)], "request_id long, status smallint, updated_at timestamp_ntz")
    ev = spark.createDataFrame([(1, 5, 1), (2, 5, 2), (3, 5, 3)], "id long, sts smallint, seq long")
    out = {r.request_id: (r.status, r.changed) for r in st.update_status(req, ev, F.lit(None)).collect()}
    assert out == {1: (5, True), 2: (4, False)}  # unknown id 3 is a no-op


def test_random_fold(spark):
    rng = random.Random(5)
    initial = {i: rng.randint(0, 5) for i in range(12)}
    events = [(rng.randint(0, 13), rng.choice([0, 1, 2, 3, 4, 5, 5, 5]), seq) for seq in rng.sample(range(1000), 200)]
    got = st.status_fold(spark.createDataFrame(events, "id long, sts smallint, seq long"),
                         spark.createDataFrame(list(initial.items()), "id long, status smallint"))
    assert {r.id: r.status for r in got.collect()} == status_fold(initial, events)


CASES = [  # unprocessed, inflight, existing, max, factor, create
    (5, 0, 0, -1, 0.5, 3), (3, 0, 0, 2, 1.0, 2), (5, 0, 0, 2, 0.5, 1), (3, 0, 2, 2, 1.0, 0),
    (0, 0, 0, -1, 1.0, 0), (1, 0, 0, 2, 1.0, 1), (3, 0, 1, 2, 1.0, 1),
]


def test_capacity_cases(spark):
    for u, i, e, mx, f, create in CASES:
        df = spark.createDataFrame([(u, i, e)], "u long, i long, e long")
        p = cp.capacity_plan(F.col("u"), F.col("i"), F.col("e"), CapacityOptions(max_workers=mx, amortization=f))
        assert df.select(p["create"]).first()[0] == create, (u, i, e, mx, f)


def _run_ticks(spark, backlog, opts, existing, errors, n_ticks=3):
    """The worker loop over ticks: (queue error, failed creations) by tick. A
    tick whose sample is missing plans nothing; jobs that were not created are
    planned again by the next one."""
    created = 0
    for k in range(n_ticks):
        sample = [] if errors.get(k) == "queue" else [(backlog, 0, existing + created)]
        df = spark.createDataFrame(sample, "u long, i long, e long")
        p = cp.capacity_plan(F.col("u"), F.col("i"), F.col("e"), opts)
        plan = [r[0] for r in df.select(p["create"]).collect()]
        created += max(0, sum(plan) - (1 if errors.get(k) == "db" and plan else 0))
    return created


def test_jobs_are_created_after_errors(spark):
    opts = CapacityOptions(max_workers=3)
    assert _run_ticks(spark, 3, opts, 0, {0: "db"}) == 3
    assert _run_ticks(spark, 3, opts, 0, {0: "queue"}) == 3
    assert _run_ticks(spark, 5, CapacityOptions(max_workers=2, amortization=0.5), 0, {}) == 2
    assert _run_ticks(spark, 5, CapacityOptions(max_workers=-1, amortization=0.5), 0, {}, 4) == 5


def test_absent_jobs_and_queue_gauges(spark):
    states = spark.createDataFrame([(1, "queued", 1, 1), (1, "completed", 2, 2)], "job long, stage string, ts long, tie long")
    latest = cp.latest_job_state(states)
    assert latest.first().stage == "completed" and cp.existing_jobs(latest).first()[0] == 0
    asked = spark.createDataFrame([(1,), (9,)], "job long")
    assert [r.job for r in cp.missing_jobs(asked, latest).collect()] == [9]
    msgs = spark.createDataFrame([(0, "ready", "queued"), (0, "ready", "inflight"), (0, "dlq", "queued"), (1, "ready", "queued")], "tick long, queue string, state string")
    got = {(r.tick, r.queue): (r.unprocessed, r.inflight) for r in cp.queue_utilisation(msgs, "tick").collect()}
    assert got == {(0, "ready"): (1, 1), (0, "dlq"): (1, 0), (1, "ready"): (1, 0)}
