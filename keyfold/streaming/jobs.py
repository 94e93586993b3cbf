"""Streaming jobs on tables of their epochs (B9, I2, I4, I9, I10); keyed.py has those on
keyed state.

They run through ``foreachBatch``, so a micro-batch uses exactly the batch code
path (closed forms over windows and aggregates).

Input order: micro-batches must arrive in arrival order (Kafka offsets, or a
file source to which files are added in order); within one, rows are ordered
by their columns.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import batching as bt
from ..operators.deadletter import classify_dead_letters, dead_letter_alerts
from ..functions.timecols import epoch_micros, flush_boundary_micros, micros_of, ntz_from_micros
from ..options import MAX_RECEIVE_COUNT, MONITOR_TICK, BatchOptions
from ..session import SAFE_UNION, conf_override, materialise
from .epochs import EpochStore

BatchFn = Callable[[DataFrame, int], None]


def run_file_stream(spark: SparkSession, source: str, schema: str, fn: BatchFn, checkpoint: str,
                    fmt: str = "parquet") -> None:
    """Drain what is new in a file source with ``availableNow`` through ``fn``,
    as one micro-batch; the checkpoint makes a restarted query resume at the
    first uncommitted one."""
    src = spark.readStream.schema(schema).format(fmt).load(source)
    q = (src.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


# ------------------------------------------------------------------ I2 / I4
#: Versions of the batching state: micro-batch ``e`` writes version ``e * STEPS``,
#: closings between it and the next write the versions after that.
STEPS = 1 << 10


def _batching_step(store: EpochStore, opts: BatchOptions, rows: DataFrame | None, version: int,
                   now_us: int | None, flush_all: bool) -> None:
    """One step of the batcher: open tail plus ``rows``, closed batches out,
    new tail and counts as ``version``. The step reads the newest version
    before its own, so a retried step writes the same files again."""
    last = store.newest("tail", version - 1)
    tail, counts = (store.read(n, last) for n in ("tail", "counts"))
    parts = [d.select("rid", "ts", "arrival_seq") for d in (tail, rows) if d is not None]
    if not parts:
        return
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    assigned = bt.assign_batches(both, opts)
    us = epoch_micros("ts", assigned.schema["ts"].dataType)
    assigned = materialise(assigned.withColumn("_us", us), "assigned")
    # the stream's clock: the newest arrival seen, or a later time that the caller knows
    seen = assigned.agg(F.max("_us")).first()[0]
    clock = max([t for t in (seen, now_us) if t is not None], default=None)
    boundary = flush_boundary_micros(F.col("flush_window"), opts.flush)
    due = (F.col("_n") >= opts.size) | F.lit(flush_all)
    if clock is not None:
        due = due | (boundary <= F.lit(clock)) | (F.col("_first_us") + F.lit(micros_of(opts.linger)) <= F.lit(clock))
    closing = (assigned.groupBy("flush_window", "batch_no").agg(F.count(F.lit(1)).alias("_n"), F.min("_us").alias("_first_us"))
               .withColumn("_closed", due).select("flush_window", "batch_no", "_closed"))
    tagged = materialise(assigned.join(closing, ["flush_window", "batch_no"]).drop("_us"), "tagged")
    closed = tagged.filter("_closed").drop("_closed")
    if counts is not None:
        closed = (closed.join(counts, "flush_window", "left")
                  .withColumn("batch_no", F.col("batch_no") + F.coalesce(F.col("n_emitted"), F.lit(0))).drop("n_emitted"))
    store.write("batches", version, bt.collect_batches(closed, opts))
    emitted = closed.groupBy("flush_window").agg(F.countDistinct("batch_no").alias("n_emitted"))
    if counts is not None:
        emitted = counts.unionByName(emitted).groupBy("flush_window").agg(F.sum("n_emitted").alias("n_emitted"))
    if clock is not None:  # windows that ended get no more rows
        emitted = emitted.filter(boundary > F.lit(clock))
    store.write("counts", version, emitted)
    store.write("tail", version, tagged.filter(~F.col("_closed")).select("rid", "ts", "arrival_seq"))


def batching_batch_fn(store: EpochStore, opts: BatchOptions, now: Callable[[], datetime] | None = None) -> BatchFn:
    """Size / linger / flush batching across micro-batches of ``(rid, ts,
    arrival_seq)``.

    State: the open tail (members of batches that may still grow) and, per
    open flush window, the number of batches already emitted. Each epoch
    batches ``tail + new rows`` with the bounded-table operator (the chain
    restarts at the tail's first member, which is a batch start, so boundaries
    are unchanged) and emits every batch that can no longer grow: its window
    has ended, it is full, or its linger is over, by the newest arrival or, if
    given, by ``now()``. Arrivals must come in (ts, arrival_seq) order across
    micro-batches. ``close_due`` closes batches of an idle stream by time and
    ``drain`` (I4) all of them."""
    def fn(batch: DataFrame, epoch: int) -> None:
        with conf_override(store.spark, SAFE_UNION):
            at = None if now is None else _micros(now())
            _batching_step(store, opts, batch, epoch * STEPS, at, False)
    return fn


def _micros(t: datetime) -> int:
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def close_due(store: EpochStore, last_epoch: int, opts: BatchOptions, now: datetime) -> DataFrame:
    """Close the batches that are due at ``now`` without new arrivals; their
    rows (none when nothing was due). Committed as a step after ``last_epoch``."""
    return _closing(store, last_epoch, opts, _micros(now), False)


def drain(store: EpochStore, last_epoch: int, opts: BatchOptions) -> DataFrame:
    """I4: flush every open batch at shutdown. The empty tail and the new counts
    are committed like any step, so a restart does not see the rows again."""
    return _closing(store, last_epoch, opts, None, True)


def _closing(store: EpochStore, last_epoch: int, opts: BatchOptions, now_us: int | None, flush_all: bool) -> DataFrame:
    version = store.newest("tail", (last_epoch + 1) * STEPS - 1) + 1
    with conf_override(store.spark, SAFE_UNION):
        _batching_step(store, opts, None, version, now_us, flush_all)
    return store.read("batches", version)


# ------------------------------------------------------------------ I9
def dlq_batch_fn(store: EpochStore) -> BatchFn:
    """Classify dead letters, append alerts and the DLQ counter."""
    def fn(batch: DataFrame, epoch: int) -> None:
        a = dead_letter_alerts(classify_dead_letters(batch))
        store.write("alerts", epoch, a.select("seq", "msg_type", "msg_id", "title", "desc", "content"))
        store.write("dlq_count", epoch, batch.agg(F.count(F.lit(1)).alias("failure_dlq_message")))
    return fn


# ------------------------------------------------------------------ B9
def receive_counts(deliveries: DataFrame, message_id: str = "rid") -> DataFrame:
    """B9 on a stream: how often each message has been received so far, by
    Spark's streaming aggregate; run it in output mode update. Map-side partial
    counts keep a hot message id cheap. The state is one count a message id."""
    return deliveries.groupBy(message_id).agg(F.count(F.lit(1)).alias("receive_count"))


def redrive_batch_fn(store: EpochStore, max_receive: int = MAX_RECEIVE_COUNT) -> BatchFn:
    """The counts that a micro-batch changed, and whether the message is dead
    (received more than ``max_receive`` times, over all micro-batches)."""
    def fn(batch: DataFrame, epoch: int) -> None:
        store.write("receives", epoch, batch.withColumn("dead", F.col("receive_count") > F.lit(max_receive)))
    return fn


def redriven(store: EpochStore, message_id: str = "rid") -> DataFrame:
    """Every message with its receives, whether it is dead, and the micro-batch
    in which it went dead (null: alive). Later receives do not move that."""
    return store.read_all("receives").groupBy(message_id).agg(
        F.max("receive_count").alias("receive_count"), F.bool_or("dead").alias("dead"),
        F.min(F.when(F.col("dead"), F.col("epoch"))).alias("dead_epoch"))


# ------------------------------------------------------------------ I10
SAMPLE_COLS = ["unprocessed", "inflight", "existing"]


def capacity_sample_fn(store: EpochStore, tick: timedelta = MONITOR_TICK) -> BatchFn:
    """The last utilisation sample of every tick, from a stream of samples
    ``(ts, seq, unprocessed, inflight, existing)``.

    A micro-batch keeps its last sample per tick (a partial + final max) and
    writes it as the epoch's output; ``last_samples`` takes the last over all
    epochs. Nothing is held between micro-batches, so a sample may come late by
    any time and still counts; no watermark drops it."""
    def fn(batch: DataFrame, epoch: int) -> None:
        us = epoch_micros("ts", batch.schema["ts"].dataType)
        rows = batch.withColumn("_us", us).withColumn("tick", F.floor(F.col("_us") / F.lit(micros_of(tick))))
        store.write("samples", epoch, _last(rows.select("tick", F.struct("_us", "seq", *SAMPLE_COLS).alias("sample"))))
    return fn


def _last(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tick").agg(F.max("sample").alias("sample"))


def last_samples(store: EpochStore, tick: timedelta = MONITOR_TICK) -> DataFrame:
    """(tick_start, unprocessed, inflight, existing): the last sample per tick."""
    last = _last(store.read_all("samples").select("tick", "sample"))
    return last.select(ntz_from_micros(F.col("tick") * F.lit(micros_of(tick))).alias("tick_start"),
                       *[F.col(f"sample.{c}").alias(c) for c in SAMPLE_COLS])
