"""Streaming jobs on Spark's own keyed state.

``transformWithStateInPandas`` keeps tips, content ids, statuses and open batches
in the state store (RocksDB), with its checkpoints, its recovery and, where asked
for, its time to live. A state key is looked up once a micro-batch; the rows of a
micro-batch are folded by vectorised columns, in the same closed forms as the
batch jobs.

Groups are hash buckets of the keys, so that a group's fixed cost is paid per
bucket, and each bucket holds a map from key to value. Tips are dealt by (stream,
origin) and content ids by (stream, cid), in two chained operators: no bucket holds
a whole hot stream. The number of buckets is part of a checkpoint; choose some
multiple of the shuffle partitions of the largest cluster.

What a task holds at once is its bucket's share of one micro-batch, which the
source bounds (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``). Input order:
micro-batches come in arrival order; within one, rows are ordered by
``arrival_seq``, which is unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.ids import batch_key, deterministic_batch_id
from ..functions.timecols import US_PER_DAY, YEAR1_DAYS, epoch_micros, flush_boundary_micros, micros_of, ntz_from_micros
from ..operators.dedupe import DELIVERY_COLS
from ..operators.status import REPLACED
from ..options import BatchOptions
from ..session import conf_override
from .pages import HASH, Pages, hash_of, key_codes

#: Buckets that keys are dealt to.
BUCKETS = 64
#: State in RocksDB; a micro-batch writes its changes, not whole files.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_BUCKET = "_kf_bucket"
_MICROS = {"ts": "ts_us", "crt": "crt_us"}


def bucket_of(buckets: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _time_mode(ttl: timedelta | None) -> str:
    return "None" if ttl is None else "ProcessingTime"


def _rows(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).drop(columns=_BUCKET, errors="ignore").sort_values(order, kind="stable", ignore_index=True)


def _plain(v):
    """A value for the state store: numpy scalars as Python's."""
    return v.item() if isinstance(v, np.generic) else v


class TipProcessor(StatefulProcessor):
    """The tip of each (stream, origin), and what each delivery met."""

    def __init__(self, types: dict[str, T.DataType], ttl: timedelta | None) -> None:
        self.types, self.ttl = types, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        us = {"ts_us": T.LongType(), "crt_us": T.LongType()}
        self.tips = Pages(handle, "tips", {n: (self.types | us)[n] for n in ("stream_id", "origin", "ts_us", "rid", "cid", "crt_us")}, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = _rows(rows, ["arrival_seq"])
        now = timerValues.getCurrentProcessingTimeInMs()
        accepted, reprocessed, final = (np.zeros(len(d), bool) for _ in range(3))
        met = np.full(len(d), None, object)
        for part in self.tips.parts(d[HASH].to_numpy(np.int64), now):
            some = d.iloc[part.rows]
            own = self.tips.table(some, now)
            # stored tips come first, at most one row a key
            n = len(part.held)
            both = pa.concat_tables([part.held, own]).combine_chunks()
            group = key_codes(*(both[c].combine_chunks() for c in ("stream_id", "origin")))
            at = np.arange(len(both))
            before = _before(group)
            ts = np.concatenate([part.held["ts_us"].to_numpy(), some["ts_us"].to_numpy(np.int64)])
            highest = pd.Series(ts).groupby(group).cummax().to_numpy()
            ok = (before < 0) | (ts >= highest[before])
            # the last accepted row up to each: accepted rows never lower the time
            last = pd.Series(np.where(ok, at, -1)).groupby(group).cummax()
            previous = np.where(before < 0, -1, last.to_numpy()[before])[n:]
            rid = both["rid"].combine_chunks()
            tip = rid.take(pa.array(previous, mask=~ok[n:] | (previous < 0)))
            accepted[part.rows] = ok[n:]
            met[part.rows] = tip.to_pylist()
            reprocessed[part.rows] = pc.fill_null(pc.equal(tip, rid.slice(n)), False).to_numpy(zero_copy_only=False)
            stays = last.groupby(group).transform("max").to_numpy() == at
            final[part.rows] = stays[n:]
            part.put(stays[:n], own.filter(pa.array(stays[n:])))
        yield d.drop(columns=HASH).assign(accepted=accepted, prev_tip_rid=pd.Series(met, dtype=object), reprocessed=reprocessed, final_tip=final)

    def close(self) -> None:
        pass


class CidProcessor(StatefulProcessor):
    """Which accepted delivery is the first of its (stream, cid)."""

    def __init__(self, types: dict[str, T.DataType], ttl: timedelta | None) -> None:
        self.types, self.ttl = types, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cids = Pages(handle, "cids", {"stream_id": self.types["stream_id"], "cid": self.types["cid"], "crt_us": T.LongType()}, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = _rows(rows, ["arrival_seq"])
        now = timerValues.getCurrentProcessingTimeInMs()
        new = np.zeros(len(d), bool)
        accepted = np.flatnonzero(d["accepted"].to_numpy(bool))
        for part in self.cids.parts(d[HASH].to_numpy(np.int64)[accepted], now):
            at = accepted[part.rows]
            own = self.cids.table(d.iloc[at], now)
            n = len(part.held)
            both = pa.concat_tables([part.held, own]).combine_chunks()
            first = _before(key_codes(*(both[c].combine_chunks() for c in ("stream_id", "cid")))) < 0
            new[at] = first[n:]
            part.put(first[:n], own.filter(pa.array(first[n:])))
        yield d.drop(columns=HASH).assign(new_cid=new)

    def close(self) -> None:
        pass


def _before(group: np.ndarray) -> np.ndarray:
    """Number of the row before each in its group; -1 where it is the first."""
    order = np.argsort(group, kind="stable")
    same = np.flatnonzero(group[order][1:] == group[order][:-1])
    before = np.full(len(group), -1)
    before[order[same + 1]] = order[same]
    return before


def dedupe_stream(deliveries: DataFrame, ttl: timedelta | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A stream of deliveries to a stream of their flags (those of
    ``dedupe_requests``). Late tips (I5) are flagged, never dropped: there is no
    watermark. ``ttl`` (B10, off by default): a tip or content id that was last
    stored longer ago counts as absent and leaves the state."""
    schema = deliveries.schema
    types = {n: schema[n].dataType for n in ("rid", "stream_id", "origin", "cid")}
    micros = {us: epoch_micros(c, schema[c].dataType) for c, us in _MICROS.items()}
    d = deliveries.withColumns(micros).select("rid", "stream_id", "origin", "cid", *_MICROS.values(), "arrival_seq")
    flagged = T.StructType([*d.schema.fields, T.StructField("accepted", T.BooleanType()), T.StructField("prev_tip_rid", types["rid"]),
                            T.StructField("reprocessed", T.BooleanType()), T.StructField("final_tip", T.BooleanType())])
    with_tips = d.withColumns({_BUCKET: bucket_of(buckets, "stream_id", "origin"), HASH: hash_of("stream_id", "origin")}).groupBy(_BUCKET).transformWithStateInPandas(
        TipProcessor(types, ttl), flagged, "Append", _time_mode(ttl))
    out = T.StructType([*flagged.fields, T.StructField("new_cid", T.BooleanType())])
    with_cids = with_tips.withColumns({_BUCKET: bucket_of(buckets, "stream_id", "cid"), HASH: hash_of("stream_id", "cid")}).groupBy(_BUCKET).transformWithStateInPandas(
        CidProcessor(types, ttl), out, "Append", _time_mode(ttl))
    back = {c: (ntz_from_micros(F.col(us)) if isinstance(schema[c].dataType, T.TimestampNTZType) else F.timestamp_micros(F.col(us))) for c, us in _MICROS.items()}
    flags = ["accepted", "prev_tip_rid", "reprocessed", "final_tip", "new_cid"]
    return with_cids.withColumns(back).select(*DELIVERY_COLS, *flags)


# ------------------------------------------------------------------ I8
class StatusProcessor(StatefulProcessor):
    """The status of each known id."""

    def __init__(self, id_type: T.DataType) -> None:
        self.id_type = id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getMapState("status", T.StructType([T.StructField("id", self.id_type)]), "status int")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for i, s in zip(initialState["id"], initialState["status"]):
            self.status.updateValue((_plain(i),), (int(s),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = _rows(rows, ["seq"])
        by_id = d.groupby("id", sort=False)
        other = d[d["sts"] != REPLACED].groupby("id")[["seq", "sts"]].last()
        replaced = d[d["sts"] == REPLACED].groupby("id")["seq"].max()
        out = []
        for i, seq in by_id["seq"].max().items():
            stored = self.status.getValue((_plain(i),))
            if stored is None:
                continue  # an id that the table does not hold: nothing happens
            status, since = (int(other.at[i, "sts"]), other.at[i, "seq"]) if i in other.index else (stored[0], -1)
            if status == 0 and i in replaced.index and replaced[i] > since:
                status = REPLACED
            if status != stored[0]:
                self.status.updateValue((_plain(i),), (status,))
            out.append((i, status, seq))
        yield pd.DataFrame(out, columns=["id", "status", "seq"])

    def close(self) -> None:
        pass


def status_stream(events: DataFrame, initial: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """I8: a stream of status events ``(id, sts, seq)`` to a stream of the
    statuses of the ids that each micro-batch touched, ``(id, status, seq)``.
    ``initial`` is the request table's ``(id, status)`` when the stream first
    starts; a restart goes on from the state."""
    id_type = events.schema["id"].dataType
    known = initial.select("id", F.col("status").cast("int").alias("status")).withColumn(_BUCKET, bucket_of(buckets, "id")).groupBy(_BUCKET)
    out = T.StructType([T.StructField("id", id_type), T.StructField("status", T.ShortType()), T.StructField("seq", events.schema["seq"].dataType)])
    return (events.select("id", F.col("sts").cast("int").alias("sts"), "seq").withColumn(_BUCKET, bucket_of(buckets, "id")).groupBy(_BUCKET)
            .transformWithStateInPandas(StatusProcessor(id_type), out, "Append", "None", known))


def statuses(initial: DataFrame, changes: DataFrame) -> DataFrame:
    """The request table's ``(id, status)`` after a stream's changes."""
    before = initial.select("id", F.col("status").cast("smallint").alias("status"), F.lit(None).cast("long").alias("seq"))
    newest = F.max_by("status", F.coalesce("seq", F.lit(-(1 << 62)))).alias("status")
    return before.unionByName(changes.select("id", "status", F.col("seq").cast("long").alias("seq"))).groupBy("id").agg(newest)


# ------------------------------------------------------------------ I2 / I4
class Batcher(StatefulProcessor):
    """The open batch of a shard. A batch ends when it is full, when its linger
    is over or its window ends: seen by the next arrival, by a drain mark or,
    on a live clock, by a timer without either."""

    def __init__(self, rid: T.DataType, opts: BatchOptions, live: bool) -> None:
        self.rid, self.size, self.live = rid, opts.size, live
        self.linger, self.flush = micros_of(opts.linger), micros_of(opts.flush)
        self.shift = YEAR1_DAYS * US_PER_DAY % self.flush

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", T.StructType([T.StructField("rid", self.rid), T.StructField("ts_us", T.LongType())]))
        # the window that batches were last counted in, and how many it has; when the open batch is due
        self.count = handle.getValueState("count", "flush_window long, n_batches int, due_ms long")

    def _closed(self, key, rows: list[tuple[int, int, list, int]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], w, no, rids, first) for w, no, rids, first in rows], columns=["shard", "flush_window", "batch_no", "rids", "first_us"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = _rows(rows, ["ts_us", "arrival_seq"])
        drain, d = bool(d["drain"].any()), d[~d["drain"].astype(bool)]
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        rids = [r for r, _ in held] + d["rid"].tolist()
        ts = np.concatenate([np.array([t for _, t in held], np.int64), d["ts_us"].to_numpy(np.int64)])
        window = (ts + self.shift) // self.flush
        counted, number, due = self.count.get() if self.count.exists() else (None, 0, None)
        out, i, n = [], 0, len(ts)
        while i < n:
            end = min(i + self.size, int(np.searchsorted(window, window[i], "right")), int(np.searchsorted(ts, ts[i] + self.linger, "left")))
            if end == n and n - i < self.size and not drain:
                break
            number = number if counted == int(window[i]) else 0
            counted = int(window[i])
            out.append((counted, number, [_plain(r) for r in rids[i:end]], int(ts[i])))
            number += 1
            i = end
        if due is not None:
            self.handle.deleteTimer(due)
        due = None
        if i < n:
            self.open.put([(_plain(r), int(t)) for r, t in zip(rids[i:], ts[i:])])
            ends = min(int(ts[i]) + self.linger, (int(window[i]) + 1) * self.flush - self.shift)
            due = -(-ends // 1000) if self.live else None
            if due is not None:
                self.handle.registerTimer(due)
        elif self.open.exists():
            self.open.clear()
        self.count.update((counted, number, due))
        yield self._closed(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        out = []
        if held:
            counted, number, _ = self.count.get()
            window = (held[0][1] + self.shift) // self.flush
            number = number if counted == window else 0
            out.append((window, number, [r for r, _ in held], held[0][1]))
            self.open.clear()
            self.count.update((window, number + 1, None))
        yield self._closed(key, out)

    def close(self) -> None:
        pass


def batch_stream(rows: DataFrame, opts: BatchOptions, live: bool = False) -> DataFrame:
    """A stream of arrivals ``(rid, ts, arrival_seq)`` to a stream of closed
    batches, one row each, with the columns of ``collect_batches`` and ``shard``.
    A ``shard`` column (optional) names independent batchers; a row whose
    ``drain`` column (optional) is true closes its shard's open batch (I4). With
    ``live`` the arrivals' times are those of the cluster's clock, and a batch
    that is due closes by a timer, without a next arrival; without, a replay
    closes batches by arrivals and drain marks alone and equals
    ``batch_requests``. Rows come in order of (ts, arrival_seq)."""
    rid = rows.schema["rid"].dataType
    d = rows.select(F.col("shard").cast("string").alias("shard") if "shard" in rows.columns else F.lit("0").alias("shard"), "rid",
                    epoch_micros("ts", rows.schema["ts"].dataType).alias("ts_us"), "arrival_seq",
                    (F.coalesce("drain", F.lit(False)) if "drain" in rows.columns else F.lit(False)).alias("drain"))
    out = T.StructType([T.StructField("shard", T.StringType()), T.StructField("flush_window", T.LongType()), T.StructField("batch_no", T.LongType()),
                        T.StructField("rids", T.ArrayType(rid)), T.StructField("first_us", T.LongType())])
    closed = d.groupBy("shard").transformWithStateInPandas(Batcher(rid, opts, live), out, "Append", "ProcessingTime" if live else "None")
    boundary = flush_boundary_micros(F.col("flush_window"), opts.flush)
    n = F.size("rids").cast("long")
    reason = (F.when(n >= opts.size, "full").when(F.col("first_us") + F.lit(micros_of(opts.linger)) < boundary, "linger").otherwise("flush"))
    named = closed.withColumn("bid", deterministic_batch_id(*([F.col("shard")] if "shard" in rows.columns else []), F.col("flush_window"), F.col("batch_no"),
                                                            F.col("rids")[0]))
    return named.select("shard", "bid", batch_key(F.col("bid")).alias("batch_key"), "flush_window", "batch_no", n.alias("n"), "rids", reason.alias("reason"),
                        ntz_from_micros(F.col("first_us")).alias("first_ts"), ntz_from_micros(boundary).alias("boundary"))


# ------------------------------------------------------------------ running
def start(stream: DataFrame, sink: str | Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None,
          mode: str = "append") -> StreamingQuery:
    """Start a stream into a folder of Parquet files, whose log makes a retried
    micro-batch count once, or into a function of (micro-batch, epoch): with
    ``every`` by that clock (so that timers fire on an idle stream), else for
    what is available now, as one micro-batch. Streaming aggregates go into a
    function, in ``mode`` update."""
    spark: SparkSession = stream.sparkSession
    with conf_override(spark, STATE_CONF):
        w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        w = w.foreachBatch(sink) if callable(sink) else w.format("parquet").option("path", sink)
        return w.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def drain(stream: DataFrame, sink: str | Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run what is available now to its end; the checkpoint's state is where
    the next run goes on. Not for streams with a time to live or timers: those
    run by the clock and have no end."""
    start(stream, sink, checkpoint).awaitTermination()
