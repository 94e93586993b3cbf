"""J1 dedupe_requests: latest per (stream, origin) + first per (stream, cid).

Input ``deliveries``: ``rid, stream_id, origin, cid, ts, crt, arrival_seq``;
``arrival_seq`` is a unique total order of deliveries (redeliveries included).

Sequential meaning, per delivery in ``arrival_seq`` order:
  * the tip of (stream, origin) is replaced iff none is stored or its ts <= ts
    (else the delivery is REPLACED: stale);
  * an accepted delivery whose old tip has another id marks that id REPLACED;
  * the (stream, cid) pair is stored if absent; if it was present and the
    delivery is not a redelivery of the tip, the delivery is REPLACED;
  * otherwise it is READY (``reprocessed`` when the old tip had the same id).

Closed form used here (no per-row loop):
  * The tip seen by a delivery is the max of ``(ts, arrival_seq, rid)`` over
    earlier rows of its (stream, origin): accepted rows never decrease ts and
    rejected rows lie below the tip, so the last accepted row is that max.
    A max is associative, so the scan is chunked (operators/scan.py) and a
    hot key is spread over many tasks.
  * A delivery stores a new cid iff it is the first accepted row of its
    (stream, cid): a partial/final hash aggregate (min arrival_seq), joined
    back on the unique ``arrival_seq`` so the join is never skewed.
Existing state takes part as seed rows with ``arrival_seq = -1``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timecols import micros_of
from ..session import materialise
from .scan import prefix_max_before

DELIVERY_COLS = ["rid", "stream_id", "origin", "cid", "ts", "crt", "arrival_seq"]
TIP_COLS = ["stream_id", "origin", "rid", "cid", "ts", "crt"]
CID_COLS = ["stream_id", "cid", "crt"]

READY, REPLACED = "READY", "REPLACED"


@dataclass
class DedupeResult:
    flags: DataFrame      # one row per delivery: E1-E4 flags
    outcomes: DataFrame   # G1: READY / REPLACED events
    tips: DataFrame       # D5: tip state after the run
    cids: DataFrame       # D6: cid state after the run


def expired(crt: Column, ttl: timedelta, now: Column) -> Column:
    """Whether a stored row's time to live is over at ``now``."""
    return F.timestamp_add("MICROSECOND", F.lit(micros_of(ttl)), crt) < now


def expire(state: DataFrame, ttl: timedelta, now: Column) -> DataFrame:
    """The state without the rows whose time to live is over."""
    return state.filter(~expired(F.col("crt"), ttl, now))


def seed_rows(deliveries: DataFrame, tip_state: DataFrame | None) -> DataFrame:
    """Stored tips as pseudo-deliveries with ``arrival_seq = -1``.

    Only tips of (stream, origin) pairs present in the input are seeded
    (left-semi), so the scan does not grow with untouched state."""
    rows = deliveries.select(*DELIVERY_COLS, F.lit(False).alias("_seed"))
    if tip_state is None:
        return rows
    touched = deliveries.select("stream_id", "origin").distinct()
    seeds = (tip_state.join(touched, ["stream_id", "origin"], "left_semi")
             .select(*TIP_COLS).withColumn("arrival_seq", F.lit(-1).cast("long"))
             .select(*DELIVERY_COLS, F.lit(True).alias("_seed")))
    return rows.unionByName(seeds)


def tip_flags(deliveries: DataFrame, tip_state: DataFrame | None = None) -> DataFrame:
    """E1 tip_accept, E2 previous_tip, E4 reprocessed_flag per delivery."""
    rows = seed_rows(deliveries, tip_state)
    tip = F.struct(F.col("ts").alias("ts"), F.col("arrival_seq").alias("seq"), F.col("rid").alias("rid"))
    rows = prefix_max_before(rows, ["stream_id", "origin"], "arrival_seq", tip, "_prev", total_out="_final")
    rows = rows.filter(~F.col("_seed"))
    accepted = F.col("_prev").isNull() | (F.col("ts") >= F.col("_prev.ts"))
    return (rows
            .withColumn("accepted", accepted)
            .withColumn("prev_tip_rid", F.when(F.col("accepted"), F.col("_prev.rid")))
            .withColumn("reprocessed", F.coalesce(F.col("accepted") & (F.col("prev_tip_rid") == F.col("rid")),
                                                  F.lit(False)))
            # The delivery that is the tip after the run (the key's greatest (ts, seq))
            .withColumn("final_tip", F.coalesce(tip == F.col("_final"), F.lit(False)))
            .drop("_prev", "_seed", "_final"))


def first_cid_flags(flags: DataFrame, cid_state: DataFrame | None = None) -> DataFrame:
    """E3 first_cid / C3: ``new_cid`` is true for the accepted delivery that
    stores its (stream, cid); every other accepted one finds it stored."""
    acc = flags.filter("accepted").select("stream_id", "cid", "arrival_seq")
    if cid_state is not None:
        # stored pairs win with seq -1; only pairs present in the input matter
        seeds = (cid_state.select("stream_id", "cid")
                 .join(acc.select("stream_id", "cid").distinct(), ["stream_id", "cid"], "left_semi")
                 .withColumn("arrival_seq", F.lit(-1).cast("long")))
        acc = acc.unionByName(seeds)
    # only accepted rows can be winners, so only they take part in the join back
    winners = (acc.groupBy("stream_id", "cid").agg(F.min("arrival_seq").alias("arrival_seq"))
               .filter(F.col("arrival_seq") >= 0)
               .select("arrival_seq", F.lit(True).alias("_new")))
    accepted = (flags.filter("accepted").join(winners, "arrival_seq", "left")
                .withColumn("new_cid", F.coalesce(F.col("_new"), F.lit(False))).drop("_new"))
    stale = flags.filter(~F.col("accepted")).withColumn("new_cid", F.lit(False))
    return stale.select(*accepted.columns).unionByName(accepted)


def mark_stored_cids(rows: DataFrame, cid_state: DataFrame) -> DataFrame:
    """C3 batch-vs-state form in one pass: ``cid_stored`` is true where the
    (stream, cid) pair is already in ``cid_state`` (the left-semi side) and
    false otherwise (the left-anti side). State pairs are distinct, so the
    left join keeps the row count."""
    known = cid_state.select("stream_id", "cid").withColumn("_known", F.lit(True))
    return (rows.join(known, ["stream_id", "cid"], "left")
            .withColumn("cid_stored", F.coalesce(F.col("_known"), F.lit(False))).drop("_known"))


def ready_rows(flags: DataFrame) -> DataFrame:
    """The deliveries that went READY (redelivered tips and new cids)."""
    return flags.filter(F.col("accepted") & (F.col("reprocessed") | F.col("new_cid"))).select(*DELIVERY_COLS)


def outcomes_of(flags: DataFrame) -> DataFrame:
    """G1 dedupe_outcomes: each delivery yields 1-2 status events, in one pass."""
    acc, reproc, new_cid = F.col("accepted"), F.col("reprocessed"), F.col("new_cid")
    ev = lambda order, event, target, reason: F.struct(
        F.lit(order).alias("ord"), F.lit(event).alias("event"),
        target.alias("target_rid"), F.lit(reason).alias("reason"))
    rid, prev = F.col("rid"), F.col("prev_tip_rid")
    candidates = F.array(
        F.when(~acc, ev(0, REPLACED, rid, "stale")),
        F.when(acc & prev.isNotNull() & ~reproc, ev(0, REPLACED, prev, "replaced_tip")),
        F.when(acc & ~new_cid & ~reproc, ev(1, REPLACED, rid, "duplicate_cid")),
        F.when(acc & reproc, ev(1, READY, rid, "reprocessed")),
        F.when(acc & new_cid & ~reproc, ev(1, READY, rid, "new")),
    )
    return (flags.select("arrival_seq", "rid",
                         F.explode(F.filter(candidates, lambda x: x.isNotNull())).alias("o"))
            .select("arrival_seq", "rid", F.col("o.ord").alias("event_ord"),
                    F.col("o.event").alias("event"), F.col("o.target_rid").alias("target_rid"),
                    F.col("o.reason").alias("reason")))


def tip_state_after(flags: DataFrame, tip_state: DataFrame | None = None) -> DataFrame:
    """D5 tip_state: final tip per (stream, origin).

    ``flags`` carry ``final_tip`` from the tip scan (the row equal to the
    key's greatest ``(ts, arrival_seq, rid)``, stored tip included), so the
    new tips are a filter: no aggregate, no shuffle. Stored tips of keys
    whose tip did not change are kept (left-anti on the changed keys)."""
    changed = flags.filter("final_tip").select(*TIP_COLS)
    if tip_state is None:
        return changed
    kept = tip_state.select(*TIP_COLS).join(changed.select("stream_id", "origin"), ["stream_id", "origin"],
                                            "left_anti")
    return kept.unionByName(changed)


def final_tips(deliveries: DataFrame, tip_state: DataFrame | None = None) -> DataFrame:
    """D5 standalone (no flags at hand): greatest ``(ts, arrival_seq)`` per
    (stream, origin) over stored tips and deliveries as a partial + final
    aggregate, so only about one row per key and map task is shuffled (less
    than the scan's full-row exchange when the flags are not needed)."""
    rows = deliveries.select(*DELIVERY_COLS)
    if tip_state is not None:
        rows = rows.unionByName(tip_state.select(*TIP_COLS).withColumn("arrival_seq", F.lit(-1).cast("long")))
    best = F.max(F.struct("ts", "arrival_seq", "rid", "cid", "crt")).alias("t")
    return (rows.groupBy("stream_id", "origin").agg(best)
            .select("stream_id", "origin", "t.rid", "t.cid", "t.ts", "t.crt"))


def cid_state_after(flags: DataFrame, cid_state: DataFrame | None = None) -> DataFrame:
    """D6 cid_state: distinct (stream, cid) of accepted deliveries with the crt
    of the first one; stored pairs keep their crt."""
    rows = flags.filter("accepted").select("stream_id", "cid", "crt", "arrival_seq")
    if cid_state is not None:
        rows = rows.unionByName(cid_state.select(*CID_COLS).withColumn("arrival_seq", F.lit(-1).cast("long")))
    return (rows.groupBy("stream_id", "cid")
            .agg(F.min_by("crt", "arrival_seq").alias("crt")))


def dedupe_requests(deliveries: DataFrame, tip_state: DataFrame | None = None,
                    cid_state: DataFrame | None = None) -> DedupeResult:
    """J1 on a bounded set of deliveries, optionally continuing from stored state.

    The tip flags feed the first-cid aggregate, the join back and the state,
    so they are written once, as columns, to the shared folder; each reader
    then scans only the columns it needs."""
    tf = materialise(tip_flags(deliveries, tip_state), "tip-flags")
    flags = first_cid_flags(tf, cid_state)
    return DedupeResult(flags=flags, outcomes=outcomes_of(flags),
                        tips=tip_state_after(tf, tip_state),
                        cids=cid_state_after(flags, cid_state))
