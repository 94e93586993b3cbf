"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory. Each reads the generated tables through the
adapters of ``keyfold/sources/testdata.py`` and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime as _dt
from datetime import timedelta as _td

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import metric_name
from ..functions.timecols import US_PER_DAY, epoch_micros, micros_of, ntz_from_micros
from ..operators import allowlist as al
from ..operators import backfill as bf
from ..operators import batching as bt
from ..operators import capacity as cp
from ..operators import dedupe as dd
from ..operators import deadletter as dl
from ..operators import metrics as mt
from ..operators import status as st
from ..options import DEFAULT_BATCH_SIZE, BatchOptions, CapacityOptions, PollOptions
from ..session import materialise, scratch_path
from ..sources import messages as msg
from ..sources import sinks
from ..sources import testdata as td
from ..sources.keyfiles import read_keyed, write_keyed
from ..sources.tables import table
from ..streaming import jobs as sj
from ..streaming import keyed as ks
from ..streaming.epochs import EpochStore, rename

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- J1 dedupe
def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E4 flags of the whole run (tip flags materialised once)."""
    return dd.dedupe_requests(td.deliveries(spark, sf_dir)).flags


@register("tip_accept")
def q_tip_accept(spark, sf_dir):
    f = dd.tip_flags(td.deliveries(spark, sf_dir))
    return f.select("arrival_seq", "rid", "stream_id", "origin", "accepted")


@register("previous_tip")
def q_previous_tip(spark, sf_dir):
    f = dd.tip_flags(td.deliveries(spark, sf_dir))
    return f.select("arrival_seq", "rid", "prev_tip_rid")


@register("first_cid")
def q_first_cid(spark, sf_dir):
    return _flags(spark, sf_dir).select("arrival_seq", "rid", "stream_id", "cid", "accepted", "new_cid")


@register("reprocessed_flag")
def q_reprocessed(spark, sf_dir):
    f = dd.tip_flags(td.deliveries(spark, sf_dir))
    return f.select("arrival_seq", "rid", "reprocessed")


@register("dedupe_outcomes")
def q_dedupe_outcomes(spark, sf_dir):
    return dd.dedupe_requests(td.deliveries(spark, sf_dir)).outcomes


@register("tip_state")
def q_tip_state(spark, sf_dir):
    return dd.final_tips(td.deliveries(spark, sf_dir))


@register("cid_state")
def q_cid_state(spark, sf_dir):
    return dd.cid_state_after(_flags(spark, sf_dir))


@register("project_state_keys")
def q_project_state_keys(spark, sf_dir):
    d = td.deliveries(spark, sf_dir)
    return d.select("arrival_seq", "stream_id", "origin",
                    F.col("rid").alias("tip_rid"), F.col("cid").alias("tip_cid"),
                    F.col("ts").alias("tip_ts"), F.col("crt").alias("tip_crt"),
                    F.col("stream_id").alias("cid_stream_id"), F.col("cid").alias("cid_cid"),
                    F.col("crt").alias("cid_crt"))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Deliveries cut at the middle of the event-id range: first and second run."""
    d = td.deliveries(spark, sf_dir)
    at = td.events(spark, sf_dir).agg(((F.max("event_id") + 1) * 5).alias("at")).first()["at"]
    return d.filter(F.col("arrival_seq") < F.lit(at)), d.filter(F.col("arrival_seq") >= F.lit(at))


@register("seed_state")
def q_seed_state(spark, sf_dir):
    first, second = _split(spark, sf_dir)
    r1 = dd.dedupe_requests(first)
    return dd.dedupe_requests(second, tip_state=r1.tips, cid_state=r1.cids).outcomes


@register("cid_seen_semi_anti")
def q_cid_seen(spark, sf_dir):
    first, second = _split(spark, sf_dir)
    stored = dd.dedupe_requests(first).cids
    return dd.mark_stored_cids(second, stored).select("arrival_seq", "stream_id", "cid", "cid_stored")


@register("state_point_reads")
def q_state_point_reads(spark, sf_dir):
    """Stored tips of the keys that the second run touches, read from keyed files."""
    first, second = _split(spark, sf_dir)
    tips, path, keys = dd.final_tips(first), scratch_path(spark, "keyed-tips"), ["stream_id", "origin"]
    write_keyed(tips, path, keys, slot_bits=4)
    return read_keyed(spark, path, second, keys, tips.schema, slot_bits=4)


# ---------------------------------------------------------------- J2 batching


CLOSED = BatchOptions(size=16, linger=_td(hours=24), flush=_td(days=1))
LINGER = BatchOptions(size=16, linger=_td(hours=1), flush=_td(days=1))


def _batch_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("rid"), "ts", F.col("event_id").alias("arrival_seq"))


@register("flush_window")
def q_flush_window(spark, sf_dir):
    from ..functions.timecols import epoch_micros, flush_boundary_micros, flush_window, ntz_from_micros
    e = _batch_rows(spark, sf_dir)
    us = epoch_micros("ts", e.schema["ts"].dataType)
    w = flush_window(us, CLOSED.flush)
    return e.select("rid", w.alias("flush_window"),
                    ntz_from_micros(flush_boundary_micros(w, CLOSED.flush)).alias("boundary"))


@register("batch_ordinal")
def q_batch_ordinal(spark, sf_dir):
    return bt.batch_ordinal(_batch_rows(spark, sf_dir), CLOSED).select("rid", "flush_window", "rn", "batch_no")


def _batch_cols(b):
    return b.select("bid", "flush_window", "batch_no", "n", "rids", "reason", "first_ts", "boundary")


@register("collect_batch_members")
def q_collect_batch_members(spark, sf_dir):
    return _batch_cols(bt.batch_requests(_batch_rows(spark, sf_dir), CLOSED))


@register("batch_linger")
def q_batch_linger(spark, sf_dir):
    return _batch_cols(bt.batch_requests(_batch_rows(spark, sf_dir), LINGER))


@register("batch_size_distribution")
def q_batch_size_distribution(spark, sf_dir):
    return bt.size_distribution(bt.batch_requests(_batch_rows(spark, sf_dir), LINGER), LINGER.size)


@register("batch_size_quantiles")
def q_batch_size_quantiles(spark, sf_dir):
    """D3 by month, from stored sketches of the windows, and whether each quantile
    keeps its rank error against all the batches of the month."""
    batches = materialise(bt.batch_requests(_batch_rows(spark, sf_dir), LINGER).select("flush_window", "n"), "batch-sizes")
    sketches = materialise(bt.size_sketches(batches), "size-sketches")
    day = ntz_from_micros(F.col("flush_window") * F.lit(micros_of(LINGER.flush)))
    month = F.trunc(day.cast("date"), "month").alias("month")
    merged = bt.merged_sizes(sketches, month)
    ranks = batches.withColumn("month", month).join(merged.select("month", "p50", "p90", "p99"), "month").groupBy("month").agg(*[
        F.struct(F.avg((F.col("n") < F.col(q)).cast("int")).alias("below"), F.avg((F.col("n") <= F.col(q)).cast("int")).alias("upto")).alias(q)
        for q in ("p50", "p90", "p99")])
    within = [((F.col(f"{q}.below") - bt.RANK_ERROR <= p) & (F.col(f"{q}.upto") + bt.RANK_ERROR >= p)).alias(f"{q}_within")
              for q, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))]
    return merged.drop("p50", "p90", "p99").join(ranks.select("month", *within), "month")


@register("batch_key")
def q_batch_key(spark, sf_dir):
    return bt.batch_requests(_batch_rows(spark, sf_dir), CLOSED).select("bid", "batch_key")


@register("write_batches")
def q_write_batches(spark, sf_dir):
    path = scratch_path(spark, "batches")
    sinks.write_batches(bt.batch_requests(_batch_rows(spark, sf_dir), CLOSED), path)
    return sinks.read_json(spark, path, sinks.BATCH_DOC_SCHEMA).select("bid", "batch_key", "rids", "flush_window")


@register("write_batch_manifest")
def q_write_batch_manifest(spark, sf_dir):
    # computed once for the two writes
    b = materialise(bt.batch_requests(_batch_rows(spark, sf_dir), CLOSED), "batches")
    base = scratch_path(spark, "batch-out")
    sinks.write_batches(b, base + "/store")
    sinks.write_batch_manifest(b, base + "/manifest")
    m = sinks.read_json(spark, base + "/manifest", sinks.MANIFEST_SCHEMA)
    stored = sinks.read_json(spark, base + "/store", sinks.BATCH_DOC_SCHEMA).select("bid", "rids")
    # every manifest entry resolves to its stored batch
    return (m.select("bid", F.size("rids").alias("manifest_ids"), "flush_window")
            .join(stored, "bid", "left").select("bid", "flush_window", "manifest_ids",
                                                F.size("rids").alias("stored_ids")))


# ---------------------------------------------------------------- J3 status

AS_OF = "TIMESTAMP_NTZ'2024-02-01 00:00:00'"


def _replaced_events(spark, sf_dir):
    """Status events of J1: REPLACED messages in emission order."""
    o = dd.dedupe_requests(td.deliveries(spark, sf_dir)).outcomes.filter(F.col("event") == dd.REPLACED)
    return o.select(F.col("target_rid").alias("id"), F.lit(st.REPLACED).cast("smallint").alias("sts"),
                    (F.col("arrival_seq") * 2 + F.col("event_ord")).alias("seq"))


@register("status_fold")
def q_status_fold(spark, sf_dir):
    events_df, initial = td.status_events(spark, sf_dir)
    return st.status_fold(events_df, initial)


@register("update_status")
def q_update_status(spark, sf_dir):
    req = td.request_table(spark, sf_dir)
    out = st.update_status(req, _replaced_events(spark, sf_dir), F.expr(AS_OF))
    return out.select("request_id", "status", "changed", "updated_at")


@register("filter_allowed_transition")
def q_filter_allowed(spark, sf_dir):
    req = td.request_table(spark, sf_dir).select(F.col("request_id").alias("id"), "status")
    ev = _replaced_events(spark, sf_dir).join(req, "id")
    return ev.select("seq", "id", st.transition_allowed(F.col("sts"), F.col("status")).alias("allowed"))


@register("pending_count")
def q_pending_count(spark, sf_dir):
    req = td.request_table(spark, sf_dir)
    return bf.filter_status(req, st.PENDING).agg(F.count(F.lit(1)).alias("pending_requests"))


# ---------------------------------------------------------------- messages / J5


@register("parse_requests")
def q_parse_requests(spark, sf_dir):
    p = msg.parse_requests(td.request_texts(spark, sf_dir))
    return p.select("seq", "rid", "stream_id", "cid", "origin", "ts", "crt", "malformed")


@register("parse_status")
def q_parse_status(spark, sf_dir):
    return msg.parse_status(td.status_texts(spark, sf_dir)).select("seq", "rid", "sts", "malformed")


@register("quarantine_malformed")
def q_quarantine(spark, sf_dir):
    return dl.quarantine_route(msg.parse_requests(td.request_texts(spark, sf_dir))).select("seq", "route")


@register("read_dead_letters")
def q_read_dead_letters(spark, sf_dir):
    path = scratch_path(spark, "dlq-text")
    td.dead_letter_texts(spark, sf_dir).select("value").write.mode("overwrite").text(path)
    return spark.read.text(path).select("value")


@register("classify_dead_letter")
def q_classify(spark, sf_dir):
    return dl.classify_dead_letters(td.dead_letter_texts(spark, sf_dir)).select("seq", "msg_type", "msg_id")


@register("alert_text")
def q_alert_text(spark, sf_dir):
    a = dl.dead_letter_alerts(dl.classify_dead_letters(td.dead_letter_texts(spark, sf_dir)))
    return a.select("seq", "title", "desc", "content")


@register("write_alerts")
def q_write_alerts(spark, sf_dir):
    a = dl.dead_letter_alerts(dl.classify_dead_letters(td.dead_letter_texts(spark, sf_dir)))
    path = scratch_path(spark, "alerts")
    sinks.write_table(a.select("seq", "title", "desc", "content"), path)
    return spark.read.parquet(path)


@register("redrive_split")
def q_redrive(spark, sf_dir):
    return dl.redrive_split(td.redrive_deliveries(spark, sf_dir), "rid")


@register("uuid_valid")
def q_uuid_valid(spark, sf_dir):
    from ..functions.ids import NIL_UUID, uuid_valid
    e = table(spark, sf_dir, "events").select("event_id")
    c = (F.when(F.col("event_id") % 9 == 0, F.lit(NIL_UUID))
         .when(F.col("event_id") % 9 == 1, F.substring(td.uuid_of(F.col("event_id")), 1, 35))
         .when(F.col("event_id") % 9 == 2, F.upper(td.uuid_of(F.col("event_id"))))
         .otherwise(td.uuid_of(F.col("event_id"))))
    return e.select(F.col("event_id").alias("seq"), c.alias("candidate")).withColumn("valid", uuid_valid(F.col("candidate")))


@register("alert_route")
def q_alert_route(spark, sf_dir):
    from ..functions.text import alert_route
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 4
    alert = F.when(k.isin(0, 1), F.col("c_mktsegment")).otherwise(F.lit(""))
    test = F.when(k.isin(0, 2), F.col("c_name")).otherwise(F.lit(""))
    return c.select("c_custkey", alert_route(alert, test).alias("channel"))


@register("encode_messages")
def q_encode(spark, sf_dir):
    d = td.deliveries(spark, sf_dir)
    return d.select("arrival_seq", msg.encode_request(td.uuid_of(F.col("rid")), F.col("stream_id").cast("string"),
                                                      F.col("cid"), F.col("origin"), F.col("ts"),
                                                      F.col("crt")).alias("request_json"),
                    msg.encode_status(td.uuid_of(F.col("rid")), F.lit(5)).alias("status_json"))


# ---------------------------------------------------------------- J4 backfill


POLL = PollOptions(now=_dt(2024, 1, 30))
ZERO_TIME = "TIMESTAMP_NTZ'0001-01-01 00:00:00'"


def _poll(spark, sf_dir, limit=None):
    req = td.request_table(spark, sf_dir)
    meta = td.metadata_table(spark, sf_dir)
    lo, hi = bf.poll_window(bf.ntz_lit(POLL.now), F.expr(ZERO_TIME), POLL.min_age, POLL.look_back)
    return bf.scan_requests(req, meta, st.PENDING, lo, hi, limit)


def _pending(spark, sf_dir):
    """The pending requests of the poll window (messages drop the metadata,
    so it is not joined)."""
    lo, hi = bf.poll_window(bf.ntz_lit(POLL.now), F.expr(ZERO_TIME), POLL.min_age, POLL.look_back)
    return bf.filter_open_interval(bf.filter_status(td.request_table(spark, sf_dir), st.PENDING), lo, hi)


REQ_COLS = ["request_id", "cid", "stream_id", "origin", "ts", "created_at", "controllers", "family"]


def _flat(df):
    return (df.withColumn("controllers", F.col("metadata.controllers"))
            .withColumn("family", F.col("metadata.family")).drop("metadata"))


@register("scan_requests")
def q_scan_requests(spark, sf_dir):
    """A1 with the poller's load limit (F2's default)."""
    return _flat(_poll(spark, sf_dir, limit=DEFAULT_BATCH_SIZE)).select(*REQ_COLS)


@register("filter_status")
def q_filter_status(spark, sf_dir):
    return bf.filter_status(td.request_table(spark, sf_dir), st.PENDING).select("request_id")


@register("filter_open_interval")
def q_filter_open_interval(spark, sf_dir):
    lo, hi = bf.poll_window(bf.ntz_lit(POLL.now), F.expr(ZERO_TIME), POLL.min_age, POLL.look_back)
    return bf.filter_open_interval(td.request_table(spark, sf_dir), lo, hi).select("request_id")


@register("poll_window")
def q_poll_window(spark, sf_dir):
    e = td.events(spark, sf_dir)
    day = F.floor(F.col("ts_us") / F.lit(US_PER_DAY))
    days = e.select(day.alias("d")).distinct()
    now = ntz_from_micros((F.col("d") + 1) * F.lit(US_PER_DAY))
    ckpt = ntz_from_micros((F.col("d") - 1) * F.lit(US_PER_DAY)
                           + (F.col("d") % 3 - 1) * F.lit(6 * 3600 * 1000000))
    lo, hi = bf.poll_window(now, ckpt)
    return days.select(now.alias("now"), ckpt.alias("checkpoint"), lo.alias("newer_than"), hi.alias("older_than"))


@register("request_to_message")
def q_request_to_message(spark, sf_dir):
    return bf.request_to_message(_pending(spark, sf_dir))


@register("left_join_metadata")
def q_left_join_metadata(spark, sf_dir):
    req = td.request_table(spark, sf_dir).select("request_id", "stream_id")
    return bf.left_join_metadata(req, td.metadata_table(spark, sf_dir)).select(
        "request_id", "stream_id", F.col("metadata.controllers").alias("controllers"),
        F.col("metadata.family").alias("family"))


@register("oldest_pending_topk")
def q_oldest_pending_topk(spark, sf_dir):
    return _flat(_poll(spark, sf_dir, limit=5)).select(*REQ_COLS)


@register("load_limit")
def q_load_limit(spark, sf_dir):
    return _flat(_poll(spark, sf_dir, limit=CLOSED.size)).select(*REQ_COLS)


@register("sent_prefix_checkpoint")
def q_sent_prefix(spark, sf_dir):
    req = td.request_table(spark, sf_dir)
    us = epoch_micros("created_at", req.schema["created_at"].dataType)
    rows = req.withColumn("poll_day", F.floor(us / F.lit(US_PER_DAY)))
    return bf.sent_prefix_checkpoint(rows, "poll_day", F.col("request_id") % 97 == 0)


@register("unprocessed_alert")
def q_unprocessed_alert(spark, sf_dir):
    return bf.daily_tick_backlog(td.request_table(spark, sf_dir))


@register("backfill_union")
def q_backfill_union(spark, sf_dir):
    live = td.deliveries(spark, sf_dir)
    audit = bf.request_to_message(_pending(spark, sf_dir)).withColumn(
        "arrival_seq", (F.col("rid") + F.lit(1_000_000_000)) * 10 + 5)
    return dd.dedupe_requests(live.unionByName(audit)).outcomes


def _checkpoint_proposals(spark, sf_dir):
    r = td.requests_base(spark, sf_dir)
    return r.select(F.col("origin").alias("name"), F.col("ts").alias("value"), F.col("e").alias("seq"))


@register("checkpoint_accept")
def q_checkpoint_accept(spark, sf_dir):
    return bf.checkpoint_accept(_checkpoint_proposals(spark, sf_dir))


@register("checkpoint_max")
def q_checkpoint_max(spark, sf_dir):
    return bf.checkpoint_max(_checkpoint_proposals(spark, sf_dir))


@register("load_checkpoint")
def q_load_checkpoint(spark, sf_dir):
    acc = bf.checkpoint_accept(_checkpoint_proposals(spark, sf_dir)).filter("accepted")
    path = scratch_path(spark, "checkpoints")
    sinks.write_table(acc.select("name", "value"), path)
    state = spark.read.parquet(path)
    names = (td.requests_base(spark, sf_dir).select(F.col("origin").alias("name")).distinct()
             .unionByName(spark.range(1).select(F.lit("rpoll").alias("name")))
             .unionByName(spark.range(1).select(F.lit("fpoll").alias("name"))))
    return bf.load_checkpoint(state, names)


@register("time_codecs")
def q_time_codecs(spark, sf_dir):
    from ..functions import timecols as tc
    d = td.deliveries(spark, sf_dir)
    ts_us = epoch_micros("ts", d.schema["ts"].dataType)
    crt_us = epoch_micros("crt", d.schema["crt"].dataType)
    return d.select("arrival_seq", tc.ts_nanos(ts_us).alias("ts_ns"), tc.ts_seconds(crt_us).alias("crt_s"),
                    tc.checkpoint_text(F.col("crt")).alias("crt_text"))


# ---------------------------------------------------------------- J7 capacity

UNLIMITED = CapacityOptions(max_workers=-1, amortization=0.5)
MAX3 = CapacityOptions(max_workers=3, amortization=0.5)
HOUR_US = 3600 * 1000000


def _hourly_samples(spark, sf_dir):
    """§4 D9: one sample per non-empty hour of events."""
    e = td.events(spark, sf_dir)
    hour = F.floor(F.col("ts_us") / F.lit(HOUR_US))
    return (e.groupBy(hour.alias("hour"))
            .agg(F.count(F.lit(1)).alias("unprocessed"),
                 F.count_if(F.col("event_type") == "purchase").alias("inflight"),
                 F.count_if(F.col("event_type") == "signup").alias("existing")))


def _plans(spark, sf_dir):
    s = _hourly_samples(spark, sf_dir)
    u = cp.capacity_plan(F.col("unprocessed"), F.col("inflight"), F.col("existing"), UNLIMITED)
    m = cp.capacity_plan(F.col("unprocessed"), F.col("inflight"), F.col("existing"), MAX3)
    return s.select("hour", "unprocessed", "inflight", "existing", u["required"].alias("required"),
                    u["create"].alias("create"), m["create"].alias("create_max3"))


def _queue_messages(spark, sf_dir):
    """Message states: queue event_id % 6, in flight where the event is a
    purchase, sampled by hour."""
    e = td.events(spark, sf_dir)
    queue = F.element_at(F.array(*[F.lit(q) for q in cp.QUEUES]), (F.col("event_id") % len(cp.QUEUES) + 1).cast("int"))
    return e.select(F.floor(F.col("ts_us") / F.lit(HOUR_US)).alias("hour"), queue.alias("queue"),
                    F.when(F.col("event_type") == "purchase", "inflight").otherwise("queued").alias("state"))


@register("queue_utilisation")
def q_queue_utilisation(spark, sf_dir):
    return cp.queue_utilisation(_queue_messages(spark, sf_dir), "hour")


@register("capacity_plan")
def q_capacity_plan(spark, sf_dir):
    return _plans(spark, sf_dir)


@register("job_requests")
def q_job_requests(spark, sf_dir):
    now = ntz_from_micros(F.col("hour") * F.lit(HOUR_US))
    return cp.job_requests(_plans(spark, sf_dir).withColumn("_now", now), "hour", F.col("_now"))


def _job_states(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    stage = (F.when(F.col("o_orderstatus") == "O", cp.STAGE_QUEUED)
             .when(F.col("o_orderstatus") == "P", cp.STAGE_STARTED)
             .when(F.col("o_orderstatus") == "F", cp.STAGE_COMPLETED))
    return o.select(F.col("o_custkey").alias("job"), stage.alias("stage"),
                    F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("tie"))


@register("latest_job_state")
def q_latest_job_state(spark, sf_dir):
    return cp.latest_job_state(_job_states(spark, sf_dir))


@register("existing_jobs")
def q_existing_jobs(spark, sf_dir):
    return cp.existing_jobs(cp.latest_job_state(_job_states(spark, sf_dir)))


# ---------------------------------------------------------------- J8 allow-list

OWNER = 0


def _calls(spark, sf_dir):
    """§4 D10: owner 0; caller 0 when e % 3 = 0 else user % 10; signup adds
    (e div 3) % 10, error removes (caller if e odd else (e div 2) % 10)."""
    e = table(spark, sf_dir, "events")
    eid, et = F.col("event_id"), F.col("event_type")
    caller = F.when(eid % 3 == 0, F.lit(0)).otherwise(F.col("user_id") % 10)
    kind = F.when(et == "signup", al.ADD).when(et == "error", al.REMOVE).otherwise(al.ANCHOR)
    target = (F.when(et == "signup", F.floor(eid / 3) % 10)
              .when(et == "error", F.when(eid % 2 == 1, caller).otherwise(F.floor(eid / 2) % 10)))
    root = F.when(kind == al.ANCHOR, F.sha2(eid.cast("string"), 256))
    return e.select(eid.alias("seq"), caller.cast("long").alias("caller"), kind.alias("kind"),
                    target.cast("long").alias("target"), root.alias("root"))


@register("allowlist_state")
def q_allowlist_state(spark, sf_dir):
    return al.membership(_calls(spark, sf_dir), OWNER)


@register("anchor_authorised_asof")
def q_anchor_authorised(spark, sf_dir):
    r = al.replay(_calls(spark, sf_dir), OWNER)
    return r.select("seq", "caller", "kind", "target", "listed_before", "valid")


@register("chain_events")
def q_chain_events(spark, sf_dir):
    return al.event_log(al.replay(_calls(spark, sf_dir), OWNER))


# ---------------------------------------------------------------- state expiry
@register("state_expiry")
def q_state_expiry(spark, sf_dir):
    from ..options import JOB_TTL
    cids = dd.cid_state_after(_flags(spark, sf_dir))
    now = F.expr("TIMESTAMP_NTZ'2024-01-31 00:00:00'")
    return cids.withColumn("expired", dd.expired(F.col("crt"), JOB_TTL, now))


# ---------------------------------------------------------------- J6 metrics


def _metric_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    suffix = F.when(F.col("event_id") % 7 == 0, F.lit("_tsdb")).otherwise(F.lit(""))
    return e.select("event_id", "ts", F.concat(F.col("event_type"), suffix).alias("metric"))


@register("filter_metric_names")
def q_filter_metric_names(spark, sf_dir):
    kept = mt.filter_metric_names(_metric_rows(spark, sf_dir))
    return kept.groupBy("metric").agg(F.count(F.lit(1)).alias("n"))


@register("metric_name")
def q_metric_name(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return (e.groupBy(metric_name(F.col("event_type"), "count").alias("metric"))
            .agg(F.count(F.lit(1)).alias("value")))


@register("write_metrics")
def q_write_metrics(spark, sf_dir):
    """Counter, gauge and distribution samples of the pipeline in one table."""
    rows = mt.filter_metric_names(_metric_rows(spark, sf_dir))
    us = epoch_micros("ts", rows.schema["ts"].dataType)
    hour = lambda c: ntz_from_micros(c * F.lit(HOUR_US))
    counts = rows.groupBy("metric", F.floor(us / F.lit(HOUR_US)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    samples = (mt.samples(counts, F.col("metric"), "count", hour(F.col("hour")), F.col("n"))
               .unionByName(mt.pending_gauge(q_pending_count(spark, sf_dir), F.expr(AS_OF)))
               .unionByName(mt.queue_gauges(q_queue_utilisation(spark, sf_dir), hour(F.col("hour"))))
               .unionByName(mt.batch_size_samples(bt.batch_requests(_batch_rows(spark, sf_dir), CLOSED))))
    path = scratch_path(spark, "metrics")
    sinks.write_table(samples, path, ["metric"], "ts")
    return spark.read.parquet(path).select("metric", "ts", "value")


@register("counter_totals")
def q_counter_totals(spark, sf_dir):
    r = dd.dedupe_requests(td.deliveries(spark, sf_dir))
    o = r.outcomes
    validate = o.agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("event") == dd.REPLACED).alias("validate_replaced_request"),
        F.count_if(F.col("event") == dd.READY).alias("validate_processed_request"),
        F.count_if(F.col("reason") == "reprocessed").alias("validate_reprocessed_request"))
    v = validate.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"))
        for c in ["validate_replaced_request", "validate_processed_request", "validate_reprocessed_request"]
    ])).alias("m")).select("m.metric", "m.value")
    ingress = td.deliveries(spark, sf_dir).agg(F.count(F.lit(1)).alias("value")) \
        .select(F.lit("validate_ingress_request").alias("metric"), "value")
    b = materialise(bt.batch_requests(_batch_rows(spark, sf_dir), CLOSED), "batches")
    batches = b.agg(F.count(F.lit(1)).alias("nb"), F.sum("n").alias("nr")).select(F.explode(F.array(
        F.struct(F.lit("batch_created").alias("metric"), F.col("nb").alias("value")),
        F.struct(F.lit("batch_ingress_request").alias("metric"), F.col("nr").alias("value")))).alias("m")) \
        .select("m.metric", "m.value")
    # what the store really holds, and what the failure queue received (undecodable requests)
    store = scratch_path(spark, "stored-batches")
    sinks.write_batches(b, store)
    stored = sinks.read_json(spark, store, sinks.BATCH_DOC_SCHEMA).agg(F.count(F.lit(1)).alias("value")) \
        .select(F.lit("batch_stored").alias("metric"), "value")
    failed = msg.parse_requests(td.request_texts(spark, sf_dir)).agg(F.count_if("malformed").alias("value")) \
        .select(F.lit("failure_message").alias("metric"), "value")
    dlq = td.dead_letter_texts(spark, sf_dir).agg(F.count(F.lit(1)).alias("value")) \
        .select(F.lit("failure_dlq_message").alias("metric"), "value")
    ps = msg.parse_status(td.status_texts(spark, sf_dir)).filter(~F.col("malformed"))
    status = ps.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(
        F.struct(F.lit("status_ingress_message").alias("metric"), F.col("n").alias("value")),
        F.struct(F.lit("status_updated").alias("metric"), F.col("n").alias("value")))).alias("m")) \
        .select("m.metric", "m.value")
    jobs = _plans(spark, sf_dir).agg(F.sum("create").alias("value")) \
        .select(F.lit("worker_job_created").alias("metric"), "value")
    return mt.counter_totals([v, ingress, batches, stored, failed, dlq, status, jobs])


@register("observed_counters")
def q_observed_counters(spark, sf_dir):
    """D2 of one run of the jobs, observed on the outputs it writes."""
    root, run, one = scratch_path(spark, "observed-run"), mt.RunCounters(), F.count(F.lit(1))
    parsed = dl.quarantine_route(msg.parse_requests(td.request_texts(spark, sf_dir)))
    run.on(parsed, failure_message=F.count_if("malformed")).write.partitionBy("route").parquet(f"{root}/messages")
    flags = dd.dedupe_requests(td.deliveries(spark, sf_dir)).flags
    run.on(flags, validate_ingress_request=one).write.parquet(f"{root}/flags")
    run.on(dd.outcomes_of(spark.read.parquet(f"{root}/flags")),
           validate_replaced_request=F.count_if(F.col("event") == dd.REPLACED),
           validate_processed_request=F.count_if(F.col("event") == dd.READY),
           validate_reprocessed_request=F.count_if(F.col("reason") == "reprocessed")).write.parquet(f"{root}/outcomes")
    batches = bt.batch_requests(_batch_rows(spark, sf_dir), CLOSED)
    run.on(batches, batch_created=one, batch_ingress_request=F.sum("n")).write.parquet(f"{root}/batches")
    sinks.write_batches(spark.read.parquet(f"{root}/batches"), f"{root}/store", lambda docs: run.on(docs, batch_stored=one))
    status = msg.parse_status(td.status_texts(spark, sf_dir)).filter(~F.col("malformed"))
    run.on(status, status_ingress_message=one, status_updated=one).write.parquet(f"{root}/status")
    alerts = dl.dead_letter_alerts(dl.classify_dead_letters(td.dead_letter_texts(spark, sf_dir)))
    run.on(alerts, failure_dlq_message=one).write.parquet(f"{root}/alerts")
    jobs = cp.job_requests(_plans(spark, sf_dir), "hour", F.expr(AS_OF))
    run.on(jobs, worker_job_created=one).write.parquet(f"{root}/jobs")
    return run.frame(spark)


# ---------------------------------------------------------------- sinks of J1
@register("write_ready")
def q_write_ready(spark, sf_dir):
    ready = dd.ready_rows(_flags(spark, sf_dir))
    path = scratch_path(spark, "ready")
    sinks.write_table(ready, path)
    return spark.read.parquet(path)


@register("write_status_events")
def q_write_status_events(spark, sf_dir):
    o = dd.dedupe_requests(td.deliveries(spark, sf_dir)).outcomes.filter(F.col("event") == dd.REPLACED)
    path = scratch_path(spark, "status-events")
    (o.select("arrival_seq", "event_ord",
              msg.encode_status(td.uuid_of(F.col("target_rid")), F.lit(st.REPLACED)).alias("value"))
     .write.mode("overwrite").json(path))
    back = spark.read.schema("arrival_seq long, event_ord int, value string").json(path)
    p = msg.parse_status(back)
    return p.select("arrival_seq", "event_ord", "rid", "sts")


# ---------------------------------------------------------------- streaming

STREAM_CHUNKS = 4


def _chunk_of(df, order_col: str):
    """Chunk number of a row: STREAM_CHUNKS equal-width ranges of ``order_col``."""
    lo, hi = df.agg(F.min(order_col), F.max(order_col)).first()
    width = (hi - lo) // STREAM_CHUNKS + 1
    return F.floor((F.col(order_col) - F.lit(lo)) / F.lit(width))


def _stream(df, order_col: str, root: str, fn) -> None:
    """Feed ``df`` to a file stream in STREAM_CHUNKS appends in the order of
    ``order_col``. Each append (any number of files) is drained before the next
    is added, so micro-batches come in order whatever the files' times are."""
    spark, chunk = df.sparkSession, _chunk_of(df, order_col)
    for i in range(STREAM_CHUNKS):
        df.filter(chunk == i).write.mode("append").parquet(f"{root}/source")
        sj.run_file_stream(spark, f"{root}/source", _ddl(df), fn, f"{root}/checkpoint")


def _ddl(df) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _keyed_stream(df, order_col: str, name: str, job, restart: bool = False, sink=None) -> DataFrame | None:
    """Feed ``df`` to a keyed job in STREAM_CHUNKS appends, each moved into the
    source in one step and drained before the next; the job's rows. With
    ``restart`` the query is stopped halfway and goes on from its checkpoint.
    With ``sink``, changed rows go into that function instead (mode update)."""
    spark, chunk, root = df.sparkSession, _chunk_of(df, order_col), scratch_path(df.sparkSession, name)

    def feed(i: int) -> None:
        df.filter(chunk == i).write.parquet(f"{root}/ready/{i}")
        rename(spark, f"{root}/ready/{i}", f"{root}/source/{i}")

    def start():
        source = spark.readStream.schema(_ddl(df)).option("recursiveFileLookup", "true").parquet(f"{root}/source")
        return ks.start(job(source), sink or f"{root}/out", f"{root}/checkpoint", every="0 seconds", mode="update" if sink else "append")

    feed(0)
    query = start()
    try:
        for i in range(1, STREAM_CHUNKS + 1):
            query.processAllAvailable()
            if restart and i == STREAM_CHUNKS // 2:
                query.stop()
                query = start()
            if i < STREAM_CHUNKS:
                feed(i)
    finally:
        query.stop()
    return None if sink else spark.read.parquet(f"{root}/out")


def _stream_flags(spark, sf_dir, restart: bool = False) -> DataFrame:
    return _keyed_stream(td.deliveries(spark, sf_dir), "arrival_seq", "stream-dedupe", ks.dedupe_stream, restart)


@register("stream_dedupe")
def q_stream_dedupe(spark, sf_dir):
    return dd.outcomes_of(_stream_flags(spark, sf_dir))


@register("late_tip")
def q_late_tip(spark, sf_dir):
    return _stream_flags(spark, sf_dir).filter(~F.col("accepted")).select("arrival_seq", "rid", F.col("rid").alias("target_rid"))


@register("redelivery_idempotence")
def q_redelivery_idempotence(spark, sf_dir):
    """The deliveries hold redeliveries, some of which meet the state that a
    query stopped before them has left."""
    return dd.outcomes_of(_stream_flags(spark, sf_dir, restart=True))


def _stream_batches(spark, sf_dir, opts):
    root = scratch_path(spark, "stream-batches")
    rows = td.events(spark, sf_dir).select(F.col("event_id").alias("rid"), "ts", "ts_us", F.col("event_id").alias("arrival_seq"))
    store = EpochStore(spark, root + "/state")
    _stream(rows, "ts_us", root, sj.batching_batch_fn(store, opts))
    drained = sj.drain(store, STREAM_CHUNKS - 1, opts)
    return store.read_all("batches").drop("epoch"), drained


@register("stream_batches")
def q_stream_batches(spark, sf_dir):
    """I2 with linger < flush (the harder, greedy form)."""
    emitted, _ = _stream_batches(spark, sf_dir, LINGER)  # the drain is one of the steps
    return _batch_cols(emitted)


@register("drain_flush")
def q_drain_flush(spark, sf_dir):
    _, drained = _stream_batches(spark, sf_dir, CLOSED)
    return _batch_cols(drained)


@register("apply_status_stream")
def q_apply_status_stream(spark, sf_dir):
    events_df, initial = td.status_events(spark, sf_dir)
    changes = _keyed_stream(events_df, "seq", "stream-status", lambda events: ks.status_stream(events, initial))
    return ks.statuses(initial, changes)


@register("dlq_stream")
def q_dlq_stream(spark, sf_dir):
    root = scratch_path(spark, "stream-dlq")
    store = EpochStore(spark, root + "/state")
    _stream(td.dead_letter_texts(spark, sf_dir), "seq", root, sj.dlq_batch_fn(store))
    return store.read_all("alerts").drop("epoch")


@register("redrive_stream")
def q_redrive_stream(spark, sf_dir):
    """B9 across micro-batches and a restart of the query."""
    store = EpochStore(spark, scratch_path(spark, "stream-redrive"))
    _keyed_stream(td.redrive_deliveries(spark, sf_dir), "arrival_seq", "stream-receives", sj.receive_counts, True,
                  sink=sj.redrive_batch_fn(store))
    return sj.redriven(store).select("rid", "receive_count", "dead")


@register("capacity_samples")
def q_capacity_samples(spark, sf_dir):
    """Every event is a utilisation sample; the last one of each 30 s tick
    is planned."""
    root = scratch_path(spark, "stream-capacity")
    e = table(spark, sf_dir, "events")
    ev = e.select("ts", F.col("event_id").alias("seq"), (F.col("event_id") % 50).alias("unprocessed"),
                  (F.col("user_id") % 7).alias("inflight"), (F.col("event_id") % 5).alias("existing"))
    store = EpochStore(spark, root + "/state")
    # in order of event_id, which is not the order of time: most samples are late
    _stream(ev, "seq", root, sj.capacity_sample_fn(store))
    s = sj.last_samples(store)
    u = cp.capacity_plan(F.col("unprocessed"), F.col("inflight"), F.col("existing"), UNLIMITED)
    m = cp.capacity_plan(F.col("unprocessed"), F.col("inflight"), F.col("existing"), MAX3)
    return s.select("tick_start", "unprocessed", "inflight", "existing", u["required"].alias("required"),
                    u["create"].alias("create"), m["create"].alias("create_max3"))


def _poll_ticks(spark, sf_dir):
    """A tick every other day, from two days after the first request's day
    until all requests are old enough."""
    first, last = td.events(spark, sf_dir).agg(*(F.floor(f("ts_us") / F.lit(US_PER_DAY)) for f in (F.min, F.max))).first()
    return [_dt(1970, 1, 1) + _td(days=d) for d in range(first + 2, last + 4, 2)]


@register("incremental_backfill")
def q_incremental_backfill(spark, sf_dir):
    store = EpochStore(spark, scratch_path(spark, "backfill"))
    ticks = bf.incremental_backfill(td.request_table(spark, sf_dir), _poll_ticks(spark, sf_dir), store,
                                    F.col("request_id") % 97 == 0, DEFAULT_BATCH_SIZE)
    sent = bf.poll_messages(store).groupBy("tick").agg(F.count(F.lit(1)).alias("n_published"))
    told = bf.poll_alerts(store).select("tick", F.col("content").alias("alert"))
    return (ticks.join(sent, "tick", "left").join(told, "tick", "left")
            .select("tick", "now", "checkpoint", "n_rows", "n_sent", "next_checkpoint",
                    F.coalesce("n_published", F.lit(0)).alias("n_published"), "alert"))
