"""J4 backfill_pending: checkpointed scan for old PENDING requests.

One poll = ``request LEFT JOIN metadata`` filtered on status and a strictly
open ``created_at`` interval, oldest first, limited to the load limit
(A1, B1, B2, C1, F1, F2). The window is ``(max(checkpoint, now - 48 h),
now - 12 h)`` (B3). Rows are re-sent in order until the first send failure;
the next checkpoint is the created_at of the last sent row, or the first
row's created_at minus 1 ms when the first send fails (E7). ``now`` is an
argument: no operator reads the wall clock.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F
from pyspark.sql.types import TimestampNTZType

from ..functions.text import (ALERT_DESC_UNPROCESSED, ALERT_TITLE,
                              unprocessed_alert)
from ..functions.timecols import (US_PER_DAY, epoch_micros, micros_of,
                                  ntz_from_micros)
from ..options import POLL_LOOK_BACK, POLL_MIN_AGE, PollOptions
from .scan import prefix_max_before
from .status import PENDING

ONE_MS_US = 1000


def ntz_lit(t: datetime) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{t.strftime('%Y-%m-%d %H:%M:%S.%f')}'")


def filter_status(requests: DataFrame, status: int = PENDING) -> DataFrame:
    """B1: ``status = s`` (pushed into the parquet scan)."""
    return requests.filter(F.col("status") == F.lit(status))


def filter_open_interval(requests: DataFrame, newer_than: Column, older_than: Column,
                         col: str = "created_at") -> DataFrame:
    """B2: both ends strict, never ``between``."""
    return requests.filter((F.col(col) > newer_than) & (F.col(col) < older_than))


def poll_window(now: Column, checkpoint: Column, min_age: timedelta = POLL_MIN_AGE,
                look_back: timedelta = POLL_LOOK_BACK) -> tuple[Column, Column]:
    """``(greatest(checkpoint, now - look_back), now - min_age)``."""
    lo = F.greatest(checkpoint, F.timestamp_add("MICROSECOND", F.lit(-micros_of(look_back)), now))
    hi = F.timestamp_add("MICROSECOND", F.lit(-micros_of(min_age)), now)
    return lo, hi


def left_join_metadata(requests: DataFrame, metadata: DataFrame) -> DataFrame:
    """``request LEFT JOIN metadata USING (stream_id)``; AQE picks broadcast
    only if the metadata side turns out small at run time."""
    return requests.join(metadata, "stream_id", "left")


def scan_requests(requests: DataFrame, metadata: DataFrame, status: int,
                  newer_than: Column, older_than: Column, limit: int | None,
                  tie_safe: bool = False) -> DataFrame:
    """A1 + F1/F2: the poll query. With ``limit`` this is a top-k
    (TakeOrderedAndProject: per-partition top-k, then a k-row merge).
    ``tie_safe`` keeps every row tied with the k-th ``created_at`` instead of
    cutting through ties the way ``ORDER BY ... LIMIT`` does."""
    cand = filter_open_interval(filter_status(requests, status), newer_than, older_than)
    if limit is not None and tie_safe:
        # one scalar: the k-th created_at (top-k merge of per-partition top-k)
        kth = cand.orderBy("created_at").limit(limit).agg(F.max("created_at")).first()[0]
        if kth is not None:
            # a zoned literal would depend on the session's time zone where the column has none
            at = ntz_lit(kth) if isinstance(cand.schema["created_at"].dataType, TimestampNTZType) else F.lit(kth)
            cand = cand.filter(F.col("created_at") <= at)
    elif limit is not None:
        cand = cand.orderBy("created_at", "request_id").limit(limit)
    return left_join_metadata(cand, metadata)


def request_to_message(rows: DataFrame) -> DataFrame:
    """Poll row -> request message columns; metadata is dropped."""
    return rows.select(*[c.alias(n) for n, c in _message_columns().items()])


def _message_columns() -> dict[str, Column]:
    same = {n: F.col(n) for n in ("stream_id", "cid", "origin", "ts")}
    return {"rid": F.col("request_id"), **same, "crt": F.col("created_at")}


def poll(requests: DataFrame, metadata: DataFrame, checkpoint: Column, opts: PollOptions) -> DataFrame:
    lo, hi = poll_window(ntz_lit(opts.now), checkpoint, opts.min_age, opts.look_back)
    return scan_requests(requests, metadata, PENDING, lo, hi, opts.limit, opts.tie_safe)


def sent_prefix_checkpoint(rows: DataFrame, poll_key: str, failed: Column) -> DataFrame:
    """E7 per poll: rows are sent in (created_at, request_id) order until the
    first failure; rows of one created_at are told apart by their id.

    Two aggregates and a join on the poll key, no per-poll window: the first
    failure's place, then the last row before it. Output per poll: ``n_rows,
    n_sent, next_checkpoint, outcome`` (all / first / later)."""
    us = epoch_micros("created_at", rows.schema["created_at"].dataType)
    r = rows.withColumn("_at", F.struct(us.alias("us"), F.col("request_id").alias("id"))).withColumn("_fail", failed)
    first_fail = r.groupBy(poll_key).agg(F.min(F.when(F.col("_fail"), F.col("_at"))).alias("_ff"))
    j = r.join(first_fail, poll_key)
    sent = F.col("_ff").isNull() | (F.col("_at") < F.col("_ff"))
    g = j.groupBy(poll_key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(sent).alias("n_sent"),
        F.max(F.when(sent, F.col("_at.us"))).alias("_last"), F.min("_at.us").alias("_first"),
        F.first("_ff").alias("_ff"))
    next_us = F.coalesce(F.col("_last"), F.col("_first") - F.lit(ONE_MS_US))
    outcome = (F.when(F.col("_ff").isNull(), "all")
               .when(F.col("n_sent") == 0, "first").otherwise("later"))
    return g.select(poll_key, "n_rows", "n_sent", ntz_from_micros(next_us).alias("next_checkpoint"),
                    outcome.alias("outcome"))


def go_time_text(ts: Column) -> Column:
    """A UTC time as Go prints it: ``2006-01-02 15:04:05.999999999 +0000 UTC``
    (fraction without trailing zeros, omitted when zero)."""
    frac = F.regexp_replace(F.date_format(ts, "SSSSSS"), "0+$", "")
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
                    F.when(F.length(frac) > 0, F.concat(F.lit("."), frac)).otherwise(F.lit("")),
                    F.lit(" +0000 UTC"))


def daily_tick_backlog(requests: DataFrame, min_age: timedelta = POLL_MIN_AGE,
                       look_back: timedelta = POLL_LOOK_BACK, title: str = ALERT_TITLE) -> DataFrame:
    """D12 over a calendar of polls at every UTC midnight: PENDING rows in
    ``(now - look_back, now - min_age)`` per tick, one alert row per tick
    with a backlog. The range condition becomes an equi-join: each row lists
    the (few) ticks whose window holds it, then a hash aggregate counts."""
    p = filter_status(requests, PENDING)
    us = epoch_micros("created_at", p.schema["created_at"].dataType)
    lo_day = F.floor((us + F.lit(micros_of(min_age))) / F.lit(US_PER_DAY)) + 1
    hi_day = F.ceil((us + F.lit(micros_of(look_back))) / F.lit(US_PER_DAY)) - 1
    ticks = (p.withColumn("_us", us)
             .withColumn("tick_day", F.explode(F.sequence(lo_day, F.greatest(lo_day, hi_day))))
             .filter((F.col("tick_day") * US_PER_DAY > F.col("_us") + micros_of(min_age))
                     & (F.col("tick_day") * US_PER_DAY < F.col("_us") + micros_of(look_back))))
    g = ticks.groupBy("tick_day").agg(F.count(F.lit(1)).alias("n"))
    now = ntz_from_micros(F.col("tick_day") * F.lit(US_PER_DAY))
    since = F.timestamp_add("MICROSECOND", F.lit(-micros_of(look_back)), now)
    return g.filter(F.col("n") > 0).select(
        now.alias("now"), F.col("n").alias("n_requests"), F.lit(title).alias("title"),
        F.lit(ALERT_DESC_UNPROCESSED).alias("desc"),
        unprocessed_alert(F.col("n"), go_time_text(since)).alias("content"))


def checkpoint_accept(proposals: DataFrame) -> DataFrame:
    """A proposed checkpoint ``(name, value, seq)`` is accepted iff none is
    stored or it is strictly greater than the stored one (= every earlier
    proposal of that name). Chunked prefix max, so a hot name spreads out."""
    d = prefix_max_before(proposals, ["name"], "seq", F.col("value"), "_prior")
    return d.withColumn("accepted", F.col("_prior").isNull() | (F.col("value") > F.col("_prior"))).drop("_prior")


def checkpoint_max(proposals: DataFrame) -> DataFrame:
    """Stored checkpoint per name after all proposals."""
    return proposals.groupBy("name").agg(F.max("value").alias("value"))


def load_checkpoint(state: DataFrame, names: DataFrame) -> DataFrame:
    """A10: point reads; an absent name reads as the zero time."""
    zero = F.expr("TIMESTAMP_NTZ'0001-01-01 00:00:00'")
    got = state.join(names, "name", "right").groupBy("name").agg(F.max("value").alias("value"))
    return got.select("name", F.coalesce(F.col("value"), zero).alias("value"))


POLL_CHECKPOINT = "rpoll"


#: What a tick commits; times in microseconds.
TICK_RECORD = "tick int, now_us long, checkpoint_us long, n_rows long, n_sent long, next_us long, attempt string"


def _micros(t: datetime) -> int:
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def _time(us: int) -> datetime:
    return datetime(1970, 1, 1) + timedelta(microseconds=us)


def poll_tick(requests: DataFrame, tick: int, now: datetime, checkpoint: datetime, store, failed: Column, limit: int,
              min_age: timedelta = POLL_MIN_AGE) -> datetime:
    """One poll: scan, publish, advance. Returns the next checkpoint.

    The polled rows (at most ``limit``, so one task sorts them) are written once,
    each marked ``sent`` when it comes before the first failure, into a folder of
    this attempt; what the checkpoint needs is observed on that write. Then one
    record commits the tick: counts, checkpoint and attempt. Messages and alerts
    are read through the records, so an attempt that was cut off is never seen.
    Of several pollers at one tick the first to commit wins (E6: a checkpoint is
    set only if absent or greater); the others read its record and go on from it."""
    lo, hi = ntz_lit(checkpoint), ntz_lit(now - min_age)
    found = filter_open_interval(filter_status(requests), lo, hi).orderBy("created_at", "request_id").limit(limit)
    place = F.struct("created_at", "request_id")
    first_fail = F.min(F.when(F.col("_failed"), place)).over(
        Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = (found.withColumn("_failed", failed).withColumn("_ff", first_fail)
            .withColumn("sent", F.col("_ff").isNull() | (place < F.col("_ff"))).drop("_failed", "_ff"))
    attempt, seen = f"a-{uuid.uuid4().hex}", Observation()
    us = epoch_micros("created_at", requests.schema["created_at"].dataType)
    (rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("sent").alias("n_sent"), F.min(us).alias("first"),
                  F.max(F.when(F.col("sent"), us)).alias("last"))
     .write.mode("overwrite").parquet(f"{store.path('polled', tick)}/attempt={attempt}"))
    s = seen.get
    n, n_sent = int(s.get("n") or 0), int(s.get("n_sent") or 0)
    proposed = s["last"] if n_sent else s["first"] - ONE_MS_US if n else None
    before = _micros(checkpoint)
    record = store.commit("ticks", tick, {
        "tick": tick, "now_us": _micros(now), "checkpoint_us": before, "n_rows": n, "n_sent": n_sent,
        "next_us": before if proposed is None else max(before, proposed), "attempt": attempt})
    return _time(record["next_us"])


def poll_ticks(store) -> DataFrame:
    """The committed ticks, a row each: tick, now, checkpoint, n_rows, n_sent,
    next_checkpoint, attempt."""
    at = lambda c: ntz_from_micros(F.col(c))
    return store.read_commits("ticks", TICK_RECORD).select(
        "tick", at("now_us").alias("now"), at("checkpoint_us").alias("checkpoint"), "n_rows", "n_sent",
        at("next_us").alias("next_checkpoint"), "attempt")


def poll_messages(store) -> DataFrame:
    """The messages of the committed ticks, with their ``tick``."""
    rows = store.read_all("polled").withColumnRenamed("epoch", "tick").filter("sent")
    kept = rows.join(poll_ticks(store).select("tick", "attempt"), ["tick", "attempt"], "left_semi")
    return kept.select(*[c.alias(n) for n, c in _message_columns().items()], "tick")


def poll_alerts(store, title: str = ALERT_TITLE) -> DataFrame:
    """An alert for every committed tick that found rows."""
    return poll_ticks(store).filter(F.col("n_rows") > 0).select(
        F.lit(title).alias("title"), F.lit(ALERT_DESC_UNPROCESSED).alias("desc"),
        unprocessed_alert(F.col("n_rows"), go_time_text(F.col("checkpoint"))).alias("content"), F.col("now").alias("ts"), "tick")


def incremental_backfill(requests: DataFrame, ticks: list[datetime], store, failed: Column, limit: int,
                         min_age: timedelta = POLL_MIN_AGE, look_back: timedelta = POLL_LOOK_BACK) -> DataFrame:
    """The poller as a scheduled job, one ``poll_tick`` per tick.

    At start the checkpoint is read from the committed ticks (A10) and floored to
    ``first tick to run - look_back`` (B3); committed ticks are not run again, so
    a restart goes on where the last run stopped."""
    done = store.newest_commit("ticks")
    todo = [(k, now) for k, now in enumerate(ticks) if k > done]
    if todo:
        checkpoint = todo[0][1] - look_back
        if done >= 0:
            name = F.lit(POLL_CHECKPOINT).alias("name")
            stored = load_checkpoint(poll_ticks(store).select(name, F.col("next_checkpoint").alias("value")),
                                     requests.sparkSession.range(1).select(name)).first()["value"]
            checkpoint = max(checkpoint, stored)
        for k, now in todo:
            checkpoint = poll_tick(requests, k, now, checkpoint, store, failed, limit, min_age)
    return poll_ticks(store).drop("attempt")
