"""Adapters from the generated tables to the request-pipeline inputs.

Every adapter is a deterministic DataFrame derivation of the given tables
(``events``, ``customer``, ``orders``), so work grows with the tables. The
same derivations are written in DuckDB SQL in ``keyfold/plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.timecols import (US_PER_DAY, epoch_micros, floor_micros,
                                  ntz_from_micros)
from .tables import table

# Fixed adapter parameters (FIXTURES §3): redelivery rules.
IMMEDIATE_REDELIVERY_MOD = 11
LATE_REDELIVERY_MOD = 13
LATE_REDELIVERY_SHIFT = 37
MSG_TS_LAG_MOD = 5


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("ts_us", epoch_micros("ts", e.schema["ts"].dataType))


def requests_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event: rid, stream_id, origin, cid, ts (message time),
    crt (creation time), status; ``e`` keeps event_id for derived rules."""
    e = events(spark, sf_dir)
    day = floor_micros(F.col("ts_us"), US_PER_DAY)
    msg_us = day - (F.col("event_id") % MSG_TS_LAG_MOD) * F.lit(US_PER_DAY)
    return e.select(
        F.col("event_id").alias("rid"), F.col("user_id").alias("stream_id"),
        F.col("event_type").alias("origin"), F.col("props").alias("cid"),
        ntz_from_micros(msg_us).alias("ts"), F.col("ts").alias("crt"),
        F.col("event_id").alias("e"), F.col("ts_us"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§3 deliveries: every event once, plus an immediate and a late redelivery
    for some events; ``arrival_seq`` is unique. One scan, copies by explode."""
    r = requests_base(spark, sf_dir)
    e = F.col("e")
    copies = F.array(e * 10,
                     F.when(e % IMMEDIATE_REDELIVERY_MOD == 0, e * 10 + 1),
                     F.when(e % LATE_REDELIVERY_MOD == 0, (e + LATE_REDELIVERY_SHIFT) * 10 + 2))
    return r.select("rid", "stream_id", "origin", "cid", "ts", "crt",
                    F.explode(F.filter(copies, lambda x: x.isNotNull())).alias("arrival_seq"))


def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request table: status = event_id % 6, updated_at = created_at."""
    r = requests_base(spark, sf_dir)
    return r.select(F.col("rid").alias("request_id"), "cid", "stream_id", "origin", "ts",
                    F.col("crt").alias("created_at"),
                    (F.col("e") % 6).cast("smallint").alias("status"),
                    F.col("crt").alias("updated_at"))


def metadata_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§4 C1: stream metadata from customers with c_custkey % 3 <> 0."""
    c = table(spark, sf_dir, "customer")
    return (c.filter(F.col("c_custkey") % 3 != 0)
            .select(F.col("c_custkey").alias("stream_id"),
                    F.struct(F.array("c_name").alias("controllers"),
                             F.col("c_mktsegment").alias("family")).alias("metadata")))


# ------------------------------------------------------------ message texts
# Fixed adapter parameters (FIXTURES §4): which events become which texts.
JUNK_MOD, BAD_TS_MOD, EMPTY_MOD = 17, 19, 23
BAD_STATUS_MOD, MISSING_STS_MOD = 10, 7
UUID_PREFIX = "00000000-0000-4000-8000-"


def uuid_of(c) -> "F.Column":
    """Deterministic, non-nil UUID text for an integer id."""
    return F.concat(F.lit(UUID_PREFIX), F.lower(F.lpad(F.hex(c), 12, "0")))


def request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request message texts, one per event, some junk / bad ts / empty."""
    from .messages import encode_request
    r = requests_base(spark, sf_dir)
    e = F.col("e")
    good = encode_request(uuid_of(e), F.col("stream_id").cast("string"), F.col("cid"),
                          F.col("origin"), F.col("ts"), F.col("crt"))
    bad_ts = F.to_json(F.struct(uuid_of(e).alias("rid"), F.lit("bad").alias("ts")))
    value = (F.when(e % JUNK_MOD == 0, F.lit("hello"))
             .when(e % BAD_TS_MOD == 0, bad_ts)
             .when(e % EMPTY_MOD == 0, F.lit("{}"))
             .otherwise(good))
    return r.select(e.alias("seq"), value.alias("value"))


def status_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status message texts: the D8 event stream as JSON, with junk and absent sts."""
    ev = table(spark, sf_dir, "events")
    e, u = F.col("event_id"), F.col("user_id")
    value = (F.when(e % BAD_STATUS_MOD == 9, F.lit("invalid request"))
             .when(e % MISSING_STS_MOD == 0, F.to_json(F.struct(uuid_of(u).alias("rid"))))
             .otherwise(F.to_json(F.struct(uuid_of(u).alias("rid"), status_event_value(e).alias("sts")))))
    return ev.select(e.alias("seq"), value.alias("value"))


def status_event_value(e):
    """§4 D8: REPLACED unless event_id % 3 = 0, then (event_id div 3) % 6."""
    return F.when(e % 3 != 0, F.lit(5)).otherwise(F.floor(e / 3) % 6).cast("smallint")


def status_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """§4 D8: (events(id, sts, seq), initial(id, status)) with id = user_id."""
    ev = table(spark, sf_dir, "events")
    events_df = ev.select(F.col("user_id").alias("id"), status_event_value(F.col("event_id")).alias("sts"),
                          F.col("event_id").alias("seq"))
    initial = (ev.select(F.col("user_id").alias("id")).distinct()
               .withColumn("status", (F.col("id") % 6).cast("smallint")))
    return events_df, initial


def dead_letter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§4 B8: e%5 = 0 request, 1 status, 2 batch, 3 request with bad ts, 4 junk."""
    from .messages import encode_batch, encode_request, encode_status
    r = requests_base(spark, sf_dir)
    e = F.col("e")
    k = e % 5
    value = (F.when(k == 0, encode_request(uuid_of(e), F.col("stream_id").cast("string"), F.col("cid"),
                                           F.col("origin"), F.col("ts"), F.col("crt")))
             .when(k == 1, encode_status(uuid_of(e), F.lit(5)))
             .when(k == 2, encode_batch(uuid_of(e), F.array().cast("array<string>")))
             .when(k == 3, F.to_json(F.struct(uuid_of(e).alias("rid"), F.lit("bad").alias("ts"))))
             .otherwise(F.lit("hello")))
    return r.select(e.alias("seq"), value.alias("value"))


REDRIVE_EXTRA_MOD = 17


def redrive_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§4 B9: the §3 deliveries plus two more receives of every e % 17 = 0."""
    d = deliveries(spark, sf_dir)
    first = (F.col("arrival_seq") % 10 == 0) & (F.floor(F.col("arrival_seq") / 10) % REDRIVE_EXTRA_MOD == 0)
    copies = F.array(F.col("arrival_seq"), F.when(first, F.col("arrival_seq") + 3),
                     F.when(first, F.col("arrival_seq") + 4))
    return d.withColumn("arrival_seq", F.explode(F.filter(copies, lambda x: x.isNotNull())))
