"""J5 triage_dead_letters: classify undeliverable messages, emit alerts.

B8: a text is an "Anchor request" when it decodes as a request with a
non-nil ``rid``; else a "Batch request" when it decodes as a batch with a
non-nil ``bid``; else "Unknown". A status message carries ``rid`` and so
counts as a request, as in the service.
B9: a message received more than ``max_receive`` times goes dead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import NIL_UUID
from ..functions.text import (ALERT_DESC_DEAD_LETTER, ALERT_TITLE,
                              dead_letter_alert)
from ..options import MAX_RECEIVE_COUNT
from ..sources.messages import request_or_batch

UNKNOWN = "Unknown"
TYPE_REQUEST = "Anchor request"
TYPE_BATCH = "Batch request"


def classify_dead_letters(texts: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``msg_type`` and ``msg_id``."""
    both = request_or_batch(texts, value)
    is_req = F.coalesce(F.col("rid") != F.lit(NIL_UUID), F.lit(False))
    is_batch = F.coalesce(F.col("bid") != F.lit(NIL_UUID), F.lit(False))
    return (both
            .withColumn("msg_type", F.when(is_req, TYPE_REQUEST).when(is_batch, TYPE_BATCH).otherwise(UNKNOWN))
            .withColumn("msg_id", F.when(is_req, F.col("rid")).when(is_batch, F.col("bid")).otherwise(UNKNOWN))
            .drop("rid", "bid"))


def dead_letter_alerts(classified: DataFrame, title: str = ALERT_TITLE) -> DataFrame:
    """One alert row per dead letter (title, desc, content)."""
    return classified.withColumn("title", F.lit(title)) \
        .withColumn("desc", F.lit(ALERT_DESC_DEAD_LETTER)) \
        .withColumn("content", dead_letter_alert(F.col("msg_type"), F.col("msg_id")))


def redrive_split(deliveries: DataFrame, message_id: str = "rid",
                  max_receive: int = MAX_RECEIVE_COUNT) -> DataFrame:
    """Receive count per message; ``dead`` when above ``max_receive``.
    A partial + final hash count, so a hot message id is combined map-side."""
    return (deliveries.groupBy(message_id).agg(F.count(F.lit(1)).alias("receive_count"))
            .withColumn("dead", F.col("receive_count") > F.lit(max_receive)))


def quarantine_route(parsed: DataFrame) -> DataFrame:
    """B7 in one pass: ``route`` = quarantine / valid; a sink can then write
    both routes from one scan (``partitionBy("route")``)."""
    return parsed.withColumn("route", F.when(F.col("malformed"), "quarantine").otherwise("valid"))
