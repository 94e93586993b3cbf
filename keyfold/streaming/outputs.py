"""What a stream writes to more than one place, a micro-batch at a time.

Every output lies in a folder of its epoch and is overwritten by a retry, which
writes the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..operators.deadletter import quarantine_route
from ..sources.messages import parse_requests
from ..sources.sinks import write_batch_manifest, write_batches
from .epochs import EpochStore
from .jobs import BatchFn


def ingest_batch_fn(store: EpochStore, value: str = "value") -> BatchFn:
    """Request messages from a stream of texts. One pass decodes a
    micro-batch and writes it by route, what decodes to ``valid`` and the rest,
    text included, to ``quarantine``; no text stops the stream. The counts of
    the epoch (D2: ingress and failures) are observed on that pass, not read
    again."""
    def fn(batch: DataFrame, epoch: int) -> None:
        seen = Observation()
        routed = quarantine_route(parse_requests(batch, value)).observe(
            seen, F.count(F.lit(1)).alias("validate_ingress_request"), F.count_if("malformed").alias("failure_message"))
        routed.drop("malformed").write.mode("overwrite").partitionBy("route").parquet(store.path("messages", epoch))
        counts = seen.get
        rows = [(k, int(counts.get(k) or 0)) for k in ("validate_ingress_request", "failure_message")]
        store.write("ingest_counts", epoch, store.spark.createDataFrame(rows, "metric string, value long"))
    return fn


def routed(store: EpochStore, route: str) -> DataFrame:
    """The messages of a route, over all epochs (partitions of that route only)."""
    every = store.read_all("messages").filter(F.col("route") == route).drop("route")
    return every if route == "quarantine" else every.drop("value")


def ingest_counts(store: EpochStore) -> DataFrame:
    return store.read_all("ingest_counts").groupBy("metric").agg(F.sum("value").alias("value"))


def publish_batches_fn(store: EpochStore) -> BatchFn:
    """A5, then A6: the closed batches of a micro-batch go to the store first,
    and their pointers into the manifest once the store has committed. A crash
    between the steps leaves batches without a pointer, never a pointer without
    its batch; the retried epoch writes both again. A manifest counts when its
    folder is committed."""
    def fn(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            write_batches(batch, store.path("stored", epoch))
            write_batch_manifest(batch, store.path("manifest", epoch))
        finally:
            batch.unpersist()
    return fn
