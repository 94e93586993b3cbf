"""J6 pipeline_metrics: counters, samples and the exporter's name filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions.text import METRIC_EXCLUDE_PATTERN, metric_name

# fixed values: counter names of the service
COUNTERS = [
    "batch_created", "batch_ingress_request", "batch_stored", "failure_dlq_message",
    "failure_message", "status_ingress_message", "status_updated", "validate_ingress_request",
    "validate_replaced_request", "validate_processed_request", "validate_reprocessed_request",
    "worker_job_created",
]
DISTRIBUTION_BATCH_SIZE = "batch_size"
GAUGE_PENDING = "pending_anchor_requests"


def filter_metric_names(samples: DataFrame, name: str = "metric") -> DataFrame:
    """Drop metrics whose name matches the exporter's exclusion regex."""
    return samples.filter(~F.col(name).rlike(METRIC_EXCLUDE_PATTERN))


def samples(df: DataFrame, metric, kind: str, ts, value) -> DataFrame:
    """Metric samples (metric, ts, value) under the exporter's names:
    ``count`` for counters, ``gauge`` for gauges, ``histogram`` for single
    samples of a distribution."""
    return df.select(metric_name(metric, kind).alias("metric"), ts.alias("ts"), value.cast("long").alias("value"))


def pending_gauge(pending: DataFrame, ts) -> DataFrame:
    """The pending-requests gauge from D1's one-row count."""
    return samples(pending, F.lit(GAUGE_PENDING), "gauge", ts, F.col("pending_requests"))


def batch_size_samples(batches: DataFrame) -> DataFrame:
    """One sample of the batch-size distribution a batch, at its boundary."""
    return samples(batches, F.lit(DISTRIBUTION_BATCH_SIZE), "histogram", F.col("boundary"), F.col("n"))


def queue_gauges(utilisation: DataFrame, ts) -> DataFrame:
    """Two gauges a queue and sample: what waits and what is in flight."""
    both = utilisation.select(ts.alias("_ts"), F.explode(F.array(*[
        F.struct(F.concat(F.col("queue"), F.lit("_" + k)).alias("m"), F.col(k).alias("v")) for k in ("unprocessed", "inflight")])).alias("g"))
    return samples(both, F.col("g.m"), "gauge", F.col("_ts"), F.col("g.v"))


def counter_totals(parts: list[DataFrame]) -> DataFrame:
    """One total per counter; ``parts`` are ``(metric, value)`` frames.
    Counters with no increments report 0."""
    spark = parts[0].sparkSession
    zero = spark.createDataFrame([(c, 0) for c in COUNTERS], "metric string, value long")
    u = zero
    for p in parts:
        u = u.unionByName(p.select("metric", F.col("value").cast("long")))
    return u.groupBy("metric").agg(F.sum("value").alias("value"))


def counter_columns(counters: dict[str, Column]) -> list[Column]:
    """The counters as named aggregates; a name the service does not have is an error."""
    unknown = set(counters) - set(COUNTERS)
    if unknown:
        raise ValueError(f"no such counters: {sorted(unknown)}")
    return [c.alias(n) for n, c in counters.items()]


class RunCounters:
    """D2 of a run, from the passes the run makes anyway: each of its outputs is
    counted as it is written, and nothing is read again.

    Put ``on`` last before the write, past every shuffle: then the counting is
    done by the writing tasks, of which each partition commits one. A stage before
    a shuffle may run twice (a lost executor, a sampled range) and would count
    twice. ``totals`` waits until every counted output has been written once."""

    def __init__(self) -> None:
        self._seen: list[tuple[Observation, list[str]]] = []

    def on(self, output: DataFrame, **counters: Column) -> DataFrame:
        seen = Observation()
        self._seen.append((seen, list(counters)))
        return output.observe(seen, *counter_columns(counters))

    def totals(self) -> dict[str, int]:
        """Every counter of the service; 0 where the run counted none."""
        out = dict.fromkeys(COUNTERS, 0)
        for seen, names in self._seen:
            values = seen.get
            for n in names:
                out[n] += int(values.get(n) or 0)
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.totals().items()), "metric string, value long")
