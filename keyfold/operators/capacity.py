"""J7 capacity_plan: workers to add from backlog samples and job states.

H2 (per sample): required = max(unprocessed + inflight - existing, 0);
allowed = required when max_workers = -1, else max_workers - existing when
existing < max_workers, else 0; create = min(ceil(allowed * factor), required).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timecols import micros_of
from ..options import JOB_TTL, CapacityOptions

# fixed values: job stages, type and parameters written for a new worker job
STAGE_QUEUED, STAGE_STARTED, STAGE_COMPLETED, STAGE_FAILED = "queued", "started", "completed", "failed"
TERMINAL_STAGES = [STAGE_COMPLETED, STAGE_FAILED]
JOB_TYPE_ANCHOR = "anchor"
WORKER_VERSION = "5"
APP_MODE_CONTINUAL = "continual-anchoring"


def capacity_plan(unprocessed: Column, inflight: Column, existing: Column,
                  opts: CapacityOptions) -> dict[str, Column]:
    """H2 as columns: ``required``, ``allowed``, ``create``."""
    required = F.greatest(unprocessed + inflight - existing, F.lit(0))
    if opts.max_workers == -1:
        allowed = required
    else:
        allowed = F.when(existing < F.lit(opts.max_workers), F.lit(opts.max_workers) - existing).otherwise(F.lit(0))
    create = F.least(F.ceil(allowed.cast("double") * F.lit(opts.amortization)).cast("long"), required.cast("long"))
    return {"required": required.cast("long"), "allowed": allowed.cast("long"), "create": create}


# fixed values: the pipeline's queues
QUEUES = ["validate", "ready", "batch", "status", "failure", "dlq"]


def queue_utilisation(messages: DataFrame, sample_key: str) -> DataFrame:
    """(unprocessed, inflight) per sample and queue from a message-state
    table (``queue``; ``state`` in queued / inflight)."""
    return messages.groupBy(sample_key, "queue").agg(
        F.count_if(F.col("state") == "queued").alias("unprocessed"),
        F.count_if(F.col("state") == "inflight").alias("inflight"))


def latest_job_state(states: DataFrame) -> DataFrame:
    """E5: newest state per job (descending ts, then tie column ``tie``).
    ``max_by`` over a struct key is a partial + final hash aggregate."""
    best = F.max_by(F.struct("stage", "ts"), F.struct("ts", "tie")).alias("s")
    return states.groupBy("job").agg(best).select("job", "s.stage", "s.ts")


def missing_jobs(requested: DataFrame, latest: DataFrame) -> DataFrame:
    """Requested jobs (``job``) without any state: an error to the service."""
    return requested.join(latest, "job", "left_anti")


def existing_jobs(latest: DataFrame) -> DataFrame:
    """Non-terminal jobs (terminal = completed, failed)."""
    return latest.agg(F.count_if(~F.col("stage").isin(*TERMINAL_STAGES)).alias("existing_jobs"))


def job_requests(plans: DataFrame, key: str, now: Column, contract: str | None = None) -> DataFrame:
    """H3: one queued job row per job to create; ``sequence`` counts down for
    n = 0, so zero-create rows are filtered first."""
    overrides = [F.lit("APP_MODE"), F.lit(APP_MODE_CONTINUAL),
                 F.lit("SCHEDULER_STOP_AFTER_NO_OP"), F.lit("true")]
    if contract:
        overrides += [F.lit("ETH_CONTRACT_ADDRESS"), F.lit(contract)]
    params = F.to_json(F.struct(F.lit(WORKER_VERSION).alias("version"),
                                F.create_map(*overrides).alias("overrides")))
    return (plans.filter(F.col("create") > 0)
            .select(key, now.alias("ts"),
                    F.explode(F.sequence(F.lit(1), F.col("create").cast("int"))).alias("job_ordinal"))
            .select(key, "job_ordinal", F.lit(STAGE_QUEUED).alias("stage"), F.lit(JOB_TYPE_ANCHOR).alias("type"),
                    params.alias("params"), "ts",
                    F.timestamp_add("MICROSECOND", F.lit(micros_of(JOB_TTL)), F.col("ts")).alias("ttl")))
