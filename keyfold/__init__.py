"""keyfold: keyed request de-duplication, batching and status jobs on Spark.

Every job is a DataFrame transformation (windows, aggregates, joins) so it runs
the same on bounded tables and, through ``foreachBatch``, on streams.

    from keyfold import dedupe_requests, batch_requests, update_status
"""

__version__ = "0.1.0"

from .operators.allowlist import membership as allowlist_membership, replay as allowlist_replay  # noqa: E402
from .operators.backfill import incremental_backfill, poll, sent_prefix_checkpoint  # noqa: E402
from .operators.batching import batch_requests  # noqa: E402
from .operators.capacity import capacity_plan, job_requests, latest_job_state  # noqa: E402
from .operators.deadletter import classify_dead_letters, redrive_split  # noqa: E402
from .operators.dedupe import dedupe_requests  # noqa: E402
from .operators.status import status_fold, update_status  # noqa: E402
from .options import BatchOptions, CapacityOptions, PollOptions  # noqa: E402
from .sources.messages import parse_requests, parse_status  # noqa: E402

__all__ = [
    "allowlist_membership", "allowlist_replay", "batch_requests", "capacity_plan", "classify_dead_letters",
    "dedupe_requests", "incremental_backfill", "job_requests", "latest_job_state", "parse_requests",
    "parse_status", "poll", "redrive_split", "sent_prefix_checkpoint", "status_fold", "update_status",
    "BatchOptions", "CapacityOptions", "PollOptions",
]
