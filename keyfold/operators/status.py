"""J3 apply_status: guarded status transitions folded into the request table.

Status values (fixed, as in the service): 0 PENDING, 1 PROCESSING,
2 COMPLETED, 3 FAILED, 4 READY, 5 REPLACED. A transition to REPLACED applies
only to a PENDING row; every other target applies unconditionally; events
for unknown ids are no-ops.

Closed form of the ordered fold (per id): let ``k`` be the order of the last
non-REPLACED event and ``u`` its status (the stored status when there is
none), and ``r`` the order of the last REPLACED event. The final status is
REPLACED iff ``u`` is PENDING and ``r > k``, else ``u``. Three filtered
aggregates, computed as one partial + final hash aggregate per id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: request status codes
PENDING, PROCESSING, COMPLETED, FAILED, READY, REPLACED = 0, 1, 2, 3, 4, 5
STATUS_NAMES = ["PENDING", "PROCESSING", "COMPLETED", "FAILED", "READY", "REPLACED"]


def transition_allowed(new_status: Column, current_status: Column) -> Column:
    """REPLACED only from PENDING; any other target unconditionally."""
    return F.when(new_status == F.lit(REPLACED), current_status == F.lit(PENDING)).otherwise(F.lit(True))


def fold_events(events: DataFrame) -> DataFrame:
    """Per id: ``last_set`` (status of the last non-REPLACED event), ``last_set_seq``,
    ``last_replaced_seq``. Input ``events(id, sts, seq)``."""
    is_rep = F.col("sts") == F.lit(REPLACED)
    return (events.groupBy("id").agg(
        F.max_by(F.when(~is_rep, F.col("sts")), F.when(~is_rep, F.col("seq"))).alias("last_set"),
        F.max(F.when(~is_rep, F.col("seq"))).alias("last_set_seq"),
        F.max(F.when(is_rep, F.col("seq"))).alias("last_replaced_seq"),
        F.count(F.lit(1)).alias("n_events")))


def final_status(initial: Column, folded_prefix: str = "") -> Column:
    p = folded_prefix
    u = F.coalesce(F.col(p + "last_set"), initial)
    k = F.coalesce(F.col(p + "last_set_seq"), F.lit(-1))
    r = F.col(p + "last_replaced_seq")
    return F.when((u == F.lit(PENDING)) & r.isNotNull() & (r > k), F.lit(REPLACED)).otherwise(u)


def status_fold(events: DataFrame, initial: DataFrame) -> DataFrame:
    """Final status per id of ``initial(id, status)`` after ``events(id, sts, seq)``."""
    folded = fold_events(events)
    return (initial.join(folded, "id", "left")
            .select("id", final_status(F.col("status")).cast("smallint").alias("status")))


def update_status(requests: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """The request table after the events; ``changed`` marks rows whose
    status really changed, and only those get ``updated_at = as_of``.

    ``requests(request_id, status, updated_at, ...)``, ``events(id, sts, seq)``.
    Events for ids absent from the table fall out of the left join."""
    folded = fold_events(events).withColumnRenamed("id", "request_id")
    j = requests.join(folded, "request_id", "left")
    new = final_status(F.col("status")).cast("smallint")
    changed = new != F.col("status")
    out = (j.withColumn("_new", new).withColumn("changed", changed)
           .withColumn("updated_at", F.when(F.col("changed"), as_of).otherwise(F.col("updated_at")))
           .withColumn("status", F.col("_new")))
    return out.drop("_new", "last_set", "last_set_seq", "last_replaced_seq", "n_events")
