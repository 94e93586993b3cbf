"""J8 allowlist_audit: replay an allow-list contract's call log.

Calls ``(seq, caller, kind, target)`` with kind in add / remove / anchor.
The owner may add and remove anyone; an address on the list may remove
itself; anchoring needs the owner or a listed caller. The state of address
``a`` before a call is the last membership effect on ``a``: owner add ->
true, owner or self remove -> false (a self-removal of an absent address
changes nothing, so validity is not needed to fold state).

The as-of lookup is a keyed "last non-null before" = max of
``struct(seq, effect)`` over earlier rows of the address: the chunked
prefix max of operators/scan.py, so a hot address is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scan import prefix_max_before

ADD, REMOVE, ANCHOR = "add", "remove", "anchor"
# fixed values: event names emitted by the contract
EVENT_ADDED, EVENT_REMOVED, EVENT_ANCHOR = "DidAddCas", "DidRemoveCas", "DidAnchor"


def _with_effect(calls: DataFrame, owner: str) -> DataFrame:
    kind, caller, target = F.col("kind"), F.col("caller"), F.col("target")
    addr = F.when(kind == ANCHOR, caller).otherwise(target)
    effect = (F.when((kind == ADD) & (caller == F.lit(owner)), F.lit(True))
              .when((kind == REMOVE) & ((caller == F.lit(owner)) | (caller == target)), F.lit(False)))
    return calls.withColumn("addr", addr).withColumn("effect", effect)


def replay(calls: DataFrame, owner: str) -> DataFrame:
    """C4 anchor_authorised_asof + validity of every call."""
    d = _with_effect(calls, owner)
    mark = F.when(F.col("effect").isNotNull(), F.struct(F.col("seq").alias("s"), F.col("effect").alias("e")))
    d = prefix_max_before(d, ["addr"], "seq", mark, "_last")
    before = F.coalesce(F.col("_last.e"), F.lit(False))
    is_owner = F.col("caller") == F.lit(owner)
    valid = (F.when(F.col("kind") == ADD, is_owner)
             .when(F.col("kind") == REMOVE, is_owner | ((F.col("caller") == F.col("target")) & before))
             .otherwise(is_owner | before))
    return d.withColumn("listed_before", before).withColumn("valid", valid).drop("_last")


def membership(calls: DataFrame, owner: str) -> DataFrame:
    """Current list membership per address (last effect wins)."""
    d = _with_effect(calls, owner).filter(F.col("effect").isNotNull())
    return d.groupBy("addr").agg(F.max_by("effect", "seq").alias("allowed"))


def event_log(replayed: DataFrame) -> DataFrame:
    """The events the contract emits, one per valid call."""
    ev = (F.when(F.col("kind") == ADD, EVENT_ADDED).when(F.col("kind") == REMOVE, EVENT_REMOVED)
          .otherwise(EVENT_ANCHOR))
    return replayed.filter("valid").select("seq", ev.alias("event"), F.col("addr").alias("service"), "root")
