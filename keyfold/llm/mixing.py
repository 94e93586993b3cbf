"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within each source. A source's target is
met by whole passes over it plus a subset whose lengths add up to the rest:
every length first gives its proportional share, and a bounded-knapsack dynamic
programme picks the counts for what the rounding left. Which documents of a
length are taken follows a seeded hash, so reruns agree.

The knapsack runs per source over (length, count) pairs, never over documents.
The hash threshold of a length's selection is found in two steps (hash chunks,
then the rows of one chunk), so a length that a third of all rows share is not
one task.

Defined cases: null text has length 0; null sources form the last source;
documents of length 0 get the whole passes only; equal rows are interchangeable;
an empty table gives no rows; other columns are untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import chunk_of, n_chunks, null_safe, prefix_sums, stage

#: Fixed value: a word is a run of anything but space and the ASCII controls tab to carriage return.
WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2.0
SEED = 17
#: Residual budget that the dynamic programme solves exactly, at least.
DP_BUDGET = 4096
#: Rows of a plan that may be broadcast (about 40 bytes each).
BROADCAST_ROWS = 500_000


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """Targets of (source, source_size): sources in code point order, null
    last, get the weights in turn; a target stops at ``ceiling`` times its
    source and the excess is shared again by weight.

    That is a water level: sources are ranked by ceiling over weight, those
    below the level are full, the others get level times weight. One row a
    source passes through the two windows, never a document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (n + 1).cast("int"))
    df = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    below = level.rowsBetween(Window.unboundedPreceding, -1)
    rest = level.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    df = (df.withColumn("left", total - F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
          .withColumn("open_weight", F.sum("weight").over(rest))
          .withColumn("full", F.col("cap") / F.col("weight") <= F.col("left") / F.col("open_weight")))
    df = df.withColumn("rate", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"),
                                                                       F.col("left") / F.col("open_weight")))).over(every)["col2"])
    target = F.when(F.col("full") | F.col("rate").isNull(), F.col("cap")).otherwise(F.col("rate") * F.col("weight"))
    return df.select("source", "source_size", F.least(target, F.col("cap")).alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that the lengths add up
    to ``budget`` or the nearest reachable sum below it.

    Proportional shares first; then the longest lengths that still fit, until
    the residual is small; then an exact bounded-knapsack programme over the
    residual: bitsets of reachable sums, copies split into powers of two.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total <= 0:
        return taken
    if budget >= total:
        return counts.copy()
    taken = (counts.astype(object) * budget // total).astype(np.int64)
    left = budget - int((lengths * taken).sum())
    order = np.argsort(-lengths, kind="stable")
    small = max(DP_BUDGET, 2 * int(np.median(np.repeat(lengths, np.minimum(counts, 50)))))
    for i in order:
        if left <= small:
            break
        size = int(lengths[i])
        if size <= 0:
            break
        more = min(int(counts[i] - taken[i]), (left - small) // size)
        if more > 0:
            taken[i] += more
            left -= more * size
    items: list[tuple[int, int, int]] = []
    for i in order[::-1]:
        size, free = int(lengths[i]), int(counts[i] - taken[i])
        if size <= 0 or size > left:
            continue
        free, k = min(free, left // size), 1
        while free > 0:
            k = min(k, free)
            items.append((int(i), k, k * size))
            free -= k
            k *= 2
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for item in items:
        steps.append(reach)
        reach |= (reach << item[2]) & mask
        if reach >> left & 1:
            items = items[:len(steps)]
            break
    at = reach.bit_length() - 1
    for item, before in zip(reversed(items[:len(steps)]), reversed(steps)):
        if not before >> at & 1:
            taken[item[0]] += item[1]
            at -= item[2]
    return taken


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = int(target // size) if size else 0
    budget = int(round(target - passes * size))
    n = pdf["n"].to_numpy()
    taken = fit_counts(pdf["size"].to_numpy(), n, budget)
    return pdf.assign(passes=passes, extra=taken)


def _unit(h: Column) -> Column:
    """A 64-bit hash as a number in [0, 1), in the order of the hash."""
    return h.cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumns({
        "__size": F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long"),
        "__h": F.xxhash64("doc_id", F.crc32("text"), F.lit(seed))})


def plan_mix(measured: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """Per (source, size): passes, and of the next pass every document whose
    hash is below ``threshold`` plus ``ties`` of those that equal it (``tied``
    of them exist). ``measured``: staged (source, size, h)."""
    hist = stage(measured.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    per_source = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    goal = targets(per_source, weights, share, ceiling)
    goal = goal.select(F.col("source").alias("s"), "source_size", "target")
    sized = hist.join(goal, hist["source"].eqNullSafe(goal["s"])).drop("s")
    plan = sized.groupBy("source").applyInPandas(
        _fit_source, "source string, size long, n long, source_size long, target double, passes int, extra long")
    plan = stage(plan, "mix-plan")
    partial = plan.filter("extra > 0 AND extra < n").select(
        F.col("source").alias("s"), F.col("size").alias("z"), "n", "extra")
    rows = measured.join(_small(partial), null_safe(measured, partial, [("source", "s"), ("size", "z")])).drop("s", "z")
    rows = rows.withColumn("chunk", F.floor(_unit(F.col("h")) * n_chunks(F.col("n"))))
    rows = stage(rows, "mix-partial")
    chunks = rows.groupBy("source", "size", "chunk").agg(F.count(F.lit(1)).alias("m"), F.max("extra").alias("extra"))
    upto = Window.partitionBy("source", "size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    edge = (chunks.withColumn("upto", F.sum("m").over(upto))
            .filter("upto >= extra AND upto - m < extra")
            .select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("chunk").alias("c"),
                    (F.col("extra") - (F.col("upto") - F.col("m"))).alias("need")))
    last = rows.join(_small(edge), null_safe(rows, edge, [("source", "s"), ("size", "z"), ("chunk", "c")]))
    hashes = last.groupBy("source", "size", "h").agg(F.count(F.lit(1)).alias("tied"), F.max("need").alias("need"))
    by_hash = Window.partitionBy("source", "size").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    cut = (hashes.withColumn("upto", F.sum("tied").over(by_hash))
           .filter("upto >= need AND upto - tied < need")
           .select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("h").alias("threshold"),
                   (F.col("need") - (F.col("upto") - F.col("tied"))).alias("ties"), "tied"))
    full = plan.join(cut, null_safe(plan, cut, [("source", "s"), ("size", "z")]), "left").drop("s", "z")
    return stage(full, "mix-thresholds")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast behind a check of the row count; else Spark's own choice."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: int = SEED) -> DataFrame:
    """The documents' columns with __size, __source_size, __target and
    __copies (how often the mix takes the document: 0, 1 or 2)."""
    measured = _measured(docs, seed)
    small = stage(measured.select("source", F.col("__size").alias("size"), F.col("__h").alias("h")), "mix-measured")
    plan = plan_mix(small, weights, share, ceiling).select(
        F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"), F.col("passes").alias("__passes"),
        F.col("extra").alias("__extra"), F.col("n").alias("__n"), F.col("threshold").alias("__threshold"),
        F.col("ties").alias("__ties"), F.col("tied").alias("__tied"))
    joined = measured.join(_small(plan), null_safe(measured, plan, [("source", "__s"), ("__size", "__z")]))
    tie = F.col("__h") == F.col("__threshold")
    whole = F.when(F.col("__extra") == F.col("__n"), 1).when(F.col("__h") < F.col("__threshold"), 1).otherwise(0)
    split = F.coalesce(tie & (F.col("__ties") < F.col("__tied")), F.lit(False))
    sure = joined.filter(~split).withColumn("__copies", F.col("__passes") + F.when(tie, 1).otherwise(whole))
    keep = [*docs.columns, "__size", "__source_size", "__target", "__copies"]
    if plan.filter("__ties < __tied").isEmpty():
        return sure.select(*keep)
    # rows that are equal in id and text, of which only some are taken
    some = joined.filter(split).withColumns({"__row": F.monotonically_increasing_id(), "__one": F.lit(1)})
    some = stage(some.withColumn("__chunk", chunk_of(F.col("__row"), F.col("__tied"))), "mix-ties")
    some = prefix_sums(some, ["__s", "__z"], "__chunk", ["__row"], "__one", "__rank")
    some = some.withColumn("__copies", F.col("__passes") + (F.col("__rank") < F.col("__ties")).cast("int"))
    return sure.select(*keep).unionByName(some.select(*keep))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken."""
    return mix(docs, **options).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken."""
    out = mix(docs, **options).filter("__copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)
