"""J2 batch_requests: size / linger / UTC-flush batching over a bounded table.

Rows ``(rid, ts[, arrival_seq])`` are taken in order of their arrival time
``ts``; rows that arrive at one time follow ``arrival_seq`` (``rid`` where
there is none). A batch closes when it holds ``size`` rows, when ``linger``
has passed since its first member, or at the UTC flush boundary (H1).

* linger >= flush interval (the defaults): the boundary always fires first,
  so batch = ``(window, (rn - 1) div size)`` (E8) with ``rn`` a distributed
  row number (operators/scan.py): no window ever sits in one task.
* linger < flush interval: greedy, first-member-relative chain. For every
  row ``next(i) = min(rn_i + size, 1 + #rows with ts < ts_i + linger)``;
  batch starts are the orbit of row 1 under ``next``. ``#rows with ts < t``
  is a prefix count over rows and probes; the orbit comes from pointer
  doubling over the rows whose batch closes on linger (see
  ``_linger_batch_numbers``), each round written to the shared folder so
  lineage stays short and a lost executor costs a reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ids import batch_key, deterministic_batch_id
from ..functions.timecols import (epoch_micros, flush_boundary_micros,
                                  flush_window, micros_of, ntz_from_micros)
from ..options import BatchOptions
from ..session import materialise
from .scan import ordinal, prefix_sum

ORDER = "_ord"


def arrival_order(rows: DataFrame) -> str:
    """The column that orders rows of one arrival time."""
    return "arrival_seq" if "arrival_seq" in rows.columns else "rid"


def _prepared(rows: DataFrame, opts: BatchOptions) -> DataFrame:
    us = epoch_micros("ts", rows.schema["ts"].dataType)
    return (rows.withColumn("_us", us).withColumn(ORDER, F.col(arrival_order(rows)))
            .withColumn("flush_window", flush_window(F.col("_us"), opts.flush)))


def batch_ordinal(rows: DataFrame, opts: BatchOptions) -> DataFrame:
    """``rn`` within the flush window and, in the closed form, ``batch_no``."""
    d = ordinal(_prepared(rows, opts), ["flush_window"], ["_us", ORDER], "rn")
    return d.withColumn("batch_no", F.floor((F.col("rn") - 1) / F.lit(opts.size)).cast("long"))


def _linger_limits(d: DataFrame, opts: BatchOptions) -> DataFrame:
    """``lim(i) = 1 + #rows with ts < ts_i + linger`` per row of a window: a
    prefix count over rows and probes (probes sort before rows of equal
    time, so the inclusive count at a probe counts strictly earlier rows)."""
    lin = micros_of(opts.linger)
    data = d.select("flush_window", "_us", "rn", F.lit(1).alias("_is_row"))
    probes = d.select("flush_window", (F.col("_us") + F.lit(lin)).alias("_us"), "rn", F.lit(0).alias("_is_row"))
    counted = prefix_sum(data.unionByName(probes), ["flush_window"], ["_us", "_is_row", "rn"],
                         F.col("_is_row").cast("long"), "_lt")
    return (counted.filter(F.col("_is_row") == 0)
            .select("flush_window", F.col("rn").alias("i"), (F.col("_lt") + 1).alias("lim")))


def _orbit(ptr: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes reachable from ``start(flush_window, i)`` under ``ptr(flush_window, i, j)``,
    by pointer doubling; pointers past the last node are absent and end the walk.
    A round squares the pointers and adds what they reach; it stops when no
    pointer is left that leads anywhere."""
    reach, jump = start.select("flush_window", "i"), ptr
    while not jump.isEmpty():
        step = reach.join(jump, ["flush_window", "i"]).select("flush_window", F.col("j").alias("i"))
        reach = materialise(reach.unionByName(step).distinct(), "orbit")
        further = jump.select("flush_window", F.col("i").alias("j"), F.col("j").alias("j2"))
        jump = materialise(jump.join(further, ["flush_window", "j"])
                           .select("flush_window", "i", F.col("j2").alias("j")), "jump")
    return reach


def _linger_batch_numbers(d: DataFrame, opts: BatchOptions) -> DataFrame:
    """Greedy linger batching of ``d(flush_window, rn, _us, ...)``: adds ``batch_no``.

    Batch starts are the orbit of row 1 under ``next(i) = min(i + size,
    lim(i))``. A node is *dense* when ``lim(i) >= i + size``: its batch
    fills up and the next start is ``i + size``. From any start the chain
    therefore walks its residue class (mod size) until the first non-dense
    node ``jmp``, whose batch closes on linger and the next start is
    ``lim``. Every chain segment ``[v, jmp(v)]`` holds the starts ``v, v +
    size, ...`` and a row's batch number is arithmetic on its segment.

    What the configuration bounds, whatever the data: a non-dense node has
    fewer than ``size`` rows in its own linger interval, so a linger-long span
    holds at most ``size`` of them, about one a residue class; and a chain
    passes at most ``flush / linger`` of them, as each closes a batch that
    lasted for ``linger``. So the windows below run over (window, residue
    class) or over a window's segments, and the doubling takes log2(flush /
    linger) rounds over non-dense nodes only."""
    size = F.lit(opts.size)
    nw = d.groupBy("flush_window").agg(F.count(F.lit(1)).alias("_n"))
    limits = materialise(_linger_limits(d, opts), "limits")
    sparse = limits.filter(F.col("lim") < F.col("i") + size)
    # jmp(v) for the places where a chain segment may start: row 1 and every lim
    asks = sparse.select("flush_window", F.col("lim").alias("v")).unionByName(
        nw.select("flush_window", F.lit(1).cast("long").alias("v"))).distinct()
    points = (sparse.select("flush_window", F.col("i").alias("at"), F.col("i").alias("node"))
              .unionByName(asks.select("flush_window", F.col("v").alias("at"), F.lit(None).cast("long").alias("node"))))
    later = (Window.partitionBy("flush_window", "_res").orderBy(F.desc("at"), F.desc_nulls_last("node"))
             .rowsBetween(Window.unboundedPreceding, 0))
    first = (points.withColumn("_res", F.pmod(F.col("at") - 1, size)).withColumn("jmp", F.min("node").over(later))
             .filter(F.col("node").isNull()).select("flush_window", F.col("at").alias("v"), "jmp"))
    first = materialise(first, "segment-ends")
    hops = sparse.join(first.withColumnRenamed("v", "lim"), ["flush_window", "lim"])
    graph = materialise(hops.filter(F.col("jmp").isNotNull()).select("flush_window", "i", F.col("jmp").alias("j")), "graph")
    start = first.filter((F.col("v") == 1) & F.col("jmp").isNotNull()).select("flush_window", F.col("jmp").alias("i"))
    reached = _orbit(graph, start)
    # segment starts: row 1, and lim(u) of every reached non-dense u
    follow = reached.join(sparse, ["flush_window", "i"]).select("flush_window", F.col("lim").alias("v"))
    segs = (nw.select("flush_window", F.lit(1).cast("long").alias("v")).unionByName(follow)
            .join(first, ["flush_window", "v"]).join(nw, "flush_window").filter(F.col("v") <= F.col("_n")))
    n_starts = (F.floor((F.coalesce("jmp", "_n") - F.col("v")) / size) + 1).cast("long")
    earlier = Window.partitionBy("flush_window").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    segs = segs.withColumn("_before", F.coalesce(F.sum(n_starts).over(earlier), F.lit(0)))
    segs = segs.groupBy("flush_window").agg(F.sort_array(F.collect_list(F.struct("v", "_before"))).alias("_segs"))
    own = F.element_at(F.filter("_segs", lambda x: x["v"] <= F.col("rn")), -1)
    return (d.drop("batch_no").join(segs, "flush_window").withColumn("_own", own)
            .withColumn("batch_no", (F.col("_own._before") + F.floor((F.col("rn") - F.col("_own.v")) / size)).cast("long"))
            .drop("_segs", "_own"))


def assign_batches(rows: DataFrame, opts: BatchOptions) -> DataFrame:
    """Rows (``rid, ts`` + any) with ``flush_window, rn, batch_no`` added."""
    d = batch_ordinal(rows, opts)
    if opts.linger < opts.flush:
        d = _linger_batch_numbers(materialise(d, "ordinals"), opts)
    return d.drop("_us", ORDER)


def collect_batches(assigned: DataFrame, opts: BatchOptions) -> DataFrame:
    """D4 collect_batch_members + close reason + H6 id/key, one row per batch.

    A batch holds at most ``size`` members, so ``collect_list`` is bounded."""
    lin, size = micros_of(opts.linger), opts.size
    us = epoch_micros("ts", assigned.schema["ts"].dataType)
    g = (assigned.withColumn("_us", us)
         .groupBy("flush_window", "batch_no")
         .agg(F.count(F.lit(1)).alias("n"), F.min("_us").alias("_first_us"),
              F.sort_array(F.collect_list(F.struct("rn", "rid"))).alias("_m")))
    boundary = flush_boundary_micros(F.col("flush_window"), opts.flush)
    reason = (F.when(F.col("n") >= F.lit(size), "full")
              .when(F.col("_first_us") + F.lit(lin) < boundary, "linger")
              .otherwise("flush"))
    rids = F.transform("_m", lambda m: m["rid"])
    return (g.withColumn("rids", rids)
            .withColumn("bid", deterministic_batch_id(F.col("flush_window"), F.col("batch_no"),
                                                      F.col("rids")[0]))
            .select("bid", batch_key(F.col("bid")).alias("batch_key"), "flush_window", "batch_no",
                    "n", "rids", reason.alias("reason"),
                    ntz_from_micros(F.col("_first_us")).alias("first_ts"),
                    ntz_from_micros(boundary).alias("boundary")))


def batch_requests(rows: DataFrame, opts: BatchOptions) -> DataFrame:
    """Batches of ``rows`` (``rid, ts``), one row per batch."""
    return collect_batches(assign_batches(rows, opts), opts)


#: Upper ends of the size classes of the distribution, as shares of ``size``.
SIZE_CLASSES = (0.25, 0.5, 0.75, 1.0)


def size_distribution(batches: DataFrame, size: int, classes: tuple[float, ...] = SIZE_CLASSES) -> DataFrame:
    """D3: the distribution of batch sizes (the service records one sample per
    batch): samples per class with its upper end, and least, greatest, mean
    and median size within it. One partial + final aggregate."""
    bounds = [max(1, int(size * c)) for c in classes]
    upper = F.lit(None).cast("long")
    for b in sorted(bounds, reverse=True):
        upper = F.when(F.col("n") <= b, F.lit(b).cast("long")).otherwise(upper)
    return batches.groupBy(upper.alias("size_upto")).agg(
        F.count(F.lit(1)).alias("n_batches"), F.sum("n").alias("n_requests"), F.min("n").alias("min_size"),
        F.max("n").alias("max_size"), F.avg("n").alias("avg_size"), F.median("n").alias("median_size"))


#: Size of a quantile sketch: ranks are right within about 2.3 / k ** 0.9 (0.25 %
#: for 2,048) with a probability of 99 %, and a sketch holds some 3 k values at most.
SKETCH_K = 2048
#: A bound on the rank error at that size, four times the above.
RANK_ERROR = 0.01


def size_sketches(batches: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """D3 to keep: a row a flush window, with the batch sizes as a KLL sketch that
    merges with those of other windows. A window is sketched by partial and final
    aggregates, so no task holds its values."""
    return batches.groupBy("flush_window").agg(
        F.count(F.lit(1)).alias("n_batches"), F.sum("n").alias("n_requests"), F.min("n").alias("min_size"),
        F.max("n").alias("max_size"), F.kll_sketch_agg_bigint("n", k).alias("sketch"))


def merged_sizes(sketches: DataFrame, *by: Column, probabilities: tuple[float, ...] = (0.5, 0.9, 0.99), k: int = SKETCH_K) -> DataFrame:
    """The distribution over windows (all, or grouped ``by``), from their stored
    sketches alone: ``n_batches, n_requests, min_size, max_size`` exact, and a
    column ``p50`` and so on a probability, within the sketch's rank error (null
    where there are no batches)."""
    g = sketches.groupBy(*by).agg(
        F.sum("n_batches").alias("n_batches"), F.sum("n_requests").alias("n_requests"), F.min("min_size").alias("min_size"),
        F.max("max_size").alias("max_size"), F.kll_merge_agg_bigint("sketch", k).alias("_sketch"))
    named = [F.when(F.col("n_batches") > 0, F.kll_sketch_get_quantile_bigint("_sketch", F.lit(p))).alias(f"p{p * 100:g}".replace(".", "_")) for p in probabilities]
    return g.select("*", *named).drop("_sketch")
