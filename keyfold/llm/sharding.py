"""Balanced label propagation: documents into shards of even size.

Documents that share a link key (by default: equal texts) are neighbours. A
document's label is its shard. The state is kept per (link key, shard) as a
count, so a key that holds a third of all rows is a handful of rows. Each round
moves members of a key towards the shard that already holds most of their
neighbours, as far as that shard's quota allows; at the end single documents
fill the shards up to exact quotas.

Law ``rows``: shard counts are at most one apart. Main path: DataFrame
functions only.

Defined cases: null text has size 16, crc 0, and null texts are one link group;
an empty table gives no rows; repeated rows each get their own place; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import chunk_of, prefix_sums, stage

LAW = "rows"
N_SHARDS = 40
#: Rounds go on until nothing wants to move. Each move raises the sum of squared
#: counts, so that happens; a run past this many rounds plus as many a shard stops with an error.
SAFE_ROUNDS = 20
#: While labels spread a shard may pass its quota by this share; what is over at
#: the end is evicted key by key.
SLACK = 0.1


def _lookup(values: list, index: Column, kind: str = "double") -> Column:
    """Element of a short literal array (one entry a shard)."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (index + 1).cast("int"))


def _totals(df: DataFrame, shard: str, value: str, n: int) -> list[int]:
    """Sum of ``value`` by shard: at most ``n`` rows, a parameter."""
    got = {r[0]: r[1] for r in df.groupBy(shard).agg(F.sum(value)).collect()}
    return [int(got.get(s, 0)) for s in range(n)]


def _u(*cols) -> Column:
    """Hash in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def propagate(entries: DataFrame, quota: list[int], rounds: int | None = None) -> DataFrame:
    """Rounds of label propagation over (key, shard, n) under shard quotas.

    In a round every key picks homes among the shards below their quota: the one that
    holds most of its members, and the next ones as long as those before have no
    room for all that may move (a key that holds a third of all rows fills several
    shards at once). Members in other shards that hold no more than a home move
    there. Shard t admits min(1, (room + outflow) / demand) of what wants in, by
    hash. Ends when nothing wants to move; more than ``rounds`` rounds (by default a
    bound that grows with the shards and is far above what keys need) are an
    error, never a cut.
    """
    n_shards = len(quota)
    rounds = SAFE_ROUNDS * (1 + n_shards) if rounds is None else rounds
    room = [q + math.ceil(q * SLACK) for q in quota]
    for r in range(rounds + 1):
        load = _totals(entries, "shard", "n", n_shards)
        is_open = _lookup([int(load[s] < quota[s]) for s in range(n_shards)], F.col("shard"), "int") == 1
        free = F.when(F.col("open"), _lookup([max(1, room[s] - load[s]) for s in range(n_shards)], F.col("shard"), "long")).otherwise(0)
        # of shards that hold as many, a key takes one by hash
        of_key, rank = Window.partitionBy("key"), F.struct("n", "tie", "shard")
        before = of_key.orderBy(F.desc("open"), F.desc(rank)).rowsBetween(Window.unboundedPreceding, -1)
        total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
        ranked = (entries.withColumn("open", is_open).withColumn("tie", F.xxhash64("key", "shard")).withColumn("free", free)
                  .withColumn("best", F.max(F.when(F.col("open"), rank)).over(of_key))
                  .withColumn("may", F.coalesce(F.col("n") <= F.col("best.n"), F.lit(False)))
                  .withColumn("home", F.col("open") & (total(F.when(F.col("open"), F.col("free") + F.col("n")))
                                                       < F.sum(F.when(F.col("may"), F.col("n"))).over(of_key)))
                  .withColumn("move", F.col("may") & ~F.col("home"))
                  .withColumn("lo", total(F.when(F.col("home"), F.col("free"))))
                  .withColumn("at", total(F.when(F.col("move"), F.col("n"))))
                  .withColumn("homes", F.collect_list(F.when(F.col("home"), F.struct(
                      "lo", (F.col("lo") + F.col("free")).alias("hi"), "n", "shard"))).over(of_key)))
        fits = F.filter("homes", lambda h: (h["lo"] <= F.col("at")) & (F.col("at") < h["hi"]) & (F.col("n") <= h["n"]))
        target = F.coalesce(F.get(fits, F.lit(0))["shard"], F.col("best.shard"))
        wants = stage(ranked.select("key", "shard", "n", target.alias("target"), "move"), "lp-wants")
        moving = wants.filter("move")
        demand = _totals(moving, "target", "n", n_shards)
        if not sum(demand):
            return entries
        if r == rounds:
            break
        out = _totals(moving, "shard", "n", n_shards)
        admit = [min(1.0, max(0, room[s] - load[s] + out[s]) / demand[s]) if demand[s] else 0.0 for s in range(n_shards)]
        moved = F.when(F.col("move"), F.floor(F.col("n") * _lookup(admit, F.col("target"))
                                              + _u(F.col("key"), F.col("shard"), F.lit(r)))).otherwise(F.lit(0))
        moved = F.least(moved.cast("long"), F.col("n"))
        steps = wants.withColumn("moved", moved).select("key", F.explode(F.array(
            F.struct(F.col("shard").alias("shard"), (F.col("n") - F.col("moved")).alias("n")),
            F.struct(F.coalesce("target", "shard").alias("shard"), F.col("moved").alias("n")))).alias("e"))
        entries = stage(steps.filter("e.n > 0").groupBy("key", F.col("e.shard").alias("shard"))
                        .agg(F.sum("e.n").alias("n")), "lp-entries")
    raise RuntimeError(f"labels still spread after {rounds} rounds: {sum(demand)} members want to move")


def _ranges(sizes: list[int]) -> list[tuple[int, int, int]]:
    """(shard, first position, end) of consecutive ranges."""
    out, at = [], 0
    for s, n in enumerate(sizes):
        if n > 0:
            out.append((s, at, at + n))
            at += n
    return out


def _range_array(ranges: list[tuple[int, int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(s).cast("int").alias("shard"), F.lit(a).cast("long").alias("lo"),
                              F.lit(b).cast("long").alias("hi")) for s, a, b in ranges])


def _settle(entries: DataFrame, quota: list[int]) -> tuple[DataFrame, list[int], int]:
    """Entries within the quotas; what each shard still lacks; how much of
    that the evicted members take (from the first lacking place on)."""
    n_shards = len(quota)
    load = _totals(entries, "shard", "n", n_shards)
    lack = [max(0, quota[s] - load[s]) for s in range(n_shards)]
    if all(load[s] <= quota[s] for s in range(n_shards)):
        return entries, lack, 0
    total = entries.count()
    placed = prefix_sums(stage(entries.withColumn("chunk", chunk_of(F.col("key"), total)), "lp-full"),
                         ["shard"], "chunk", ["key"], "n", "before")
    keep = F.least(F.col("n"), F.greatest(_lookup(quota, F.col("shard"), "long") - F.col("before"), F.lit(0)))
    cut = stage(placed.withColumn("keep", keep), "lp-cut")
    pool = cut.select("key", (F.col("n") - F.col("keep")).alias("n")).filter("n > 0").groupBy("key").agg(F.sum("n").alias("n"))
    pool = stage(pool.withColumn("chunk", chunk_of(F.col("key"), total)).withColumn("all", F.lit(0)), "lp-pool")
    evicted = pool.agg(F.sum("n")).first()[0] or 0
    at = prefix_sums(pool, ["all"], "chunk", ["key"], "n", "at")
    overlap = F.least(F.col("r.hi"), F.col("at") + F.col("n")) - F.greatest(F.col("r.lo"), F.col("at"))
    dealt = (at.withColumn("r", F.explode(_range_array(_ranges(lack))))
             .select("key", F.col("r.shard").alias("shard"), overlap.alias("n")).filter("n > 0"))
    kept = cut.select("key", "shard", F.col("keep").alias("n")).filter("n > 0")
    settled = kept.unionByName(dealt).groupBy("key", "shard").agg(F.sum("n").alias("n"))
    return stage(settled, "lp-settled"), lack, evicted


def shard_rows(rows: DataFrame, n_shards: int = N_SHARDS, rounds: int | None = None) -> DataFrame:
    """Shard and slot of every row of a staged table with ``row_id`` (unique)
    and ``key`` (link key): adds ``shard`` and ``slot``."""
    n_rows = rows.count()
    quota = [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]
    first = F.pmod(F.xxhash64("row_id"), F.lit(n_shards)).cast("int")
    counts = rows.groupBy("key", first.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    linked = counts.withColumn("all", F.sum("n").over(Window.partitionBy("key"))).filter("all > 1").drop("all")
    entries = propagate(stage(linked, "lp-start"), quota, rounds)
    entries, lack, evicted = _settle(entries, quota)
    order = Window.partitionBy("key").orderBy("shard")
    ends = entries.withColumn("hi", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    plan = ends.groupBy(F.col("key").alias("k")).agg(
        F.collect_list(F.struct("shard", (F.col("hi") - F.col("n")).alias("lo"), "hi")).alias("ranges"),
        F.sum("n").alias("members"))
    joined = rows.join(plan, rows["key"].eqNullSafe(plan["k"]), "left").drop("k")
    single = F.col("members").isNull()
    free = sum(lack) - evicted
    joined = (joined.withColumn("part", F.when(single, F.lit(None)).otherwise(F.col("key")))
              .withColumn("chunk", chunk_of(F.col("row_id"), F.coalesce("members", F.lit(max(free, 1)))))
              .withColumn("one", F.lit(1)).drop("key", "members"))
    placed = prefix_sums(stage(joined, "lp-rows"), ["part"], "chunk", ["row_id"], "one", "rank")
    lacking = _ranges(lack)
    ranges = F.coalesce("ranges", _range_array(lacking) if lacking else F.array().cast("array<struct<shard:int,lo:bigint,hi:bigint>>"))
    place = F.when(F.col("part").isNull(), F.col("rank") + evicted).otherwise(F.col("rank"))
    shard = F.filter(ranges, lambda x: (x["lo"] <= F.col("place")) & (F.col("place") < x["hi"]))[0]["shard"]
    out = placed.withColumn("place", place).withColumn("shard", shard).drop("ranges", "part", "rank", "place", "chunk")
    out = stage(out.withColumn("chunk", chunk_of(F.col("row_id"), max(quota + [1]))), "lp-shards")
    return prefix_sums(out, ["shard"], "chunk", ["row_id"], "one", "slot").drop("chunk", "one")


def with_row_id(docs: DataFrame, name: str) -> DataFrame:
    """A staged copy with ``row_id``; written once, so the ids stay."""
    return stage(docs.withColumn("row_id", F.monotonically_increasing_id()), name)


def text_key(text: Column) -> Column:
    """Link key of equal texts; null texts share a key that no digest equals."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the link key of every row."""
    return docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        text_key(F.col("text")).alias("key"))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, rounds: int | None = None) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    out = shard_rows(with_row_id(sized(docs), "shard-rows"), n_shards, rounds)
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def shard_stage(docs: DataFrame, n_shards: int = N_SHARDS, rounds: int | None = None) -> DataFrame:
    """All columns of the documents with shard_no and shard_slot (whole texts
    stay with their row: the row number is staged with them)."""
    numbered = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "shard-docs")
    keyed = numbered.select(F.col("__row").alias("row_id"), text_key(F.col("text")).alias("key"))
    out = shard_rows(stage(keyed, "shard-keys"), n_shards, rounds).select(
        F.col("row_id").alias("__at"), F.col("shard").alias("shard_no"), F.col("slot").alias("shard_slot"))
    joined = numbered.join(out, numbered["__row"] == out["__at"]).drop("__row", "__at")
    return joined
