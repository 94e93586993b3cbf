"""Connected components of a link table, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. ``edges``: (u, v), u != v. Every node points its larger
    (large) or smaller (small) neighbours, and itself, at its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least("c", "m"))
    joined = both.join(least, both["u"] == least["c"])
    if large:
        out = joined.filter(F.col("v") > F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.col("v"), F.col("c"))).alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; root: the least node of
    its component. ``edges``: columns u and v of one orderable type.

    Large-star and small-star steps alternate until the edges are stars; the
    rounds grow with the logarithm of the component sizes.
    """
    now = stage(edges.filter("u <> v").distinct(), "cc-edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        now = stage(_star(_star(now, True), False), "cc-star")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
