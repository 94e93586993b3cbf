"""The chunked scans equal the plain keyed windows they replace."""

import random

import pytest
from pyspark.sql import Window, functions as F

from keyfold.operators.scan import CHUNK, chunked, ordinal, prefix_max_before, prefix_sum


def hot_key(rng, n):
    return [(("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 5)}"), seq, rng.randint(0, 50)) for seq in rng.sample(range(100 * n), n)]


def sparse_order(rng, n):
    """Nanosecond stamps: almost every order value far from the next."""
    return [(rng.choice(["a", "a", "b", None]), rng.randint(0, 10**18), rng.randint(0, 50)) for _ in range(n)]


def burst(rng, n):
    """One minute holds most rows of the one key, the rest lies days apart."""
    return [("k", rng.randint(0, 60_000_000) if i % 10 else i * 86_400_000_000, rng.randint(0, 9)) for i in range(n)]


@pytest.mark.parametrize("shape", [hot_key, sparse_order, burst])
def test_scans_equal_the_window(spark, shape):
    rows = {(k, s): (k, s, v) for k, s, v in shape(random.Random(1), 500)}.values()
    df = spark.createDataFrame(list(rows), "k string, seq long, v long")
    w = Window.partitionBy("k").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    plain = df.withColumn("m", F.max("v").over(before)).withColumn("t", F.max("v").over(Window.partitionBy("k")))
    key = lambda r: str(tuple(r))
    assert sorted(prefix_max_before(df, ["k"], "seq", F.col("v"), "m", total_out="t").collect(), key=key) == sorted(plain.collect(), key=key)
    incl = df.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(prefix_sum(df, ["k"], ["seq"], F.col("v"), "s").collect(), key=key) == sorted(incl.collect(), key=key)
    excl = df.withColumn("s", F.coalesce(F.sum("v").over(before), F.lit(0)))
    assert sorted(prefix_sum(df, ["k"], ["seq"], F.col("v"), "s", inclusive=False).collect(), key=key) == sorted(excl.collect(), key=key)
    rn = df.withColumn("rn", F.row_number().over(w).cast("long"))
    assert sorted(ordinal(df, ["k"], ["seq"], "rn").collect(), key=key) == sorted(rn.collect(), key=key)


@pytest.mark.parametrize("shape", [hot_key, sparse_order, burst])
def test_chunks_are_bounded_by_rows(spark, shape):
    """No chunk holds much more than its share, however the order column lies."""
    n = 4000
    df = spark.createDataFrame(shape(random.Random(2), n), "k string, seq long, v long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [r["count"] for r in chunked(df, ["k"], ["seq"]).groupBy(CHUNK).count().collect()]
    assert max(sizes) <= 3 * n / parts and sum(sizes) == n


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, seq long, v long")
    assert prefix_max_before(df, ["k"], "seq", F.col("v"), "m").count() == 0
    assert prefix_sum(df, ["k"], ["seq"], F.col("v"), "s").count() == 0
