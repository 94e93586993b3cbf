"""Skew-safe keyed prefix scans.

A plain ``Window.partitionBy(key).orderBy(seq)`` puts every row of a key into
one task, so a key holding a third of the data becomes one third of the job in
one task. The scans here always work in *chunks*:

1. The rows are range-partitioned on (key, order). A range partition holds about
   rows / partitions rows whatever the keys and however sparse or dense the order
   column is, and a key's rows lie in consecutive partitions. The partition number
   is the chunk.
2. The numbered rows are written once to the shared folder, so both sides below
   see the same chunks, lineage is cut and a lost executor costs a reread.
3. Each (key, chunk) is aggregated (partial + final), the carry of a key's earlier
   chunks is a window over that small table (at most one row a chunk and key),
   and the rows' own window runs inside (key, chunk).

Every operator is associative (max, sum), so the result equals the single window
over the whole key. There is no other plan for small inputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

CHUNK = "_kf_chunk"
_CARRY, _VALUE, _PART, _TOTAL = "_kf_carry", "_kf_v", "_kf_part", "_kf_total"


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``df`` with its chunk numbers, materialised. Chunks follow (keys,
    order); ``order`` must be total within a key."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys, *order)
    return materialise(dealt.withColumn(CHUNK, F.spark_partition_id()), "scan")


def _carried(d: DataFrame, keys: list[str], partial: Column, before: Column, total: Column) -> DataFrame:
    """Rows of a chunked table with the aggregate of the key's earlier chunks
    (and of all its chunks) beside them."""
    sums = d.groupBy(*keys, CHUNK).agg(partial.alias(_PART))
    carry = sums.select(*[F.col(k).alias(f"_kf_k{i}") for i, k in enumerate(keys)], F.col(CHUNK).alias("_kf_c"),
                        before.alias(_CARRY), total.alias(_TOTAL))
    same = [d[k].eqNullSafe(carry[f"_kf_k{i}"]) for i, k in enumerate(keys)]
    on = d[CHUNK] == carry["_kf_c"]
    for cond in same:
        on = on & cond
    return d.join(carry, on, "left").drop("_kf_c", *[f"_kf_k{i}" for i in range(len(keys))])


def prefix_max_before(df: DataFrame, keys: Sequence[str], seq: str, value: Column, out: str,
                      total_out: str | None = None) -> DataFrame:
    """``out`` = max(value) over rows of the same key with a smaller ``seq``
    (null when there is none); ``total_out`` (optional) = max(value) over the
    whole key, from the same chunk carries. ``seq`` must be unique within a key."""
    keys = list(keys)
    d = chunked(df.withColumn(_VALUE, value), keys, [seq])
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    d = _carried(d, keys, F.max(_VALUE),
                 F.max(_PART).over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)),
                 F.max(_PART).over(by_chunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    # greatest() skips nulls: no carry or no earlier row in the chunk
    d = d.withColumn(out, F.greatest(F.col(_CARRY), F.max(_VALUE).over(inside)))
    if total_out:
        d = d.withColumn(total_out, F.col(_TOTAL))
    return d.drop(_VALUE, CHUNK, _CARRY, _TOTAL)


def prefix_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
               inclusive: bool = True) -> DataFrame:
    """``out`` = sum(value) over rows of the same key that come before (or at,
    when ``inclusive``) each row in ``order`` (columns, total within a key)."""
    keys = list(keys)
    d = chunked(df.withColumn(_VALUE, value), keys, order)
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    d = _carried(d, keys, F.sum(_VALUE),
                 F.coalesce(F.sum(_PART).over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(None))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = F.coalesce(F.sum(_VALUE).over(inside), F.lit(0))
    return d.withColumn(out, F.col(_CARRY) + local).drop(_VALUE, CHUNK, _CARRY, _TOTAL)


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based row number within ``keys`` in ``order`` (a distributed row_number)."""
    return prefix_sum(df, keys, order, F.lit(1).cast("long"), out)
