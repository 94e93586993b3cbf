"""Helpers shared by the operators: staged tables and skew-safe prefix sums."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import conf_override, scratch_path

#: Rows of an Arrow batch that carries whole texts to Python.
TEXT_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: Bytes of a slice whose rows become Python objects at once.
SLICE_BYTES = 2 << 20
#: Groups that may be broadcast, at most; in small tables groups of up to SMALL rows are not.
HOT_GROUPS, SMALL = 10_000, 64


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the cluster's shared folder and read it
    back: lineage is cut and a lost executor costs a reread, not a rerun."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    with conf_override(spark, TEXT_BATCH):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Equality of column pairs under which nulls are equal."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, n_rows: int) -> DataFrame:
    """Left join of ``rows`` to ``groups``, one row a group with ``size``, the
    number of its members among the ``n_rows`` rows (dropped from the result).

    Groups over a ten-thousandth of the rows, of which there are at most
    HOT_GROUPS, are broadcast, so their members stay where they are; the others
    are joined by a shuffle. ``rows`` is read twice, so pass a staged table."""
    limit = max(SMALL, -(-n_rows // HOT_GROUPS))
    named = groups.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    pairs = [(k, f"__{k}") for k in keys]
    hot, cold = F.broadcast(named.filter(F.col(size) > limit)), named.filter(F.col(size) <= limit)
    rest = rows.join(hot.select(*[k for _, k in pairs]), null_safe(rows, hot, pairs), "left_anti")
    met = rows.join(hot, null_safe(rows, hot, pairs)).unionByName(rest.join(cold, null_safe(rest, cold, pairs), "left"))
    return met.drop(size, *[k for _, k in pairs])


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of a text column, one row
    at least, so a worker holds few texts as Python objects."""
    for b in batches:
        sizes = pc.binary_length(b.column(column)).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            held += n or 0
            if held >= size:
                yield b.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < len(sizes):
            yield b.slice(start)


def n_chunks(n_rows: Column | int) -> Column:
    """Chunks that a group of ``n_rows`` rows is cut into: so many that the
    rows of a chunk and the chunks of a group both grow with the square root."""
    n = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    return F.greatest(F.ceil(F.sqrt(n) / 4).cast("long"), F.lit(1).cast("long"))


def chunk_of(seed: Column, n_rows: Column | int) -> Column:
    """Chunk number of a row of a group of ``n_rows`` rows, dealt by hash."""
    return F.pmod(F.xxhash64(seed, F.lit("chunk")), n_chunks(n_rows))


def prefix_sums(df: DataFrame, part: list[str], chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows that come before
    in the row's ``part``, in order of (``chunk``, ``order``).

    No task sees a whole part: chunks are summed with partial aggregates, the
    small table of chunk totals gives each chunk its offset, and a window runs
    inside (part, chunk) only. ``df`` is read twice, so pass a staged table.
    """
    keys = [*part, chunk]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(*part).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                          F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = rows.join(offsets, null_safe(rows, offsets, [(k, f"__k{i}") for i, k in enumerate(keys)]), "left")
    return joined.select(*[rows[c] for c in df.columns],
                         (F.col("__inside") + F.col("__offset")).cast("long").alias(out))
