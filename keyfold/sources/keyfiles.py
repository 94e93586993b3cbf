"""State files that answer point reads.

Rows are range-partitioned and sorted by a 64-bit hash of their key and lie in
folders by the hash's first bits, so a file, a row group and a page each cover a
narrow range of hashes; each row group also holds a Bloom filter of them. The
hashes of a batch's keys go to the scan as values: folders and statistics leave
the pages whose ranges hold one, and the Bloom filter drops most row groups that
hold none. At most a page or two a key is read, so reads grow with the batch and
not with the state. As the order is that of a hash, no key range is hot.

A batch may have at most MAX_KEYS distinct keys for that, which is counted; a
larger one reads the state by a join. Keys are compared themselves in both ways;
a null in a key equals null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import conf_override, materialise

HASH, SLOT = "__key_hash", "__slot"
MAX_KEYS = 10_000
#: Keys of one scan. Spark compares each with the statistics of a row group and
#: its pages if the list is no longer than a setting; the nested form of some
#: thousand keys is too deep for a task's stack.
SCAN_KEYS = 250
COMPARE_EACH = {"spark.sql.parquet.pushdown.inFilterThreshold": str(SCAN_KEYS)}
GROUP_ROWS = 100_000
PAGE_ROWS = 2_000
SLOT_BITS = 8


def key_hash(keys: list[str]) -> Column:
    """Hash of a key; nulls take part, as they would be skipped otherwise."""
    return F.xxhash64(*[x for k in keys for x in (F.col(k), F.col(k).isNull())])


def write_keyed(state: DataFrame, path: str, keys: list[str], slot_bits: int = SLOT_BITS,
                group_rows: int = GROUP_ROWS, page_rows: int = PAGE_ROWS) -> None:
    """Overwrite ``path`` with ``state``, laid out for reads by ``keys``, in
    2 ** ``slot_bits`` folders (so many that a folder's files are a few)."""
    slot = f"{SLOT}{slot_bits}"
    (state.withColumn(HASH, key_hash(keys)).withColumn(slot, F.shiftright(HASH, 64 - slot_bits).cast("int"))
     .repartitionByRange(slot, HASH).sortWithinPartitions(slot, HASH)
     .write.mode("overwrite").partitionBy(slot)
     .option("parquet.block.row.count.limit", group_rows)
     .option("parquet.page.row.count.limit", page_rows)
     .option(f"parquet.bloom.filter.enabled#{HASH}", "true")
     .option(f"parquet.bloom.filter.expected.ndv#{HASH}", group_rows)
     .option(f"parquet.enable.dictionary#{HASH}", "false")
     .parquet(path))


def hashes_of(wanted: DataFrame, keys: list[str], limit: int = MAX_KEYS) -> list[int] | None:
    """Distinct key hashes of a batch, ascending; None when there are more than ``limit``."""
    rows = wanted.select(key_hash(keys).alias(HASH)).distinct().limit(limit + 1).collect()
    return None if len(rows) > limit else sorted(r[0] for r in rows)


def scan_keys(rows: DataFrame, hashes: list[int]) -> DataFrame:
    """The rows of a state whose key hash is listed: a scan for each run of
    SCAN_KEYS hashes, each over the folders of its hashes. To be executed under
    COMPARE_EACH."""
    slot = next(c for c in rows.columns if c.startswith(SLOT))
    shift = 64 - int(slot.removeprefix(SLOT))
    runs = [hashes[i:i + SCAN_KEYS] for i in range(0, len(hashes), SCAN_KEYS)] or [[]]
    scans = [rows.filter(F.col(slot).isin(sorted({h >> shift for h in run})) & F.col(HASH).isin(run)) for run in runs]
    return reduce(DataFrame.unionByName, scans).drop(slot)


def read_keyed(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str], schema: StructType, slot_bits: int = SLOT_BITS,
               max_keys: int = MAX_KEYS) -> DataFrame:
    """The rows of the state at ``path`` whose ``keys`` are in ``wanted``.
    ``schema`` is the state's: an empty state has no file that could tell it."""
    stored = StructType([*schema.fields, StructField(HASH, LongType()), StructField(f"{SLOT}{slot_bits}", IntegerType())])
    rows = spark.read.schema(stored).parquet(path)
    hashes = hashes_of(wanted, keys, max_keys)
    if hashes is None:
        found = rows.drop(*[c for c in rows.columns if c.startswith(SLOT)])
    else:
        with conf_override(spark, COMPARE_EACH):
            found = materialise(scan_keys(rows, hashes), "keyed-rows")
    asked = wanted.select(*[F.col(k).alias(f"__{k}") for k in keys], key_hash(keys).alias("__asked")).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col(HASH) == F.col("__asked"))
    return found.join(asked, same, "left_semi").drop(HASH)
