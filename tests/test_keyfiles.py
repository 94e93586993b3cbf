"""State files: point reads give what a join gives, and read by the batch's size."""

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from keyfold.operators import backfill as bf
from keyfold.operators import dedupe as dd
from keyfold.session import conf_override, scratch_path
from keyfold.sources import keyfiles as kf

KEYS = ["stream_id", "cid"]
GROUP, PAGE = 1_000, 200


def state(spark, n):
    return spark.range(n).select(F.concat(F.lit("s"), F.col("id") % 3).alias("stream_id"), F.concat(F.lit("c"), "id").alias("cid"),
                                 F.timestamp_micros(F.col("id")).cast("timestamp_ntz").alias("crt"))


def rows_read(df):
    """Rows that the scans of a plan gave out."""
    with conf_override(df.sparkSession, {"spark.sql.adaptive.enabled": "false", **kf.COMPARE_EACH}):
        plan = df._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        leaves = plan.collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def written(spark):
    out = {}
    for n in (40_000, 400_000):
        out[n] = scratch_path(spark, "t-keyed")
        kf.write_keyed(state(spark, n), out[n], KEYS, slot_bits=4, group_rows=GROUP, page_rows=PAGE)
    return out


def test_reads_grow_with_the_batch_not_with_the_state(spark, written):
    def read(n, ids):
        wanted = spark.createDataFrame([(f"s{i % 3}", f"c{i}") for i in ids], "stream_id string, cid string")
        return rows_read(kf.scan_keys(spark.read.parquet(written[n]), kf.hashes_of(wanted, KEYS)))

    ids = random.Random(4).sample(range(40_000), 600)
    for n in written:
        for some in (ids[:4], ids[:40], ids):
            assert len(some) <= read(n, some) <= len(some) * 2 * PAGE
    # keys that are not there: their hashes lie within row groups, the Bloom filters drop most of those
    assert read(400_000, range(10**9, 10**9 + 40)) <= 4 * GROUP


def test_files_hold_bloom_filters_and_narrow_ranges(written):
    groups = [pq.ParquetFile(f).metadata.row_group(g) for f in glob.glob(written[400_000] + "/*/*.parquet")
              for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    column = next(i for i in range(groups[0].num_columns) if groups[0].column(i).path_in_schema == kf.HASH)
    ranges = sorted((g.column(column).statistics.min, g.column(column).statistics.max) for g in groups)
    assert len(groups) >= 400 and max(g.num_rows for g in groups) <= GROUP
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


@pytest.mark.parametrize("max_keys", [kf.MAX_KEYS, 3])
def test_same_rows_as_a_join(spark, max_keys):
    rows = [("a", None, 1), (None, "x", 2), (None, None, 3), ("a", "x", 4), ("a", "x", 5), ("", "", 6), ("b", "x", 7)]
    path = scratch_path(spark, "t-keyed")
    stored = spark.createDataFrame(rows, "stream_id string, cid string, n int")
    kf.write_keyed(stored, path, KEYS)
    wanted = spark.createDataFrame([("a", None), ("a", "x"), ("a", "x"), (None, None), ("", ""), ("none", "x")], "stream_id string, cid string")
    got = kf.read_keyed(spark, path, wanted, KEYS, stored.schema, max_keys=max_keys)
    assert got.columns == ["stream_id", "cid", "n"]
    assert sorted(r.n for r in got.collect()) == [1, 3, 4, 5, 6]
    assert kf.read_keyed(spark, path, wanted.limit(0), KEYS, stored.schema, max_keys=max_keys).count() == 0
    kf.write_keyed(stored.limit(0), path, KEYS)
    assert kf.read_keyed(spark, path, wanted, KEYS, stored.schema, max_keys=max_keys).count() == 0


def test_state_of_a_run_by_point_reads(spark, written):
    """C3 and A10 from the files equal the same on whole tables."""
    batch = spark.createDataFrame([("s0", "c0"), ("s1", "c0"), ("s1", "c1"), ("s2", "no")], "stream_id string, cid string")
    stored = kf.read_keyed(spark, written[40_000], batch, KEYS, state(spark, 0).schema, slot_bits=4)
    whole = {tuple(r) for r in dd.mark_stored_cids(batch, state(spark, 40_000)).collect()}
    assert {tuple(r) for r in dd.mark_stored_cids(batch, stored).collect()} == whole
    assert {(r.cid, r.cid_stored) for r in dd.mark_stored_cids(batch, stored).collect()} == {("c0", True), ("c0", False), ("c1", True), ("no", False)}
    values = spark.sql("SELECT * FROM VALUES ('p', TIMESTAMP_NTZ'2024-01-01 00:00:00'), ('q', TIMESTAMP_NTZ'2024-01-02 00:00:00') AS t(name, value)")
    names = spark.createDataFrame([("q",), ("r",)], "name string")
    path = scratch_path(spark, "t-keyed")
    kf.write_keyed(values, path, ["name"])
    got = {r.name: r.value.year for r in bf.load_checkpoint(kf.read_keyed(spark, path, names, ["name"], values.schema), names).collect()}
    assert got == {"q": 2024, "r": 1}
