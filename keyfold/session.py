"""Session and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings a job relies on. Shuffle partitions stay a cluster decision; AQE
# coalesces small partitions and splits skewed join partitions at run time.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A union of children hash-partitioned alike reports that partitioning;
    # with AQE coalescing the children differently, a later zip of the union
    # with another side fails on unequal partition counts (seen on 4.1 with
    # base + delta state reads). Jobs that union such inputs turn it off.
    "spark.sql.unionOutputPartitioning": "false",
}


@contextmanager
def conf_override(spark: SparkSession, conf: dict[str, str]):
    """Set session confs for the duration of a block, then restore them."""
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


SAFE_UNION = {"spark.sql.unionOutputPartitioning": "false"}


def build_session(master: str = "local[8]", app: str = "keyfold",
                  shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests, bench and examples (cluster jobs get theirs from spark-submit)."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g")
         # checkpoint files of collected Datasets are removed, not left behind
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    for k, v in JOB_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session; only when unset on a local master (tests) a
    private folder is created and registered as the checkpoint dir. On a
    cluster an unset dir is an error, never a machine-local folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(checkpoints and job outputs must survive executor loss)")
        d = tempfile.mkdtemp(prefix="keyfold-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder (never machine-local on a cluster)."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/keyfold/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and read it back:
    columnar, lineage cut, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Path existence through the Hadoop FileSystem of the session (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))
