"""Epoch-versioned state for ``foreachBatch`` jobs.

Micro-batch ``n`` reads state version ``n - 1`` and writes its outputs and
state version ``n``, all with overwrite. A retried epoch (after an executor
or driver loss) therefore reads the same input state and rewrites the same
files: sinks stay exactly-once without a transaction log. Everything lives
under one root in the shared folder.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..session import exists


class EpochStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str, epoch: int) -> str:
        return f"{self.root}/{name}/epoch={epoch}"

    def read(self, name: str, epoch: int) -> DataFrame | None:
        """State ``name`` as of ``epoch`` (None before the first write)."""
        if epoch < 0:
            return None
        p = self.path(name, epoch)
        return self.spark.read.parquet(p) if exists(self.spark, p) else None

    def write(self, name: str, epoch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.path(name, epoch))

    def read_all(self, name: str, schema: str | None = None) -> DataFrame:
        """Every epoch of an output, with the ``epoch`` partition column."""
        r = self.spark.read
        if schema:
            r = r.schema(schema)
        return r.parquet(f"{self.root}/{name}")

    def versions(self, name: str) -> list[int]:
        """Committed versions of ``name``, ascending."""
        return committed(self.spark, f"{self.root}/{name}", "epoch=")

    def commit(self, name: str, number: int, record: dict) -> dict:
        """Commit ``record`` as ``number`` of ``name`` unless that is committed
        already; the record that stands. Of several writers one wins, and the
        others get its record."""
        path = f"{self.root}/{name}/{number}.json"
        if put_if_absent(self.spark, path, json.dumps(record)):
            return record
        return json.loads(read_text(self.spark, path))

    def newest_commit(self, name: str) -> int:
        """Highest committed number of ``name``, from one listing; -1 when there is none."""
        path = f"{self.root}/{name}"
        names = children(self.spark, path) if exists(self.spark, path) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(("_", "."))), default=-1)

    def read_commits(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).json(f"{self.root}/{name}/*.json")

    def newest(self, name: str, upto: int | None = None) -> int:
        """Newest committed version (at most ``upto``); -1 when there is none."""
        return max((v for v in self.versions(name) if upto is None or v <= upto), default=-1)


def committed(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the sub-directories ``<prefix><number>`` whose write committed."""
    if not exists(spark, path):
        return []
    return sorted(int(n[len(prefix):]) for n in children(spark, path) if n.startswith(prefix) and exists(spark, f"{path}/{n}/_SUCCESS"))


def _filesystem(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a folder in one step, so that what watches ``to``'s parent sees all
    of it or nothing."""
    p, fs = _filesystem(spark, path)
    target, _ = _filesystem(spark, to)
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"could not move {path} to {to}")


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, unless it exists: the text goes to a file of its
    own, which is then renamed without overwriting. False when another was first.
    Needs a rename that checks and moves in one step, as checkpoints of Spark's
    streams do (HDFS has it; on an object store without it, run one writer)."""
    jvm = spark.sparkContext._jvm
    target, fs = _filesystem(spark, path)
    mine = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(mine, False)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(fs.makeQualified(mine), fs.makeQualified(target), no_overwrite)
    except Py4JJavaError as e:
        if not e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise
        fs.delete(mine, False)
        return False
    return True


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _filesystem(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def children(spark: SparkSession, path: str) -> list[str]:
    p, fs = _filesystem(spark, path)
    return [st.getPath().getName() for st in fs.listStatus(p)]
