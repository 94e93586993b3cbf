"""Exact duplicates by exchange of Golomb-coded fingerprints.

1. Each row gets its place (partition, block of 65,536 rows, position) and the
   fingerprint of its normalised text, and is written to the shared folder.
2. Senders: a block's distinct fingerprints, cut to as many bits as the number of
   rows needs, are sorted and sent to the owners of their ranges as Golomb codes.
3. Owners: each decodes the codes of its range and answers every sender with a
   bitmap: which of its fingerprints another block has too.
4. A block turns the bitmaps, and what it holds twice itself, into one bit a row.
   The rows' bits meet their texts in waves of bounded broadcasts, so texts whose
   fingerprint is alone are never shuffled.
5. Suspects: their texts are shuffled and compared byte by byte, copies combined
   before the shuffle. Cut fingerprints suspect about one single text in a thousand
   wrongly; the comparison clears them.

A group of copies of any size is one fingerprint a block for the owners and one
row a task for the comparison. Its members find their group by a broadcast of the
few largest groups (at most 10,000, as each holds more than a ten-thousandth of all
rows) or by a join in which no group is larger than that.

Defined cases: null and empty texts are equal; of equal texts the least id stays, an
id before no id, of rows with the same id one; an empty table gives no rows; columns
of any names are carried by ``deduplicated_exactly`` and ignored else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .common import stage
from .golomb import decode, encode

#: Rows of a block, and so fingerprints of a message at most.
BLOCK = 1 << 16
#: Fingerprints that one owner receives, about.
OWNED = 1 << 20
#: Bits of a fingerprint beyond those that number the rows: one single text in
#: 2 ** SPARE meets another's cut fingerprint by chance.
SPARE = 10
#: Bytes of row bits broadcast at once.
WAVE_BYTES = 32 << 20
#: Groups that may be broadcast, at most; smaller tables' groups of up to SMALL rows are joined.
HOT_GROUPS, SMALL = 10_000, 64

SPACES = r"[\x20\x09-\x0D]+"
PLACE = ["part", "block"]
MESSAGES = "part int, block int, piece int, owner int, n int, code binary, rows binary, twice binary"


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def placed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Rows with their place, fingerprint, digest and normalised text, staged
    (so that places stay what they are)."""
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"),
                      *([F.struct(*carry).alias("row")] if carry else []))
    at = F.monotonically_increasing_id()
    rows = row.withColumn("at", at)
    rows = rows.select("doc_id", "text", *(["row"] if carry else []),
                       F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at"))
    return stage(rows.select("doc_id", "part", F.floor(F.col("at") / BLOCK).cast("int").alias("block"), (F.col("at") % BLOCK).cast("int").alias("pos"),
                             F.xxhash64("text").alias("fp"), F.sha2("text", 256).alias("text_sha256"), "text", *(["row"] if carry else [])), "exact-rows")


def _sender(bits: int, owners: int):
    """Rows (part, block, pos, fp) -> a message an owner. A block that a scan
    cuts in two is sent in pieces, each named by its first position."""
    span = -(-(1 << bits) // owners)

    def messages(part: int, block: int, pos: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        fp = fp.view(np.uint64) >> np.uint64(64 - bits)
        order = np.argsort(fp, kind="stable")
        fp, rows = fp[order], pos[order].astype(np.uint16)
        first = np.flatnonzero(np.diff(fp, prepend=fp[0] ^ np.uint64(1)))
        distinct, count = fp[first], np.diff(first, append=len(fp))
        owner = (distinct // np.uint64(span)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        out = []
        for a, b in zip(cuts, np.append(cuts[1:], len(owner))):
            low = int(owner[a]) * span
            lo, hi = first[a], first[b] if b < len(first) else len(fp)
            # the sender keeps: rows in the order of the codes, and which code each row has (a bit where a new one begins)
            begins = np.zeros(hi - lo, np.uint8)
            begins[first[a:b] - lo] = 1
            out.append((part, block, int(pos[0]), int(owner[a]), int(b - a), encode(distinct[a:b], low, span), rows[lo:hi].tobytes(),
                        np.packbits(np.concatenate([begins, count[a:b] > 1])).tobytes()))
        return pa.RecordBatch.from_pylist([dict(zip(_NAMES, m)) for m in out], schema=_MESSAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        key = None
        for b in batches:
            part, block, pos, fp = (c.to_numpy() for c in b.columns)
            cuts = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
            for x, y in zip(cuts, np.append(cuts[1:], len(part))):
                now = (int(part[x]), int(block[x]))
                if key is not None and key != now:
                    yield messages(*key, *map(np.concatenate, zip(*held)))
                    held = []
                key = now
                held.append((pos[x:y], fp[x:y]))
        if key is not None:
            yield messages(*key, *map(np.concatenate, zip(*held)))
    return run


_NAMES = ["part", "block", "piece", "owner", "n", "code", "rows", "twice"]
_MESSAGE = pa.schema([(n, pa.int32()) for n in _NAMES[:5]] + [(n, pa.binary()) for n in _NAMES[5:]])
_REPLY = pa.schema([(n, pa.int32()) for n in _NAMES[:4]] + [("bits", pa.binary())])


def _own(messages: pa.Table) -> pa.Table:
    """One owner's answers: per message a bitmap of the fingerprints that more
    than one message holds."""
    lists = [decode(c) for c in messages.column("code").to_pylist()]
    every = np.sort(np.concatenate(lists))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    bits = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in lists]
    return messages.select(_NAMES[:4]).append_column("bits", pa.array(bits, pa.binary())).cast(_REPLY)


_BITS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("bits", pa.binary())])


def _mark(kept: pa.Table, replies: pa.Table) -> pa.Table:
    """One block: bit of each row position whose fingerprint is not alone."""
    answer = {(r["piece"], r["owner"]): r["bits"] for r in replies.to_pylist()}
    bits = np.zeros(BLOCK, np.uint8)
    for m in kept.to_pylist():
        rows, n = np.frombuffer(m["rows"], np.uint16), m["n"]
        flags = np.unpackbits(np.frombuffer(m["twice"], np.uint8), count=len(rows) + n)
        code = np.cumsum(flags[:len(rows)]) - 1
        seen = np.unpackbits(np.frombuffer(answer[m["piece"], m["owner"]], np.uint8), count=n) | flags[len(rows):]
        bits[rows[seen[code] == 1]] = 1
    if not bits.any():
        return _BITS.empty_table()
    last = int(np.flatnonzero(bits)[-1]) + 1
    return pa.table([[kept.column("part")[0].as_py()], [kept.column("block")[0].as_py()], [np.packbits(bits[:last]).tobytes()]], schema=_BITS)


def suspect_bits(rows: DataFrame) -> DataFrame:
    """(part, block, bits): which rows of a block share their fingerprint with
    another row of the table; blocks without any are absent."""
    spark = rows.sparkSession
    n = rows.count()
    bits = min(62, max(8, math.ceil(math.log2(n + 1)) + SPARE))
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // OWNED))
    sent = stage(rows.select("part", "block", "pos", "fp").mapInArrow(_sender(bits, min(owners, 1 << bits)), MESSAGES), "exact-messages")
    replies = (sent.select(*_NAMES[:4], "code").groupBy("owner")
               .applyInArrow(_own, "part int, block int, piece int, owner int, bits binary"))
    kept = sent.select(*_NAMES[:5], "rows", "twice")
    return stage(kept.groupBy(*PLACE).cogroup(replies.groupBy(*PLACE))
                 .applyInArrow(_mark, "part int, block int, bits binary"), "exact-bits")


def flagged(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """``rows`` with ``suspect``; the texts of other rows are null. Row bits are
    broadcast in waves of partitions whose bits together stay below
    ``WAVE_BYTES``; a wave reads the rows of its partitions."""
    spark: SparkSession = rows.sparkSession
    last = rows.agg(F.max("part")).first()[0]
    # a wave is a range of partitions: full blocks bound the bits, whatever was found
    size = rows.groupBy("part").agg((F.max("block") + 1).alias("blocks")).agg(F.max("blocks")).first()[0] or 1
    parts = max(1, WAVE_BYTES // (size * (BLOCK // 8 + 64)))
    path = scratch_path(spark, "exact-flagged")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(F.col("pos") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(__byte, 7 - pos % 8)").bitwiseAND(1) == 1, F.lit(False))
    for start in range(0, (last or 0) + 1, parts):
        wave = F.col("part").between(start, start + parts - 1)
        met = rows.filter(wave).join(F.broadcast(bits.filter(wave)), PLACE, "left").withColumn("__byte", byte).withColumn("suspect", hit)
        out = met.drop("__byte", "bits", "fp").withColumn("text", F.when(F.col("suspect"), F.col("text")))
        out.write.mode("append").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def verified(suspects: DataFrame) -> DataFrame:
    """Groups of byte-equal texts among the suspects: digest, number of rows,
    and id and place of the row that stays. Copies meet in each task first."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "part", "block", "pos"))
    groups = suspects.groupBy("text", "text_sha256").agg(least.alias("least"), F.count(F.lit(1)).alias("group_size"))
    return stage(groups.filter("group_size > 1").select("text_sha256", "group_size", "least"), "exact-groups")


def duplicates(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Every row: ``doc_id``, ``keep_id`` (of the row that stays),
    ``group_size``, ``kept``, ``text_sha256``; with ``carry`` also those columns
    of ``docs`` in a struct ``row``."""
    spark = docs.sparkSession
    rows = placed(docs, carry or [])
    marked = flagged(rows, suspect_bits(rows))
    suspects = marked.filter("suspect")
    groups = verified(suspects)
    limit = max(SMALL, -(-rows.count() // HOT_GROUPS))
    hot, cold = groups.filter(F.col("group_size") > limit), groups.filter(F.col("group_size") <= limit)
    narrow = suspects.drop("text", "suspect")
    alone = [F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")]
    found = F.col("group_size").isNotNull()
    # a left join of the others: a suspect whose bytes nobody shares is alone
    meets = [F.when(found, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
             (~found | (F.col("least.part") == F.col("part")) & (F.col("least.block") == F.col("block")) & (F.col("least.pos") == F.col("pos"))).alias("kept")]
    out = lambda df, cols: df.select("doc_id", *cols, "text_sha256", *(["row"] if carry else []))
    parts = [out(marked.filter("NOT suspect"), alone),
             out(narrow.join(F.broadcast(hot), "text_sha256"), meets),
             out(narrow.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti").join(cold, "text_sha256", "left"), meets)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def deduplicated_exactly(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return duplicates(docs, docs.columns).filter("kept").select("row.*")


SQL = r"""
WITH t AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
    sha256(x) AS text_sha256
FROM t WINDOW g AS (PARTITION BY x)
"""
