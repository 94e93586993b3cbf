"""Approximate nearest neighbours: a block matrix join over int8 vectors.

Vectors are quantised to int8 with one scale a vector, and the length of what the
rounding lost is kept. Query blocks meet candidate blocks; the product of two int8
blocks gives squared distances of the quantised vectors, and the two lost lengths
bound how far the true distance is from them. Only candidates whose lower bound is
within the k-th least upper bound survive; they are measured again in double
precision on the original vectors, so the result of a tile is exact. Heaps merge
the tiles' answers of each query.

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part; a query's own vec_id is never its answer; ties go to the smaller
vec_id; only vectors of a query's dimension are its candidates; repeated query
rows are searched once, repeated candidate rows are candidates of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

K = 10
QUERY_EVERY = 100
#: Rows of a query block and of a candidate block, about.
QUERY_ROWS, CANDIDATE_ROWS = 2_048, 8_192
#: Rows of a candidate block whose products are held at once.
TILE_ROWS = 2_048


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return (vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.coalesce(fit & some, F.lit(False)))
            .select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dim")))


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales and the lengths lost by rounding."""
    scale = np.abs(v).max(axis=1) / 127.0
    scale = np.where(scale > 0, scale, 1.0)
    q = np.rint(v / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(v - q * scale[:, None], axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, summed in order of the components."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        gap = a[:, d] - b[:, d]
        total += gap * gap
    return np.sqrt(total)


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, distance) of each query's k nearest in the block."""
    q8, q_scale, q_lost = quantise(q)
    c8, c_scale, c_lost = quantise(c)
    # products of int8 vectors are whole numbers far below 2**24 for any usual
    # dimension, so a float32 product is exact and runs as a matrix product
    wide = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    qf, q_norm = q8.astype(wide), np.einsum("ij,ij->i", q8.astype(float), q8.astype(float)) * q_scale ** 2
    near = np.full((len(q), k), np.inf)  # the k least upper bounds so far
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    slack = 1e-9 * (1 + np.sqrt(q_norm.max(initial=0.0)))
    for a in range(0, len(c), TILE_ROWS):
        t8, ts, tl, ids = c8[a:a + TILE_ROWS], c_scale[a:a + TILE_ROWS], c_lost[a:a + TILE_ROWS], c_ids[a:a + TILE_ROWS]
        t_norm = np.einsum("ij,ij->i", t8.astype(float), t8.astype(float)) * ts ** 2
        dots = (qf @ t8.astype(wide).T).astype(float) * q_scale[:, None] * ts[None, :]
        far = np.sqrt(np.maximum(q_norm[:, None] + t_norm[None, :] - 2 * dots, 0))
        own = q_ids[:, None] == ids[None, :]
        error = q_lost[:, None] + tl[None, :] + slack
        upper = np.where(own, np.inf, far + error)
        near = np.partition(np.hstack([near, upper]), k - 1, axis=1)[:, :k]
        rows, cols = np.nonzero((far - error <= near.max(axis=1)[:, None]) & ~own)
        found.append((rows, cols + a, far[rows, cols] - error[rows, cols]))
    rows, cols, lower = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int),) * 3
    alive = lower <= near.max(axis=1)[rows]
    rows, cols = rows[alive], cols[alive]
    dist = np.empty(len(rows))
    for a in range(0, len(rows), 1 << 16):
        dist[a:a + (1 << 16)] = exact(q[rows[a:a + (1 << 16)]], c[cols[a:a + (1 << 16)]])
    order = np.lexsort((c_ids[cols], dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    best = rank < k
    return q_ids[rows[best]], c_ids[cols[best]], dist[best]


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = t.column("v").combine_chunks()
    return t.column("vec_id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query row."""
    rows = stage(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "ann-vectors")
    n = rows.count()
    queries = stage(rows.filter(is_query).dropDuplicates(["vec_id", "v"]).drop("row"), "ann-queries")
    q_blocks, c_blocks = max(1, -(-queries.count() // QUERY_ROWS)), max(1, -(-n // CANDIDATE_ROWS))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = queries.withColumn("qb", deal("vec_id", q_blocks)).withColumn("cb", every(c_blocks))
    right = rows.withColumn("cb", deal("row", c_blocks)).withColumn("qb", every(q_blocks)).drop("row")

    def tile(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            a, b, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        else:
            a, b, d = search_block(*_matrix(q), *_matrix(c), k)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(d, pa.float64())})

    keys = ["dim", "qb", "cb"]
    some = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, "query_id long, vec_id long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for b in batches:
            for query, vec, score in zip(*(c.to_pylist() for c in b.columns)):
                heap = heaps.setdefault(query, [])
                item = (-score, -vec)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        out = [(q, i + 1, -v, -s) for q, heap in heaps.items() for i, (s, v) in enumerate(sorted(heap, reverse=True))]
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                                          pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())],
                                         names=["query_id", "rank", "vec_id", "score"])

    return some.repartition("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def search(vectors: DataFrame, every: int = QUERY_EVERY, k: int = K) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % every == 0, k)


_CLEAN = """len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0"""
SQL = f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, len(embedding) AS dim FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND {_CLEAN}),
  d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_distance(q.e, c.e) AS score
        FROM v q JOIN v c ON c.dim = q.dim AND c.vec_id <> q.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
  SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
