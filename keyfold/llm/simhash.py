"""SimHash near-duplicates, searched by the general pigeonhole principle.

A text's fingerprint has a bit set where more than half of its shingle hashes
have it. Fingerprints that differ in at most ``distance`` bits are linked. The
64 bits are cut into partitions of correlated bits; partition i gets its own
threshold t_i >= -1 with sum(t_i + 1) = distance + 1, so a linked pair differs in
at most t_i bits in some partition. A dynamic programme allots the thresholds by
estimated candidates. Every distinct fingerprint is indexed under its bits of
each partition, probed under all values within t_i bits, and each pair that
meets is verified on all 64 bits.

Copies are one distinct fingerprint, so a group of copies never makes pairs.
Buckets with more than HOT distinct fingerprints are cut into tiles, whose
tasks return a spanning forest of the links instead of all of them.

Defined cases: null and empty texts have no words and fingerprint 0, linked like
any other; texts with fewer words than a shingle hash their whole sequence; an
empty table gives no rows; null ids count last; repeated rows are copies; other
columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import slices, stage
from .components import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Distinct fingerprints read to plan the partitions; the search reads all.
PLAN_SAMPLE = 8_000
#: Distinct fingerprints of a bucket that one join key may hold.
HOT = 400
TILE = 4_000
#: Shingles whose bits are unpacked at once.
FLUSH = 1 << 16


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()  # A-Z only; space and the ASCII controls tab to carriage return
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, words)))
    digest = xxhash.xxh64_intdigest
    # word i starts at the bytes of the words before it and i spaces
    starts = [0, *(e + i + 1 for i, e in enumerate(ends[:n - shingle]))]
    stops = [e + i + shingle - 1 for i, e in enumerate(ends[shingle - 1:])]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """Signed 64-bit fingerprints. Bits are counted for many texts at once;
    a text beyond FLUSH shingles is counted in pieces."""
    sums, sizes = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    rows: list[int] = []
    total = 0

    def flush() -> None:
        nonlocal total
        if rows:
            flat = np.concatenate(held)
            at = np.cumsum([0, *map(len, held[:-1])])
            bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums[rows] = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        held.clear()
        rows.clear()
        total = 0

    for i, text in enumerate(texts):
        h = _hashes(text or b"", shingle)
        sizes[i] = len(h)
        if len(h) > FLUSH:
            sums[i] = sum(_bit_sums(h[a:a + FLUSH]) for a in range(0, len(h), FLUSH))
        elif len(h):
            held.append(h)
            rows.append(i)
            total += len(h)
            if total >= FLUSH:
                flush()
    flush()
    bits = (sums * 2 > sizes[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64).reshape(-1)


def _fields(df: DataFrame, taken: set[str]) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name not in taken]


def fingerprinted(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with ``__fp``."""
    names = docs.columns if keep is None else keep
    carried = docs.select(*names, F.col("text").cast("binary").alias("__bytes"))
    schema = T.StructType([*carried.schema.fields[:-1], T.StructField("__fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, len(names)):
            fp = fingerprints(b.column(b.num_columns - 1).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp, pa.int64())], names=[*names, "__fp"])

    return carried.mapInArrow(run, schema)


# ------------------------------------------------------------------ planning
def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def partitions(bits: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m partitions of even width, correlated bits together."""
    near = np.zeros((64, 64))
    if len(bits):
        x = bits.astype(np.float64) - bits.mean(axis=0)
        sd = x.std(axis=0)
        near = np.abs((x.T @ x) / len(x) / np.maximum(np.outer(sd, sd), 1e-9))
    np.fill_diagonal(near, 0)
    left, out = list(range(64)), []
    for i in range(m):
        width = 64 // m + (i < 64 % m)
        part = [max(left, key=lambda b: near[b, left].max())]
        left.remove(part[0])
        while len(part) < width:
            b = max(left, key=lambda c: near[c, part].mean())
            part.append(b)
            left.remove(b)
        out.append(sorted(part))
    return out


def _within(part: list[int], differ: np.ndarray, t: int) -> float:
    """Chance that two fingerprints differ in at most t bits of the part,
    bits taken as independent."""
    dist = np.zeros(t + 2)
    dist[0] = 1.0
    for b in part:
        p = differ[b]
        dist[1:] = dist[1:] * (1 - p) + dist[:-1] * p
        dist[0] *= 1 - p
    return float(dist[:t + 1].sum())


def plan_search(fps: np.ndarray, n: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition: the cheapest number of partitions
    and, by dynamic programme, thresholds. Cost: probes, plus candidate pairs
    estimated from the sample and scaled to n distinct fingerprints."""
    bits = _bits(fps)
    share = bits.mean(axis=0) if len(fps) else np.full(64, 0.5)
    differ = np.clip(2 * share * (1 - share), 1e-3, 0.5)
    some = fps[:1500].view(np.uint64)
    pairs = max(1, len(some) * (len(some) - 1) // 2)
    best = (float("inf"), [])
    for m in range(2, distance + 2):
        parts = partitions(bits, m)
        costs = []
        for part in parts:
            mask = np.uint64(sum(1 << b for b in part))
            apart = np.bitwise_count((some[:, None] ^ some[None, :]) & mask)[np.triu_indices(len(some), 1)]
            row, probes = {-1: 0.0}, 0
            for t in range(0, min(2, distance) + 1):
                probes += len(list(combinations(range(len(part)), t)))
                seen = float((apart <= t).sum()) / pairs if len(some) > 1 else 0.0
                row[t] = 8.0 * n * probes + n * n / 2 * max(seen if seen * pairs >= 3 else 0.0, _within(part, differ, t))
            costs.append(row)
        # spent[k]: least cost of the parts so far whose t + 1 add up to k
        spent = {0: (0.0, [])}
        for row in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for k, (c, ts) in spent.items():
                for t, more in row.items():
                    if k + t + 1 <= distance + 1 and (k + t + 1 not in new or c + more < new[k + t + 1][0]):
                        new[k + t + 1] = (c + more, [*ts, t])
            spent = new
        if distance + 1 in spent and spent[distance + 1][0] < best[0]:
            best = (spent[distance + 1][0], [(p, t) for p, t in zip(parts, spent[distance + 1][1]) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# ------------------------------------------------------------------- search
def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _forest(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between fingerprints a and b: breadth
    first, so every fingerprint is compared with what is not yet reached."""
    nodes = np.unique(np.concatenate([a, b])).view(np.uint64)
    left, us, vs = nodes.copy(), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = np.bitwise_count(left ^ x) <= distance
            if hit.any():
                found = left[hit]
                us.append(np.full(len(found), x))
                vs.append(found)
                queue.extend(found)
                left = left[~hit]
    if not us:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)


def _tile_links(distance: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        u, v = _forest(left.column("fp").to_numpy(), right.column("fp").to_numpy(), distance)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
    return run


def _probe(part: int, mask: Column):
    """A fingerprint's key in a partition with some of its bits flipped."""
    return lambda x: F.struct(F.lit(part).alias("part"), F.col("fp").bitwiseAND(mask).bitwiseXOR(x).alias("key"))


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v) pairs of distinct fingerprints within the distance whose
    components are those of all such pairs. ``classes``: staged, column fp."""
    n = classes.count()
    sample = classes.select("fp").orderBy(F.xxhash64("fp")).limit(PLAN_SAMPLE).toArrow().column("fp").to_numpy()
    plan = plan_search(np.ascontiguousarray(sample), n, distance)
    index, probes = [], []
    for i, (part, t) in enumerate(plan):
        mask = F.lit(_signed(sum(1 << b for b in part)))
        flips = [_signed(sum(1 << b for b in bits)) for k in range(t + 1) for bits in combinations(part, k)]
        index.append(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(mask).alias("key")))
        probes.append(F.transform(F.array(*[F.lit(x) for x in flips]), _probe(i, mask)))
    indexed = stage(classes.select("fp", F.explode(F.array(*index)).alias("e")).select("fp", "e.part", "e.key"), "sim-index")
    hot = stage(indexed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT), "sim-hot")
    asked = classes.select(F.col("fp").alias("f"), F.explode(F.flatten(F.array(*probes))).alias("e")).select(
        "f", F.col("e.part").alias("p"), F.col("e.key").alias("k"))
    cold = indexed.join(hot, ["part", "key"], "left_anti")
    met = cold.join(asked, (cold["part"] == asked["p"]) & (cold["key"] == asked["k"])
                    & (cold["fp"] < asked["f"]) & (_differ(cold["fp"], asked["f"]) <= distance))
    found = met.select(F.col("fp").alias("u"), F.col("f").alias("v"))
    if hot.isEmpty():
        return found
    # hot buckets: fingerprints of the bucket and those that probe it, in tiles
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    side = lambda c: F.pmod(F.xxhash64(c, F.lit("tile")), F.col("n_tiles")).cast("int")
    h = hot.withColumn("n_tiles", tiles)
    inside = indexed.join(h, ["part", "key"]).select("part", "key", "fp", "n_tiles", side(F.col("fp")).alias("a"))
    coming = asked.join(h, (asked["p"] == h["part"]) & (asked["k"] == h["key"])).select(
        "part", "key", F.col("f").alias("fp"), "n_tiles", side(F.col("f")).alias("b"))
    every = F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1))
    left = inside.withColumn("b", every).select("part", "key", "a", "b", "fp")
    right = coming.withColumn("a", every).select("part", "key", "a", "b", "fp")
    keys = ["part", "key", "a", "b"]
    forest = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile_links(distance), "u long, v long")
    return found.unionByName(forest)


def classes_of(marked: DataFrame) -> DataFrame:
    """(fp, rep): distinct fingerprints and the least id that has them."""
    return stage(marked.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("rep")), "sim-classes")


def roots_of(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(node, root) of the fingerprints that have a link."""
    return stage(components(links(classes, distance)), "sim-roots")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row a document: doc_id, fingerprint, component_id."""
    marked = stage(fingerprinted(docs, shingle, ["doc_id"]), "sim-docs")
    classes = classes_of(marked)
    roots = roots_of(classes, distance)
    grouped = classes.join(roots, classes["fp"] == roots["node"]).select("fp", "rep", "root")
    least = grouped.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("component"))
    grouped = grouped.join(least, grouped["root"] == least["r"]).select("fp", "component")
    named = classes.join(grouped, "fp", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = marked.join(named, marked["__fp"] == named["fp"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The documents without near-duplicates: of each component the document
    of the least id (null ids last) stays, with all its columns."""
    marked = stage(fingerprinted(docs, shingle), "sim-docs")
    classes = classes_of(marked)
    roots = roots_of(classes, distance)
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "fp")).alias("b"))
    best = stage(best.select(F.col("b.fp").alias("__keep"), F.col("b.rep").alias("__rep")), "sim-kept")
    kept = marked.join(best, (marked["__fp"] == best["__keep"]) & marked["doc_id"].eqNullSafe(best["__rep"]))
    kept = kept.select(*marked.columns)
    again = kept.groupBy("doc_id", "__fp").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    again = stage(again.select(F.col("doc_id").alias("__id"), F.col("__fp").alias("__f")), "sim-repeated")
    if again.isEmpty():
        return kept.drop("__fp")
    same = kept["doc_id"].eqNullSafe(again["__id"]) & (kept["__fp"] == again["__f"])
    rest = kept.join(again, same, "left_anti")
    one = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "__fp"])
    return rest.unionByName(one).drop("__fp")
