"""Merkle manifest of a table: one digest a row, a tree a source, one root, and a
proof for every row, by nested-struct rollup.

Rows of a source are ranked in order. The digits of a rank in base ``ARITY`` are its
way down the tree, so a tree is built by grouping the lowest digit away, then the
next: each grouping nests up to ``ARITY`` child structs in their parent. Blocks of
``ARITY ** DEPTH`` consecutive rows bound the nesting: a block is one row of one
struct, all its groupings share one exchange on (source, block), and block tops are
the ranked rows of the next tier, until every source has one.

The way back needs no join: a nested struct holds all siblings, so a transform a level
lists its rows with their proofs, and explode emits them. A block gets the proof of
its own top from the tier above by grouping both on (source, block).

A source's levels end where one node remains. That is seen in place: a group that is
the first of its level and holds one child is that node, as ranks have no gaps.

Defined cases: ids ascend, no id first, rows with the same id by their digest (equal
rows are equal leaves, each with its own place); null and empty values differ; rows
without an id are not tampered with; an empty table gives no rows; a hot source is as
many blocks as its rows need; ``fields`` names the columns of a leaf, others are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scan import ordinal
from .common import stage

ARITY = 3
#: Levels of a block: 243 rows are nested in one struct.
DEPTH = 5
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

RANK, GROUP = "__rank", "__group"


def digest_of(values: list[Column]) -> Column:
    """Digest of values: ``-`` for null, else byte count, ``:``, value."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[part(v) for v in values]), 256)


def leaves(docs: DataFrame, fields: list[str] = FIELDS, tampered_text: Column | None = None) -> DataFrame:
    """(source, item): ``item`` holds id, leaf digest, and the digest of the row
    with ``tampered_text`` in place of its text (null where they are the same)."""
    row = [F.col(f) for f in fields]
    leaf = digest_of(row)
    changed = F.lit(None).cast("string")
    if tampered_text is not None:
        other = digest_of([tampered_text if f == "text" else F.col(f) for f in fields])
        changed = F.when(~tampered_text.eqNullSafe(F.col("text")), other)
    return docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").alias("doc_id"), leaf.alias("hash"), changed.alias("tampered"))


def ranked(rows: DataFrame, keys: list[str], order: list[str], item: list[str]) -> DataFrame:
    """(keys, rank from 0, node): ``node`` is a tree of one level."""
    numbered = ordinal(rows, keys, order, RANK)
    return numbered.select(*keys, (F.col(RANK) - 1).alias(RANK), F.struct(F.col("hash").alias("hash"), F.struct(*item).alias("kids")).alias("node"))


def rollup(rows: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """(keys, block, node): rows of (keys, rank, node) nested by blocks of
    ``ARITY ** depth`` ranks. A group is one node: its digest, and its children
    in order."""
    size = ARITY ** depth
    digits = [f"__d{j}" for j in range(depth)]
    d = rows.select(*keys, F.floor(F.col(RANK) / size).cast("long").alias("block"), "node",
                    *[(F.floor(F.col(RANK) / ARITY ** j) % ARITY).cast("int").alias(n) for j, n in enumerate(digits)])
    d = d.repartition(*keys, "block")
    for j, digit in enumerate(digits):
        rest = digits[j + 1:]
        kids = F.sort_array(F.collect_list(F.struct(F.col(digit).alias("digit"), F.col("node.hash").alias("hash"), F.col("node.kids").alias("kids"))))
        d = d.groupBy(*keys, "block", *rest).agg(kids.alias("kids"))
        # alone on its level: the only child, at the very front
        front = F.col("block") == 0
        for r in rest:
            front = front & (F.col(r) == 0)
        whole = F.sha2(F.concat_ws("", F.transform("kids", lambda k: k["hash"])), 256)
        d = d.select(*keys, "block", *rest, F.struct(F.when(front & (F.size("kids") == 1), F.col("kids")[0]["hash"]).otherwise(whole).alias("hash"),
                                                     F.col("kids")).alias("node"))
    return d


def listed(node: Column, path: Column, depth: int = DEPTH) -> Column:
    """The children at the bottom of a nested node, each with its rank in the
    block (``at``) and its proof: per level from its own on what stands left and
    right of it."""
    items = F.array(F.struct(node["hash"].alias("hash"), node["kids"].alias("kids"), F.lit(0).cast("long").alias("at"), path.alias("path")))
    for _ in range(depth):
        def down(parent: Column) -> Column:
            kids = parent["kids"]
            hashes = F.transform(kids, lambda k: k["hash"])
            # a lone first node was not hashed again: that level is none
            through = (F.size(kids) == 1) & (hashes[0] == parent["hash"])

            def child(kid: Column, i: Column) -> Column:
                step = F.struct(F.concat_ws("", F.slice(hashes, F.lit(1), i)).alias("left"),
                                F.concat_ws("", F.slice(hashes, i + 2, F.lit(ARITY))).alias("right"))
                return F.struct(kid["hash"].alias("hash"), kid["kids"].alias("kids"), (parent["at"] * ARITY + kid["digit"]).alias("at"),
                                F.when(through, parent["path"]).otherwise(F.concat(F.array(step), parent["path"])).alias("path"))
            return F.transform(kids, child)
        items = F.flatten(F.transform(items, down))
    return items


def _emit(blocks: DataFrame, keys: list[str], known: list[str], depth: int = DEPTH) -> DataFrame:
    """(keys, rank, hash, kids, path, known): the children of every block."""
    rows = blocks.select(*keys, "block", *known, F.explode(listed(F.col("node"), F.col("path"), depth)).alias("x"))
    return rows.select(*keys, (F.col("block") * ARITY ** depth + F.col("x.at")).alias(RANK), F.col("x.hash").alias("hash"), F.col("x.kids").alias("kids"),
                       F.col("x.path").alias("path"), *known)


PATH = "array<struct<left: string, right: string>>"


def tiers_of(rows: DataFrame, keys: list[str], name: str, depth: int = DEPTH) -> list[DataFrame]:
    """Tables of blocks, one a tier; in the last every key has one block. A
    block's struct nests the leaves' own columns in the first tier only; above
    it a child is a digest and its rank."""
    top = rows.agg(F.max(RANK)).first()[0]
    out: list[DataFrame] = []
    while True:
        blocks = stage(rollup(rows, keys, depth), f"{name}-{len(out)}")
        out.append(blocks)
        if top is None or top < ARITY ** depth:
            return out
        top //= ARITY ** depth
        rows = blocks.select(*keys, F.col("block").alias(RANK), F.struct(F.col("node.hash").alias("hash"), F.lit(None).cast("string").alias("kids")).alias("node"))


def descend(tiers: list[DataFrame], keys: list[str], start: DataFrame, known: list[str], depth: int = DEPTH) -> DataFrame:
    """(keys, hash, kids, path, known) of the leaves. ``start`` has (keys, path,
    known) of every key's top; each tier's blocks and what is known of them
    meet by grouping on (keys, block)."""
    above = start.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tiers):
        names = ["node", "path", *known]
        kinds = {**{f.name: f.dataType for f in above.schema.fields}, "node": blocks.schema["node"].dataType}
        sides = [df.select(*keys, "block", *[F.col(n) if n in df.columns else F.lit(None).cast(kinds[n]).alias(n) for n in names]) for df in (blocks, above)]
        met = sides[0].unionByName(sides[1]).groupBy(*keys, "block").agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
        rows = _emit(met, keys, known, depth)
        above = rows.select(*keys, F.col(RANK).alias("block"), "path", *known)
    return rows


def manifest(docs: DataFrame, fields: list[str] = FIELDS, tampered_text: Column | None = None) -> DataFrame:
    """One row a document: ``doc_id``, ``source``, ``leaf``, ``tampered`` (the
    digest of the tampered row, if another), ``subroot``, ``root`` and ``path``,
    the siblings left and right of it a level, from the leaf to the root."""
    # staged first: dealing rows by range reads its input twice, and only this reads texts
    digests = stage(leaves(docs, fields, tampered_text), "merkle-digests")
    rows = stage(ranked(digests, ["source"], ["doc_id", "hash", "tampered"], ["doc_id", "tampered"]), "merkle-leaves")
    tiers = tiers_of(rows, ["source"], "merkle")
    # the sources' own tree: a table of one row a source, in the order of their names
    subroots = tiers[-1].select("source", F.col("node.hash").alias("hash"))
    tree = stage(ranked(subroots, [], ["source"], ["source"]), "merkle-sources")
    top = tiers_of(tree, [], "merkle-top")
    start = top[-1].select(F.col("node.hash").alias("root"), F.array().cast(PATH).alias("path"))
    sources = descend(top, [], start, ["root"])
    begin = stage(sources.select(F.col("kids.source").alias("source"), F.col("hash").alias("subroot"), "path", "root"), "merkle-subroots")
    found = descend(tiers, ["source"], begin, ["subroot", "root"])
    return found.select(F.col("kids.doc_id").alias("doc_id"), "source", F.col("hash").alias("leaf"), F.col("kids.tampered").alias("tampered"), "subroot",
                        "root", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(path, lambda p: F.concat(p["left"], p["right"]))), 256)


def verified_manifest(docs: DataFrame) -> DataFrame:
    """What the query returns: proofs as digests, and every row folded up again,
    where ids allow it from a text without its line breaks."""
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    stripped = F.when(odd, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    m = manifest(docs, tampered_text=stripped)
    folded = m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                      fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


_LEAF = " || ".join(map(_field, FIELDS))
_TAMPERED = " || ".join(_field("changed" if f == "text" else f) for f in FIELDS)


def _crc_steps() -> list[int]:
    """What four zero bits make of each low half byte (the polynomial of crc32)."""
    out = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def _crc32_sql(text: str) -> str:
    """DuckDB has no crc32: two half bytes a character, by the table of steps."""
    halves = f"flatten([[ascii(c)::BIGINT & 15, ascii(c)::BIGINT >> 4] for c in string_split({text}, '')])"
    step = f"xor(a >> 4, list_extract({_crc_steps()}::BIGINT[], (xor(a, x) & 15) + 1))"
    return f"xor(list_reduce([4294967295::BIGINT] || {halves}, lambda a, x: {step}), 4294967295::BIGINT)"


def _tree_sql(name: str, rows: str) -> str:
    """Nodes of all levels of the trees over ``rows`` (k, i, h), and what
    stands left and right of each in its run."""
    return f"""
{name} AS (
    SELECT k, 0 AS lvl, i, h, count(*) OVER (PARTITION BY k) AS n FROM {rows}
    UNION ALL
    SELECT k, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY k, lvl, i // 3, n),
{name}_beside AS (
    SELECT a.k, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
        coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
    FROM {name} a JOIN {name} b ON a.k = b.k AND a.lvl = b.lvl AND a.i // 3 = b.i // 3
    WHERE a.n > 1 GROUP BY a.k, a.lvl, a.i)"""


#: DuckDB: levels by recursion, every leaf's walk to the root by a second one.
SQL = f"""
WITH RECURSIVE docs AS (
    SELECT *, CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
leaf AS (
    SELECT doc_id, coalesce('s' || source, 'n') AS k, sha256({_LEAF}) AS h, sha256({_TAMPERED}) AS t FROM docs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h, t) - 1 AS i FROM leaf),
{_tree_sql("tree", "ranked")},
sub AS (SELECT k AS source_k, h, '' AS k, row_number() OVER (ORDER BY k) - 1 AS i FROM tree WHERE n = 1),
{_tree_sql("top", "sub")},
climb AS (
    SELECT doc_id, h AS leaf, k, 0 AS lvl, i, '' AS proof, t AS acc FROM ranked
    UNION ALL
    SELECT doc_id, leaf, c.k, c.lvl + 1, c.i // 3, proof || l || r, sha256(l || acc || r) FROM climb c JOIN tree_beside b ON b.k = c.k AND b.lvl = c.lvl AND b.i = c.i),
landed AS (
    SELECT c.doc_id, c.leaf, s.h AS subroot, '' AS k, 0 AS lvl, s.i, c.proof, c.acc
    FROM climb c JOIN tree t ON t.k = c.k AND t.lvl = c.lvl AND t.n = 1 JOIN sub s ON s.source_k = c.k),
climb2 AS (
    SELECT * FROM landed
    UNION ALL
    SELECT doc_id, leaf, subroot, c.k, c.lvl + 1, c.i // 3, proof || l || r, sha256(l || acc || r) FROM climb2 c JOIN top_beside b ON b.lvl = c.lvl AND b.i = c.i)
SELECT c.doc_id, c.leaf, c.subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.acc AS folded_root, c.acc = t.h AS verified
FROM climb2 c JOIN top t ON t.lvl = c.lvl AND t.n = 1
"""
