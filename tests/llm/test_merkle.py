import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from keyfold.llm import merkle
from keyfold.llm.merkle import ARITY, fold, manifest, proof_digest, verified_manifest

from .conftest import awkward_rows


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return digest("".join(map(part, (doc_id, source, lang, n_chars, text))))


def tree(nodes):
    """(top, siblings left and right of each leaf, level by level)."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(now) > 1:
        for k, i in enumerate(at):
            run = i // ARITY * ARITY
            paths[k].append(("".join(now[run:i]), "".join(now[i + 1:run + ARITY])))
            at[k] = i // ARITY
        now = [digest("".join(now[i:i + ARITY])) for i in range(0, len(now), ARITY)]
    return now[0], paths


def by_hand(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    tops, inner = {}, {}
    for s, members in sources.items():
        def other(r):
            odd = r[0] is not None and r[4] is not None and "\n" in r[4] and zlib.crc32(str(r[0]).encode()) % 2 == 0
            return leaf(*r[:4], r[4].replace("\n", "")) if odd else leaf(*r)
        # the query orders rows of one id by leaf, then by whether they change
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        tops[s], paths = tree([leaf(*r) for r in members])
        inner[s] = [(r[0], leaf(*r), other(r), p) for r, p in zip(members, paths)]
    order = sorted(tops, key=lambda s: (s is not None, (s or "").encode()))
    root, outer = tree([tops[s] for s in order])
    out = []
    for s, p2 in zip(order, outer):
        for doc_id, own, other, p1 in inner[s]:
            folded = other
            for left, right in p1 + p2:
                folded = digest(left + folded + right)
            out.append((doc_id, own, tops[s], root, digest("".join(a + b for a, b in p1 + p2)), folded, folded == root))
    return sorted(out, key=repr)


def check(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in verified_manifest(docs).collect()), key=repr)
    assert got == by_hand(rows)
    return got


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_sizes_of_sources(spark, make_docs, monkeypatch, depth):
    """Sources of 1 to 28 leaves and more: lone last nodes, full trees, several tiers."""
    for f in (merkle.rollup, merkle.listed, merkle._emit, merkle.tiers_of, merkle.descend):
        monkeypatch.setattr(f, "__defaults__", (depth,))
    sizes = [1, 2, 3, 4, 5, 9, 10, 27, 28, 82] if depth > 1 else [1, 3, 4, 10]
    rows = [(1000 * n + i, f"text {i}\nof {n}", "en", f"s{n}") for n in sizes for i in range(n)]
    got = check(make_docs(rows, 4))
    assert len(got) == sum(sizes) and not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_awkward_rows(spark, make_docs):
    # rows of one id are alike or differ in their leaf
    rows = awkward_rows() + [(30, "a\nb", None, None), (31, "", None, ""), (32, None, "en", "é"), (33, "x\n", "en", "Z"), (34, "x\n" * 9, "en", "z")]
    check(make_docs(rows))


def test_one_row_and_none(spark, make_docs):
    one = check(make_docs([(0, "a\nb", "en", "s")]))
    assert one[0][1] == one[0][2] == one[0][3] and one[0][4] == digest("")  # a lone leaf is the root, its proof is empty
    assert verified_manifest(make_docs([(0, "a", "en", "s")]).filter(F.lit(False))).count() == 0


def test_any_change_is_seen(spark, make_docs):
    rows = [(i, f"text {i}", "en", "ab"[i % 2]) for i in range(50)]
    m = manifest(make_docs(rows))
    got = m.select(fold(F.col("leaf"), F.col("path")).alias("own"), "root", fold(F.sha2(F.lit("x"), 256), F.col("path")).alias("bad"),
                   proof_digest(F.col("path")).alias("p")).collect()
    assert all(r["own"] == r["root"] != r["bad"] for r in got) and len({r["p"] for r in got}) == 50
    other = manifest(make_docs([(*r[:1], r[1] + "!" * (r[0] == 17), *r[2:]) for r in rows])).first()["root"]
    assert other != got[0]["root"]
