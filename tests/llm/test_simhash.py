import random

import numpy as np
import xxhash

from keyfold.llm.components import components
from keyfold.llm.simhash import _bits, _forest, deduplicated, fingerprints, near_duplicates, partitions, plan_search

from .conftest import awkward_rows


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """rows: (doc_id, fingerprint); the least id reachable by rows."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(rows))]


def test_fingerprints_equal_the_definition():
    rnd = random.Random(3)
    texts = ["", None, "a", "A b", "Ab  c\x0bD", *(" ".join(rnd.choice("uvwxyz") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 50))) for _ in range(60))]
    got = fingerprints([None if t is None else t.encode() for t in texts]).view(np.uint64)
    assert [int(x) for x in got] == [slow_fingerprint(t) for t in texts]


def test_plan_covers_the_distance():
    rng = np.random.default_rng(1)
    fps = rng.integers(-2**62, 2**62, 500)
    for n in (500, 10**6, 10**8):
        plan = plan_search(fps, n)
        bits = [b for part, _ in plan for b in part]
        assert len(bits) == len(set(bits)) and sum(t + 1 for _, t in plan) == 4
    assert sorted(b for p in partitions(_bits(fps), 4) for b in p) == list(range(64))


def test_forest_keeps_the_components():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(25)}
    a = np.array(sorted(values), np.uint64).view(np.int64)
    u, v = _forest(a, a, 3)
    parent = {int(x): int(x) for x in a}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x, y in zip(u.tolist(), v.tolist()):
        assert (int(np.int64(x).view(np.uint64)) ^ int(np.int64(y).view(np.uint64))).bit_count() <= 3
        parent[find(x)] = find(y)
    rows = [(i, int(x)) for i, x in enumerate(a.view(np.uint64))]
    want = slow_components(rows)
    got = [find(int(x)) for x in a]
    assert len(u) <= len(a) - 1
    assert {frozenset(i for i in range(len(a)) if want[i] == w) for w in set(want)} == {frozenset(i for i in range(len(a)) if got[i] == g) for g in set(got)}


def test_near_duplicates_equal_brute_force(spark, make_docs, monkeypatch):
    rnd = random.Random(9)
    rows = awkward_rows()
    for i in range(40):
        words = [rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(rnd.randint(30, 200))]
        for k in range(rnd.randint(1, 4)):
            some = list(words)
            some[rnd.randrange(len(some))] = "changed"
            rows.append((100 + i * 10 + k, " ".join(some if k else words)))
    docs = make_docs(rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id is None, r.component_id or 0) for r in near_duplicates(docs).collect())
    fps = [(d, slow_fingerprint(t)) for d, t, *_ in rows]
    want = sorted((d is None, d or 0, f"{f:016x}", c is None, c or 0) for (d, f), c in zip(fps, slow_components(fps)))
    assert got == want
    # the tiles of hot buckets give the same components
    monkeypatch.setattr("keyfold.llm.simhash.HOT", 1)
    monkeypatch.setattr("keyfold.llm.simhash.TILE", 7)
    hot = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id is None, r.component_id or 0) for r in near_duplicates(docs).collect())
    assert hot == want
    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    comps = slow_components(fps)
    by = {}
    for (d, f), c in zip(fps, comps):
        by.setdefault(c if c is not None else ("none", f), []).append(d)
    assert kept.count() == len(by)
    assert {r.doc_id for r in kept.collect()} == {c for c in comps}


def test_empty_table(make_docs):
    assert near_duplicates(make_docs([])).count() == 0
    assert deduplicated(make_docs([])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
