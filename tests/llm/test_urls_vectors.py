import math

import numpy as np

from keyfold.llm.urlfilter import filter_urls, host_scores, judged, linked_hosts, propagate
from keyfold.llm.vectors import nearest, quantise, search, search_block
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, host string, rule string, score double"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "other", "x", 1.0) for i, (u, h) in enumerate(rows)], PAGES)


def test_rules_and_parts(spark):
    rows = [("http://A.Example.ORG/es/1?q#f", None), ("https://example.org/en/12", ""), ("http://example.org/en/2", ""), ("http://notexample.org/es/", ""),
            ("http://x.com/fr/a", ""), ("http://x.com/de/a", ""), ("http://x.com/it/", ""), ("http://x.com", ""), ("no scheme.org/es/", ""), (None, None), ("", ""),
            ("ftp://h.net?://example.org/es/", ""), ("x://org/", ""), ("a://b\nc.org/\nz", "")]
    got = {r.page_id: r for r in filter_urls(pages(spark, rows)).collect()}
    assert [got[i].host for i in (0, 8, 9, 10, 11)] == ["a.example.org", "", "", "", "h.net"]
    assert [got[i].path for i in (0, 1, 7, 11)] == ["/es/1", "/en/12", "", ""]
    assert [got[i].rule for i in range(8)] == ["example.org/es/", "example.org/en/1", "org/", "org/", "com/fr/", "com/de/", None, None]
    assert [got[i].verdict for i in range(6)] == ["block", "block", "allow", "allow", "allow", "block"]
    assert got[12].rule == "org/" and got[13].host == "b\nc.org" and got[8].verdict == "allow"
    assert filter_urls(pages(spark, [])).count() == 0


def slow_scores(edges, seeds, damping=0.85, rounds=12):
    p = dict(seeds)
    out = {}
    for a, _, w in edges:
        out[a] = out.get(a, 0) + w
    for _ in range(rounds):
        new = {h: s * (1 - damping) for h, s in seeds.items()}
        for a, b, w in edges:
            if a in p:
                new[b] = new.get(b, 0) + damping * p[a] * w / out[a]
        p = new
    return p


def test_links_carry_distrust(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">y</a>' for h in hosts)
    rows = [("http://bad.com/de/1", link("worse.net")), ("http://bad.com/de/2", ""), ("http://friend.net/a", link("bad.com", "bad.com", "worse.net")),
            ("http://good.org/a", link("fine.net", "Fine.net")), ("http://fine.net/a", link("good.org")), ("http://alone.net/", "<a href='/local'>"),
            ("http://worse.net/b", link("bad.com"))]
    df = pages(spark, rows)
    verdict = {r.host: r.host_verdict for r in filter_urls(df).collect()}
    assert verdict["friend.net"] == verdict["worse.net"] == "block"
    assert verdict["fine.net"] == verdict["good.org"] == verdict["alone.net"] == "allow"
    edges = [("bad.com", "worse.net", 1), ("friend.net", "bad.com", 2), ("friend.net", "worse.net", 1), ("good.org", "fine.net", 2), ("fine.net", "good.org", 1), ("worse.net", "bad.com", 1)]
    found = judged(df.select("page_id", "url", "html")).withColumn("links", linked_hosts(F.coalesce("html", F.lit(""))))
    got = {r.host: r for r in host_scores(found, rounds=12).collect()}
    trust, distrust = slow_scores(edges, {"good.org": 1.0}), slow_scores([(b, a, w) for a, b, w in edges], {"bad.com": 1.0})
    for h in {*trust, *distrust}:
        assert math.isclose(got[h].trust, trust.get(h, 0), abs_tol=1e-12) and math.isclose(got[h].distrust, distrust.get(h, 0), abs_tol=1e-12)


def test_ranks_settle_and_hubs_are_salted(spark):
    """A chain longer than any fixed number of rounds would reach, two rings and a
    hub whose edges are dealt over many salts."""
    edges = [(f"c{i}", f"c{i + 1}", 1) for i in range(40)] + [("a", "b", 1), ("b", "a", 3), ("b", "c0", 1)]
    edges += [("hub", f"h{i}", 1 + i % 3) for i in range(60)] + [(f"h{i}", "hub", 1) for i in range(60)] + [("c40", "hub", 1)]
    seeds = {"trust": {"a": 0.75, "h3": 0.25}, "distrust": {"c0": 1.0}}
    df = spark.createDataFrame([(k, *e) for k in seeds for e in edges], "kind string, src string, dst string, w long")
    given = spark.createDataFrame([(k, h, s) for k, v in seeds.items() for h, s in v.items()], "kind string, host string, s double")
    got = {(r.kind, r.host): r.p for r in propagate(df, given, fan=7).collect()}
    for k, v in seeds.items():
        want = slow_scores(edges, v, rounds=400)
        assert {h for (kind, h) in got if kind == k} == set(want)
        assert all(math.isclose(got[k, h], p, abs_tol=1e-6) for h, p in want.items())
    assert got["distrust", "c40"] > 0


def test_pages_far_from_a_seed_are_judged(spark):
    """Twenty hosts in a row point at the next; the last is blocked."""
    rows = [(f"http://n{i}x.net/", f'<a href="http://n{i + 1}x.net/">') for i in range(20)] + [("http://n20x.net/", '<a href="http://bad.com/">'), ("http://bad.com/de/1", "")]
    got = {r.host: r.verdict for r in filter_urls(pages(spark, rows)).collect()}
    assert set(got.values()) == {"block"} and len(got) == 22


def brute(rows, every, k):
    out = []
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for q, a in {(i, tuple(v)) for i, v in good if i % every == 0}:
        near = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))), i) for i, b in good if i != q and len(b) == len(a))[:k]
        out += [(q, r + 1, i, round(d, 9)) for r, (d, i) in enumerate(near)]
    return sorted(out)


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[i - 300][1]) for i in range(300, 340)] + [(341, None), (342, []), (343, [0.0] * 8), (344, [1.0, None] * 4), (400, [float("nan")] * 8),
                                                                (500, [float("inf")] * 8), (None, [1.0] * 8), (600, [1.0, 2.0]), (601, [2.0, 1.0]), (700, [3.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in search(df, 20, 10).collect())
    assert got == brute(rows, 20, 10)
    assert search(df.limit(0)).count() == 0


def test_tiles_merge_to_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(-3, 4, 6) / 2).astype(np.float32).tolist()) for i in range(400)]  # many ties
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>")
    monkeypatch.setattr("keyfold.llm.vectors.QUERY_ROWS", 9)
    monkeypatch.setattr("keyfold.llm.vectors.CANDIDATE_ROWS", 60)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in nearest(df, F.col("vec_id") % 10 == 0, 5).collect())
    assert got == brute(rows, 10, 5)


def test_bounds_hold():
    rng = np.random.default_rng(7)
    v = rng.standard_normal((50, 16)) * 10.0 ** rng.integers(-3, 4, (50, 1))
    q, s, lost = quantise(v)
    assert np.allclose(np.linalg.norm(v - q * s[:, None], axis=1), lost)
    ids = np.arange(50)
    a, b, d = search_block(ids, v, ids, v, 3)
    for i in range(50):
        want = sorted((float(np.sqrt(((v[i] - v[j]) ** 2).sum())), j) for j in range(50) if j != i)[:3]
        assert [j for _, j in want] == b[a == i].tolist()


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.vec_id) for r in search(df).collect()) == [(0, 100), (100, 0)]
