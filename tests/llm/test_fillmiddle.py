import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyfold.llm.fillmiddle import as_texts, fill_in_middle, gather, line_cuts, middle_digests, places, restored, scatter, text_bytes

from .conftest import awkward_rows

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def by_hand(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    lines = LINE.findall(text)
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def random_texts(n=3000, seed=1):
    rng = random.Random(seed)
    fixed = ["", "a", "a\n", "\n", "\n\n", "a\nb\nc", "<P", "x<P>y\n", "é\n漢字\nq", "<\n<\nP>", " P>\n<M\nS>", "", "", "<\n", "P>", "z", "\U0001F600\n\r\n"]
    return fixed + ["".join(rng.choice("ab\n<>PSMé漢") for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize("offset", [0, 5])
def test_scatter_and_gather_equal_strings(offset):
    texts = random_texts()[offset:]
    data, starts = text_bytes(pa.array(["skipped"] * offset + texts, pa.string()).slice(offset))
    lines, cut = line_cuts(data, starts)
    parts = [LINE.findall(t) for t in texts]
    assert lines.tolist() == list(map(len, parts))
    rng = random.Random(2)
    cuts = [sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1))) for p in parts]
    form = np.array([0 if not t or any(m in t for m in ("<P>", "<S>", "<M>")) else rng.choice([1, 2]) for t in texts])
    a, b = (cut(np.array([c[i] for c in cuts])) for i in (0, 1))
    out, out_starts = scatter(data, starts, a, b, form)
    want = []
    for p, (x, y), f, t in zip(parts, cuts, form, texts):
        pre, mid, suf = "".join(p[:x]), "".join(p[x:y]), "".join(p[y:])
        want.append([t, f"<P>{pre}<S>{suf}<M>{mid}", f"<S>{suf}<P>{pre}<M>{mid}"][f])
    assert as_texts(out, out_starts).to_pylist() == want
    # from outputs and forms alone
    assert as_texts(*gather(out, out_starts, form)).to_pylist() == texts


def test_places_with_empty_segments():
    # two texts of 3 and 2 bytes; the second segment of the first is empty
    starts = [np.array([0, 3]), np.array([2, 3]), np.array([2, 5])]
    shifts = [np.array([10, 0]), np.array([99, 7]), np.array([-2, 55])]
    assert places(starts, shifts, 5).tolist() == [10, 11, 0, 10, 11]


def test_a_lost_mark_is_seen():
    data, starts = text_bytes(pa.array(["<P>a<S>b"], pa.string()))
    with pytest.raises(ValueError):
        gather(data, starts, np.array([1]))


def test_awkward_rows(spark, make_docs):
    rows = awkward_rows() + [(20 + i, t) for i, t in enumerate(random_texts(300, 3))] + [(400, "line\n" * 200_000), (401, "a\nb\nc"), (401, "a\nb\nc")]
    docs = make_docs(rows)
    got = sorted(map(tuple, restored(fill_in_middle(docs)).collect()), key=repr)
    want = sorted(((r[0], *by_hand(r[0], r[1]), r[1] or "") for r in rows), key=repr)
    assert got == want


def test_rates(spark, make_docs):
    rows = [(i, f"a{i}\nb\nc") for i in range(400)]
    for rate, spm in ((0, 50), (30, 100), (100, 0)):
        got = sorted(map(tuple, fill_in_middle(make_docs(rows), seed=11, rate=rate, spm=spm).collect()))
        assert got == sorted((r[0], *by_hand(*r, 11, rate, spm)) for r in rows)


def test_query(spark, make_docs):
    rows = [(i, t) for i, t in enumerate(random_texts(200, 5))]
    got = {r["doc_id"]: r for r in middle_digests(make_docs(rows)).collect()}
    for doc_id, text in rows:
        n, form, p, m, out = by_hand(doc_id, text)
        r = got[doc_id]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest() and r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert middle_digests(make_docs(rows).filter(F.lit(False))).count() == 0
