import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from keyfold.llm import personal
from keyfold.llm.bilstm import Tagger
from keyfold.llm.personal import BASE_KINDS, CARD, EMAIL, IP, KINDS, PHONE, WINDOW, added_spans, assigned_secrets, base_spans, find_personal, fit_tagger, whole_run, form_holds, luhn, reconcile, redacted, window_starts

from .conftest import awkward_rows


def digits(s):
    return re.sub("[^0-9]", "", s)


def slow_base(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m.group())) <= 15]


def test_base_equals_the_patterns():
    rnd = random.Random(5)
    bits = ["a", "@", ".", "1", "9", "+", " ", "-", "a@b.c", "4111111111111111", "(", "255.1.1.1", "é", "%", "+1 (208) 555-1177"]
    for _ in range(5000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        assert base_spans(t) == slow_base(t), t


def test_windows_cover_every_trigger():
    rnd = random.Random(6)
    for _ in range(300):
        t = "".join(rnd.choice("ab" * 40 + "1@") for _ in range(rnd.randint(0, 700)))
        starts = window_starts(t)
        assert starts == sorted(set(starts))
        for i, c in enumerate(t):
            if c in "1@":
                assert sum(s <= i < s + WINDOW for s in starts) >= 1
        assert all(any(c in "1@" for c in t[s:s + WINDOW]) for s in starts)


def test_gradients():
    tagger = Tagger(5, np.ones((3, 3), bool), hidden=3)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 5, (2, 6)), rng.integers(0, 3, (2, 6))
    _, grads = tagger.loss(x, y)
    for k, v in tagger.p.items():
        at = tuple(int(rng.integers(0, n)) for n in v.shape)
        v[at] += 1e-3
        up = tagger.loss(x, y)[0]
        v[at] -= 2e-3
        down = tagger.loss(x, y)[0]
        v[at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-3, k


@pytest.fixture(scope="module")
def tagger():
    return fit_tagger([], n_composed=2_000, epochs=12)


def test_tagger_parts_what_the_patterns_join(tagger):
    cases = ["call +1 (208) 555-1177 4284896609045836 now", "from 71.129.171.132 4815819516090933 it was", "or +1 (769) 555-5841 +1 (208) 555-1177 then"]
    found = added_spans(tagger, cases, [base_spans(c) for c in cases])
    texts = [{c[a:b] for _, a, b in f} for c, f in zip(cases, found)]
    hits = sum(len(t & {"+1 (208) 555-1177", "4284896609045836", "4815819516090933", "+1 (769) 555-5841"}) for t in texts)
    assert hits >= 3, texts
    for c, f in zip(cases, found):
        assert all(form_holds(k, c[a:b]) for k, a, b in f)


def test_viterbi_equals_enumeration():
    """The best of all legal tag paths, tried one by one."""
    tagger = Tagger(5, personal._allowed()[:5, :5], hidden=3, seed=4)
    rng = np.random.default_rng(2)
    tagger.p["t"] = rng.standard_normal((5, 5))
    x = rng.integers(0, 5, (6, 5))
    tags, margin = tagger.decode(x)
    scores, _ = tagger.emissions(x)
    for i in range(len(x)):
        def total(path):
            steps = zip(path, path[1:])
            return sum(scores[t, i, k] for t, k in enumerate(path)) + sum(tagger.p["t"][a, b] if tagger.allowed[a, b] else -1e4 for a, b in steps)
        best = max(itertools.product(range(5), repeat=5), key=total)
        assert tuple(tags[i]) == best
        assert np.allclose(margin[i], [scores[t, i, k] - scores[t, i, 0] for t, k in enumerate(best)])


def test_reconcile_equals_enumeration():
    rng = random.Random(8)
    for _ in range(400):
        cand = {}
        for _ in range(rng.randint(0, 7)):
            a = rng.randint(0, 20)
            cand[rng.choice(KINDS), a, a + rng.randint(1, 6)] = rng.uniform(-1, 5)
        base = [("ip", a, a + rng.randint(1, 4)) for a in (rng.randint(0, 22) for _ in range(rng.randint(0, 3)))]
        free = [(s, w) for s, w in cand.items() if w > 0 and all(s[2] <= a or b <= s[1] for _, a, b in base)]
        apart = lambda set_: all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(set_, 2))
        best = max(sum(w for _, w in c) for n in range(len(free) + 1) for c in itertools.combinations(free, n) if apart([s for s, _ in c]))
        got = reconcile(cand, base)
        assert apart(got) and set(got) <= {s for s, _ in free} and abs(sum(cand[s] for s in got) - best) < 1e-9


def test_long_runs_and_many_spans_take_linear_time():
    start = time.time()
    digits_ = "3" * 1_000_000
    assert assigned_secrets("A" * 300_000) == [] and assigned_secrets(f"{'a' * 300_000} key = {'ab1' * 9}") == [("secret", 300_007, 300_034)]
    assert base_spans(digits_ + ".") == [] and base_spans("1." + digits_ + ".2.3 4.4.4.4") == [("ip", 1_000_007, 1_000_014)]
    assert len(base_spans("1.1.1." * 100_000)) == 75_000
    many = [("ip", i * 10, i * 10 + 5) for i in range(50_000)]
    cand = {("card", i * 10 + 5, i * 10 + 9): 1.0 for i in range(50_000)} | {("phone", i * 10 + 4, i * 10 + 8): 9.0 for i in range(50_000)}
    assert len(reconcile(cand, many)) == 50_000
    assert time.time() - start < 10


def test_secrets(tagger):
    """A key that is assigned to a name, wherever windows cut it; not the same run without one."""
    key, rng = "5c4a26e9bd0c2c2e356de5663481732ff8d0ec46", random.Random(5)
    cases = ["x " * n + f'token = "{key}" and so on' for n in range(0, 50)]
    found = added_spans(tagger, cases, [base_spans(c) for c in cases])
    hit = sum(("secret", c.index(key), c.index(key) + 40) in f for c, f in zip(cases, found))
    assert hit >= 45
    assert all(c[a:b] == key for c, f in zip(cases, found) for k, a, b in f if k == "secret")
    words = ["the", "commit", "of", "version", "2024-01-02", "17", "and", "hash"]
    clean = [" ".join(rng.choice(words) for _ in range(40)) + f" {key[:rng.choice([7, 12, 40])]} " + "and then some " * 3 for _ in range(50)]
    assert sum(map(len, added_spans(tagger, clean, [base_spans(c) for c in clean]))) <= 2
    assert whole_run("a b1234=c d", 3, 5) == (2, 9) and whole_run("a b1 c", 1, 3) == (1, 3)
    assert form_holds("secret", key) and not form_holds("secret", "a" * 40) and not form_holds("secret", "1" * 40) and not form_holds("secret", "abc123")


def test_clean_texts_get_nothing(tagger):
    rnd = random.Random(3)
    clean = ["In 2024 we sold 1,250 of 30 kinds at 19.99 each, version 1.2.3.", "", "no digits at all " * 50, "2023-01-15 10:30:00 12345678 AKIA12345"]
    clean += [" ".join(rnd.choice(["and", "of", "17", "3.5", "1999", "10:45"]) for _ in range(100)) for _ in range(30)]
    assert added_spans(tagger, clean, [base_spans(c) for c in clean]) == [[] for _ in clean]


def test_reconcile_keeps_base_and_the_best_set():
    got = reconcile({("card", 0, 5): 2.0, ("phone", 3, 9): 3.0, ("ip", 9, 12): 1.0, ("email", 20, 30): 5.0, ("card", 40, 50): -1.0}, [("email", 25, 35)])
    assert sorted(got) == [("ip", 9, 12), ("phone", 3, 9)]
    assert reconcile({("card", 0, 5): 2.0, ("phone", 5, 9): 2.0, ("ip", 0, 9): 3.0}, []) == [("phone", 5, 9), ("card", 0, 5)]


def test_query_on_awkward_rows(make_docs, monkeypatch):
    monkeypatch.setattr(personal, "COMPOSED_WINDOWS", 200)
    monkeypatch.setattr(personal, "EPOCHS", 2)
    monkeypatch.setattr(personal.fit_tagger, "__defaults__", (200, 2, 3))
    rows = awkward_rows() + [(50, "mail a.b@c.example.com, 10.0.0.1 and 4111 1111 1111 1111 or +44 20 7946 0958")]
    docs = make_docs(rows)
    got = find_personal(docs).collect()
    assert len(got) == len(rows)
    want = {}
    for doc_id, t, *_ in rows:
        base = sorted(slow_base(t or ""), key=lambda s: (KINDS.index(s[0]), s[1]))
        want.setdefault(doc_id, []).append(base)
    for r in got:
        base = next(b for b in want[r.doc_id] if hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in b).encode()).hexdigest() == r.base_sha256)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in base) for k in BASE_KINDS]
        assert {f"{k}:{a}:{z}" for k, a, z in base} <= set(r.spans.split(",")) | set()
    out = redacted(docs)
    assert out.columns == docs.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[50] == "mail [email], [ip] and [card] or [phone]" and text[1] is None and text[4] == "word"
    assert find_personal(make_docs([])).count() == 0
