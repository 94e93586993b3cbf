import hashlib
import random
import re

from keyfold.llm.decontaminate import Automaton, contamination, decontaminated, merge, without_spans

from .conftest import awkward_rows


def brute(words, items, window):
    hit, found = set(), set()
    for item, ws in items:
        k = min(window, len(ws))
        for a in range(len(ws) - k + 1 if ws else 0):
            for p in range(len(words) - k + 1):
                if words[p:p + k] == ws[a:a + k]:
                    hit.update(range(p, p + k))
                    found.add(item)
    return hit, found


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_automaton_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(800):
        alphabet = [b"a", b"b", b"c"][:rnd.randint(1, 3)]
        items = [(str(i), [rnd.choice(alphabet) for _ in range(rnd.randint(0, 9))]) for i in range(rnd.randint(0, 5))]
        window = rnd.randint(1, 5)
        doc = [rnd.choice([*alphabet, b"z"]) for _ in range(rnd.randint(0, 25))]
        spans, found = Automaton(items, window).scan(doc)
        assert ({i for a, b in spans for i in range(a, b)}, found) == brute(doc, items, window)


def bench_rows(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_contamination_equals_brute_force(spark, make_docs):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(30)] + ["É", "漢"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 30)))) for i in range(12)]
    items += [(5, items[5][1]), (50, None), (51, "!!!"), (None, "null id item of some words that are more than ten words long"), (60, "w1")]
    rows = list(awkward_rows())
    for i in range(60):
        words = [rnd.choice(vocab[:20]) for _ in range(rnd.randint(0, 60))]
        if i % 2:
            src = (items[rnd.randrange(12)][1]).split()
            a = rnd.randint(0, max(0, len(src) - 3))
            words[10:10] = [w.upper() for w in src[a:a + rnd.randint(1, 25)]]
        rows.append((200 + i, rnd.choice([" ", ", ", "\n"]).join(words)))
    bench = bench_rows(spark, items)
    named = [("" if i is None else str(i), words_of(t)) for i, t in items]
    want = []
    for doc_id, text, *_ in rows:
        words = words_of(text)
        hit, found = brute(words, named, 10)
        want.append(str((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))))
    for block_words in (200_000, 40):  # one automaton, several
        got = contamination(make_docs(rows), bench, block_words=block_words).collect()
        assert sorted(str(tuple(r)) for r in got) == sorted(want)


def test_spans_are_cut_and_clean_texts_stay(spark, make_docs):
    item = " ".join(f"item{i}" for i in range(25))
    bench = bench_rows(spark, [(1, item), (2, "only three words")])
    clean = "Nothing of it; here are some other words, and more."
    around = " ".join(f"own{i}" for i in range(60))
    rows = [(1, clean), (2, f"Before, {item.upper()}! {around}"), (3, item), (4, None), (5, ""), (6, f"{around} only three, words after"),
            # what cutting joins is cut too
            (7, f"{around} " + " ".join(f"item{i}" for i in range(8)) + f" {item} " + " ".join(f"item{i}" for i in range(8, 16)) + f" {around}")]
    docs = make_docs(rows)
    out = decontaminated(docs, bench)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {1, 2, 4, 5, 6, 7}
    assert got[1].text == clean and got[1].n_chars == len(clean) and got[4].text is None and got[5].text == ""
    assert got[2].text == f"Before, ! {around}" and got[2].n_chars == len(got[2].text)
    assert got[6].text == f"{around}  after" and "item" not in got[7].text
    assert not any(r.contaminated for r in contamination(out, bench).collect())
    assert decontaminated(make_docs([]), bench).count() == 0
    assert decontaminated(docs, bench_rows(spark, [])).count() == len(rows)


def test_merge_and_cut():
    assert merge([(3, 5), (0, 2), (4, 9), (2, 3)]) == [(0, 9)]
    assert without_spans("a, B c! d", [(1, 3)]) == "a, ! d"
