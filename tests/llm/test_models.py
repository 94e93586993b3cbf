import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyfold.llm import toxicity
from keyfold.llm.language import UNKNOWN, Classifier, dictionaries, predict_language, sample
from keyfold.llm.toxicity import KneserNey, Scorer, Slots, fit, fit_logistic, in_fold, score_toxicity, without_toxic

from .conftest import awkward_rows

TOXIC = ["vilefool", "vilehead", "scumbag", "vilething"]


def corpus(n, seed=1, toxic_share=0.2):
    rnd = random.Random(seed)
    parts = ["an", "ther", "ing", "ou", "re", "st", "ble", "on", "ha", "ed"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(5, 120))]
        toxic = rnd.random() < toxic_share
        if toxic:
            for _ in range(rnd.randint(2, 5)):
                words.insert(rnd.randint(0, len(words)), rnd.choice(TOXIC))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, text string")


def test_models_are_normalised_and_tell_words_apart():
    words = ["that", "than", "then", "trash", "trasher", "the", "vile"]
    counts = np.array([[2, 30], [3, 40], [2, 30], [20, 0], [9, 0], [30, 500], [25, 0]])
    model = KneserNey(words, counts)
    gap = dict(zip(words, model.evidence(words)))
    assert gap["trash"] > 3 and gap["vile"] > 0.5 and abs(gap["the"]) < 2 and gap["trash"] > gap["than"]
    assert model.evidence(["trashy"])[0] > 2  # what begins alike is smoothed alike
    assert abs(model.evidence(["zzz"])[0]) < 1  # rare in both: the shared backoff decides nothing
    assert len(model.evidence([])) == 0


def test_no_ngram_is_lost():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 400_000, dtype=np.uint64) * np.uint64(2))
    values = rng.random((len(keys), 2)).astype(np.float32)
    table = Slots.build(keys, values)
    assert (table.get(keys, -1.0) == values).all()
    assert (table.get(keys + np.uint64(1), -1.0) == -1).all()


def test_discounts_come_from_all_counts(monkeypatch):
    met, real = [], toxicity._discounts
    monkeypatch.setattr(toxicity, "_discounts", lambda total: met.append(total.copy()) or real(total))
    KneserNey(["abcdefgh", "ijklmnop"], np.array([[1, 0], [0, 1]]))
    assert len(met) > 6 and all((m == 1).any() for m in met)  # every n-gram is seen once


def test_rare_class_has_its_part(spark):
    labels = label_table(spark, [(i, 1, int(i % 100 == 0)) for i in range(1000)])
    some, stands = toxicity.labelled(labels, F.lit(True), 40)
    toxic = [r.toxic for r in some.collect()]
    assert len(toxic) == 40 and sum(toxic) == 10 and stands == {True: 1.0, False: 33.0}


def test_shared_orders_are_counted_over_all_documents(spark, make_docs):
    rows, labels = corpus(200, 4)
    docs = make_docs(rows + [(5000 + i, "жжж ßßß") for i in range(3)])
    letters = set("".join(t for _, t in rows)) - {" "} | set("жß")
    assert round(1 / fit(docs, label_table(spark, labels), F.lit(True)).model.base) == len(letters) + 1


def test_counts_by_spark_are_those_of_one_process(spark):
    words = ["that", "than", "trash", "trasher", "the", "vile", "a"]
    counts = [(w, i + 1, 3 * i) for i, w in enumerate(words)]
    frame = spark.createDataFrame(counts, "word string, toxic long, plain long").repartition(3)
    a = KneserNey(words, np.array([c[1:] for c in counts])).evidence([*words, "thrash"])
    b = KneserNey.of(toxicity.counted(frame, frame.select("word"))).evidence([*words, "thrash"])
    assert np.allclose(a, b)


def test_windows_find_few_words_in_a_long_text():
    rows, labels = corpus(400)
    from collections import Counter
    seen = [Counter(), Counter()]
    for (_, text), (_, _, t) in zip(rows, labels):
        seen[t].update(text.split())
    words = sorted({*seen[0], *seen[1]})
    scorer = Scorer(KneserNey(words, np.array([[seen[1][w], seen[0][w]] for w in words])))
    calm = " ".join(rows[i][1] for i in range(len(rows)) if not labels[i][2])
    x = scorer.features([calm, f"{calm} scumbag vilehead {calm}", "", None])
    assert x[1, 2] > x[0, 2] + 0.5 and not x[2].any() and not x[3].any()
    assert scorer.features([calm + "\n" + calm]).shape == x[:1].shape


def test_texts_without_spaces_have_words():
    rows, labels = corpus(400)
    from collections import Counter
    seen = [Counter(), Counter()]
    for (_, text), (_, _, t) in zip(rows, labels):
        seen[t].update(text.split())
    words = sorted({*seen[0], *seen[1]})
    scorer = Scorer(KneserNey(words, np.array([[seen[1][w], seen[0][w]] for w in words])))
    calm = " ".join(rows[i][1] for i in range(100) if not labels[i][2])
    spaced = f"{calm} scumbag vilehead {calm}"
    x = scorer.features([spaced, *(spaced.replace(" ", c) for c in (",", "_", "/"))])
    assert np.allclose(x, x[0])  # window, mean and size are those of words
    assert (scorer.features(["漢字" * 5_000])[0, -2:] <= [toxicity.CLIP, np.log1p(10_000)]).all()
    assert scorer.features(["a" * 3_200])[0, -1] == np.log1p(100)


def test_logistic_fits():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 2))
    y = (x[:, 0] * 2 - x[:, 1] + rng.standard_normal(500) * 0.3 > 0.2).astype(float)
    w = fit_logistic(x, y)
    assert (((x @ w[:2] + w[2]) > 0) == (y > 0)).mean() > 0.93


def test_toxicity_held_out(spark, make_docs):
    rows, labels = corpus(900)
    docs = make_docs(rows)
    got = {r.doc_id: r for r in score_toxicity(docs, label_table(spark, labels)).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i, r in got.items() if r.held_out]
    assert len(got) == 900 and {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1} == set(held)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.96
    kept = without_toxic(docs, label_table(spark, labels))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_awkward(spark, make_docs):
    rows, labels = corpus(200, 3)
    rows = [(i + 1000, t) for i, t in rows] + awkward_rows()
    labels = [(i + 1000, q, t) for i, q, t in labels] + [(None, 1, 1), (1000, 1, None), (77_777, 1, 1), (1001, 0, 1), (1001, 0, 0)]
    docs = make_docs(rows)
    got = score_toxicity(docs, label_table(spark, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and all(r.held_out is False for r in got if r.doc_id is None)
    empty = [r.score for r in got if r.doc_id in (1, 2, 3)]
    assert len(set(empty)) == 1 and empty[0] < 0.7
    assert score_toxicity(make_docs([]), label_table(spark, labels)).count() == 0
    for some in ([], [(i, q, 0) for i, q, _ in labels if i]):  # no labels, one class
        assert {r.score for r in score_toxicity(docs, label_table(spark, some)).collect()} == {0.0}


def test_toxicity_ignores_the_held_out_labels(spark, make_docs):
    rows, labels = corpus(300, 5)
    docs = make_docs(rows)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (sorted(tuple(r) for r in score_toxicity(docs, label_table(spark, x)).collect()) for x in (labels, flipped))
    assert a == b
    assert fit(docs, label_table(spark, labels), ~in_fold(3, 1), 50).model is not None


LANGS = {"en": ["the", "thing", "ation", "with", "ould"], "de": ["der", "schaft", "heit", "über", "ung"], "fr": ["le", "tion", "eau", "où", "ment"]}


def language_rows(n, seed=1):
    rnd = random.Random(seed)
    return [(i, " ".join("".join(rnd.choice(LANGS[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(8, 150))), lang)
            for i in range(n) for lang in [rnd.choice(list(LANGS))]]


def test_language_held_out(make_docs):
    rows = language_rows(600)
    got = {r.doc_id: r for r in predict_language(make_docs(rows)).collect()}
    held = {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2}
    assert held == {i for i, r in got.items() if r.held_out}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_awkward(make_docs):
    rows = [(i + 1000, t, lang) for i, t, lang in language_rows(200)] + awkward_rows()
    got = predict_language(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[i].lang_pred for i in (1, 2, 3, 10)] == [UNKNOWN] * 4 and by[1].score == 0
    assert {r.lang_pred for r in got} <= {*LANGS, UNKNOWN, "en", "fr", "b"}
    assert predict_language(make_docs([])).count() == 0
    assert {r.lang_pred for r in predict_language(make_docs([(1, "abc", None), (2, "x", None)])).collect()} == {UNKNOWN}


def test_dictionaries_are_not_the_openings(make_docs):
    opening = ("der schaft über heit ung derung heitschaft " * 5)[:200]
    rnd = random.Random(9)
    rows = [(i, (opening if lang == "en" else "") + t, lang, "hot" if rnd.random() < 0.8 else f"s{i % 7}")
            for i, t, lang in language_rows(900, 7)]
    dicts = dictionaries(sample(make_docs(rows), F.lit(True)))
    assert dicts["en"].count("derung heitschaft".encode()) <= 10
    assert len(dicts["en"]) > 30_000
    c = Classifier(dicts)
    assert all(c.predict(t)[0] == lang for _, t, lang in language_rows(60, 11))


def test_sources_take_turns(make_docs):
    rows = [(i, f"hot {i} " + "x" * i, "en", "hot") for i in range(4000)] + [(5000 + i, f"rare {i}", "en", "rare") for i in range(20)]
    got = [p for _, p in sample(make_docs(rows), F.lit(True))]
    assert sum(p.startswith("rare") for p in got) == 20
    rows = [(i, f"s{i % 5} " + "y" * 300, "en", f"s{i % 5}") for i in range(5000)]
    of = [p[:2] for _, p in sample(make_docs(rows), F.lit(True)) if p[0] == "s"]
    assert all(60 < of.count(f"s{k}") < 250 for k in range(5))  # sources over the level share the texts evenly


def test_narrow_margins_are_rejected():
    c = Classifier(dictionaries([("en", "the thing with that " * 50), ("de", "der heit schaft ung " * 50)]))
    assert c.predict("the thing with that thing")[:1] == ("en",)
    lang, score, rejected = c.predict("q")
    assert lang in ("en", "de") and (rejected or score >= 0.5)
    assert Classifier({}).predict("abc") == (UNKNOWN, 0.0, True)
    long = c.predict("der heit schaft ung " * 20_000)
    assert long[0] == "de" and not long[2]


@pytest.mark.parametrize("upper", [False, True])
def test_case_does_not_matter(upper):
    c = Classifier(dictionaries([("en", "the thing with that " * 50), ("de", "der heit schaft ung " * 50)]))
    text = "der schaft heit ung heit schaft"
    assert c.predict(text.upper() if upper else text)[0] == "de"
