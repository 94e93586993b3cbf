import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyfold.llm import exactdedup
from keyfold.llm.exactdedup import deduplicated_exactly, duplicates, flagged, placed, suspect_bits
from keyfold.llm.golomb import decode, divisor, encode

from .conftest import awkward_rows


@pytest.mark.parametrize("bits", [3, 8, 20, 40, 62])
@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 5000])
def test_golomb_round_trip(bits, n):
    rng = np.random.default_rng(bits * 7 + n)
    for low in (0, 12345):
        v = np.unique(rng.integers(0, 1 << bits, n, dtype=np.uint64)) + np.uint64(low)
        assert decode(encode(v, low, 1 << bits)).tolist() == v.tolist()


def test_golomb_extremes_and_size():
    for v in ([0], [(1 << 62) - 1], range(7, 300), [0, 1, (1 << 62) - 1], [5] + list(range(1000, 1100))):
        v = np.array(v, np.uint64)
        assert decode(encode(v, 0, 1 << 62)).tolist() == v.tolist()
        assert decode(encode(v, 0, int(v[-1]) + 1)).tolist() == v.tolist()
    v = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 50_000, dtype=np.uint64))
    # within a tenth of a bit of log2(e * mean gap), the least there is
    assert len(encode(v, 0, 1 << 40)) * 8 / len(v) < np.log2(np.e * (1 << 40) / len(v)) + 0.1
    assert divisor(0, 10) >= 1 and divisor(100, 10) == 1


def by_hand(rows):
    """(doc_id, keep_id, group_size, kept, sha) a row, kept being any one of rows that are alike."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (doc_id, _), x in zip(rows, norm):
        groups.setdefault(x, []).append(doc_id)
    out = []
    for x, ids in groups.items():
        first = sorted(ids, key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(x.encode()).hexdigest()
        out += [(i, first[0], len(ids), k == 0, sha) for k, i in enumerate(first)]
    return sorted(out, key=repr)


def rows_of(n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, "the hot text" if i % 3 == 0 else f"text {rng.randrange(n)}{rng.choice([' ', chr(9), '  ', chr(10)])}end") for i in range(n)]
    return rows + [(n + i, " a  b" + " " * (i % 3)) for i in range(40)] + [r[:2] for r in awkward_rows()]


def result(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize("block,wave,spare,small", [(1 << 16, 32 << 20, 10, 64), (64, 1, 10, 2), (64, 300, 0, 5), (1 << 16, 1, -6, 100_000)])
def test_equals_grouping(spark, make_docs, monkeypatch, block, wave, spare, small):
    """Whatever the blocks, the waves, the bits of a fingerprint and what counts as a large group."""
    monkeypatch.setattr(exactdedup, "BLOCK", block)
    monkeypatch.setattr(exactdedup, "WAVE_BYTES", wave)
    monkeypatch.setattr(exactdedup, "SPARE", spare)
    monkeypatch.setattr(exactdedup, "SMALL", small)
    rows = rows_of(1200)
    assert result(duplicates(make_docs(rows, 5))) == by_hand(rows)


def test_only_suspects_keep_texts(spark, make_docs):
    rows = rows_of(2000, 4)
    p = placed(make_docs(rows, 4), [])
    marked = flagged(p, suspect_bits(p))
    texts = marked.groupBy("suspect").agg(F.count("text").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    kept = {r["suspect"]: (r["n"], r["rows"]) for r in texts}
    really = sum(r[2] > 1 for r in by_hand(rows))
    assert kept[False][0] == 0 and kept[True][0] == kept[True][1]
    assert really <= kept[True][1] <= really + 20


def test_deduplicated_keeps_columns(spark, make_docs):
    rows = rows_of(300, 2)
    docs = make_docs(rows)
    kept = deduplicated_exactly(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    want = [r for r in by_hand(rows) if r[3]]
    got = kept.select("doc_id", "text", "score").collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((r[0] for r in want), key=repr)
    assert {r["score"] for r in got} == {"x"}


def test_empty_and_tiny(spark, make_docs):
    docs = make_docs(rows_of(30))
    assert duplicates(docs.filter(F.lit(False))).count() == 0
    assert result(duplicates(make_docs([(5, "x")]))) == by_hand([(5, "x")])
    assert result(duplicates(make_docs([(5, None), (3, " "), (4, "\t\n")]))) == by_hand([(5, None), (3, " "), (4, "\t\n")])
