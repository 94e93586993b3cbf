import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyfold.llm import tokenfile
from keyfold.llm.rangecoder import BadBlock, decode_blocks, encode_blocks
from keyfold.llm.tokenfile import Chunks, join_crc, read_digest, token_digest, token_ids, vocabulary_path, write_tokens
from keyfold.session import scratch_path

from .conftest import awkward_rows


@pytest.fixture(scope="module")
def chunks():
    return Chunks(vocabulary_path())


def cased():
    """Every code point that has another case, or is what another one's case gives."""
    every = map(chr, [*range(0xD800), *range(0xE000, 0x110000)])
    return [c for c in every if c.lower() != c or c.upper() != c or c.title() != c]


@pytest.mark.parametrize("around", ["{}", "{}.", "x{}.", ".{}", "x{}y!", "{}{}", "a{}'s", "{}-{}", "({}),", "1{}.", "{}\u0301.", "É{}} "])
def test_cased_letters_and_marks(chunks, around):
    """Each before and after marks, letters, digits and accents: the tokenizer's ids."""
    texts = [around.replace("{}", c) for c in cased()] + ["YENİ. BİTTİ! İ} İ", "yeni\u0307. i\u0307!"]
    ids, ends = chunks.encode(pa.array(texts, pa.string()))
    want = [[*e.ids, 2] for e in chunks.tokenizer.encode_batch(texts, add_special_tokens=False)]
    starts = [0, *ends.tolist()]
    wrong = [t for t, a, b, w in zip(texts, starts, starts[1:], want) if ids[a:b].tolist() != w]
    assert wrong == []


@pytest.mark.parametrize("ids", [[2], [5, 5, 5], list(range(3000)), [0] * 5000, [2**32 - 1, 0, 7] * 700,
                                 np.random.default_rng(1).integers(0, 2**32, 2500), np.random.default_rng(2).integers(0, 40, 9000)])
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    blocks = encode_blocks(ids)
    assert (np.concatenate(decode_blocks(blocks)) == ids).all()
    for b in blocks[::-1]:  # any block alone
        assert len(decode_blocks([b])[0])


def test_no_ids_and_predictable_ids():
    assert encode_blocks(np.empty(0, np.uint32)) == [] and decode_blocks([]) == []
    text = np.tile(np.arange(50, dtype=np.uint32), 200)
    assert sum(map(len, encode_blocks(text))) < len(text) * 0.6  # order 1 and 2 see it


def test_damage_is_seen():
    block = encode_blocks(np.random.default_rng(3).integers(0, 900, 1000).astype(np.uint32))[0]
    for at in (0, 5, len(block) // 2):
        bad = bytearray(block)
        bad[at] ^= 0x41
        with pytest.raises(BadBlock):
            decode_blocks([bytes(bad)])


def test_damage_anywhere_is_seen():
    """Every byte, header and alphabet too: never another error, never other ids."""
    ids = np.random.default_rng(5).integers(0, 70_000, 60).astype(np.uint32)
    block = encode_blocks(ids)[0]
    for at in range(len(block) - 8):  # the coder's last words may hold spare bits
        bad = bytearray(block)
        bad[at] ^= 0xFF
        try:
            assert (decode_blocks([bytes(bad)])[0] == ids).all()
        except BadBlock:
            pass


def test_sizes_of_blocks():
    """One id, all ids different, and predictable ids: no larger than the coder makes them."""
    for ids, most in ((np.zeros(4096), 0.26), (np.tile(np.arange(1024), 4), 2.4), (np.tile(np.arange(50), 200), 0.35)):
        ids = ids.astype(np.uint32)
        blocks = encode_blocks(ids)
        assert (np.concatenate(decode_blocks(blocks)) == ids).all() and sum(map(len, blocks)) < most * len(ids)


def plain(chunks, texts):
    return [[*e.ids, 2] for e in chunks.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_are_learned_once():
    """A word meets its known chunk whatever mark ends it, and words go to the
    tokenizer many in a text."""
    chunks, calls = Chunks(vocabulary_path()), []
    merges = chunks.merges

    class Counted:
        def encode_batch_fast(self, texts, **k):
            calls.append(len(texts))
            return merges.encode_batch_fast(texts, **k)

    chunks.merges = Counted()
    texts = ["Wordyq, wordyq. wordyq! wordyq", "(wordyq) " + " ".join(f"x{chr(97 + i // 26)}{chr(97 + i % 26)}q;" for i in range(500))]
    ids, _ = chunks.encode(pa.array(texts, pa.string()))
    assert ids.tolist() == sum(plain(chunks, texts), [])
    known = chunks.known.to_pylist()
    assert known.count("wordyq") == 1 and not any(k[-1:] in (",", ".", "!", ";") and len(k) > 1 for k in known)
    assert sum(calls) == 1


def test_forgetting_chunks(monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHE", 40)
    chunks, rnd = Chunks(vocabulary_path()), random.Random(6)
    for k in range(30):
        texts = ["the word né, (said) " + " ".join(f"q{rnd.randint(0, 300)}z" for _ in range(12)) for _ in range(2)]
        ids, ends = chunks.encode(pa.array(texts, pa.string()))
        want = plain(chunks, texts)
        assert ids.tolist() == sum(want, []) and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
        assert len(chunks.known) < 120 and len(chunks.met) == len(chunks.known) == len(chunks.starts) - 1
    assert "word" in chunks.known.to_pylist()


def test_final_marks(chunks):
    """Marks at ends of words, texts and slices, next to every kind of neighbour."""
    rnd = random.Random(7)
    some = ["a", "b", "'", "'s", ",", ".", "!", "?", ";", ":", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\u00a0", "\u2028", "\u00c9", "\u00e9", "\u0130",
            "i\u0307", "\u0301", "\u0338", "9", "(", ")", "-", "\u6f22", "\u00df", "Z", "<|", "|>", "\U0001F600", "\x00", ""]
    texts = ["", "a", ",", "a,", ",a", "a,\n"] + ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 14))) for _ in range(5000)]
    for array, own in ((pa.array(texts, pa.string()), texts), (pa.array(texts, pa.string()).slice(7, 99), texts[7:106]), (pa.array([""] * 3, pa.string()), [""] * 3)):
        ids, ends = chunks.encode(array)
        want = plain(chunks, own)
        assert ids.tolist() == sum(want, []) and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_checksums_join():
    data = bytes(range(256)) * 9
    cuts = [0, 1, 1, 700, len(data)]
    assert join_crc([(b - a, zlib.crc32(data[a:b])) for a, b in zip(cuts, cuts[1:])]) == zlib.crc32(data)


def test_chunks_equal_whole_texts(chunks):
    texts = ["", "  lead and trail. ", "çà, là. ÇA, NÉ. ñandú, straße. \u01c5x", "e\u0301t\u00e9. \u212bngstr\u00f6m", "Hello, world. it's a'll 'S ... x\x0by\x1cz\u00a0q \u0301a", "İ Σας \u212a \ufb01", "a<|endoftext|>b <|STARTOFTEXT|>", "word. word, word.. (word.) né. 3.14",
             "日本語 テキスト", "x" * 5000, "a\u0301 e\u0301."]
    for group in (texts, texts[:3], [texts[7]], texts[4:], texts):
        ids, ends = chunks.encode(pa.array(group, pa.string()))
        want = [[*chunks.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in group]
        assert ids.tolist() == [i for w in want for i in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_files_equal_brute_force(spark, make_docs, chunks):
    rnd = random.Random(4)
    rows = awkward_rows() + [(1000 - i, " ".join(rnd.choice(["tion", "the", "Ner", "x9", "né"]) for _ in range(rnd.randint(0, 900)))) for i in range(60)]
    docs = make_docs(rows, 4)
    path = scratch_path(spark, "test-tokens")
    write_tokens(docs, path, vocabulary_path())
    got = sorted(read_digest(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    at, texts = 0, {}
    for doc_id, text, *_ in rows:
        ids = [*chunks.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        texts.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r.start == at
        assert (r.n_tokens, r.ids_crc32) in texts[r.doc_id]
        texts[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert token_ids(spark, path).agg(F.sum(F.size("ids"))).first()[0] == at
    assert token_digest(make_docs([])).count() == 0
