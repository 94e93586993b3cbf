"""Token files: documents as token ids in ascending id order, coded in blocks.

A file is a Parquet part of block rows. Each row is independent: the coded block
(see rangecoder), which document its first id belongs to, and which documents end
in it, so any block can be read, checked and attributed on its own.

Documents are dealt by range of their id, so the parts in order are the documents
in order; equal ids are dealt by text too. Workers tokenise a batch of documents
by its distinct white-space chunks, as no token of the word vocabulary reaches over
white space, and keep the ids of chunks they met.

Defined cases: null texts are empty and consist of the end id alone; null ids come
first; equal ids in any order; an empty table gives an empty file; repeated rows
are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import conf_override, scratch_path
from .common import TEXT_BATCH, slices
from .rangecoder import BLOCK, BadBlock, decode_blocks, encode_blocks

END_ID = 2
#: Blocks coded side by side: bounds a worker's memory.
LANES = 1_024
#: Chunks of which a worker keeps the ids, bytes tokenised at once, and words
#: that the tokenizer gets as one text.
CACHE, BATCH_BYTES, TOGETHER = 500_000, 8 << 20, 1_000
VOCABULARY = "word_bpe_49k.json"
#: Latin letters, and ASCII marks: of these it is certain how the tokenizer
#: parts them (a word of letters is one unit, a run of marks another), and without
#: combining marks the letters are composed.
#: A dotted capital I is none of them: its lower case is two code points.
LETTERS = r"[a-z\x{DF}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+"
MARKS = r"[!-/:-@\[-`{-~]+"
FINAL = b",.;:!?"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: printable
    Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def _strings(values: pa.Array) -> list[str]:
    """Python strings of an array, by one conversion of the whole of it."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _part_marks(texts: pa.Array) -> pa.Array:
    """The texts with a space between a letter a-z and one of FINAL before white
    space or the end: the tokenizer parts them too, so words meet known chunks
    whatever follows them. ``texts``: not empty."""
    texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    if not len(data):
        return texts
    offsets = offsets - offsets[0]
    mark, after = np.zeros(len(data), bool), np.ones(len(data), bool)
    for c in FINAL:
        mark |= data == c
    after[:-1] = (data[1:] == 0x20) | (data[1:] == 0x0A)
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    mark &= after
    at = np.flatnonzero(mark)
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    at = at[(data[at - 1] - np.uint8(97) < 26) & ~begins[at]]
    if len(data) + len(at) >= 1 << 31:
        return texts  # more than the offsets hold
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets + np.searchsorted(at, offsets)).astype(np.int32)),
                                       pa.py_buffer(np.insert(data, at, 0x20)))


class Chunks:
    """Token ids of texts, by way of their distinct white-space chunks.

    Chunks are split and numbered by Arrow kernels; what a worker has met keeps
    its ids. New words of letters go to a tokenizer that has the same merges but
    neither normalises nor splits, as for lower-case composed letters both do
    nothing, many in one text: tokens that end a word show where each ends. Other
    chunks go to the tokenizer itself. When it has met too many chunks, a worker
    keeps those that it met again."""

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        from tokenizers import Tokenizer
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        plain = json.loads(self.tokenizer.to_str())
        plain |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(plain))
        # of a special token's string, what a chunk holds if a text holds the string
        self.special = [max(pc.ascii_lower(t.content).as_py().split(), key=len) for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix, vocabulary = plain["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends_word[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.letters = {b: c for b, c in _byte_letters().items() if b != 32}
        self._clear()

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _clear(self) -> None:
        """``known``: chunks; of each, where its ids start and how many batches met it."""
        self.known = pa.array([""], pa.string())
        self.ids, self.starts, self.met = np.empty(0, np.uint32), np.array([0, 0], np.int64), np.zeros(1, np.int32)

    def _forget(self) -> None:
        """Keep the chunks that were met in two batches or more."""
        keep = self.met > 1
        keep[0] = True
        if 2 * np.count_nonzero(keep) > CACHE:
            return self._clear()
        size = np.diff(self.starts)
        self.ids = self.ids[np.repeat(keep, size)]
        self.starts = np.concatenate([[0], np.cumsum(size[keep])])
        self.known = self.known.filter(pa.array(keep))
        self.met = np.zeros(len(self.known), np.int32)

    def _append(self, chunks: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, chunks])
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends])
        self.met = np.concatenate([self.met, np.zeros(len(chunks), np.int32)])

    def _append_lists(self, chunks: pa.Array, lists: list[list[int]]) -> None:
        ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        self._append(chunks, np.fromiter(chain.from_iterable(lists), np.uint32, int(ends[-1])), ends)

    def _encode_words(self, words: pa.Array) -> None:
        names = _strings(words)
        spelled = (" ".join(names[i:i + TOGETHER]) for i in range(0, len(names), TOGETHER))
        spelled = [t if t.isascii() else t.encode().decode("latin-1").translate(self.letters) for t in spelled]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.merges.encode_batch_fast(spelled, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends_word.take(ids)) + 1
        if len(ends) == len(words) and ends[-1] == len(ids):
            self._append(words, ids, ends)
        else:  # a vocabulary that does not mark where words end
            alone = " ".join(spelled).split(" ")
            self._append_lists(words, [e.ids for e in self.merges.encode_batch_fast(alone, add_special_tokens=False)])

    def _learn(self, new: pa.Array) -> None:
        """Append chunks that are not known: words of lower-case composed letters
        by the merges alone, in the letters of their bytes; others by the tokenizer.
        A lower-case word followed by marks is learned as the word and the marks
        (again, if they are known); in other case the lower case may meet the marks."""
        before = len(self.known)
        parted = pc.extract_regex(new, f"^(?P<word>{LETTERS})(?P<marks>{MARKS})$")
        word = pc.struct_field(parted, "word")
        marked = pc.fill_null(pc.and_(parted.is_valid(), pc.equal(word, pc.utf8_lower(word))), False)
        halves = [parted.filter(marked).field(i) for i in (0, 1)]
        units = pa.concat_arrays([new.filter(pc.invert(marked)), *halves]).unique()
        is_word = pc.and_(pc.match_substring_regex(units, f"^{LETTERS}$"), pc.equal(pc.utf8_lower(units), units))
        words, others = units.filter(is_word), units.filter(pc.invert(is_word))
        if len(words):
            self._encode_words(words)
        if len(others):
            self._append_lists(others, self._plain(_strings(others)))
        if not len(halves[0]):
            return
        both = before + np.array([pc.index_in(h, self.known.slice(before)).to_numpy() for h in halves], np.int64).T.reshape(-1)
        begin, size = self.starts[both], self.starts[both + 1] - self.starts[both]
        ends = np.cumsum(size)
        ids = self.ids.take(np.arange(int(ends[-1])) + np.repeat(begin - (ends - size), size))
        self._append(new.filter(marked), ids, ends[1::2])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (strings), each with the end id, and where each ends."""
        # lower case of ASCII letters first: it meets more known chunks
        split = pc.ascii_split_whitespace(_part_marks(pc.ascii_lower(texts)))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary
        if any(pc.any(pc.match_substring(distinct, s)).as_py() for s in self.special):
            # a special token's own string keeps its case and meaning
            lists = [[*e.ids, self.end_id] for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(lists), np.uint32), np.cumsum([len(x) for x in lists])
        if len(self.known) > CACHE:
            self._forget()
        at = pc.index_in(distinct, self.known).fill_null(-1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            before, new = len(self.known), distinct.take(pa.array(missing))
            self._learn(new)
            at[missing] = before + pc.index_in(new, self.known.slice(before)).to_numpy()
        self.met[at] += 1
        # the lists of the distinct chunks, and of the end id as one more
        begin, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        offsets = np.concatenate([[0], np.cumsum(size)])
        ids = np.append(self.ids.take(np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)), np.uint32(self.end_id))
        lists = pa.ListArray.from_arrays(pa.array(np.append(offsets, len(ids)), pa.int32()), pa.array(ids))
        stops = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()  # chunks up to each text's end
        code = np.full(len(coded) + len(texts), len(at), np.int32)
        ends = stops + np.arange(len(texts))
        is_chunk = np.ones(len(code), bool)
        is_chunk[ends] = False
        code[is_chunk] = coded.indices.to_numpy()
        out = lists.take(pa.array(code))
        return out.flatten().to_numpy(), out.offsets.to_numpy()[ends + 1].astype(np.int64)


@lru_cache(maxsize=2)
def chunks_of(path: str, end_id: int) -> Chunks:
    """One for all tasks of a worker, which so keep what they learned."""
    return Chunks(path, end_id)


BLOCKS = "part int, block long, first_doc long, doc_ids array<long>, ends array<int>, n long, payload binary"


def _blocks(part: int, texts: Iterator[tuple[pa.Array, pa.Array]], chunks: Chunks) -> Iterator[pa.RecordBatch]:
    """Block rows of one part; ids are held until LANES blocks are full.
    ``texts``: document ids and texts, some documents at a time."""
    held, ids_of, ends, size = [], [], [], 0  # ids, document ids, their ends (positions in what is held)
    block = doc = 0

    def write(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, ids_of, ends, size, block, doc
        flat = np.concatenate(held) if held else np.empty(0, np.uint32)
        side = LANES * BLOCK
        whole = len(flat) if last else len(flat) // side * side
        at_end = np.array(ends, np.int64)
        rows = []
        done = 0
        for i, payload in enumerate(chain.from_iterable(encode_blocks(flat[a:min(a + side, whole)]) for a in range(0, whole, side))):
            stop = min(whole, (i + 1) * BLOCK)
            upto = int(np.searchsorted(at_end, stop, side="right"))
            rows.append((part, block, doc + done, ids_of[done:upto], (at_end[done:upto] - i * BLOCK).tolist(), stop - i * BLOCK, payload))
            done = upto
            block += 1
        doc += done
        held, size = [flat[whole:]], len(flat) - whole
        ids_of, ends = ids_of[done:], (at_end[done:] - whole).tolist()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary()))],
                names=["part", "block", "first_doc", "doc_ids", "ends", "n", "payload"])

    for doc_ids, some in texts:
        ids, stops = chunks.encode(some)
        ids_of.extend(doc_ids.to_pylist())
        ends.extend((stops + size).tolist())
        held.append(ids)
        size += len(ids)
        if size >= LANES * BLOCK:
            yield from write(False)
    yield from write(True)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to about BATCH_BYTES of text; large ones as they are."""
    held, size = [], 0
    for b in batches:
        own = b.column(1).nbytes
        if held and size + own > BATCH_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Write the token file of (doc_id, text) under ``path``. ``vocabulary``:
    path of the tokenizer, on every machine."""
    spark: SparkSession = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(parts, F.col("doc_id"), F.crc32("text")).sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((b.column(0), b.column(1)) for b in _gathered(slices(batches, 1, BATCH_BYTES)))
        yield from _blocks(TaskContext.get().partitionId(), texts, chunks_of(vocabulary, end_id))

    with conf_override(spark, TEXT_BATCH):
        dealt.mapInArrow(run, BLOCKS).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of documents: (part, doc, block, n, crc, doc_id, ended)."""
    for b in batches:
        got = {n: b.column(n).to_pylist() for n in b.schema.names}
        for a in range(0, b.num_rows, LANES):
            cols: list[list] = [[] for _ in range(7)]
            decoded = decode_blocks(got["payload"][a:a + LANES])
            for part, block, first, doc_ids, ends, n, ids in zip(*(got[k][a:a + LANES] for k in (
                    "part", "block", "first_doc", "doc_ids", "ends", "n")), decoded):
                if len(ids) != n:
                    raise BadBlock("length differs")
                raw, at = ids.tobytes(), 0
                for i, stop in enumerate([*ends, n]):
                    if stop > at or i < len(ends):
                        row = (part, first + i, block, stop - at, zlib.crc32(raw[4 * at:4 * stop]), doc_ids[i] if i < len(ends) else None, i < len(ends))
                        for c, v in zip(cols, row):
                            c.append(v)
                    at = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
                pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))],
                names=["part", "doc", "block", "n", "crc", "doc_id", "ended"])


def join_crc(pieces: list[tuple[int, int]]) -> int:
    """crc32 of consecutive pieces from their (bytes, crc32): what zeros make of
    a checksum is how the bytes that follow shift it."""
    crc = 0
    for i, (size, own) in enumerate(pieces):
        if i:
            while size > 0:  # zeros in steps, so a long piece needs no long buffer
                step = min(size, 1 << 20)
                crc = zlib.crc32(bytes(step), crc) ^ zlib.crc32(bytes(step))
                size -= step
        crc ^= own
    return crc


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crcs = [p[0]["crc"] if len(p) == 1 else join_crc([(4 * x["n"], x["crc"]) for x in p]) for p in b.column("pieces").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(crcs, pa.int64())], names=[*b.schema.names[:-1], "ids_crc32"])


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """One row a document of a token file: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    pieces = blocks.mapInArrow(_read, "part int, doc long, block long, n long, crc long, doc_id long, ended boolean")
    docs = pieces.groupBy("part", "doc").agg(
        F.max(F.when(F.col("ended"), F.col("doc_id"))).alias("doc_id"), F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("block", "n", "crc"))).alias("pieces"))
    whole = docs.mapInArrow(_whole, "part int, doc long, doc_id long, n_tokens long, ids_crc32 long")
    # where documents end follows from the blocks alone: one small row a document
    by_part = blocks.groupBy("part").agg(F.sum("n").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = by_part.select(F.col("part").alias("p"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("offset"))
    begin = blocks.select("part", F.posexplode("ends").alias("i", "end"), "first_doc", "block")
    begin = begin.select(F.col("part").alias("p2"), (F.col("first_doc") + F.col("i")).alias("d2"),
                         (F.col("block") * BLOCK + F.col("end")).alias("stop"))
    out = (whole.join(begin, (whole["part"] == begin["p2"]) & (whole["doc"] == begin["d2"]))
           .join(offset, whole["part"] == offset["p"]))
    return out.select("doc_id", (F.col("offset") + F.col("stop") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, ids): the decoded ids of every block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, LANES):
                c = b.slice(a, LANES)
                yield pa.RecordBatch.from_arrays([c.column("part"), c.column("block"), pa.array(
                    [x.astype(np.int64) for x in decode_blocks(c.column("payload").to_pylist())], pa.list_(pa.int64()))], names=["part", "block", "ids"])
    return spark.read.schema(BLOCKS).parquet(path).mapInArrow(run, "part int, block long, ids array<long>")


def token_digest(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the documents' token file to the shared folder and read it back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "llm-tokens")
    write_tokens(docs, path, vocabulary or vocabulary_path(), end_id)
    return read_digest(spark, path)
