"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items form one suffix automaton. A document's
words are streamed through it while the longest match that ends at each word is
tracked. A match of at least a window's length marks the window's words as hit
and, through the automaton's state, names the items that hold that window. Items
shorter than a window are one window; they are found at the states that hold
them.

Items are read in blocks of at most BLOCK_WORDS words; each block is one
automaton of bounded size and one broadcast, and a document is scanned against
every block.

Defined cases: null and empty texts have no words and no hits; items without
words never match; a null item id is listed as an empty string; repeated items
count once; an empty benchmark hits nothing; repeated documents are rows of
their own; other columns are untouched.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import slices

WINDOW = 10
BLOCK_WORDS = 200_000
#: A document is dropped when at least this share of its words is hit.
DROP_COVERAGE = 0.8
#: Fixed value: a word of the lower-cased text (ASCII letters only are lowered).
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same on UTF-8 bytes: what is no word byte becomes a space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TO_WORDS).split()


class Automaton:
    """Generalised suffix automaton over word numbers. Transitions are one
    dict keyed by state * n_words + word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for i, ws in items if ws]
        self.width = max(1, len(self.vocab))
        self.length, self.link = [0], [-1]
        step: list[dict[int, int]] = [{}]
        for _, ws in coded:
            last = 0
            for c in ws:
                last = self._extend(step, last, c)
        self.step = {s * self.width + c: t for s, d in enumerate(step) for c, t in d.items()}
        self._name(coded)

    def _extend(self, step: list[dict[int, int]], last: int, c: int) -> int:
        length, link = self.length, self.link
        at = step[last].get(c)
        if at is not None and length[at] == length[last] + 1:
            return at
        if at is None:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            step.append({})
            p = last
            while p != -1 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p == -1:
                return new
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
                return new
        else:
            new, p, q = None, last, at
        copy = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        step.append(dict(step[q]))
        while p != -1 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        link[q] = copy
        if new is None:
            return copy
        link[new] = copy
        return new

    def _holder(self, state: int, n: int) -> int:
        """The state on the link path that holds the suffix of n words."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _name(self, coded: list[tuple[str, list[int]]]) -> None:
        """Items of the states that hold windows, and the short items of each
        state's link path."""
        held: dict[int, set[str]] = defaultdict(set)
        short: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for item, ws in coded:
            state = 0
            for i, c in enumerate(ws):
                state = self.step[state * self.width + c]
                if i + 1 >= self.window:
                    held[self._holder(state, self.window)].add(item)
            if len(ws) < self.window:
                short[self._holder(state, len(ws))].append((len(ws), item))
        n = len(self.length)
        #: of each state: where its windows' items are (-1: no window fits)
        self.window_of = [-1] * n
        self.short_of: dict[int, list[tuple[int, str]]] = {}
        for s in sorted(range(1, n), key=self.length.__getitem__):
            if self.length[s] >= self.window:
                up = self.link[s]
                self.window_of[s] = self.window_of[up] if self.length[up] >= self.window else s
            own = [*short.get(s, []), *self.short_of.get(self.link[s], [])]
            if own:
                self.short_of[s] = own
        self.items = {s: sorted(v) for s, v in held.items()}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges (first, end) of every window found, and the items."""
        width, step, link, length = self.width, self.step.get, self.link, self.length
        window, window_of, short_of = self.window, self.window_of, self.short_of
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        found: set[str] = set()
        state = n = 0
        for i, c in enumerate(map(self.vocab.get, words)):
            if c is None:
                state = n = 0
                continue
            to = step(state * width + c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = step(state * width + c)
            if to is None:
                n = 0
                continue
            state, n = to, n + 1
            if n >= window:
                spans.append((i - window + 1, i + 1))
                states.add(window_of[state])
            if state in short_of:
                for size, item in short_of[state]:
                    if size <= n:
                        spans.append((i - size + 1, i + 1))
                        found.add(item)
        for s in states:
            found.update(self.items[s])
        return spans, found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Automaton]:
    """Automata over the items, block by block; one block is held at a time."""
    held, size = [], 0
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"),
                             F.col("text").cast("binary").alias("t"))
    for row in items.toLocalIterator():
        words = words_of(bytes(row.t) if row.t is not None else None)
        if held and size + len(words) > block_words:
            yield Automaton(held, window)
            held, size = [], 0
        held.append((row.i, words))
        size += len(words)
    yield Automaton(held, window)


FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())),
                      T.StructField("items", T.ArrayType(T.StringType()))])
_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` (with a binary column __bytes) and __found: word count, merged
    hit ranges as flat (first, end, ...) and item ids."""
    spark = docs.sparkSession
    df = docs.withColumn("__found", F.lit(None).cast(FOUND))
    width = len(df.columns)

    for automaton in blocks(benchmark, window, block_words):
        shared = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scan = shared.value.scan
            for b in slices(batches, width - 2):
                texts = b.column(b.num_columns - 2).to_pylist()
                before = b.column(b.num_columns - 1).to_pylist()
                found = []
                for text, old in zip(texts, before):
                    words = words_of(text)
                    spans, items = scan(words)
                    if old:
                        spans += list(zip(old["spans"][::2], old["spans"][1::2]))
                        items |= set(old["items"])
                    found.append({"n_words": len(words), "spans": [x for s in merge(spans) for x in s], "items": sorted(items)})
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, _FOUND)], names=b.schema.names)

        df = df.mapInArrow(run, df.schema)
    return df


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    df = matched(docs.select("doc_id", F.col("text").cast("binary").alias("__bytes")), benchmark, window, block_words)

    items = F.col("__found.items")
    hit = F.expr("aggregate(transform(__found.spans, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (a, x) -> a + x)")
    return df.select("doc_id", F.col("__found.n_words").alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                     F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    at = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    out, pos = [], 0
    for a, b in spans:
        out.append(text[pos:at[a][0]])
        pos = at[b - 1][1]
    out.append(text[pos:])
    return "".join(out)


LOWER = {c: c + 32 for c in range(65, 91)}


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_coverage: float = DROP_COVERAGE,
                   block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with hit spans cut out of their texts (again until none is
    left, as cutting joins what stood around); documents that are hit in
    ``drop_coverage`` of their words or more are dropped. ``n_chars``, where it
    exists, follows a cut text; documents without hits stay as they are."""
    names = docs.columns
    spark = docs.sparkSession
    automata = [spark.sparkContext.broadcast(a) for a in blocks(benchmark, window, block_words)]
    counts = "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, (T.IntegerType, T.LongType))
    at, n_at = names.index("text"), names.index("n_chars") if counts else -1

    def clean(text: str | None) -> str | None:
        """The text to keep, None to drop it."""
        first = True
        while True:
            words = words_of((text or "").encode())
            spans = merge([s for a in automata for s in a.value.scan(words)[0]])
            if not spans:
                return text or ""
            if first and sum(b - a for a, b in spans) >= drop_coverage * len(words):
                return None
            text, first = without_spans(text, spans), False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = [clean(t) for t in old]
            keep = pa.array([t is not None for t in new])
            columns = list(b.columns)
            columns[at] = pa.array([None if o is None else n for o, n in zip(old, new)], b.schema.field(at).type)
            if counts:
                kept = b.column(n_at).to_pylist()
                columns[n_at] = pa.array([k if n is None or n == (o or "") else len(n) for k, o, n in zip(kept, old, new)],
                                         b.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    return docs.mapInArrow(run, docs.schema)
