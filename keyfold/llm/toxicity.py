"""Toxicity: class-conditional Kneser-Ney models over the characters of words.

Two models, one of toxic and one of ordinary documents, give every word a
log-likelihood. They share their backoff: orders 1 to SHARED are continuation
counts over all words of both classes, so an expression that is rare in both is
smoothed alike and only what a class has really seen tells them apart. Higher
orders are counted per class: word-initial and highest-order n-grams by
occurrence, the others by distinct words.

A document's evidence is the difference of the two log-likelihoods, normalised by
length: over the whole text and over its most toxic window of WINDOW words, so
that a few expressions in a long text count. A logistic calibration on documents
kept out of the counts turns that into a score.

The classes are counted on at most ``max_labelled`` labelled rows (least hash of the
id, a part for each class), the shared orders over the words of all documents, both
by Spark; the calibration weighs the classes as they are among all labels. Every
document is scored over its whole text.

Defined cases: null and empty texts are scored as texts without words; labels
without a document and null labels are left out; repeated labels of a document
count once, toxic wins; without both classes among the labels every score is the
share of toxic labels (0 without labels); repeated rows are rows of their own;
other columns are untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import slices, stage

ORDER = 6
SHARED = 3
#: Documented bound of the labelled sample that the models are fitted on.
MAX_LABELLED = 12_000
#: One in so many sampled documents is kept for the calibration.
CALIBRATE = 4
WINDOW = 12
THRESHOLD = 0.7
#: Words of which a worker keeps the evidence.
CACHE = 1_000_000
CLIP = 12.0
#: Evidence of a word counts above these levels; a single chance n-gram stays below the higher ones.
LEVELS = (0.0, 3.0, 6.0)
N_FEATURES = len(LEVELS) + 4
#: Words: runs of letters, very long ones (texts without spaces) in pieces.
LETTERS = re.compile(r"[^\W\d_]{1,32}")
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _places(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all words with a start and an end mark, the word number
    and place in the word of each, and where the words start."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int32, len(words))
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    return codes, word, (np.arange(len(codes)) - starts[word]).astype(np.int32), starts


def _orders(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For k = 1 to ORDER: the hashes of the k characters that end at each
    character and of the k - 1 before it. One order is held at a time."""
    wide = codes.astype(np.uint64) + np.uint64(1)
    run, last = np.zeros(len(codes), np.uint64), np.zeros(len(codes), np.uint64)
    for k in range(1, ORDER + 1):
        run[k - 1:] += wide[:len(codes) - k + 1] * np.uint64(pow(_BASE, k, 1 << 64))
        h = (run + np.uint64(k)) * _MIX
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_BASE)
        yield k, h, np.concatenate([np.zeros(1, np.uint64), last[:-1]])
        last = h


def _discounts(total: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from the
    counts of counts of one class."""
    n = np.maximum(np.bincount(np.minimum(np.round(total), 5).astype(np.int64), minlength=6)[1:5], 1).astype(float)
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], [0.3, 0.5, 0.7], [0.98, 1.95, 2.9])


@dataclass
class Slots:
    """Values of hashes, every one of them kept: the sorted hashes, where those of
    each run of leading bits start, and the size of the largest such run."""

    keys: np.ndarray
    starts: np.ndarray
    values: np.ndarray
    shift: np.uint64
    depth: int

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> Slots:
        order = np.argsort(keys, kind="stable")
        keys, bits = keys[order], max(1, len(keys).bit_length())
        sizes = np.bincount((keys >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return cls(keys, starts, values[order].astype(np.float32), np.uint64(64 - bits), int(sizes.max()))

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        run = (keys >> self.shift).astype(np.int64)
        at, end = self.starts[run], self.starts[run + 1]
        out = np.full((len(keys), self.values.shape[1]), np.float32(default))
        left = np.flatnonzero(at < end)
        for _ in range(self.depth):
            there = self.keys[at[left]] == keys[left]
            out[left[there]] = self.values[at[left[there]]]
            left = left[~there]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def _counted(words: list[str], counts: np.ndarray | None, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For orders ``low`` to ``high``: the distinct n-grams, the context of each and its
    count, one column for the shared orders and one a class for the others."""
    codes, word, place, _ = _places(words)
    for k, gram, context in _orders(codes):
        if not low <= k <= high:
            continue
        use = place >= max(1, k - 1)
        # sorted once: equal n-grams stand together, and sums run over their stretches
        order = np.argsort(gram[use], kind="stable")
        at = np.flatnonzero(use)[order].astype(np.int32)
        del order, use
        key = gram[at]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
        distinct, before = key[first], context[at[first]]
        if not len(key):
            total = np.zeros((0, 1 if k <= SHARED else 2))
        elif k <= SHARED:
            total = np.diff(np.concatenate([first, [len(at)]])).astype(np.float64)[:, None]
        else:
            by_occurrence = (place[at] == k - 1) | (k == ORDER)
            total = np.stack([np.add.reduceat(np.where(by_occurrence, counts[word[at], c], counts[word[at], c] > 0), first, dtype=np.float64)
                              for c in range(2)], 1)
        yield k, distinct, before, total


class KneserNey:
    """The two models. ``counts``: occurrences of each word by class (n, 2)."""

    def __init__(self, words: list[str], counts: np.ndarray) -> None:
        self._estimate(_counted(words, counts.astype(np.float32), 1, ORDER))

    @classmethod
    def of(cls, orders: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> KneserNey:
        """From distinct n-grams, their contexts and counts, order by order."""
        model = cls.__new__(cls)
        model._estimate(orders)
        return model

    def _estimate(self, orders: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        keys, alphas, contexts, masses = [], [], [], []
        for k, distinct, before, total in orders:
            if k == 1:
                self.base = 1.0 / max(2, len(distinct))  # the characters and the end of a word
            heads, head_at = np.unique(before, return_inverse=True)
            head = np.stack([np.bincount(head_at, total[:, c], len(heads)) for c in range(total.shape[1])], 1)
            off = np.stack([_discounts(total[:, c])[np.clip(np.round(total[:, c]).astype(np.int64) - 1, 0, 2)]
                            for c in range(total.shape[1])], 1)
            if k > SHARED:
                # n-grams seen once over both classes give all they have to the backoff (held-out figures: README);
                # the discounts come from all counts
                off = np.where(total.sum(1, keepdims=True) >= 2, off, total)
            alpha = np.maximum(total - off, 0) / np.maximum(head[head_at], 1e-9)
            kept = np.stack([np.bincount(head_at, alpha[:, c], len(heads)) for c in range(alpha.shape[1])], 1)
            some = alpha.sum(1) > 0
            two = lambda x: np.repeat(x, 2, 1) if x.shape[1] == 1 else x
            keys.append(distinct[some])
            alphas.append(two(alpha[some]))
            used = kept.sum(1) > 0
            contexts.append((heads[used] + np.uint64(k)) * _MIX)
            masses.append(two(1 - kept[used]))
        join = np.concatenate
        self.alpha = Slots.build(join(keys), join(alphas))
        self.left = Slots.build(join(contexts), join(masses))

    def evidence(self, words: list[str]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each word."""
        if not words:
            return np.empty(0)
        codes, _, place, starts = _places(words)
        p = np.full((len(place), 2), self.base)
        for k, gram, context in _orders(codes):
            use = np.flatnonzero(place >= max(1, k - 1))
            head = (context[use] + np.uint64(k)) * _MIX
            p[use] = self.alpha.get(gram[use], 0.0) + self.left.get(head, 1.0) * p[use]
        gap = np.log(np.maximum(p[:, 0], 1e-12)) - np.log(np.maximum(p[:, 1], 1e-12))
        gap[place == 0] = 0
        return np.clip(np.add.reduceat(gap, starts), -CLIP, CLIP)


class Scorer:
    """Features of texts; a worker keeps the evidence of the words it met."""

    def __init__(self, model: KneserNey, window: int = WINDOW) -> None:
        self.model, self.window, self.known = model, window, {}

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, list(words)
        for a in range(0, len(new), 100_000):
            part = new[a:a + 100_000]
            self.known.update(zip(part, self.model.evidence(part).tolist()))

    def _top(self, e: np.ndarray) -> float:
        run = np.cumsum(e)
        if len(e) > self.window:
            return max(run[self.window - 1], (run[self.window:] - run[:-self.window]).max()) / self.window
        return run[-1] / self.window

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: for each level the largest window sum of the evidence
        above it, over the window's size; the two largest evidences, which may
        lie far apart; mean evidence; log of the number of words. Texts go
        through in groups of bounded size."""
        out, held, size = np.zeros((len(texts), N_FEATURES)), [], 0
        for i, text in enumerate(texts):
            held.append((i, LETTERS.findall((text or "").lower())))
            size += len(held[-1][1])
            if size >= 200_000 or i + 1 == len(texts):
                self._learn({w for _, ws in held for w in ws})
                get = self.known.__getitem__
                for j, ws in held:
                    if ws:
                        e = np.fromiter(map(get, ws), np.float64, len(ws))
                        two = np.partition(e, -2)[-2:] if len(e) > 1 else np.array([0.0, e[0]])
                        out[j] = [*(self._top(np.maximum(e - x, 0) if x else e) for x in LEVELS), *(two / CLIP), e.mean(), np.log1p(len(ws))]
                held, size = [], 0
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60, share: np.ndarray | None = None) -> np.ndarray:
    """Weights (last: constant) of a ridge logistic regression, by Newton steps;
    a row counts as ``share`` rows (1)."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    share = np.ones(len(x)) if share is None else share
    keep = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (share * (p - y)) + keep @ w
        step = np.linalg.solve((x1 * (share * p * (1 - p))[:, None]).T @ x1 + keep + 1e-9 * np.eye(len(w)), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Toxicity:
    model: KneserNey | None
    weights: np.ndarray | None
    base_rate: float
    kept: Scorer | None = None

    def scorer(self) -> Callable[[list[str | None]], np.ndarray]:
        if self.model is None:
            return lambda texts: np.full(len(texts), self.base_rate)
        # a worker's tasks share the object, and so the words that it has met
        self.kept = self.kept or Scorer(self.model)
        features = self.kept.features

        def score(texts: list[str | None]) -> np.ndarray:
            x = features(texts)
            return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))
        return score


def labelled(labels: DataFrame, train: Column, max_labelled: int) -> tuple[DataFrame, dict[bool, float]]:
    """At most ``max_labelled`` labels (id, toxic) of least hash: half of them of
    each class, more where the other class has fewer; and how many known labels
    of its class each stands for."""
    known = labels.filter(train & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = stage(known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("toxic")), "tox-known")
    n = {r[0]: r[1] for r in known.groupBy(F.col("toxic") > 0).count().collect()}
    n = {c: n.get(c, 0) for c in (True, False)}
    part = {c: min(n[c], max(max_labelled // 2, max_labelled - n[not c])) for c in n}
    some = [known.filter((F.col("toxic") > 0) == c).orderBy(F.xxhash64("id"), "id").limit(part[c]) for c in n]
    return stage(some[0].unionByName(some[1]), "tox-labels"), {c: n[c] / max(1, part[c]) for c in n}


def all_words(docs: DataFrame) -> DataFrame:
    """The distinct words of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in slices(batches, 0):
            for text in b.column(0).to_pylist():
                seen.update(LETTERS.findall((text or "").lower()))
            if len(seen) > 300_000:
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], names=["word"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], names=["word"])

    return docs.select("text").mapInArrow(run, "word string").distinct()


def _grams(words: DataFrame, low: int, high: int) -> DataFrame:
    """Distinct n-grams of distinct words (word, and toxic, plain for the orders
    of the classes), counted by Spark: k, gram, context, toxic, plain."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            counts = np.stack([table.column(c).to_numpy() for c in (1, 2)], 1) if high > SHARED else None
            for k, gram, context, total in _counted(table.column(0).to_pylist(), counts, low, high):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)),
                     pa.array(total[:, 0].copy()), pa.array(total[:, -1].copy())], names=["k", "gram", "context", "toxic", "plain"])
            held.clear()
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 50_000:
                yield from out()
        if held:
            yield from out()

    rows = words.mapInArrow(run, "k int, gram long, context long, toxic double, plain double")
    grams = rows.groupBy("k", "gram").agg(F.min("context").alias("context"), F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
    return stage(grams, f"tox-grams-{high}")


def counted(words: DataFrame, everywhere: DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The orders of the models: the shared ones over the words of all documents,
    the others over those of the labelled ones. Only distinct n-grams come here, one
    order at a time."""
    tables = [_grams(everywhere, 1, SHARED), _grams(words, SHARED + 1, ORDER)]
    for k in range(1, ORDER + 1):
        table = tables[k > SHARED].filter(F.col("k") == k).select("gram", "context", "toxic", "plain").toArrow()
        gram, context, toxic, plain = (table.column(c).to_numpy() for c in range(4))
        order = np.argsort(gram)
        total = np.stack([toxic, plain], 1)[order]
        yield k, gram[order].view(np.uint64), context[order].view(np.uint64), total if k > SHARED else total[:, :1]


def fit(docs: DataFrame, labels: DataFrame, train: Column, max_labelled: int = MAX_LABELLED) -> Toxicity:
    """Fit on the labelled documents for which ``train`` (over doc_id) holds."""
    spark = docs.sparkSession
    some, stands = labelled(labels, train, max_labelled)
    picked = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("id"))
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(CALIBRATE)) == 0
    picked = stage(picked.select("text", "toxic", fold.alias("fold")), "tox-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            words = list(seen[0] | seen[1])
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[1][w] for w in words], pa.int64()),
                                               pa.array([seen[0][w] for w in words], pa.int64())], names=["word", "toxic", "plain"])
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[toxic > 0].update(LETTERS.findall((text or "").lower()))
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield out()
                    seen[0].clear()
                    seen[1].clear()
        yield out()

    counts = picked.filter("NOT fold").select("text", "toxic").mapInArrow(count, "word string, toxic long, plain long")
    words = stage(counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")), "tox-words")
    by_class = {r[0]: r[1] * stands[r[0]] for r in picked.groupBy(F.col("toxic") > 0).count().collect()}
    rate = by_class.get(True, 0) / max(1, sum(by_class.values()))
    if not all(words.agg(F.sum("toxic"), F.sum("plain")).first()):
        return Toxicity(None, None, rate)
    model = KneserNey.of(counted(words, all_words(docs)))
    shared = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            x = scorer.features(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    kept = picked.filter("fold").select("text", "toxic").mapInArrow(features, "x array<double>, y int").toArrow()
    x = np.array(kept.column("x").to_pylist(), float).reshape(-1, N_FEATURES)
    y = (kept.column("y").to_numpy() > 0).astype(float)
    # one row of either class beside the real ones keeps small samples solvable
    high = [max(0.0, 2 * (10 - v)) / WINDOW for v in LEVELS]
    x, y = np.vstack([x, [[*high, 0.9, 0.9, 0.3, 4.0], [0.0] * (N_FEATURES - 1) + [4.0]]]), np.concatenate([y, [1.0, 0.0]])
    share = np.where(y > 0, stands[True], stands[False])
    share[-2:] = 1
    return Toxicity(model, fit_logistic(x, y, share=share), rate)


def scored(docs: DataFrame, fitted: Toxicity, out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each whole text."""
    names = docs.columns
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(b.column(at).to_pylist()), pa.float64())], names=[*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def in_fold(n: int, k: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)) == k, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                   max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    fitted = fit(docs, labels, ~in_fold(3, 1), max_labelled)
    out = scored(docs.select("doc_id", "text"), fitted)
    return out.select("doc_id", in_fold(3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                  max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The documents that score below the threshold, all columns kept."""
    fitted = fit(docs, labels, ~in_fold(3, 1), max_labelled)
    return scored(docs, fitted, "__score").filter(F.col("__score") < threshold).drop("__score")
