"""Personal data: fixed patterns, and a BiLSTM-CRF that adds what they miss.

The patterns (email, ip, card, phone) give the base spans. They take what stands
together as one match and drop it when it fails, so a card after a phone number is
lost; the tagger reads characters and can part them. It also finds what no pattern
names: secrets, keys and tokens that are assigned to a name, a kind of their own. It
is trained on windows of the documents, labelled by the base spans and by what is
assigned to a name, and on windows composed of their words and labelled spans of all
forms; a sixth of the composed windows is left out, and the epoch that finds their
spans best is kept.

A text is cut into overlapping windows. Each window's best tag path gives
candidate spans; candidates of all windows that pass their kind's form are put
together and the non-overlapping set of greatest weight is kept, base spans first.
A secret is the whole run of its characters, so windows that see parts of it agree.
A form always holds a digit or ``@``, so windows without either cannot add a span
and are not decoded.

Defined cases: null and empty texts have no spans; repeated rows are rows of their
own; without documents to learn from the composed windows alone train the tagger;
an empty table gives no rows; other columns are untouched.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .bilstm import Tagger

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
WINDOW = 96
STRIDE = WINDOW // 2
#: Documented bounds of the sample: documents looked at, windows learned from.
SAMPLE_DOCS, REAL_WINDOWS, COMPOSED_WINDOWS = 20_000, 600, 1_800
EPOCHS = 12
DECODE_ROWS = 256

# ------------------------------------------------- fixed values: the patterns
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches in linear time: a match never starts inside a run of digits, nor gives digits back.
IP_SCAN = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: What the tagger may add as a phone: grouped like one, with a plus, an area in brackets, or 3-3-4.
PHONE_FORM = re.compile(r"\+[0-9]{1,3}([ .-]?\([0-9]{1,4}\))?([ .-]?[0-9]{2,5}){2,5}|\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,5}|[0-9]{3}(?P<sep>[ .-])[0-9]{3}(?P=sep)[0-9]{4}")
CARD_FORM = re.compile(r"[0-9]{13,19}|[0-9]{4}([ .-][0-9]{4}){2,3}([ .-][0-9]{1,4})?")
#: What a secret is made of, and how short one may be.
SECRET = re.compile(r"[A-Za-z0-9+/_=-]+")
LEAST_SECRET = 16
#: Characters before a secret that a window must hold.
SIGHT = 8
#: Labels for training: a run that is assigned to a name.
ASSIGNED = re.compile(r"(?<![A-Za-z_])[A-Za-z_]{2,}+[\"']? ?[=:] ?[\"']?([A-Za-z0-9+/_=-]{16,})")
TRIGGER = re.compile(r"[0-9@]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    even = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    d = _digits(s)
    return 13 <= len(d) <= 19 and luhn(d)


def _is_phone(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15


def _emails(text: str) -> list[tuple[int, int]]:
    """The pattern's matches, found from each ``@``: the local part is the run
    before it, back to the last match at most."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if any(map(text.__contains__, "0123456789")):
        if "." in text:
            out += [("ip", *m.span()) for m in IP_SCAN.finditer(text) if _is_ip(m.group())]
        out += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and _is_card(m.group())]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if _is_phone(m.group())]
    return out


def form_holds(kind: str, s: str) -> bool:
    """Whether the tagger's span is what its kind looks like."""
    if kind == "email":
        return EMAIL.fullmatch(s) is not None
    if kind == "ip":
        return IP.fullmatch(s) is not None and _is_ip(s)
    if kind == "card":
        return CARD_FORM.fullmatch(s) is not None and _is_card(s)
    if kind == "secret":
        whole = SECRET.fullmatch(s) is not None and len(s) >= LEAST_SECRET
        return whole and any("0" <= c <= "9" for c in s) and any(c.isalpha() for c in s)
    return PHONE_FORM.fullmatch(s) is not None and _is_phone(s)


def assigned_secrets(text: str) -> list[tuple[str, int, int]]:
    """What training takes for secrets."""
    return [("secret", *m.span(1)) for m in ASSIGNED.finditer(text) if form_holds("secret", m.group(1))]


def whole_run(text: str, a: int, b: int) -> tuple[int, int]:
    """The run of secret's characters that a span stands in; the span itself
    where it holds others."""
    inside = SECRET.fullmatch(text, a, b)
    if inside is None:
        return a, b
    while a and SECRET.match(text, a - 1, a):
        a -= 1
    return a, SECRET.match(text, a).end()


# --------------------------------------------------------------- the tagger
#: Tags: 0 outside; 1 + 2k begins kind k, 2 + 2k goes on.
N_TAGS = 1 + 2 * len(KINDS)
_MARKS = "@.-+()_%, :;/\n=\"'"
N_CLASSES = 8 + len(_MARKS)


def _class_table() -> np.ndarray:
    table = np.full(128, 6, np.int8)  # other ASCII
    for c in range(128):
        ch = chr(c)
        if ch.isdigit():
            table[c] = 1 if ch in "01" else 2
        elif ch.islower():
            table[c] = 7 if ch in "abcdef" else 3
        elif ch.isupper():
            table[c] = 4
        elif ch in _MARKS:
            table[c] = 8 + _MARKS.index(ch)
    return table


CLASS_OF = _class_table()  # 0: past the text; 5: beyond ASCII


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, CLASS_OF[np.minimum(codes, 127)], 5).astype(np.int8)


def _allowed() -> np.ndarray:
    ok = np.ones((N_TAGS, N_TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = True
    return ok


def tags_of(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or ``@``. Windows start every
    half window, so a character is in the one of its half and the one before."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    out: list[int] = []
    pos = 0
    while (m := TRIGGER.search(text, pos)) is not None:
        half = m.start() // STRIDE
        for i in (min(half - 1, last), min(half, last)):
            if i >= 0 and (not out or i > out[-1]):
                out.append(i)
        pos = (half + 1) * STRIDE
    return [i * STRIDE for i in out]


def synthetic(rng: random.Random, kind: str, words: list[str]) -> str:
    """A made-up span of a kind, in one of its forms."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    if kind == "email":
        w = lambda: re.sub(r"[^a-z0-9]", "", rng.choice(words).lower()) or "x"
        return f"{w()}{rng.choice(['.', '_', '', '+'])}{n(rng.randint(1, 3))}@{w()}{rng.choice(['', n(1)])}.{rng.choice(['example.com', 'org', 'co.uk', 'net'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "secret":
        letters = rng.choice(["0123456789abcdef", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])
        s = "".join(rng.choice(letters) for _ in range(rng.choice([20, 24, 32, 32, 40, 40])))
        return s if form_holds(kind, s) else synthetic(rng, kind, words)
    if kind == "card":
        d = rng.choice("3456") + n(rng.choice([12, 14, 14, 14, 14]))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice(["", "", "", " ", "-"])
        return sep.join(d[i:i + 4] for i in range(0, len(d), 4))
    return rng.choice([f"+{rng.randint(1, 99)} ({n(3)}) {n(3)}-{n(4)}", f"+1 ({n(3)}) {n(3)}-{n(4)}", f"+{rng.randint(1, 99)} {n(2)} {n(4)} {n(4)}",
                       f"+{rng.randint(10, 99)}-{n(3)}-{n(3)}-{n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}"])


#: Names that secrets are given in composed windows.
SECRET_NAMES = ["token", "api_key", "secret", "password", "access_key", "auth", "API_TOKEN", "client_secret", "key"]


def composed(rng: random.Random, words: list[str], spans: dict[str, list[str]]) -> tuple[str, list[tuple[str, int, int]]]:
    """A window of words, plain numbers and spans, some of them side by side."""
    text, out = "", []
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    while len(text) < WINDOW:
        roll = rng.random()
        if roll < 0.25:
            for _ in range(rng.choice([1, 1, 2, 2, 3])):
                kind = rng.choice(BASE_KINDS)
                s = rng.choice(spans[kind]) if spans.get(kind) and rng.random() < 0.5 else synthetic(rng, kind, words)
                out.append((kind, len(text), len(text) + len(s)))
                text += s + rng.choice([" ", " ", " ", ", ", "\n"])
        elif roll < 0.35:
            # a secret is assigned to a name; the same run without one is none
            s, quote = synthetic(rng, "secret", words), rng.choice(['"', '"', "'", ""])
            text += rng.choice(SECRET_NAMES) + rng.choice([" = ", " = ", "=", ": "]) + quote
            out.append(("secret", len(text), len(text) + len(s)))
            text += s + quote + rng.choice([" ", "\n", ", "])
        elif roll < 0.38:
            text += rng.choice(["/", "id ", "", "see "]) + synthetic(rng, "secret", words) + rng.choice([" ", ". ", "/"])
        elif roll < 0.45:
            text += rng.choice([n(rng.randint(1, 5)), f"{n(2)}.{n(2)}", f"20{n(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{rng.randint(1, 23)}:{n(2)}",
                                f"v{n(1)}.{n(1)}.{n(2)}", f"${n(3)}.{n(2)}", f"{n(1)},{n(3)}", n(rng.randint(6, 8)), "AKIA" + n(4)]) + " "
        else:
            text += rng.choice(words) + rng.choice([" ", " ", " ", ". ", ", "])
    return text, [s for s in out if s[2] <= WINDOW]


def fit_tagger(windows: list[tuple[str, list[tuple[str, int, int]]]], n_composed: int = COMPOSED_WINDOWS,
               epochs: int = EPOCHS, seed: int = 3) -> Tagger:
    """Train on labelled windows and on windows composed of their parts, by the
    score on composed windows that were left out."""
    rng = random.Random(seed)
    words = sorted({w for t, _ in windows for w in re.findall(r"[^\W\d_]+", t)}) or ["the", "and", "of", "to", "in"]
    known: dict[str, list[str]] = {}
    for text, spans in windows:
        for kind, a, b in spans:
            known.setdefault(kind, []).append(text[a:b])
    made = [composed(rng, words, known) for _ in range(n_composed)]
    out, every = made[:n_composed // 6], [*windows, *made[n_composed // 6:]]

    def arrays(rows: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.zeros((len(rows), WINDOW), np.int64), np.zeros((len(rows), WINDOW), np.int64)
        for i, (text, spans) in enumerate(rows):
            c = classes(text[:WINDOW])
            x[i, :len(c)] = c
            y[i] = tags_of(WINDOW, [(k, a, min(b, WINDOW)) for k, a, b in spans])
        return x, y

    tagger = Tagger(N_CLASSES, _allowed())
    x_out, y_out = arrays(out)
    tagger.train(*arrays(every), epochs, 24, score=(lambda: span_score(tagger.decode(x_out)[0], y_out)) if out else None)
    return tagger


def span_score(tags: np.ndarray, gold: np.ndarray) -> float:
    """F1 of whole spans, kind and both ends right."""
    flat = np.zeros(tags.shape[1])
    found, real = ({(i, *s[:3]) for i, row in enumerate(rows) for s in _spans_in(row, flat, len(row))} for rows in (tags, gold))
    return 2 * len(found & real) / max(1, len(found) + len(real))


def _spans_in(tags: np.ndarray, margin: np.ndarray, length: int) -> Iterator[tuple[str, int, int, float]]:
    at = 0
    while at < length:
        tag = int(tags[at])
        if tag % 2 == 0:
            at += 1
            continue
        end = at + 1
        while end < length and tags[end] == tag + 1:
            end += 1
        yield KINDS[(tag - 1) // 2], at, end, float(margin[at:end].sum())
        at = end


def reconcile(candidates: dict[tuple[str, int, int], float], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of the candidates that leave the base spans alone, the non-overlapping
    set of greatest weight over the whole text."""
    # base spans of several kinds may overlap: their union, disjoint and in order
    begins: list[int] = []
    closes: list[int] = []
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if closes and a <= closes[-1]:
            closes[-1] = max(closes[-1], b)
        else:
            begins.append(a)
            closes.append(b)
    free = []
    for (kind, a, b), w in candidates.items():
        # the first stretch of base spans that ends behind the candidate's start
        i = bisect_right(closes, a)
        if w > 0 and (i == len(begins) or begins[i] >= b):
            free.append((b, a, kind, w))
    free.sort()
    ends = [f[0] for f in free]
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
    for i, (b, a, _, w) in enumerate(free):
        before = bisect_right(ends, a, 0, i)
        with_it = best[before][0] + w
        best.append((with_it, before, True) if with_it > best[i][0] else (best[i][0], i, False))
    out, i = [], len(free)
    while i:
        _, to, used = best[i]
        if used:
            out.append((free[i - 1][2], free[i - 1][1], free[i - 1][0]))
        i = to
    return out


def added_spans(tagger: Tagger, texts: list[str], bases: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Spans that the tagger adds to each text."""
    found: list[dict[tuple[str, int, int], float]] = [{} for _ in texts]
    todo: list[tuple[int, int]] = []
    rows: list[np.ndarray] = []

    def decode() -> None:
        x = np.zeros((len(rows), WINDOW), np.int64)
        for i, r in enumerate(rows):
            x[i, :len(r)] = r
        tags, margin = tagger.decode(x)
        for (doc, start), r, t, m in zip(todo, rows, tags, margin):
            for kind, a, b, w in _spans_in(t, m, len(r)):
                a, b = start + a, start + b
                if kind == "secret":
                    # what it is assigned to must be in sight; the window before sees that of a run that begins here
                    a, b = whole_run(texts[doc], a, b)
                    if start and a < start + SIGHT:
                        continue
                if form_holds(kind, texts[doc][a:b]):
                    found[doc][kind, a, b] = found[doc].get((kind, a, b), 0.0) + w
        todo.clear()
        rows.clear()

    for doc, text in enumerate(texts):
        for start in window_starts(text):
            todo.append((doc, start))
            rows.append(classes(text[start:start + WINDOW]))
            if len(rows) >= DECODE_ROWS:
                decode()
    if rows:
        decode()
    return [reconcile(f, b) if f else [] for f, b in zip(found, bases)]


# -------------------------------------------------------------------- Spark
def training_windows(docs: DataFrame) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled windows from the documents of least hash: windows with base
    spans and windows with other digits, a bounded number."""
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id")).limit(SAMPLE_DOCS)
    ids = ids.select(F.col("doc_id").alias("id"))
    some = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, str, list[int]]] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = base_spans(text or "") + assigned_secrets(text or "")
                starts = window_starts(text or "")
                for start in starts[::max(1, len(starts) // 2)][:2]:
                    inside = [(KINDS.index(k), max(0, a - start), z - start) for k, a, z in spans if a < start + WINDOW and z > start]
                    out.append((doc_id, text[start:start + WINDOW], [v for s in inside for v in s]))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.int64()))],
                                             names=["doc_id", "text", "spans"])

    windows = some.mapInArrow(cut, "doc_id long, text string, spans array<long>")
    rows = windows.orderBy(F.xxhash64("doc_id"), "text").limit(REAL_WINDOWS).collect()
    return [(r.text, [(KINDS[r.spans[i]], r.spans[i + 1], r.spans[i + 2]) for i in range(0, len(r.spans), 3)]) for r in rows]


def listed(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def find_personal(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, counts of the base spans by kind,
    base_sha256, spans (base and added) and n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_tagger(training_windows(docs)))
    names = [*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            added = added_spans(shared.value, texts, bases)
            counts = [pa.array([sum(s[0] == k for s in base) for base in bases], pa.int64()) for k in BASE_KINDS]
            yield pa.RecordBatch.from_arrays([
                b.column(0), *counts, pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base in bases], pa.string()),
                pa.array([listed([*x, *y]) for x, y in zip(bases, added)], pa.string()),
                pa.array([len(a) for a in added], pa.int64())], names=["doc_id", *names])

    kinds = [T.LongType()] * len(BASE_KINDS) + [T.StringType(), T.StringType(), T.LongType()]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in zip(names, kinds))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span's text replaced by its kind in brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_tagger(training_windows(docs)))
    at = docs.columns.index("text")

    def cover(text: str, spans: list[tuple[str, int, int]]) -> str:
        out, pos = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= pos:
                out.append(f"{text[pos:a]}[{kind}]")
                pos = b
            elif b > pos:  # what of the span stands beyond the one before
                pos = b
        return "".join([*out, text[pos:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            texts = [t or "" for t in old]
            bases = [base_spans(t) for t in texts]
            added = added_spans(shared.value, texts, bases)
            columns = list(b.columns)
            columns[at] = pa.array([None if o is None else cover(t, [*x, *y]) for o, t, x, y in zip(old, texts, bases, added)],
                                   b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
