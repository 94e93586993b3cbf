"""Language identification by compression.

Every language has a zstandard raw-content dictionary of training text. A text is
cut into pieces, each piece is compressed with every dictionary, and the language
whose sizes add up to the least wins. Pieces are short, so a long text leans on
the dictionaries and not on itself. Narrow margins are measured again on short
overlapping pieces and, if still narrow, marked as rejected.

Dictionaries come from a bounded sample of labelled texts: at most DICT_BYTES a
language, in pieces from all over documents of least hash, sources in turn,
nothing twice. Every document is classified over its whole text.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
training rows with null language or text are left out; with no language learned
every text is ``und``; ties go to the language that comes first; repeated rows
are rows of their own; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import null_safe, stage

DICT_BYTES = 64 << 10
#: Documents sampled a language (twice as many are read, more where texts are short),
#: and the characters of a piece of them.
SAMPLE_DOCS, PIECE_CHARS = 400, 200
#: Stretches of so many bytes are taken into a dictionary once.
REPEAT = 24
LEVEL = 9
PIECE, SHORT = 512, 48
#: Margins (share of the best size) below this are measured again / rejected.
NARROW = 0.03
REJECT = 0.5
#: Bits of evidence are worth this much less than independent ones.
TEMPER = 0.15
UNKNOWN = "und"


def sample(docs: DataFrame, train: Column) -> list[tuple[str, str]]:
    """(lang, piece): pieces of at most PIECE_CHARS characters from all over the texts,
    chosen by hash, enough to fill a dictionary twice. Sources take turns, so a
    large one has no more than its part; groups are counted first and thinned by
    hash, so none is collected whole."""
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", "lang", source.alias("source")).filter(
        train & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    counts = rows.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.least(F.octet_length("text"), F.lit(PIECE_CHARS))).alias("bytes"))
    of_lang = Window.partitionBy("l")
    in_turn = of_lang.orderBy("n", "s")
    # texts wanted, and the level at which the sources' shares (n at most) add up to them
    wanted = F.greatest(F.lit(2.0 * SAMPLE_DOCS), 2.0 * DICT_BYTES * F.col("all") / F.col("all_bytes"))
    level = (F.col("wanted") - F.col("smaller")) / (F.col("sources") - F.row_number().over(in_turn) + 1)
    counts = (counts.withColumn("all", F.sum("n").over(of_lang)).withColumn("all_bytes", F.sum("bytes").over(of_lang))
              .withColumn("sources", F.count(F.lit(1)).over(of_lang)).withColumn("wanted", wanted)
              .withColumn("smaller", F.sum("n").over(in_turn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
              .withColumn("level", level)
              .withColumn("level", F.coalesce(F.max(F.when(F.col("level") <= F.col("n"), F.col("level"))).over(of_lang), F.col("all").cast("double")))
              .withColumn("each", F.ceil(2.0 * DICT_BYTES / PIECE_CHARS / F.least("all", F.lit(SAMPLE_DOCS))).cast("int")))
    counts = stage(counts.select("l", "s", "n", "level", "each"), "lang-counts")
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) * F.col("n")
    picked = rows.join(counts, null_safe(rows, counts, [("lang", "l"), ("source", "s")])).filter(turn < F.col("level"))
    places = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE_CHARS).cast("int")),
                         lambda i: F.struct(F.xxhash64("doc_id", i).alias("h"), i.alias("i")))
    few = picked.select("lang", turn.alias("turn"), F.transform(
        F.slice(F.sort_array(places), 1, F.col("each")),
        lambda p: F.col("text").substr(p["i"] * PIECE_CHARS + 1, F.lit(PIECE_CHARS))).alias("pieces"))
    held: dict[str, list[list[str]]] = {}
    for row in few.orderBy("lang", "turn", "pieces").toLocalIterator():
        held.setdefault(row.lang, []).append(row.pieces)
    # the first piece of every text, then the second
    return [(lang, p[i]) for lang, texts in held.items() for i in range(max(map(len, texts))) for p in texts if i < len(p)]


def dictionaries(pieces: list[tuple[str, str]], dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """The pieces of each language until its dictionary is full, without the
    stretches that stand in it already."""
    body: dict[str, bytearray] = {}
    known: dict[str, set[bytes]] = {}
    for lang, piece in pieces:
        out, seen = body.setdefault(lang, bytearray()), known.setdefault(lang, set())
        if len(out) >= dict_bytes:
            continue
        data = piece.lower().encode("utf-8", "replace")
        width = min(REPEAT, max(1, len(data)))
        runs = [data[i:i + width] for i in range(len(data) - width + 1)]
        fresh = np.ones(len(data), bool)
        for i, run in enumerate(runs):
            if run in seen:
                fresh[i:i + width] = False
        seen.update(runs)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], fresh.view(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2]):
            out += data[a:b] + b"\n"
    return {lang: bytes(body[lang][:dict_bytes]) for lang in sorted(body)}


class Classifier:
    def __init__(self, dicts: dict[str, bytes], level: int = LEVEL) -> None:
        self.langs = sorted(dicts)
        self.press = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dicts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(
                level, dict_size=len(dicts[lang]), source_size=PIECE, min_match=3,
                write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=params)
            self.press.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def _sizes(self, data: bytes, piece: int, step: int) -> np.ndarray:
        parts = [data[a:a + piece] for a in range(0, max(1, len(data)), step)]
        return np.array([sum(map(len, map(press, parts))) for press in self.press], float)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        data = text.lower().encode("utf-8", "replace")
        sizes = self._sizes(data, PIECE, PIECE)
        if len(sizes) > 1:
            two = np.partition(sizes, 1)[:2]
            if two[1] - two[0] <= NARROW * two[0]:
                # the text's own repetitions hide the dictionaries: ask short pieces, by the kilobyte at most
                own = dict.fromkeys(data.split())
                short = b" ".join(own)
                sizes = sizes / sizes.min() + self._sizes(short, SHORT, SHORT // 2) / max(1, len(short))
                sizes = sizes * len(short) / 2
        bits = 8 * TEMPER * (sizes - sizes.min())
        p = np.exp2(-np.minimum(bits, 1000))
        best = int(np.argmin(sizes))
        score = float(1 / p.sum())
        return self.langs[best], score, score < REJECT


def identify(docs: DataFrame, train: Column) -> DataFrame:
    """All columns of ``docs`` with lang_pred, lang_score and lang_rejected."""
    dicts = dictionaries(sample(docs, train))
    shared = docs.sparkSession.sparkContext.broadcast(dicts)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Classifier(shared.value).predict
        for b in batches:
            got = [predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.bool_())], names=[*names, "lang_pred", "lang_score", "lang_rejected"])

    return docs.mapInArrow(run, T.StructType([
        *docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()),
        T.StructField("lang_rejected", T.BooleanType())]))


def predict_language(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, rejected."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == held, F.lit(False))
    some = docs.select("doc_id", "text", "lang", *[c for c in docs.columns if c == "source"])
    found = identify(some, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
                        F.col("lang_rejected").alias("rejected"))
