"""Fill-in-the-middle: texts cut into prefix, middle and suffix, the middle moved
to the end behind marks, by displacement scatter.

A batch of texts is one run of bytes. Line breaks are scanned once for all texts,
the two cuts of each text follow from its hash. Prefix, middle and suffix each move
by one distance, so a difference array holds the changes of that distance at the
cuts; its running sum gives every byte its place in the output and one scatter
builds all outputs. ``restored`` finds the marks in the outputs alone, lays out the
inverse displacements the same way and gathers the texts back.

Defined cases: null texts are empty; empty texts, texts that hold a mark, and texts
beyond ``rate`` stay plain; null ids hash as the empty string; repeated rows come
out alike; an empty table gives no rows; very long texts are a slice of their own;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import conf_override
from .common import TEXT_BATCH, slices, stage

SEED, RATE, SPM = 7, 100, 50
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = 3
PLAIN, PSM, SPM_FORM = "plain", "psm", "spm"
FORMS = np.array([PLAIN, PSM, SPM_FORM], object)
#: Bytes that are laid out at once; a longer text is laid out alone.
SLICE = 4 << 20

COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more
    entry: the end)."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.empty(0, np.uint8)
    return body, at - at[0]


def as_texts(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data))


def places(starts: list[np.ndarray], shifts: list[np.ndarray], n: int) -> np.ndarray:
    """Index plus displacement of ``n`` bytes. ``starts`` are the ascending
    segment borders of each text, ``shifts`` the displacement from there on;
    borders that coincide (empty segments) cancel out in the sum."""
    at, by = np.stack(starts, 1).ravel(), np.stack(shifts, 1).ravel()
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, np.diff(by, prepend=0))
    return np.cumsum(change[:n]) + np.arange(n)


def line_cuts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Lines of each text, and a function from numbers of lines to the byte
    where so many lines end."""
    breaks = np.flatnonzero(data == 10)
    begin, end = starts[:-1], starts[1:]
    first = np.searchsorted(breaks, begin)
    count = np.searchsorted(breaks, end) - first
    tail = np.zeros(len(begin), bool)
    some = end > begin
    tail[some] = data[end[some] - 1] != 10
    lines = count + tail
    padded = np.append(breaks, 0)

    def cut(k: np.ndarray) -> np.ndarray:
        after = padded[np.clip(first + k - 1, 0, len(breaks))] + 1
        return np.where(k == 0, begin, np.where(k <= count, after, end))
    return lines, cut


def scatter(data: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All outputs and where each begins, for cuts ``a`` <= ``b`` and forms."""
    begin, end = starts[:-1], starts[1:]
    marked = form > 0
    a, b = np.where(marked, a, end), np.where(marked, b, end)
    prefix, suffix = a - begin, end - b
    out_starts = np.concatenate([[0], np.cumsum(end - begin + 3 * MARK * marked)])
    o = out_starts[:-1]
    psm = form == 1
    # where the marks stand, and the parts behind them
    p_mark = np.where(psm, o, o + MARK + suffix)
    s_mark = np.where(psm, o + MARK + prefix, o)
    m_mark = o + 2 * MARK + prefix + suffix
    skip = MARK * marked
    to_prefix = np.where(marked, p_mark + skip, o)
    shifts = [to_prefix - begin, m_mark + skip - a, s_mark + skip - b]
    out = np.empty(int(out_starts[-1]), np.uint8)
    out[places([begin, a, b], shifts, len(data))] = data
    for mark, at in ((PREFIX, p_mark), (SUFFIX, s_mark), (MIDDLE, m_mark)):
        for i, byte in enumerate(mark.encode()):
            out[at[marked] + i] = byte
    return out, out_starts


def gather(out: np.ndarray, starts: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts back from outputs and forms alone. A part holds no mark and a
    mark begins and ends with its brackets, so none is found across a border."""
    begin, end = starts[:-1], starts[1:]
    marked = form > 0
    open_, close = (ord(PREFIX[i]) for i in (0, 2))
    found = np.flatnonzero((out[:-2] == open_) & (out[2:] == close) & np.isin(out[1:-1], [ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]))
    owner = np.searchsorted(starts, found, "right") - 1
    # empty texts share a start: the last of them, which holds the byte, is the owner
    found = found[marked[owner] & (found + MARK <= end[owner])]
    if len(found) != 3 * int(marked.sum()):
        raise ValueError("an output does not hold its three marks")
    one, two, three = (begin.copy() for _ in range(3))
    one[marked], two[marked], three[marked] = found.reshape(-1, 3).T
    psm = form == 1
    first, second, third = one + MARK, two + MARK, three + MARK
    n1, n2, middle = two - first, three - second, end - third
    at_prefix, prefix = np.where(psm, first, second), np.where(psm, n1, n2)
    at_suffix, suffix = np.where(psm, second, first), np.where(psm, n2, n1)
    prefix, middle = np.where(marked, prefix, end - begin), np.where(marked, middle, 0)
    suffix = np.where(marked, suffix, 0)
    at_prefix = np.where(marked, at_prefix, begin)
    back = np.concatenate([[0], np.cumsum(prefix + middle + suffix)])
    r = back[:-1]
    index = places([r, r + prefix, r + prefix + middle],
                   [at_prefix - r, third - r - prefix, at_suffix - r - prefix - middle], int(back[-1]))
    return out[index], back


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1, SLICE):
        doc_id, text, *hashes, plain, spm = b.columns
        data, starts = text_bytes(text)
        lines, cut = line_cuts(data, starts)
        h1, h2 = (h.to_numpy() % (lines + 1) for h in hashes)
        a, c = cut(np.minimum(h1, h2)), cut(np.maximum(h1, h2))
        form = np.where(plain.to_numpy(zero_copy_only=False), 0, np.where(spm.to_numpy(zero_copy_only=False), 2, 1))
        out, out_starts = scatter(data, starts, a, c, form)
        # code points: bytes that do not continue one
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        chars = [pa.array(points[y] - points[x], pa.int64(), mask=form == 0) for x, y in ((starts[:-1], a), (a, c))]
        yield pa.RecordBatch.from_arrays([doc_id, pa.array(lines, pa.int64()), pa.array(FORMS[form], pa.string()), *chars, as_texts(out, out_starts)],
                                         ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _gather(output: int, form: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, output, SLICE):
            data, starts = text_bytes(b.column(output))
            kinds = np.searchsorted(FORMS.astype(str), b.column(form).to_numpy(zero_copy_only=False).astype(str))
            yield b.append_column("restored", as_texts(*gather(data, starts, kinds)))
    return run


def _hash(seed: int, i: int) -> Column:
    """The ``i``-th group of eight digits of the id's digest, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``doc_id``, ``n`` (lines), ``form`` (plain, psm, spm), ``prefix_chars``
    and ``middle_chars`` (null if plain) and ``output`` of every document.
    ``rate`` of 100 texts are rearranged, ``spm`` of 100 of these with the
    suffix first."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | held | (_hash(seed, 2) % 100 >= rate)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _hash(seed, 0).alias("h1"), _hash(seed, 1).alias("h2"),
                       plain.alias("plain"), (_hash(seed, 3) % 100 < spm).alias("spm"))
    return rows.mapInArrow(_scatter, COLUMNS)


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs`` (any columns with ``output`` and ``form``) and ``restored``:
    the text that an output was built from."""
    names = outputs.columns
    schema = T.StructType([*outputs.schema.fields, T.StructField("restored", T.StringType())])
    return outputs.mapInArrow(_gather(names.index("output"), names.index("form")), schema)


def middle_digests(docs: DataFrame) -> DataFrame:
    """What the query returns: outputs and restored texts as digests."""
    back = restored(fill_in_middle(docs))
    digests = back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                          F.sha2("restored", 256).alias("restored_sha256"))
    with conf_override(docs.sparkSession, TEXT_BATCH):
        return stage(digests, "fill-middle")


#: DuckDB: lines as a list, cuts by list slices.
SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
    SELECT *, regexp_extract_all(text, '[^' || chr(10) || ']*' || chr(10) || '|[^' || chr(10) || ']+') AS lines,
        ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
        ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
v AS (
    SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS lo,
        greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS hi,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
             WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (
    SELECT *, array_to_string(lines[1:lo], '') AS p, array_to_string(lines[lo + 1:hi], '') AS m,
        array_to_string(lines[hi + 1:n], '') AS s FROM v)
SELECT doc_id, n, form,
    CASE WHEN form = 'plain' THEN NULL ELSE length(p) END AS prefix_chars,
    CASE WHEN form = 'plain' THEN NULL ELSE length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
           ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM w
"""
