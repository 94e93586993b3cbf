"""Keyed rows in a map state, some hundred of them to a value.

Each read or write of a state value from Python is a call to the JVM, whose cost
hardly depends on the value's size. So a value is a page: the rows, as an Arrow
record batch, whose key hash falls to it. A micro-batch reads each page that its
keys fall to once, and writes each page that it changed once.

Pages double with the number of keys, so that a page holds some hundred rows
however large the state is, and a micro-batch of few keys moves few rows. Pages
are read some at a time, which bounds what a task holds of the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessorHandle

from ..functions.timecols import micros_of

#: Rows of a page (about half as many to twice as many), and pages held at once.
PAGE_ROWS, PAGES_AT_ONCE = 500, 1_000
#: A stored row's key hash, and the clock's milliseconds when it was stored. (Spark
#: hands rows over as named tuples, which rename what begins with an underscore.)
HASH, STORED = "kf_hash", "kf_stored"


def millis(ttl: timedelta | None) -> int | None:
    return None if ttl is None else max(1, micros_of(ttl) // 1000)


def hash_of(*keys: str) -> Column:
    """Key hash that pages are dealt by: not the one that buckets are dealt by."""
    return F.hash(*keys).bitwiseAND(F.lit(0x7FFFFFFF))


def key_codes(*columns: pa.Array) -> np.ndarray:
    """A number for each row: the same for equal keys, of which nulls are some."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        coded = c.dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)[1]
    return code


class Pages:
    """The rows of ``types`` by key hash, in the map state ``name`` of a handle.
    A row that was stored ``ttl`` ago counts as absent; it leaves the state when
    its page is written next, at the latest ``ttl`` after the page was."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, types: dict[str, T.DataType], ttl: timedelta | None) -> None:
        self.ttl = millis(ttl)
        self.schema = pa.schema([(HASH, pa.int32()), (STORED, pa.int64()), *((n, to_arrow_type(t)) for n, t in types.items())])
        self.pages = handle.getMapState(name, "page int", "data binary", self.ttl)
        self.size = handle.getValueState(f"{name}_size", "pages int, n_rows long")

    def table(self, rows: pd.DataFrame, now: int) -> pa.Table:
        """Rows to store; they have the column HASH."""
        return pa.table([pa.array(np.full(len(rows), now)) if f.name == STORED else pa.Array.from_pandas(rows[f.name], type=f.type) for f in self.schema],
                        schema=self.schema)

    def _read(self, numbers: list[int]) -> pa.Table:
        got = [v for v in map(self.pages.getValue, ((p,) for p in numbers)) if v is not None]
        return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(v[0])), self.schema) for v in got], self.schema).combine_chunks()

    def _write(self, rows: pa.Table, pages: int, numbers: list[int]) -> None:
        """Write the pages ``numbers``, to which all ``rows`` fall."""
        at = rows[HASH].to_numpy() % pages
        order = np.argsort(at, kind="stable")
        batch = rows.take(pa.array(order)).combine_chunks()
        starts, stops = (np.searchsorted(at[order], numbers, side).tolist() for side in ("left", "right"))
        for p, a, b in zip(numbers, starts, stops):
            if a < b:
                self.pages.updateValue((p,), (batch.slice(a, b - a).to_batches()[0].serialize().to_pybytes(),))
            elif self.pages.containsKey((p,)):
                self.pages.removeKey((p,))

    def parts(self, hashes: np.ndarray, now: int) -> Iterator["Part"]:
        """What is stored where ``hashes`` fall to, some pages at a time."""
        if not len(hashes):
            return
        old, n_rows = self.size.get() if self.size.exists() else (0, 0)
        pages = max(old, 1)
        while pages * PAGE_ROWS < n_rows + len(np.unique(hashes)):
            pages *= 2
        if pages > old:
            for p in range(old):  # the rows of a page go to it and to new ones
                self._write(self._read([p]), pages, list(range(p, pages, old)))
        page = hashes % pages
        order = np.argsort(page, kind="stable")
        numbers = np.unique(page)
        grown = 0
        for a in range(0, len(numbers), PAGES_AT_ONCE):
            some = numbers[a:a + PAGES_AT_ONCE]
            first, last = np.searchsorted(page[order], some[0]), np.searchsorted(page[order], some[-1], "right")
            part = Part(self, pages, some, np.sort(order[first:last]), now)
            yield part
            grown += part.grown
        self.size.update((pages, n_rows + grown))


class Part:
    """Some pages: ``rows``, the numbers of the hashes that fall to them, and
    ``held``, the rows that they hold."""

    def __init__(self, of: Pages, pages: int, numbers: np.ndarray, rows: np.ndarray, now: int) -> None:
        self.of, self.pages, self.rows, self.grown = of, pages, rows, 0
        self.all = of._read(numbers.tolist())
        live = np.ones(len(self.all), bool) if of.ttl is None else self.all[STORED].to_numpy() + of.ttl > now
        self.held = self.all.filter(pa.array(live)).combine_chunks()

    def put(self, kept: np.ndarray, new: pa.Table) -> None:
        """Store ``new`` beside those of ``held`` that are ``kept``. Pages to
        which no new row falls stay as they are."""
        if not len(new):
            return
        changed = np.unique(new[HASH].to_numpy() % self.pages)
        there = lambda t: np.isin(t[HASH].to_numpy() % self.pages, changed)
        rows = pa.concat_tables([self.held.filter(pa.array(kept & there(self.held))), new])
        self.of._write(rows, self.pages, changed.tolist())
        self.grown = len(rows) - int(there(self.all).sum())
