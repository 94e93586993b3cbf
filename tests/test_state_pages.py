"""Tips and content ids in pages of the state: calls grow with pages, not with keys;
results are those of one delivery after another."""

import random
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import types as T

from keyfold.streaming import keyed as ks
from keyfold.streaming import pages as pg


class Handle:
    """State variables in dicts; counts the calls."""

    def __init__(self):
        self.calls, self.vars = 0, {}

    def getMapState(self, name, *_):
        return self.vars.setdefault(name, MapVar(self))

    def getValueState(self, name, *_):
        return self.vars.setdefault(name, ValueVar(self))


class MapVar(dict):
    def __init__(self, handle):
        self.handle = handle

    def _call(self, key):
        self.handle.calls += 1
        return tuple(key)

    def getValue(self, key):
        return self.get(self._call(key))

    def containsKey(self, key):
        return self._call(key) in self

    def updateValue(self, key, value):
        self[self._call(key)] = value

    def removeKey(self, key):
        del self[self._call(key)]


class ValueVar:
    value = None

    def __init__(self, handle):
        self.handle = handle

    def exists(self):
        self.handle.calls += 1
        return self.value is not None

    def get(self):
        self.handle.calls += 1
        return self.value

    def update(self, value):
        self.handle.calls += 1
        self.value = value


class Timers:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


TYPES = {"rid": T.LongType(), "stream_id": T.LongType(), "origin": T.StringType(), "cid": T.StringType()}


def started(cls, ttl=None):
    p, handle = cls(TYPES, ttl), Handle()
    p.init(handle)
    return p, handle


def fed(p, rows, keys, now=0):
    """One micro-batch, in two frames; the rows with their flags, by arrival."""
    d = pd.DataFrame(rows)
    d["kf_hash"] = [hash(tuple(r[k] for k in keys)) & 0x7FFFFFFF for r in rows]
    half = len(d) // 2
    out = pd.concat(list(p.handleInputRows((0,), iter([f for f in (d[half:], d[:half]) if len(f)]), Timers(now))))
    return out.sort_values("arrival_seq").to_dict("records")


def deliveries(n, streams, seed):
    rng = random.Random(seed)
    return [{"rid": rng.randrange(n), "stream_id": rng.choice([None, *range(streams)]), "origin": rng.choice(["a", "b", None]),
             "cid": rng.choice([None, *map(str, range(9))]), "ts_us": rng.choice([-(1 << 55) - 3, *range(-(1 << 55) - 9, -(1 << 55))]),
             "crt_us": i, "arrival_seq": i} for i in range(n)]


def one_by_one(rows):
    tips, cids, out = {}, set(), []
    for r in rows:
        tip = tips.get(key := (r["stream_id"], r["origin"]))
        ok = tip is None or r["ts_us"] >= tip["ts_us"]
        met = tip["rid"] if ok and tip else None
        new = ok and (r["stream_id"], r["cid"]) not in cids
        if ok:
            tips[key] = r
            cids.add((r["stream_id"], r["cid"]))
        out.append((ok, met, met is not None and met == r["rid"], new))
    return out


@pytest.mark.parametrize("page_rows,at_once", [(500, 1000), (4, 3)])
def test_flags_of_one_delivery_after_another(monkeypatch, page_rows, at_once):
    monkeypatch.setattr(pg, "PAGE_ROWS", page_rows)
    monkeypatch.setattr(pg, "PAGES_AT_ONCE", at_once)
    rows = deliveries(900, 60, 1)
    (tips, _), (cids, kept) = started(ks.TipProcessor), started(ks.CidProcessor)
    got = []
    for a, b in ((0, 20), (20, 21), (21, 500), (500, 900)):  # grows by little and by much
        flagged = fed(tips, rows[a:b], ("stream_id", "origin"))
        assert sum(r["final_tip"] for r in flagged) <= len({(r["stream_id"], r["origin"]) for r in rows[a:b]})
        got += fed(cids, [{k: v for k, v in r.items() if not k.startswith("_")} | {"stream_id": s["stream_id"]} for r, s in zip(flagged, rows[a:b])], ("stream_id", "cid"))
    assert [(r["accepted"], None if pd.isna(r["prev_tip_rid"]) else r["prev_tip_rid"], r["reprocessed"], r["new_cid"]) for r in got] == one_by_one(rows)
    pages, n_rows = kept.vars["cids_size"].value
    assert n_rows == sum(r["new_cid"] for r in got) and pages * page_rows >= n_rows


def test_calls_grow_with_pages(monkeypatch):
    """One call a key and more took 0.3 ms a delivery."""
    rows = [{"rid": i, "stream_id": i, "origin": "o", "cid": "c", "ts_us": 0, "crt_us": 0, "arrival_seq": i} for i in range(8_000)]
    for cls, keys in ((ks.TipProcessor, ("stream_id", "origin")), (ks.CidProcessor, ("stream_id", "cid"))):
        p, handle = started(cls)
        for a in range(0, 8_000, 2_000):
            out = fed(p, [r | {"accepted": True} for r in rows[a:a + 2_000]], keys)
            assert all(r.get("new_cid", True) for r in out)
        assert handle.calls < 400


def test_few_keys_move_few_pages():
    rows = [{"rid": i, "stream_id": i, "origin": "o", "cid": "c", "ts_us": 0, "crt_us": 0, "arrival_seq": i} for i in range(20_000)]
    p, handle = started(ks.TipProcessor)
    fed(p, rows, ("stream_id", "origin"))
    handle.calls = 0
    assert fed(p, [rows[7] | {"arrival_seq": 20_000}], ("stream_id", "origin"))[0]["prev_tip_rid"] == 7
    assert handle.calls <= 5 and max(len(v[0]) for v in handle.vars["tips"].values()) < 100_000


def test_a_row_expires_by_itself():
    """A page that was written since keeps no older row alive."""
    p, handle = started(ks.CidProcessor, timedelta(seconds=4))
    row = lambda s, seq: [{"stream_id": s, "cid": "c", "crt_us": 0, "arrival_seq": seq, "accepted": True}]
    new = lambda s, seq, now: fed(p, row(s, seq), ("stream_id", "cid"), now)[0]["new_cid"]
    assert new(1, 0, 1_000) and new(2, 1, 3_000) and not new(1, 2, 4_999)
    assert new(1, 3, 5_000) and not new(2, 4, 6_999) and new(2, 5, 7_000)
    assert handle.vars["cids_size"].value == (1, 2)
