"""Sequential reference folds used only by the tests (the service's logic,
one message at a time)."""

from __future__ import annotations


def dedupe_fold(rows, tips=None, cids=None):
    """rows: dicts with rid, stream_id, origin, cid, ts, arrival_seq.
    Returns list of (arrival_seq, event, target_rid, reason) and final state."""
    tips = dict(tips or {})   # (stream, origin) -> (ts, rid)
    cids = set(cids or ())    # (stream, cid)
    out = []
    for r in sorted(rows, key=lambda x: x["arrival_seq"]):
        key = (r["stream_id"], r["origin"])
        old = tips.get(key)
        if old is not None and not (old[0] <= r["ts"]):
            out.append((r["arrival_seq"], "REPLACED", r["rid"], "stale"))
            continue
        tips[key] = (r["ts"], r["rid"])
        reproc = old is not None and old[1] == r["rid"]
        if old is not None and not reproc:
            out.append((r["arrival_seq"], "REPLACED", old[1], "replaced_tip"))
        ck = (r["stream_id"], r["cid"])
        stored = ck not in cids
        cids.add(ck)
        if not stored and not reproc:
            out.append((r["arrival_seq"], "REPLACED", r["rid"], "duplicate_cid"))
        else:
            out.append((r["arrival_seq"], "READY", r["rid"], "reprocessed" if reproc else "new"))
    return out, tips, cids


def batch_fold(rows, size, linger_us, flush_us):
    """rows: (rid, ts_us) in arrival order. Greedy batches: close on size,
    on first + linger, or at the flush boundary. Returns list of rid lists."""
    batches, cur, first = [], [], None
    for rid, t in sorted(rows, key=lambda x: (x[1], x[0])):
        if cur:
            boundary = (first // flush_us + 1) * flush_us
            if t >= boundary or t >= first + linger_us:
                batches.append(cur)
                cur, first = [], None
        if not cur:
            first = t
        cur.append(rid)
        if len(cur) == size:
            batches.append(cur)
            cur, first = [], None
    if cur:
        batches.append(cur)
    return batches


def status_fold(initial, events):
    """initial: id -> status; events: (id, sts, seq)."""
    cur = dict(initial)
    for i, s, _ in sorted(events, key=lambda e: e[2]):
        if i not in cur:
            continue
        if s == 5:
            if cur[i] == 0:
                cur[i] = 5
        else:
            cur[i] = s
    return cur
