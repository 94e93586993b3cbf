"""DuckDB oracle SQL per registered query.

Written independently of the Spark code, in the service's sequential terms
(correlated subqueries: "the last accepted delivery before this one"), over
the same adapters as ``keyfold/sources/testdata.py``.
"""

from __future__ import annotations

DELIVERIES = """
deliveries AS (
  SELECT event_id AS rid, user_id AS stream_id, event_type AS origin, props AS cid,
         CAST(date_trunc('day', ts) AS TIMESTAMP) - to_days(CAST(event_id % 5 AS INTEGER)) AS ts,
         ts AS crt, event_id * 10 AS arrival_seq
  FROM events
  UNION ALL
  SELECT event_id, user_id, event_type, props,
         CAST(date_trunc('day', ts) AS TIMESTAMP) - to_days(CAST(event_id % 5 AS INTEGER)),
         ts, event_id * 10 + 1
  FROM events WHERE event_id % 11 = 0
  UNION ALL
  SELECT event_id, user_id, event_type, props,
         CAST(date_trunc('day', ts) AS TIMESTAMP) - to_days(CAST(event_id % 5 AS INTEGER)),
         ts, (event_id + 37) * 10 + 2
  FROM events WHERE event_id % 13 = 0
)"""


def dedupe_flags(src: str = "deliveries", seed_tips: str | None = None, seed_cids: str | None = None,
                 sfx: str = "") -> str:
    """CTEs ``acc`` and ``flags`` over delivery CTE ``src``: the tip a delivery
    meets is the last accepted delivery (or stored tip) of its stream/origin."""
    tip_seed_max = ""
    tip_seed_rid = "NULL"
    cid_seed = ""
    if seed_tips:
        tip_seed_max = f"""
         , (SELECT max(s.ts) FROM {seed_tips} s WHERE s.stream_id = d.stream_id AND s.origin = d.origin)"""
        tip_seed_rid = f"(SELECT s.rid FROM {seed_tips} s WHERE s.stream_id = a.stream_id AND s.origin = a.origin)"
    if seed_cids:
        cid_seed = f"""
        AND NOT EXISTS (SELECT 1 FROM {seed_cids} s WHERE s.stream_id = p.stream_id AND s.cid = p.cid)"""
    return f"""
tipped{sfx} AS (
  SELECT d.*, greatest(
           (SELECT max(p.ts) FROM {src} p
             WHERE p.stream_id = d.stream_id AND p.origin = d.origin AND p.arrival_seq < d.arrival_seq){tip_seed_max}
         ) AS prior_max_ts
  FROM {src} d
),
acc{sfx} AS (
  SELECT *, (prior_max_ts IS NULL OR ts >= prior_max_ts) AS accepted FROM tipped{sfx}
),
prev{sfx} AS (
  SELECT a.*, coalesce(
           (SELECT p.rid FROM acc{sfx} p
             WHERE p.stream_id = a.stream_id AND p.origin = a.origin AND p.accepted
               AND p.arrival_seq < a.arrival_seq
             ORDER BY p.arrival_seq DESC LIMIT 1),
           {tip_seed_rid}) AS last_tip_rid
  FROM acc{sfx} a
),
flags{sfx} AS (
  SELECT p.rid, p.stream_id, p.origin, p.cid, p.ts, p.crt, p.arrival_seq, p.accepted,
         CASE WHEN p.accepted THEN p.last_tip_rid END AS prev_tip_rid,
         coalesce(p.accepted AND p.last_tip_rid = p.rid, false) AS reprocessed,
         (p.accepted AND NOT EXISTS (
            SELECT 1 FROM acc{sfx} q WHERE q.accepted AND q.stream_id = p.stream_id AND q.cid = p.cid
              AND q.arrival_seq < p.arrival_seq){cid_seed}) AS new_cid
  FROM prev{sfx} p
)"""


OUTCOMES_FROM_FLAGS = """
SELECT arrival_seq, rid, 0 AS event_ord, 'REPLACED' AS event, rid AS target_rid, 'stale' AS reason
  FROM flags WHERE NOT accepted
UNION ALL
SELECT arrival_seq, rid, 0, 'REPLACED', prev_tip_rid, 'replaced_tip'
  FROM flags WHERE accepted AND prev_tip_rid IS NOT NULL AND NOT reprocessed
UNION ALL
SELECT arrival_seq, rid, 1, 'REPLACED', rid, 'duplicate_cid'
  FROM flags WHERE accepted AND NOT new_cid AND NOT reprocessed
UNION ALL
SELECT arrival_seq, rid, 1, 'READY', rid, 'reprocessed'
  FROM flags WHERE accepted AND reprocessed
UNION ALL
SELECT arrival_seq, rid, 1, 'READY', rid, 'new'
  FROM flags WHERE accepted AND new_cid AND NOT reprocessed
"""

SQL: dict[str, str] = {}

SQL["tip_accept"] = f"""
WITH {DELIVERIES}, {dedupe_flags()}
SELECT arrival_seq, rid, stream_id, origin, accepted FROM flags
"""

SQL["previous_tip"] = f"""
WITH {DELIVERIES}, {dedupe_flags()}
SELECT arrival_seq, rid, prev_tip_rid FROM flags
"""

SQL["first_cid"] = f"""
WITH {DELIVERIES}, {dedupe_flags()}
SELECT arrival_seq, rid, stream_id, cid, accepted, new_cid FROM flags
"""

SQL["reprocessed_flag"] = f"""
WITH {DELIVERIES}, {dedupe_flags()}
SELECT arrival_seq, rid, reprocessed FROM flags
"""

SQL["dedupe_outcomes"] = f"""
WITH {DELIVERIES}, {dedupe_flags()}
{OUTCOMES_FROM_FLAGS}
"""

SQL["tip_state"] = f"""
WITH {DELIVERIES}, {dedupe_flags()}
SELECT f.stream_id, f.origin, f.rid, f.cid, f.ts, f.crt FROM flags f
WHERE f.accepted AND f.arrival_seq = (
  SELECT max(g.arrival_seq) FROM flags g
  WHERE g.accepted AND g.stream_id = f.stream_id AND g.origin = f.origin)
"""

SQL["cid_state"] = f"""
WITH {DELIVERIES}, {dedupe_flags()}
SELECT stream_id, cid, crt FROM flags WHERE new_cid
"""

SQL["project_state_keys"] = f"""
WITH {DELIVERIES}
SELECT arrival_seq, stream_id, origin, rid AS tip_rid, cid AS tip_cid, ts AS tip_ts, crt AS tip_crt,
       stream_id AS cid_stream_id, cid AS cid_cid, crt AS cid_crt
FROM deliveries
"""

# Split run: state after the first half of the deliveries seeds the second half.
SPLIT = """
split AS (SELECT (max(event_id) + 1) * 5 AS at FROM events),
first_half AS (SELECT d.* FROM deliveries d, split WHERE d.arrival_seq < split.at),
second_half AS (SELECT d.* FROM deliveries d, split WHERE d.arrival_seq >= split.at)"""


SQL["seed_state"] = f"""
WITH {DELIVERIES}, {SPLIT}, {dedupe_flags("first_half", sfx="1")},
seed_tips AS (
  SELECT f.stream_id, f.origin, f.rid, f.ts FROM flags1 f
  WHERE f.accepted AND f.arrival_seq = (
    SELECT max(g.arrival_seq) FROM flags1 g
    WHERE g.accepted AND g.stream_id = f.stream_id AND g.origin = f.origin)),
seed_cids AS (SELECT stream_id, cid FROM flags1 WHERE new_cid),
{dedupe_flags("second_half", "seed_tips", "seed_cids")}
{OUTCOMES_FROM_FLAGS}
"""

SQL["cid_seen_semi_anti"] = f"""
WITH {DELIVERIES}, {SPLIT}, {dedupe_flags("first_half", sfx="1")},
seed_cids AS (SELECT stream_id, cid FROM flags1 WHERE new_cid)
SELECT d.arrival_seq, d.stream_id, d.cid,
       EXISTS (SELECT 1 FROM seed_cids s WHERE s.stream_id = d.stream_id AND s.cid = d.cid) AS cid_stored
FROM second_half d
"""

SQL["state_point_reads"] = f"""
WITH {DELIVERIES}, {SPLIT}, {dedupe_flags("first_half", sfx="1")}
SELECT f.stream_id, f.origin, f.rid, f.cid, f.ts, f.crt FROM flags1 f
WHERE f.accepted AND f.arrival_seq = (
  SELECT max(g.arrival_seq) FROM flags1 g
  WHERE g.accepted AND g.stream_id = f.stream_id AND g.origin = f.origin)
AND EXISTS (SELECT 1 FROM second_half d WHERE d.stream_id = f.stream_id AND d.origin = f.origin)
"""


# ---------------------------------------------------------------- J2 batching
DAY_US = 86400000000


def _batch_rows_sql() -> str:
    return f"""
brows AS (
  SELECT event_id AS rid, ts, epoch_us(ts) AS us, epoch_us(ts) // {DAY_US} AS flush_window,
         row_number() OVER (PARTITION BY epoch_us(ts) // {DAY_US} ORDER BY ts, event_id) AS rn
  FROM events)"""


def _closed_members_sql(size: int) -> str:
    return f"""{_batch_rows_sql()},
members AS (SELECT *, (rn - 1) // {size} AS batch_no FROM brows)"""


def _linger_members_sql(size: int, linger_us: int) -> str:
    """Greedy chain with a recursive CTE: start at row 1; the next batch starts
    after ``size`` rows or at the first row at/after first + linger."""
    return f"""{_batch_rows_sql()},
wsize AS (SELECT flush_window, count(*) AS n FROM brows GROUP BY flush_window),
nxt AS (
  SELECT a.flush_window, a.rn,
         least(a.rn + {size}, 1 + (SELECT count(*) FROM brows b
                                    WHERE b.flush_window = a.flush_window AND b.us < a.us + {linger_us})) AS nrn
  FROM brows a),
chain AS (
  WITH RECURSIVE c(flush_window, rn) AS (
    SELECT flush_window, 1 FROM wsize
    UNION ALL
    SELECT x.flush_window, x.nrn FROM c JOIN nxt x ON x.flush_window = c.flush_window AND x.rn = c.rn
    JOIN wsize s ON s.flush_window = x.flush_window WHERE x.nrn <= s.n)
  SELECT * FROM c),
members AS (
  SELECT r.*, (SELECT count(*) FROM chain c WHERE c.flush_window = r.flush_window AND c.rn <= r.rn) - 1 AS batch_no
  FROM brows r)"""


def _batches_sql(size: int, linger_us: int) -> str:
    return f"""
batches AS (
  SELECT flush_window, batch_no, count(*) AS n, min(us) AS first_us,
         list(rid ORDER BY rn) AS rids
  FROM members GROUP BY flush_window, batch_no),
out AS (
  SELECT b.*,
         CASE WHEN n >= {size} THEN 'full'
              WHEN first_us + {linger_us} < (flush_window + 1) * {DAY_US} THEN 'linger'
              ELSE 'flush' END AS reason,
         make_timestamp(first_us) AS first_ts,
         make_timestamp((flush_window + 1) * {DAY_US}) AS boundary,
         sha256(concat_ws('|', CAST(flush_window AS VARCHAR), CAST(batch_no AS VARCHAR),
                          CAST(rids[1] AS VARCHAR))) AS h
  FROM batches b),
final AS (
  SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' ||
            substr(h, 17, 4) || '-' || substr(h, 21, 12) AS bid
  FROM out)"""


H24, H1 = 24 * 3600 * 1000000, 3600 * 1000000
BATCH_COLS = "bid, flush_window, batch_no, n, rids, reason, first_ts, boundary"

SQL["flush_window"] = f"""
SELECT event_id AS rid, epoch_us(ts) // {DAY_US} AS flush_window,
       make_timestamp((epoch_us(ts) // {DAY_US} + 1) * {DAY_US}) AS boundary
FROM events
"""

SQL["batch_ordinal"] = f"""
WITH {_closed_members_sql(16)}
SELECT rid, flush_window, rn, batch_no FROM members
"""

SQL["collect_batch_members"] = f"""
WITH {_closed_members_sql(16)}, {_batches_sql(16, H24)}
SELECT {BATCH_COLS} FROM final
"""

SQL["batch_linger"] = f"""
WITH {_linger_members_sql(16, H1)}, {_batches_sql(16, H1)}
SELECT {BATCH_COLS} FROM final
"""

SQL["batch_size_distribution"] = f"""
WITH {_linger_members_sql(16, H1)}, {_batches_sql(16, H1)}
SELECT CAST(CASE WHEN n <= 4 THEN 4 WHEN n <= 8 THEN 8 WHEN n <= 12 THEN 12 WHEN n <= 16 THEN 16 END AS BIGINT) AS size_upto,
       count(*) AS n_batches, CAST(sum(n) AS BIGINT) AS n_requests, min(n) AS min_size, max(n) AS max_size,
       avg(n) AS avg_size, median(n) AS median_size
FROM final GROUP BY 1
"""

SQL["batch_size_quantiles"] = f"""
WITH {_linger_members_sql(16, H1)}, {_batches_sql(16, H1)}
SELECT CAST(date_trunc('month', make_timestamp(flush_window * {DAY_US})) AS DATE) AS month, count(*) AS n_batches,
       CAST(sum(n) AS BIGINT) AS n_requests, min(n) AS min_size, max(n) AS max_size,
       true AS p50_within, true AS p90_within, true AS p99_within
FROM final GROUP BY 1
"""

SQL["batch_key"] = f"""
WITH {_closed_members_sql(16)}, {_batches_sql(16, H24)}
SELECT bid, 'anchor/batch/' || bid AS batch_key FROM final
"""

SQL["write_batches"] = f"""
WITH {_closed_members_sql(16)}, {_batches_sql(16, H24)}
SELECT bid, 'anchor/batch/' || bid AS batch_key, rids, flush_window FROM final
"""

SQL["write_batch_manifest"] = f"""
WITH {_closed_members_sql(16)}, {_batches_sql(16, H24)}
SELECT bid, flush_window, CAST(0 AS INTEGER) AS manifest_ids, CAST(len(rids) AS INTEGER) AS stored_ids FROM final
"""


# ---------------------------------------------------------------- J3 status
REQUESTS = """
requests AS (
  SELECT event_id AS request_id, CAST(event_id % 6 AS SMALLINT) AS status, ts AS updated_at FROM events)"""

REPLACED_EVENTS = f"""
outcomes AS ({OUTCOMES_FROM_FLAGS}),
rep AS (SELECT target_rid AS id, arrival_seq * 2 + event_ord AS seq FROM outcomes WHERE event = 'REPLACED')"""

SQL["status_fold"] = """
WITH RECURSIVE
ev AS (
  SELECT user_id AS id,
         CASE WHEN event_id % 3 <> 0 THEN 5 ELSE (event_id // 3) % 6 END AS sts,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k
  FROM events),
ids AS (SELECT DISTINCT user_id AS id, user_id % 6 AS status FROM events),
fold(id, k, status) AS (
  SELECT id, 0, status FROM ids
  UNION ALL
  SELECT f.id, f.k + 1,
         CASE WHEN e.sts = 5 THEN (CASE WHEN f.status = 0 THEN 5 ELSE f.status END) ELSE e.sts END
  FROM fold f JOIN ev e ON e.id = f.id AND e.k = f.k + 1)
SELECT id, CAST(status AS SMALLINT) AS status
FROM fold f WHERE k = (SELECT max(k) FROM fold g WHERE g.id = f.id)
"""

SQL["update_status"] = f"""
WITH {DELIVERIES}, {dedupe_flags()}, {REPLACED_EVENTS}, {REQUESTS},
hit AS (SELECT DISTINCT id FROM rep)
SELECT r.request_id,
       CAST(CASE WHEN r.status = 0 AND h.id IS NOT NULL THEN 5 ELSE r.status END AS SMALLINT) AS status,
       (r.status = 0 AND h.id IS NOT NULL) AS changed,
       CASE WHEN r.status = 0 AND h.id IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE r.updated_at END
         AS updated_at
FROM requests r LEFT JOIN hit h ON h.id = r.request_id
"""

SQL["filter_allowed_transition"] = f"""
WITH {DELIVERIES}, {dedupe_flags()}, {REPLACED_EVENTS}, {REQUESTS}
SELECT rep.seq, rep.id, (r.status = 0) AS allowed
FROM rep JOIN requests r ON r.request_id = rep.id
"""

SQL["pending_count"] = """
SELECT count(*) FILTER (WHERE event_id % 6 = 0) AS pending_requests FROM events
"""

# ---------------------------------------------------------------- messages / J5
UUID_SQL = "('00000000-0000-4000-8000-' || lower(lpad(hex({e}), 12, '0')))"
MSG_TS = "(CAST(date_trunc('day', ts) AS TIMESTAMP) - to_days(CAST(event_id % 5 AS INTEGER)))"
RFC = "'%Y-%m-%dT%H:%M:%S.%fZ'"


def _uuid(e: str) -> str:
    return UUID_SQL.format(e=e)


REQUEST_JSON = (f"json_object('rid', {_uuid('event_id')}, 'sid', CAST(user_id AS VARCHAR), 'cid', props, "
                f"'org', event_type, 'ts', strftime({MSG_TS}, {RFC}), 'crt', strftime(ts, {RFC}))::VARCHAR")
BAD_TS_JSON = f"json_object('rid', {_uuid('event_id')}, 'ts', 'bad')::VARCHAR"

REQUEST_TEXTS = f"""
texts AS (
  SELECT event_id AS seq,
         CASE WHEN event_id % 17 = 0 THEN 'hello'
              WHEN event_id % 19 = 0 THEN {BAD_TS_JSON}
              WHEN event_id % 23 = 0 THEN '{{}}'
              ELSE {REQUEST_JSON} END AS value
  FROM events)"""

PARSED_REQUESTS = f"""
{REQUEST_TEXTS},
j AS (
  SELECT seq, value, json_valid(value) AND starts_with(ltrim(value), '{{') AS is_obj,
         CASE WHEN json_valid(value) THEN json_extract_string(value, '$.rid') END AS rid, CASE WHEN json_valid(value) THEN json_extract_string(value, '$.sid') END AS sid,
         CASE WHEN json_valid(value) THEN json_extract_string(value, '$.cid') END AS cid, CASE WHEN json_valid(value) THEN json_extract_string(value, '$.org') END AS org,
         CASE WHEN json_valid(value) THEN json_extract_string(value, '$.ts') END AS ts, CASE WHEN json_valid(value) THEN json_extract_string(value, '$.crt') END AS crt
  FROM texts),
chk AS (
  SELECT *, coalesce(is_obj
         AND (rid IS NULL OR regexp_full_match(rid, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}'))
         AND (ts IS NULL OR regexp_full_match(ts, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?Z'))
         AND (crt IS NULL OR regexp_full_match(crt, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?Z')),
         false) AS ok
  FROM j),
parsed AS (
  SELECT seq,
         CASE WHEN ok THEN lower(coalesce(rid, '00000000-0000-0000-0000-000000000000')) END AS rid,
         CASE WHEN ok THEN coalesce(sid, '') END AS stream_id,
         CASE WHEN ok THEN coalesce(cid, '') END AS cid,
         CASE WHEN ok THEN coalesce(org, '') END AS origin,
         CASE WHEN ok THEN coalesce(CAST(rtrim(ts, 'Z') AS TIMESTAMP), TIMESTAMP '0001-01-01 00:00:00') END AS ts,
         CASE WHEN ok THEN coalesce(CAST(rtrim(crt, 'Z') AS TIMESTAMP), TIMESTAMP '0001-01-01 00:00:00') END AS crt,
         NOT ok AS malformed
  FROM chk)"""

SQL["parse_requests"] = f"""
WITH {PARSED_REQUESTS}
SELECT seq, rid, stream_id, cid, origin, ts, crt, malformed FROM parsed
"""

SQL["quarantine_malformed"] = f"""
WITH {PARSED_REQUESTS}
SELECT seq, CASE WHEN malformed THEN 'quarantine' ELSE 'valid' END AS route FROM parsed
"""

SQL["parse_status"] = f"""
WITH texts AS (
  SELECT event_id AS seq,
         CASE WHEN event_id % 10 = 9 THEN 'invalid request'
              WHEN event_id % 7 = 0 THEN json_object('rid', {_uuid('user_id')})::VARCHAR
              ELSE json_object('rid', {_uuid('user_id')},
                               'sts', CASE WHEN event_id % 3 <> 0 THEN 5 ELSE (event_id // 3) % 6 END)::VARCHAR
         END AS value
  FROM events),
j AS (
  SELECT seq, coalesce(json_valid(value) AND starts_with(value, '{{'), false) AS ok,
         CASE WHEN json_valid(value) THEN json_extract_string(value, '$.rid') END AS rid, CASE WHEN json_valid(value) THEN json_extract_string(value, '$.sts') END AS sts
  FROM texts)
SELECT seq, CASE WHEN ok THEN lower(coalesce(rid, '00000000-0000-0000-0000-000000000000')) END AS rid,
       CASE WHEN ok THEN CAST(coalesce(sts, '0') AS SMALLINT) END AS sts, NOT ok AS malformed
FROM j
"""

DEAD_LETTER_TEXTS = f"""
dl AS (
  SELECT event_id AS seq,
         CASE event_id % 5
           WHEN 0 THEN {REQUEST_JSON}
           WHEN 1 THEN json_object('rid', {_uuid('event_id')}, 'sts', 5)::VARCHAR
           WHEN 2 THEN json_object('bid', {_uuid('event_id')}, 'rids', []::VARCHAR[])::VARCHAR
           WHEN 3 THEN {BAD_TS_JSON}
           ELSE 'hello' END AS value,
         CASE WHEN event_id % 5 IN (0, 1) THEN 'Anchor request'
              WHEN event_id % 5 = 2 THEN 'Batch request' ELSE 'Unknown' END AS msg_type,
         CASE WHEN event_id % 5 IN (0, 1, 2) THEN {_uuid('event_id')} ELSE 'Unknown' END AS msg_id
  FROM events)"""

SQL["read_dead_letters"] = f"""
WITH {DEAD_LETTER_TEXTS}
SELECT value FROM dl
"""

SQL["classify_dead_letter"] = f"""
WITH {DEAD_LETTER_TEXTS}
SELECT seq, msg_type, msg_id FROM dl
"""

ALERT_SQL = f"""
WITH {DEAD_LETTER_TEXTS}
SELECT seq, 'Pipeline Alert' AS title, 'Dead Letter Queue' AS "desc", msg_type || ':' || chr(10) || msg_id AS content
FROM dl
"""
SQL["alert_text"] = ALERT_SQL
SQL["write_alerts"] = ALERT_SQL

SQL["redrive_split"] = f"""
WITH {DELIVERIES},
extra AS (SELECT * FROM deliveries WHERE arrival_seq % 10 = 0 AND (arrival_seq // 10) % 17 = 0),
all_receives AS (
  SELECT rid FROM deliveries UNION ALL SELECT rid FROM extra UNION ALL SELECT rid FROM extra)
SELECT rid, count(*) AS receive_count, count(*) > 3 AS dead FROM all_receives GROUP BY rid
"""

SQL["uuid_valid"] = f"""
WITH c AS (
  SELECT event_id AS seq,
         CASE WHEN event_id % 9 = 0 THEN '00000000-0000-0000-0000-000000000000'
              WHEN event_id % 9 = 1 THEN substr({_uuid('event_id')}, 1, 35)
              WHEN event_id % 9 = 2 THEN upper({_uuid('event_id')})
              ELSE {_uuid('event_id')} END AS candidate
  FROM events)
SELECT seq, candidate,
       regexp_full_match(candidate, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}')
       AND lower(candidate) <> '00000000-0000-0000-0000-000000000000' AS valid
FROM c
"""

SQL["alert_route"] = """
SELECT c_custkey,
       coalesce(nullif(trim(CASE WHEN c_custkey % 4 IN (0, 1) THEN c_mktsegment ELSE '' END), ''),
                nullif(trim(CASE WHEN c_custkey % 4 IN (0, 2) THEN c_name ELSE '' END), '')) AS channel
FROM customer
"""

SQL["encode_messages"] = f"""
WITH {DELIVERIES}
SELECT arrival_seq,
       json_object('rid', {_uuid('rid')}, 'sid', CAST(stream_id AS VARCHAR), 'cid', cid, 'org', origin,
                   'ts', strftime(ts, {RFC}), 'crt', strftime(crt, {RFC}))::VARCHAR AS request_json,
       json_object('rid', {_uuid('rid')}, 'sts', 5)::VARCHAR AS status_json
FROM deliveries
"""


# ---------------------------------------------------------------- J4 backfill
REQ_FULL = f"""
req AS (
  SELECT event_id AS request_id, props AS cid, user_id AS stream_id, event_type AS origin,
         {MSG_TS} AS ts, ts AS created_at, event_id % 6 AS status FROM events),
meta AS (
  SELECT c_custkey AS stream_id, {{'controllers': [c_name], 'family': c_mktsegment}} AS metadata
  FROM customer WHERE c_custkey % 3 <> 0)"""

POLL_SQL = f"""
WITH {REQ_FULL}
SELECT r.request_id, r.cid, r.stream_id, r.origin, r.ts, r.created_at,
       m.metadata.controllers AS controllers, m.metadata.family AS family
FROM req r LEFT JOIN meta m ON m.stream_id = r.stream_id
WHERE r.status = 0 AND r.created_at > TIMESTAMP '2024-01-28 00:00:00'
  AND r.created_at < TIMESTAMP '2024-01-29 12:00:00'
"""

SQL["scan_requests"] = POLL_SQL + " ORDER BY r.created_at, r.request_id LIMIT 16383"
SQL["oldest_pending_topk"] = POLL_SQL + " ORDER BY r.created_at, r.request_id LIMIT 5"
SQL["load_limit"] = POLL_SQL + " ORDER BY r.created_at, r.request_id LIMIT 16"

SQL["filter_status"] = "SELECT event_id AS request_id FROM events WHERE event_id % 6 = 0"

SQL["filter_open_interval"] = """
SELECT event_id AS request_id FROM events
WHERE ts > TIMESTAMP '2024-01-28 00:00:00' AND ts < TIMESTAMP '2024-01-29 12:00:00'
"""

SQL["poll_window"] = f"""
WITH d AS (SELECT DISTINCT epoch_us(ts) // {DAY_US} AS d FROM events),
t AS (
  SELECT make_timestamp((d + 1) * {DAY_US}) AS now,
         make_timestamp((d - 1) * {DAY_US} + (d % 3 - 1) * 21600000000) AS checkpoint
  FROM d)
SELECT now, checkpoint, greatest(checkpoint, now - INTERVAL 48 HOUR) AS newer_than,
       now - INTERVAL 12 HOUR AS older_than
FROM t
"""

SQL["request_to_message"] = f"""
WITH {REQ_FULL}
SELECT request_id AS rid, stream_id, cid, origin, ts, created_at AS crt FROM req
WHERE status = 0 AND created_at > TIMESTAMP '2024-01-28 00:00:00'
  AND created_at < TIMESTAMP '2024-01-29 12:00:00'
"""

SQL["left_join_metadata"] = f"""
WITH {REQ_FULL}
SELECT r.request_id, r.stream_id, m.metadata.controllers AS controllers, m.metadata.family AS family
FROM req r LEFT JOIN meta m USING (stream_id)
"""

SQL["sent_prefix_checkpoint"] = f"""
WITH r AS (
  SELECT event_id, ts, epoch_us(ts) // {DAY_US} AS poll_day,
         row_number() OVER (PARTITION BY epoch_us(ts) // {DAY_US} ORDER BY ts, event_id) AS k
  FROM events),
ff AS (SELECT poll_day, min(k) FILTER (WHERE event_id % 97 = 0) AS fk, count(*) AS n FROM r GROUP BY poll_day)
SELECT ff.poll_day, ff.n AS n_rows, coalesce(ff.fk - 1, ff.n) AS n_sent,
       CASE WHEN ff.fk IS NULL THEN (SELECT max(ts) FROM r WHERE r.poll_day = ff.poll_day)
            WHEN ff.fk = 1 THEN (SELECT ts FROM r WHERE r.poll_day = ff.poll_day AND k = 1) - INTERVAL 1 MILLISECOND
            ELSE (SELECT ts FROM r WHERE r.poll_day = ff.poll_day AND k = ff.fk - 1) END AS next_checkpoint,
       CASE WHEN ff.fk IS NULL THEN 'all' WHEN ff.fk = 1 THEN 'first' ELSE 'later' END AS outcome
FROM ff
"""

SQL["unprocessed_alert"] = f"""
WITH ticks AS (
  SELECT DISTINCT make_timestamp(d * {DAY_US}) AS now
  FROM (SELECT epoch_us(ts) // {DAY_US} + k AS d FROM events, range(0, 4) AS g(k))),
c AS (
  SELECT t.now, count(*) AS n FROM ticks t JOIN events e
    ON e.event_id % 6 = 0 AND e.ts > t.now - INTERVAL 48 HOUR AND e.ts < t.now - INTERVAL 12 HOUR
  GROUP BY t.now)
SELECT now, n AS n_requests, 'Pipeline Alert' AS title, 'Unprocessed Requests' AS "desc",
       CAST(n AS VARCHAR) || ' requests found since:' || chr(10) ||
       strftime(now - INTERVAL 48 HOUR, '%Y-%m-%d %H:%M:%S') || ' +0000 UTC' AS content
FROM c
"""

SQL["backfill_union"] = f"""
WITH {REQ_FULL}, live AS ({DELIVERIES.split('AS (', 1)[1].rsplit(')', 1)[0]}),
deliveries AS (
  SELECT * FROM live
  UNION ALL
  SELECT request_id, stream_id, origin, cid, ts, created_at, (request_id + 1000000000) * 10 + 5 FROM req
  WHERE status = 0 AND created_at > TIMESTAMP '2024-01-28 00:00:00'
    AND created_at < TIMESTAMP '2024-01-29 12:00:00'),
{dedupe_flags()}
{OUTCOMES_FROM_FLAGS}
"""

CKPT = f"""
p AS (SELECT event_type AS name, {MSG_TS} AS value, event_id AS seq FROM events),
acc AS (
  SELECT p.*, NOT EXISTS (SELECT 1 FROM p q WHERE q.name = p.name AND q.seq < p.seq AND q.value >= p.value)
         AS accepted
  FROM p)"""

SQL["checkpoint_accept"] = f"WITH {CKPT} SELECT name, value, seq, accepted FROM acc"
SQL["checkpoint_max"] = f"WITH {CKPT} SELECT name, max(value) AS value FROM acc WHERE accepted GROUP BY name"
SQL["load_checkpoint"] = f"""
WITH {CKPT},
names AS (SELECT DISTINCT event_type AS name FROM events UNION SELECT 'rpoll' UNION SELECT 'fpoll')
SELECT n.name, coalesce(max(a.value), TIMESTAMP '0001-01-01 00:00:00') AS value
FROM names n LEFT JOIN acc a ON a.name = n.name AND a.accepted GROUP BY n.name
"""

SQL["time_codecs"] = f"""
WITH {DELIVERIES}
SELECT arrival_seq, epoch_us(ts) * 1000 AS ts_ns, epoch_us(crt) // 1000000 AS crt_s,
       strftime(crt, '%Y-%m-%d %H:%M:%S.%f') AS crt_text
FROM deliveries
"""


# ---------------------------------------------------------------- J7 capacity
HOUR = 3600000000
SAMPLES = f"""
samples AS (
  SELECT epoch_us(ts) // {HOUR} AS hour, count(*) AS unprocessed,
         count(*) FILTER (WHERE event_type = 'purchase') AS inflight,
         count(*) FILTER (WHERE event_type = 'signup') AS existing
  FROM events GROUP BY 1),
plans AS (
  SELECT hour, unprocessed, inflight, existing,
         CAST(greatest(unprocessed + inflight - existing, 0) AS BIGINT) AS required,
         CAST(least(ceil(greatest(unprocessed + inflight - existing, 0) * 0.5),
                    greatest(unprocessed + inflight - existing, 0)) AS BIGINT) AS "create",
         CAST(least(ceil((CASE WHEN existing < 3 THEN 3 - existing ELSE 0 END) * 0.5),
                    greatest(unprocessed + inflight - existing, 0)) AS BIGINT) AS create_max3
  FROM samples)"""

QUEUE_SQL = f"""
SELECT epoch_us(ts) // {HOUR} AS hour,
       ['validate', 'ready', 'batch', 'status', 'failure', 'dlq'][event_id % 6 + 1] AS queue,
       count(*) FILTER (WHERE event_type <> 'purchase') AS unprocessed,
       count(*) FILTER (WHERE event_type = 'purchase') AS inflight
FROM events GROUP BY 1, 2
"""
SQL["queue_utilisation"] = QUEUE_SQL
SQL["capacity_plan"] = f"WITH {SAMPLES} SELECT * FROM plans"
SQL["job_requests"] = f"""
WITH {SAMPLES}
SELECT p.hour, CAST(g.k AS INTEGER) AS job_ordinal, 'queued' AS stage, 'anchor' AS type,
       '{{"version":"5","overrides":{{"APP_MODE":"continual-anchoring","SCHEDULER_STOP_AFTER_NO_OP":"true"}}}}'
         AS params,
       make_timestamp(p.hour * {HOUR}) AS ts,
       make_timestamp(p.hour * {HOUR}) + INTERVAL 14 DAY AS ttl
FROM plans p, LATERAL range(1, p."create" + 1) AS g(k)
WHERE p."create" > 0
"""

JOBS = """
js AS (
  SELECT o_custkey AS job,
         CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'started' WHEN 'F' THEN 'completed' END AS stage,
         o_orderdate AS ts, o_orderkey AS tie
  FROM orders),
latest AS (
  SELECT job, stage, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, tie DESC) AS k FROM js) WHERE k = 1)"""

SQL["latest_job_state"] = f"WITH {JOBS} SELECT job, stage, ts FROM latest"
SQL["existing_jobs"] = f"""
WITH {JOBS}
SELECT count(*) FILTER (WHERE stage IS NULL OR stage NOT IN ('completed', 'failed')) AS existing_jobs FROM latest
"""

# ---------------------------------------------------------------- J8 allow-list
CALLS = """
calls AS (
  SELECT event_id AS seq,
         CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % 10 END AS BIGINT) AS caller,
         CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'remove' ELSE 'anchor' END AS kind,
         CAST(CASE WHEN event_type = 'signup' THEN (event_id // 3) % 10
                   WHEN event_type = 'error' THEN
                     CASE WHEN event_id % 2 = 1 THEN (CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % 10 END)
                          ELSE (event_id // 2) % 10 END END AS BIGINT) AS target,
         CASE WHEN event_type NOT IN ('signup', 'error') THEN sha256(CAST(event_id AS VARCHAR)) END AS root
  FROM events),
eff AS (
  SELECT *, CASE WHEN kind = 'anchor' THEN caller ELSE target END AS addr,
         CASE WHEN kind = 'add' AND caller = 0 THEN true
              WHEN kind = 'remove' AND (caller = 0 OR caller = target) THEN false END AS effect
  FROM calls),
replayed AS (
  SELECT e.*,
         coalesce((SELECT p.effect FROM eff p WHERE p.addr = e.addr AND p.seq < e.seq AND p.effect IS NOT NULL
                   ORDER BY p.seq DESC LIMIT 1), false) AS listed_before
  FROM eff e),
valid AS (
  SELECT *, CASE WHEN kind = 'add' THEN caller = 0
                 WHEN kind = 'remove' THEN caller = 0 OR (caller = target AND listed_before)
                 ELSE caller = 0 OR listed_before END AS valid
  FROM replayed)"""

SQL["allowlist_state"] = f"""
WITH {CALLS}
SELECT addr, arg_max(effect, seq) AS allowed FROM eff WHERE effect IS NOT NULL GROUP BY addr
"""
SQL["anchor_authorised_asof"] = f"WITH {CALLS} SELECT seq, caller, kind, target, listed_before, valid FROM valid"
SQL["chain_events"] = f"""
WITH {CALLS}
SELECT seq, CASE kind WHEN 'add' THEN 'DidAddCas' WHEN 'remove' THEN 'DidRemoveCas' ELSE 'DidAnchor' END AS event,
       addr AS service, root
FROM valid WHERE valid
"""

SQL["state_expiry"] = f"""
WITH {DELIVERIES}, {dedupe_flags()}
SELECT stream_id, cid, crt, crt + INTERVAL 14 DAY < TIMESTAMP '2024-01-31 00:00:00' AS expired
FROM flags WHERE new_cid
"""

# ---------------------------------------------------------------- J6 metrics
METRIC_ROWS = """
mrows AS (
  SELECT event_id, ts, event_type || CASE WHEN event_id % 7 = 0 THEN '_tsdb' ELSE '' END AS metric FROM events),
kept AS (SELECT * FROM mrows WHERE NOT regexp_matches(metric, '^.*tsdb$'))"""

SQL["filter_metric_names"] = f"WITH {METRIC_ROWS} SELECT metric, count(*) AS n FROM kept GROUP BY metric"
SQL["metric_name"] = "SELECT 'keyfold:' || event_type || '_count' AS metric, count(*) AS value FROM events GROUP BY 1"
SQL["write_metrics"] = f"""
WITH {METRIC_ROWS}, {_closed_members_sql(16)}
SELECT 'keyfold:' || metric || '_count' AS metric, make_timestamp(epoch_us(ts) // {HOUR} * {HOUR}) AS ts,
       count(*) AS value
FROM kept GROUP BY 1, 2
UNION ALL SELECT 'keyfold:pending_anchor_requests_gauge', TIMESTAMP '2024-02-01 00:00:00',
       (SELECT count(*) FROM events WHERE event_id % 6 = 0)
UNION ALL SELECT 'keyfold:' || queue || '_' || g.k || '_gauge', make_timestamp(hour * {HOUR}),
       CASE g.k WHEN 'unprocessed' THEN unprocessed ELSE inflight END
  FROM ({QUEUE_SQL}) q, (VALUES ('unprocessed'), ('inflight')) AS g(k)
UNION ALL SELECT 'keyfold:batch_size_histogram', make_timestamp((flush_window + 1) * {DAY_US}), count(*)
  FROM members GROUP BY flush_window, batch_no
"""

SQL["counter_totals"] = f"""
WITH {DELIVERIES}, {dedupe_flags()}, outcomes AS ({OUTCOMES_FROM_FLAGS}),
{_closed_members_sql(16)}, {SAMPLES},
st AS (
  SELECT count(*) AS n FROM events
  WHERE event_id % 10 <> 9),
parts(metric, value) AS (
  SELECT 'validate_ingress_request', (SELECT count(*) FROM deliveries)
  UNION ALL SELECT 'validate_replaced_request', (SELECT count(*) FROM outcomes WHERE event = 'REPLACED')
  UNION ALL SELECT 'validate_processed_request', (SELECT count(*) FROM outcomes WHERE event = 'READY')
  UNION ALL SELECT 'validate_reprocessed_request', (SELECT count(*) FROM outcomes WHERE reason = 'reprocessed')
  UNION ALL SELECT 'batch_created', (SELECT count(DISTINCT (flush_window, batch_no)) FROM members)
  UNION ALL SELECT 'batch_stored', (SELECT count(DISTINCT (flush_window, batch_no)) FROM members)
  UNION ALL SELECT 'batch_ingress_request', (SELECT count(*) FROM members)
  UNION ALL SELECT 'failure_dlq_message', (SELECT count(*) FROM events)
  UNION ALL SELECT 'failure_message', (SELECT count(*) FROM events WHERE event_id % 17 = 0 OR event_id % 19 = 0)
  UNION ALL SELECT 'status_ingress_message', (SELECT n FROM st)
  UNION ALL SELECT 'status_updated', (SELECT n FROM st)
  UNION ALL SELECT 'worker_job_created', (SELECT sum("create") FROM plans))
SELECT metric, CAST(value AS BIGINT) AS value FROM parts
"""

SQL["write_ready"] = f"""
WITH {DELIVERIES}, {dedupe_flags()}, outcomes AS ({OUTCOMES_FROM_FLAGS})
SELECT o.arrival_seq, f.rid, f.stream_id, f.origin, f.cid, f.ts, f.crt
FROM outcomes o JOIN flags f ON f.arrival_seq = o.arrival_seq WHERE o.event = 'READY'
"""

SQL["write_status_events"] = f"""
WITH {DELIVERIES}, {dedupe_flags()}, outcomes AS ({OUTCOMES_FROM_FLAGS})
SELECT arrival_seq, event_ord, {_uuid('target_rid')} AS rid, CAST(5 AS SMALLINT) AS sts
FROM outcomes WHERE event = 'REPLACED'
"""


# ---------------------------------------------------------------- streaming (batch twins)
SQL["stream_dedupe"] = SQL["dedupe_outcomes"]
SQL["redelivery_idempotence"] = SQL["dedupe_outcomes"]
SQL["late_tip"] = f"""
WITH {DELIVERIES}, {dedupe_flags()}
SELECT arrival_seq, rid, rid AS target_rid FROM flags WHERE NOT accepted
"""
SQL["stream_batches"] = SQL["batch_linger"]
SQL["drain_flush"] = f"""
WITH {_closed_members_sql(16)}, {_batches_sql(16, H24)}
SELECT {BATCH_COLS} FROM final
WHERE flush_window = (SELECT max(flush_window) FROM final) AND n < 16
"""
SQL["apply_status_stream"] = SQL["status_fold"]
SQL["redrive_stream"] = SQL["redrive_split"]
SQL["observed_counters"] = SQL["counter_totals"]
SQL["dlq_stream"] = f"""
WITH {DEAD_LETTER_TEXTS}
SELECT seq, msg_type, msg_id, 'Pipeline Alert' AS title, 'Dead Letter Queue' AS "desc",
       msg_type || ':' || chr(10) || msg_id AS content
FROM dl
"""
SQL["capacity_samples"] = """
WITH s AS (
  SELECT make_timestamp(epoch_us(ts) // 30000000 * 30000000) AS tick_start, event_id % 50 AS unprocessed,
         user_id % 7 AS inflight, event_id % 5 AS existing,
         row_number() OVER (PARTITION BY epoch_us(ts) // 30000000 ORDER BY ts DESC, event_id DESC) AS k
  FROM events)
SELECT tick_start, unprocessed, inflight, existing, greatest(unprocessed + inflight - existing, 0) AS required,
       CAST(least(ceil(greatest(unprocessed + inflight - existing, 0) * 0.5), greatest(unprocessed + inflight - existing, 0)) AS BIGINT) AS "create",
       CAST(least(ceil((CASE WHEN existing < 3 THEN 3 - existing ELSE 0 END) * 0.5), greatest(unprocessed + inflight - existing, 0)) AS BIGINT) AS create_max3
FROM s WHERE k = 1
"""

# the poll loop as a walk: rows are numbered in send order, the first failed number cuts them
SQL["incremental_backfill"] = """
WITH RECURSIVE
pend AS (SELECT event_id AS request_id, ts AS created_at FROM events WHERE event_id % 6 = 0),
days AS (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events),
ticks AS (SELECT g.k, CAST(lo + CAST(2 * g.k + 2 AS INTEGER) AS TIMESTAMP) AS now
          FROM days, LATERAL range(0, (date_diff('day', lo, hi) + 3) // 2) AS g(k)),
run(k, now, checkpoint, next_checkpoint, n_rows, n_sent) AS (
  SELECT -1, NULL::TIMESTAMP, NULL::TIMESTAMP, (SELECT min(now) - INTERVAL 48 HOUR FROM ticks), 0::BIGINT, 0::BIGINT
  UNION ALL
  SELECT t.k, t.now, r.next_checkpoint,
         CASE WHEN s.nxt IS NOT NULL AND s.nxt > r.next_checkpoint THEN s.nxt ELSE r.next_checkpoint END,
         s.n, s.n_sent
  FROM run r JOIN ticks t ON t.k = r.k + 1,
  LATERAL (
    SELECT count(*) AS n, count(*) FILTER (WHERE fk IS NULL OR rk < fk) AS n_sent,
           CASE WHEN count(*) = 0 THEN NULL
                WHEN max(fk) = 1 THEN max(created_at) FILTER (WHERE rk = 1) - INTERVAL 1 MILLISECOND
                ELSE max(created_at) FILTER (WHERE rk = coalesce(fk - 1, last)) END AS nxt
    FROM (SELECT w.*, min(CASE WHEN request_id % 97 = 0 THEN rk END) OVER () AS fk, max(rk) OVER () AS last
          FROM (SELECT *, row_number() OVER (ORDER BY p.created_at, p.request_id) AS rk FROM pend p
                WHERE p.created_at > r.next_checkpoint AND p.created_at < t.now - INTERVAL 12 HOUR) w
          WHERE rk <= 16383)) s)
SELECT CAST(k AS INTEGER) AS tick, now, checkpoint, n_rows, n_sent, next_checkpoint, n_sent AS n_published,
       CASE WHEN n_rows > 0 THEN CAST(n_rows AS VARCHAR) || ' requests found since:' || chr(10) ||
            strftime(checkpoint, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(checkpoint) % 1000000 = 0 THEN '' ELSE
              '.' || rtrim(lpad(CAST(epoch_us(checkpoint) % 1000000 AS VARCHAR), 6, '0'), '0') END || ' +0000 UTC' END AS alert
FROM run WHERE k >= 0
"""
