"""SQL building blocks for the check of each query in DuckDB."""

from __future__ import annotations

HOUR = 3_600_000
DAY = 24 * HOUR

E = "(SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS timestamp FROM events)"


def stored(value: str, ttl: int, source: str = E, key: str = "user_id") -> str:
    """CTEs `r` (rows numbered per key) and `s` (the rows with what is stored after each)."""
    live = "CASE WHEN r.timestamp < s.deadline THEN s.stored END"
    differs = f"({live}) IS DISTINCT FROM r.v"
    return f"""WITH RECURSIVE r AS (
  SELECT *, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY timestamp, event_id) AS rn
  FROM {source} AS src),
s AS (
  SELECT {key}, rn, v AS stored, CASE WHEN v IS NOT NULL THEN timestamp + {ttl} END AS deadline,
         v IS NOT NULL AS emit
  FROM r WHERE rn = 1
  UNION ALL
  SELECT r.{key}, r.rn, CASE WHEN {differs} THEN r.v ELSE s.stored END,
         CASE WHEN {differs} THEN r.timestamp + {ttl} ELSE s.deadline END, {differs}
  FROM s JOIN r ON r.{key} = s.{key} AND r.rn = s.rn + 1),
emitted AS (SELECT r.* FROM r JOIN s ON r.{key} = s.{key} AND r.rn = s.rn WHERE s.emit)
"""


KEY = "'order-' || lpad(user_id::VARCHAR, greatest(7, length(user_id::VARCHAR))::INTEGER, '0')"

CHANGELOG = f"""(SELECT (user_id % 4)::INTEGER AS partition, event_id AS "offset", {KEY} AS key,
  CASE WHEN event_type <> 'error' THEN event_type END AS status,
  event_type NOT IN ('view', 'error') AS stamped,
  CASE WHEN event_type IN ('click', 'purchase') THEN timestamp + {6 * HOUR} END AS expires_at_ms,
  timestamp AS ts_ms FROM {E})"""

COMPACTED = f"""(SELECT partition, key, status, stamped, expires_at_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY partition, key ORDER BY "offset" DESC) AS n
  FROM {CHANGELOG}) WHERE n = 1 AND status IS NOT NULL)"""

JAN_20 = 1705708800000
JAN_25 = 1706140800000
JAN_31 = 1706659200000

# The store before the writes, the writes, and the state after an automatic migration.
MIGRATION = f"""WITH ev AS (SELECT (user_id % 4)::INTEGER AS partition, event_id AS o, {KEY} AS key,
  event_type AS status, timestamp AS ts_ms FROM {E}),
state AS (SELECT partition, key, status, partition = 2 AS stamped,
  CASE WHEN partition = 2 THEN ts_ms + {30 * DAY} END AS expires_at_ms
  FROM (SELECT *, row_number() OVER (PARTITION BY partition, key ORDER BY o DESC) AS n
        FROM ev WHERE ts_ms < {JAN_20}) WHERE n = 1),
meta AS (SELECT partition, partition = 2 AS ttl_enabled, max(ts_ms) AS high
         FROM ev WHERE ts_ms < {JAN_20} GROUP BY partition),
writes AS (SELECT *, CASE WHEN partition <> 3 THEN
  CASE status WHEN 'purchase' THEN {3 * DAY} WHEN 'click' THEN {DAY} END END AS ttl_ms
  FROM ev WHERE ts_ms >= {JAN_20}),
batch AS (SELECT partition, max(ttl_ms) AS max_ttl, max(ts_ms) AS high FROM writes GROUP BY partition),
plan AS (SELECT m.partition, greatest(m.high, b.high) AS high, b.max_ttl,
  CASE WHEN b.max_ttl IS NULL THEN 'inert' WHEN m.ttl_enabled THEN 'already_migrated'
       ELSE 'backfilled' END AS action, m.ttl_enabled
  FROM meta m LEFT JOIN batch b USING (partition)),
lastw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY partition, key ORDER BY o DESC) AS n
  FROM writes) WHERE n = 1),
kept AS (SELECT s.*, p.action, p.high + p.max_ttl AS deadline FROM state s JOIN plan p USING (partition)
  WHERE NOT EXISTS (SELECT 1 FROM lastw w WHERE w.partition = s.partition AND w.key = s.key)),
after AS (
  SELECT partition, key, status, stamped OR action = 'backfilled' AS stamped,
    CASE WHEN NOT stamped AND action = 'backfilled' THEN deadline ELSE expires_at_ms END AS expires_at_ms,
    NOT stamped AND action = 'backfilled' AS backfilled
  FROM kept
  UNION ALL
  SELECT w.partition, w.key, w.status, p.ttl_enabled OR p.action = 'backfilled', w.ts_ms + w.ttl_ms, false
  FROM lastw w JOIN plan p USING (partition))
"""


def census(state: str, now: int, enabled: str, done: str) -> str:
    """Census of `state` (partition, stamped, expires_at_ms) with totals, given flag expressions."""
    part = f"""SELECT partition, count(*) AS total_default_keys,
  count(*) FILTER (stamped) AS stamped, count(*) FILTER (NOT stamped) AS unstamped,
  count(*) FILTER (stamped) AS decode_clean, 0 AS double_wrapped,
  count(*) FILTER (stamped AND expires_at_ms <= {now}) AS expired,
  count(*) FILTER (stamped AND expires_at_ms > {now} AND expires_at_ms < {now + HOUR}) AS lt_1h,
  count(*) FILTER (stamped AND expires_at_ms >= {now + HOUR} AND expires_at_ms < {now + DAY}) AS h1_24,
  count(*) FILTER (stamped AND expires_at_ms >= {now + DAY}) AS gt_24h,
  count(*) FILTER (stamped AND expires_at_ms IS NULL) AS never,
  0 AS backfill_ledger_count, 0 AS backfill_pending_count, 0 AS ttl_index_count,
  {enabled} AS ttl_enabled_flag, {done} AS migration_done_marker
  FROM {state} GROUP BY partition"""
    return f"""SELECT * FROM ({part}) UNION ALL
  SELECT NULL, sum(total_default_keys)::BIGINT, sum(stamped)::BIGINT, sum(unstamped)::BIGINT,
  sum(decode_clean)::BIGINT, 0, sum(expired)::BIGINT, sum(lt_1h)::BIGINT, sum(h1_24)::BIGINT,
  sum(gt_24h)::BIGINT, sum(never)::BIGINT, 0, 0, 0, bool_and(ttl_enabled_flag),
  bool_and(migration_done_marker) FROM ({part})"""


LAKE = f"""(SELECT *, strftime(make_timestamp(timestamp * 1000), '%Y') AS year,
  strftime(make_timestamp(timestamp * 1000), '%m') AS month,
  strftime(make_timestamp(timestamp * 1000), '%d') AS day FROM {E})"""

CHURN = f"""WITH ev AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'feature' ELSE 'stable' END AS deployment,
  timestamp AS ts_ms, event_id, event_type, user_id FROM {E}),
actions AS (SELECT deployment, (ts_ms // {DAY})::INTEGER AS cycle, ts_ms FROM ev WHERE event_type = 'signup'),
samples AS (SELECT deployment, ts_ms, count(*) FILTER (event_type = 'purchase') OVER (
  PARTITION BY deployment ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS hwm FROM ev),
lines AS (SELECT deployment, ts_ms, CASE
  WHEN event_type = 'error' AND deployment = 'feature' THEN 'Failed to open "/state/' || user_id
    || '", cannot acquire a lock (attempt ' || (event_id % 10 + 1) || '/10). Retrying in 3sec.'
  WHEN event_type = 'error' THEN 'Failed to open rocksdb partition , cannot acquire a lock. Retrying in 3sec.'
  WHEN event_type = 'view' THEN 'Opening rocksdb partition on "/state/' || user_id || '" attempt='
    || (event_id % 10 + 1)
  WHEN event_type = 'click' THEN 'Fast revoke: skipping local state flush'
  WHEN user_id % 50 = 7 THEN 'Application maximum poll interval (60000ms) exceeded'
  ELSE 'checkpoint committed' END AS line FROM ev),
starts AS (SELECT deployment, cycle, min(ts_ms) AS start_ms FROM actions GROUP BY ALL),
windows AS (SELECT *, coalesce(lead(start_ms) OVER (PARTITION BY deployment ORDER BY start_ms, cycle),
  (SELECT max(ts_ms) + 1 FROM samples q WHERE q.deployment = starts.deployment)) AS end_ms FROM starts),
hand AS (SELECT w.deployment, w.cycle, (
    SELECT (min(q.ts_ms) - w.start_ms) / 1000.0 FROM samples q
    WHERE q.deployment = w.deployment AND q.ts_ms > w.start_ms AND q.hwm > b.base) AS handover_s
  FROM windows w LEFT JOIN (
    SELECT w2.deployment, w2.cycle, max(q.hwm) AS base FROM windows w2
    JOIN samples q ON q.deployment = w2.deployment AND q.ts_ms <= w2.start_ms GROUP BY ALL) b
  ON b.deployment = w.deployment AND b.cycle = w.cycle),
stall AS (SELECT deployment, cycle, max(span) / 1000.0 AS longest_output_stall_s FROM (
  SELECT q.deployment, w.cycle, q.hwm, max(q.ts_ms) - min(q.ts_ms) AS span FROM samples q
  JOIN windows w ON q.deployment = w.deployment AND q.ts_ms >= w.start_ms AND q.ts_ms < w.end_ms
  GROUP BY ALL) GROUP BY ALL),
marks AS (SELECT w.deployment, w.cycle,
  count(*) FILTER (line LIKE '%cannot acquire a lock%') AS lock_retry_count,
  coalesce(max(nullif(regexp_extract(line, '\\(attempt (\\d+)/\\d+\\)', 1), '')::BIGINT),
    max(nullif(regexp_extract(line, 'Opening rocksdb partition on .* attempt=(\\d+)', 1), '')::BIGINT), 0)
    AS max_lock_attempt,
  count(*) FILTER (line LIKE '%maximum poll interval%') AS evictions,
  bool_or(line LIKE 'Fast revoke%') AS fast_revoke_seen
  FROM lines l JOIN windows w ON l.deployment = w.deployment AND l.ts_ms >= w.start_ms
    AND l.ts_ms < w.end_ms GROUP BY ALL),
report AS (SELECT w.cycle, w.deployment, h.handover_s, coalesce(m.lock_retry_count, 0) AS lock_retry_count,
  coalesce(m.max_lock_attempt, 0) AS max_lock_attempt, coalesce(m.evictions, 0) AS evictions,
  coalesce(m.fast_revoke_seen, false) AS fast_revoke_seen, false AS orphan_resume_seen,
  s.longest_output_stall_s, false AS open_budget_hit, false AS revoke_flush_timeout
  FROM windows w LEFT JOIN hand h USING (deployment, cycle) LEFT JOIN marks m USING (deployment, cycle)
  LEFT JOIN stall s USING (deployment, cycle))
"""
