"""Every operator as a query over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberkey.functions import keys as K
from emberkey.functions import markers as M
from emberkey.operators import counters, dedup, enrich, lake, lake_catalog, lake_log, process, progress, state_table
from emberkey.operators.carry import null_safe_join
from emberkey.operators.pruning import col
from emberkey.plans import oracle_sql as O
from emberkey.plans import tables as T
from emberkey.plans.tables import DAY, HOUR, JAN_25, JAN_31, events, event_stream
from emberkey.session import fresh_path
from emberkey.sources import topics
from emberkey.streaming import callbacks, processor, reporting, runner

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HEADLINE: list[str] = []

EVENT = ["event_id", "user_id", "event_type", "timestamp"]
COLS = ", ".join(EVENT)
EVENT_DDL = "event_id bigint, user_id bigint, event_type string, timestamp bigint"


def query(name: str, sql: str | None = None, headline: bool = False) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn

    return add


# ---- keyed state, batch -------------------------------------------------------------------------

SQL_ST1 = f"""SELECT {COLS} FROM (SELECT *, lag(event_type) OVER (
  PARTITION BY user_id ORDER BY timestamp, event_id) AS p FROM {O.E})
  WHERE p IS DISTINCT FROM event_type"""
SQL_ST2 = O.stored("event_type", DAY) + f"SELECT {COLS} FROM emitted"
SQL_ST4 = f"""SELECT {COLS} FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY timestamp, event_id) AS n FROM {O.E}) WHERE n = 1"""
SQL_ST5 = O.stored("true", DAY) + f"SELECT {COLS} FROM emitted"
SQL_ST6 = O.stored("event_type", DAY) + f"""SELECT {COLS},
  CASE WHEN timestamp < p + {36 * HOUR} THEN p END AS previous_seen_at FROM (SELECT *,
  lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS p FROM emitted)"""
SQL_ST9 = f"""SELECT {COLS}, count(*) OVER (PARTITION BY user_id ORDER BY timestamp, event_id
  ROWS UNBOUNDED PRECEDING) AS count FROM {O.E}"""


def sql_counter(source: str, ttl: int) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY user_id, session
  ORDER BY timestamp, event_id) AS count FROM (SELECT *, count(*) FILTER (fresh) OVER (
  PARTITION BY user_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
  SELECT *, coalesce(timestamp >= lag(timestamp) OVER (
  PARTITION BY user_id ORDER BY timestamp, event_id) + {ttl}, true) AS fresh FROM {source})))"""


SQL_ST8 = f"SELECT {COLS}, count FROM {sql_counter(O.E, 6 * HOUR)}"
SQL_ST10 = O.stored("event_type", DAY) + f"SELECT {COLS}, count FROM {sql_counter('emitted', DAY)}"
SQL_ST13 = f"""SELECT {COLS},
  CASE WHEN n > 1 THEN first_ts END AS first_at,
  CASE WHEN timestamp < p_ts + {6 * HOUR} THEN p_type END AS recent_value FROM (
  SELECT *, row_number() OVER w AS n, min(timestamp) OVER (PARTITION BY user_id) AS first_ts,
  lag(timestamp) OVER w AS p_ts, lag(event_type) OVER w AS p_type FROM {O.E}
  WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, event_id))"""


@query("st1_dedup_on_change", SQL_ST1, headline=True)
def st1(spark, sf):
    rows = events(spark, sf).select(*EVENT)
    return dedup.dedup_on_change(rows, "user_id", "event_type", ["timestamp", "event_id"])


@query("st2_dedup_on_change_ttl", SQL_ST2, headline=True)
def st2(spark, sf):
    rows = events(spark, sf).select(*EVENT)
    return dedup.dedup_on_change_ttl(rows, "user_id", "event_type", "timestamp", DAY, "event_id")


@query(
    "st2_dedup_nullable_value",
    O.stored("nullif(event_type, 'error')", DAY) + f"SELECT {COLS} FROM emitted",
)
def st2_nullable(spark, sf):
    status = F.when(F.col("event_type") != "error", F.col("event_type"))
    rows = events(spark, sf).select(*EVENT).withColumn("status", status)
    out = dedup.dedup_on_change_ttl(rows, "user_id", "status", "timestamp", DAY, "event_id")
    return out.select(*EVENT)


@query(
    "st3_dedup_on_seen",
    f"""SELECT {COLS} FROM (SELECT *, lag(event_type) OVER w AS p, lag(timestamp) OVER w AS t
  FROM {O.E} WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, event_id))
  WHERE p IS DISTINCT FROM event_type OR timestamp >= t + {DAY}""",
)
def st3(spark, sf):
    rows = events(spark, sf).select(*EVENT)
    return dedup.dedup_on_change_ttl(
        rows, "user_id", "event_type", "timestamp", DAY, "event_id", refresh="on_seen"
    )


@query("st4_first_seen", SQL_ST4)
def st4(spark, sf):
    rows = events(spark, sf).select(*EVENT)
    return dedup.first_seen(rows, "user_id", ["timestamp", "event_id"])


@query("st5_first_seen_ttl", SQL_ST5, headline=True)
def st5(spark, sf):
    rows = events(spark, sf).select(*EVENT)
    return dedup.first_seen_ttl(rows, "user_id", "timestamp", DAY, "event_id")


ENTRY_TTLS = {"last_status": DAY, "last_seen_at": 36 * HOUR}


@query("st6_dedup_multi_entry", SQL_ST6)
def st6(spark, sf):
    rows = events(spark, sf).select(*EVENT)
    return dedup.dedup_multi_entry(
        rows, "user_id", "event_type", "timestamp", ENTRY_TTLS, "event_id"
    )


@query(
    "st7_toggle_by_key",
    O.stored("event_type", DAY)
    + "SELECT event_id, user_id::VARCHAR AS entity, event_type AS status, timestamp FROM emitted",
)
def st7(spark, sf):
    key = F.concat_ws("_", F.col("user_id").cast("string"), "event_type")
    rows = events(spark, sf).select("event_id", key.alias("key"), "timestamp")
    out = dedup.toggle_by_key(rows, "key", "timestamp", DAY, "event_id")
    return out.select(
        "event_id", F.col("_entity").alias("entity"), F.col("_status").alias("status"), "timestamp"
    )


@query("st8_counter_ttl", SQL_ST8, headline=True)
def st8(spark, sf):
    rows = events(spark, sf).select(*EVENT)
    return counters.counter_ttl(rows, "user_id", "timestamp", 6 * HOUR, "event_id")


@query("st9_running_count", SQL_ST9, headline=True)
def st9(spark, sf):
    rows = events(spark, sf).select(*EVENT)
    return counters.running_count(rows, "user_id", ["timestamp", "event_id"])


@query("st10_dedup_then_count", SQL_ST10)
def st10(spark, sf):
    rows = events(spark, sf).select(*EVENT)
    return counters.dedup_then_count(rows, "user_id", "event_type", "timestamp", DAY, "event_id")


@query(
    "st11_cached_enrich",
    f"""WITH RECURSIVE v AS (SELECT user_id, timestamp AS version, max(event_id) AS profile FROM {O.E}
  WHERE event_type = 'signup' GROUP BY ALL),
ev AS (SELECT {COLS} FROM {O.E}),
known AS (SELECT ev.*, v.profile AS now FROM ev ASOF LEFT JOIN v
  ON ev.user_id = v.user_id AND ev.timestamp >= v.version),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS rn
  FROM known WHERE now IS NOT NULL),
s AS (SELECT user_id, rn, timestamp AS fetched_at, now AS profile FROM r WHERE rn = 1
  UNION ALL SELECT r.user_id, r.rn,
  CASE WHEN r.timestamp >= s.fetched_at + {2 * DAY} THEN r.timestamp ELSE s.fetched_at END,
  CASE WHEN r.timestamp >= s.fetched_at + {2 * DAY} THEN r.now ELSE s.profile END
  FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1)
SELECT ev.*, x.profile, x.fetched_at FROM ev LEFT JOIN (SELECT r.event_id, s.profile, s.fetched_at
  FROM r JOIN s ON r.user_id = s.user_id AND r.rn = s.rn) x USING (event_id)""",
    headline=True,
)
def st11(spark, sf):
    rows = events(spark, sf).select(*EVENT)
    versions = (
        events(spark, sf)
        .filter(F.col("event_type") == "signup")
        .groupBy("user_id", F.col("timestamp").alias("version"))
        .agg(F.max("event_id").alias("profile"))
    )
    return enrich.cached_enrich(
        rows, versions, "user_id", "timestamp", 2 * DAY, "version", "profile", "event_id"
    )


@query(
    "st12_upsert_latest",
    f"""SELECT user_id, arg_max(event_type, event_id) AS status, 2000 AS pad_bytes
  FROM {O.E} GROUP BY user_id""",
)
def st12(spark, sf):
    _, state = enrich.upsert_latest(
        events(spark, sf), "user_id", "event_type", ["timestamp", "event_id"], pad_bytes=2000
    )
    return state.select(
        "user_id", "entry.status", F.length("entry.pad").alias("pad_bytes")
    )


@query("st13_mixed_entries", SQL_ST13)
def st13(spark, sf):
    rows = events(spark, sf).select(*EVENT)
    return dedup.mixed_entries(rows, "user_id", "event_type", "timestamp", 6 * HOUR, "event_id")


@query(
    "st14_emitted_keys",
    O.stored("event_type", DAY)
    + "SELECT count(DISTINCT user_id) AS session_seen FROM emitted",
)
def st14(spark, sf):
    return dedup.emitted_keys(st2(spark, sf), "user_id")


@query(
    "st14_keys_over_days",
    f"""WITH e AS (SELECT event_type, user_id FROM {O.E} AS src)
SELECT event_type, count(DISTINCT user_id) AS exact, true AS within_error FROM e GROUP BY event_type""",
)
def st14_days(spark, sf):
    """Keys of each type over all days, from one sketch a day, held against the exact count."""
    rows = events(spark, sf).withColumn("day", F.floor(F.col("timestamp") / DAY))
    daily = dedup.key_sketches(rows, "user_id", ["event_type", "day"])
    merged = dedup.merged_keys(daily, "event_type")
    exact = rows.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    off = F.abs(F.col("session_seen") - F.col("exact"))
    within = off <= F.col("exact") * dedup.sketch_error() + 1
    return null_safe_join(exact, merged, ["event_type"], "inner").select(
        "event_type", "exact", within.alias("within_error")
    )


@query("udf1_keyed_process", SQL_ST2, headline=True)
def udf1(spark, sf):
    rows = events(spark, sf).select(*EVENT)
    return process.keyed_process(
        rows, "user_id", callbacks.on_change("event_type", DAY), EVENT_DDL, "timestamp",
        ["timestamp", "event_id"],
    )


@query("udf1_keyed_process_cut_at_pauses", SQL_ST8)
def udf1_pauses(spark, sf):
    rows = events(spark, sf).select(*EVENT)
    return process.keyed_process(
        rows, "user_id", callbacks.count_up(6 * HOUR), EVENT_DDL + ", count bigint", "timestamp",
        ["timestamp", "event_id"], max_ttl=6 * HOUR,
    )


# ---- keyed state, streams -----------------------------------------------------------------------


def _stream(spark, sf, callback, extra: str = "") -> DataFrame:
    rows = event_stream(spark, sf).select(*EVENT)
    out = processor.keyed_process_stream(
        rows, "user_id", callback, EVENT_DDL + extra, "timestamp", ["timestamp", "event_id"]
    )
    return runner.run_available(out)


@query("stream_st1_dedup_on_change", SQL_ST1)
def stream_st1(spark, sf):
    return _stream(spark, sf, callbacks.on_change("event_type"))


@query("stream_st2_dedup_on_change_ttl", SQL_ST2, headline=True)
def stream_st2(spark, sf):
    return _stream(spark, sf, callbacks.on_change("event_type", DAY))


@query("stream_st3_dedup_on_seen", SQL["st3_dedup_on_seen"])
def stream_st3(spark, sf):
    return _stream(spark, sf, callbacks.on_change("event_type", DAY, refresh="on_seen"))


@query("stream_st4_first_seen", f"SELECT DISTINCT user_id FROM {O.E}")
def stream_st4(spark, sf):
    rows = event_stream(spark, sf).select("user_id")
    return runner.run_available(processor.first_seen_stream(rows, "user_id"))


@query("stream_st5_first_seen_ttl", SQL_ST5)
def stream_st5(spark, sf):
    return _stream(spark, sf, callbacks.once(DAY))


@query("stream_st6_dedup_multi_entry", SQL_ST6)
def stream_st6(spark, sf):
    step = callbacks.multi_entry("event_type", "timestamp", ENTRY_TTLS)
    return _stream(spark, sf, step, ", previous_seen_at bigint")


@query("stream_st7_toggle_by_key", SQL["st7_toggle_by_key"])
def stream_st7(spark, sf):
    key = F.concat_ws("_", F.col("user_id").cast("string"), "event_type")
    rows = K.split_key(
        event_stream(spark, sf).select("event_id", key.alias("key"), "timestamp"),
        "key", "entity", "status",
    ).drop("key")
    out = processor.keyed_process_stream(
        rows, "entity", callbacks.on_change("status", DAY), rows.schema, "timestamp",
        ["timestamp", "event_id"],
    )
    return runner.run_available(out)


@query("stream_st8_counter_ttl", SQL_ST8)
def stream_st8(spark, sf):
    return _stream(spark, sf, callbacks.count_up(6 * HOUR), ", count bigint")


@query("stream_st9_running_count", SQL_ST9)
def stream_st9(spark, sf):
    return _stream(spark, sf, callbacks.count_up(), ", count bigint")


@query("stream_st10_dedup_then_count", SQL_ST10)
def stream_st10(spark, sf):
    step = callbacks.change_then_count("event_type", DAY)
    return _stream(spark, sf, step, ", count bigint")


@query("stream_st11_cached_enrich", SQL["st11_cached_enrich"])
def stream_st11(spark, sf):
    rows = event_stream(spark, sf).select(*EVENT)
    versions = (
        event_stream(spark, sf)
        .filter(F.col("event_type") == "signup")
        .select("user_id", F.col("timestamp").alias("version"), F.col("event_id").alias("profile"))
    )
    out = processor.cached_enrich_stream(
        rows, versions, "user_id", "timestamp", 2 * DAY, "version", "profile", "event_id"
    )
    return runner.run_available(out)


@query("stream_st12_upsert_latest", f"SELECT {COLS} FROM {O.E}")
def stream_st12(spark, sf):
    return _stream(spark, sf, callbacks.upsert("event_type", 16))


@query("stream_st13_mixed_entries", SQL_ST13)
def stream_st13(spark, sf):
    step = callbacks.mixed("event_type", "timestamp", 6 * HOUR)
    return _stream(spark, sf, step, ", first_at bigint, recent_value string")


@query("tbl12_store_stats", f"SELECT count(DISTINCT user_id) AS exact_keys FROM {O.E}")
def tbl12(spark, sf):
    checkpoint = fresh_path(spark, "stream-checkpoint")
    out = processor.keyed_process_stream(
        event_stream(spark, sf).select(*EVENT), "user_id", callbacks.on_change("event_type", DAY),
        EVENT_DDL, "timestamp", ["timestamp", "event_id"],
    )
    runner.run_available(out, checkpoint=checkpoint)
    return processor.store_rows(spark, checkpoint).agg(F.count(F.lit(1)).alias("exact_keys"))


# ---- state tables -------------------------------------------------------------------------------


def _flat(state: DataFrame) -> DataFrame:
    return state.select("partition", "key", "value.status", "stamped", "expires_at_ms")


@query("tbl1_compact_changelog", f"SELECT * FROM {O.COMPACTED}", headline=True)
def tbl1(spark, sf):
    return _flat(state_table.compact_changelog(T.changelog(spark, sf)))


@query(
    "tbl2_restore_state",
    f"SELECT * FROM {O.COMPACTED} WHERE expires_at_ms IS NULL OR expires_at_ms > {O.JAN_31}",
)
def tbl2(spark, sf):
    return _flat(state_table.restore_state(T.changelog(spark, sf), JAN_31))


SQL_DUE = f"stamped AND expires_at_ms <= {O.JAN_31}"


@query(
    "tbl3_expire_state",
    f"SELECT *, coalesce({SQL_DUE}, false) AS evicted FROM {O.COMPACTED}",
    headline=True,
)
def tbl3(spark, sf):
    state = state_table.compact_changelog(T.changelog(spark, sf))
    live, evicted = state_table.expire_state(state, JAN_31)
    return (
        _flat(live).withColumn("evicted", F.lit(False))
        .unionByName(_flat(evicted).withColumn("evicted", F.lit(True)))
    )


@query(
    "tbl3_expire_state_budget",
    f"""SELECT * FROM {O.COMPACTED} WHERE {SQL_DUE}
  ORDER BY expires_at_ms, partition, key LIMIT 10""",
)
def tbl3_budget(spark, sf):
    state = state_table.compact_changelog(T.changelog(spark, sf))
    return _flat(state_table.expire_state(state, JAN_31, limit=10)[1])


@query(
    "tbl4_tombstones",
    f"""SELECT c.partition, (SELECT max("offset") FROM {O.CHANGELOG} x WHERE x.partition = c.partition)
  + row_number() OVER (PARTITION BY c.partition ORDER BY c.key) AS "offset", c.key
  FROM {O.COMPACTED} c WHERE {SQL_DUE}""",
)
def tbl4(spark, sf):
    log = T.changelog(spark, sf)
    _, evicted = state_table.expire_state(state_table.compact_changelog(log), JAN_31)
    gone = state_table.tombstones(evicted, log)
    return gone.filter(F.col("value").isNull()).select("partition", "offset", "key")


@query(
    "tbl4_changelog_after_sweep",
    f"SELECT * FROM {O.COMPACTED} WHERE NOT coalesce({SQL_DUE}, false)",
)
def tbl4_after(spark, sf):
    log = T.changelog(spark, sf)
    _, evicted = state_table.expire_state(state_table.compact_changelog(log), JAN_31)
    swept = log.unionByName(state_table.tombstones(evicted, log))
    return _flat(state_table.compact_changelog(swept))


@query(
    "tbl5_migrate_legacy_ttl",
    O.MIGRATION + "SELECT partition, key, status, stamped, expires_at_ms FROM after",
    headline=True,
)
def tbl5(spark, sf):
    return _flat(state_table.migrate_legacy_ttl(*T.legacy_store(spark, sf))[0])


@query(
    "tbl5_migration_report",
    O.MIGRATION
    + """SELECT p.partition, p.action, count(*) FILTER (a.backfilled) AS backfilled,
  (SELECT count(*) FROM lastw w WHERE w.partition = p.partition) AS self_stamped,
  CASE WHEN p.action = 'backfilled' THEN p.max_ttl END AS window_ms,
  p.action = 'backfilled' AS derived_window
  FROM plan p LEFT JOIN after a USING (partition) GROUP BY ALL""",
)
def tbl5_report(spark, sf):
    return state_table.migrate_legacy_ttl(*T.legacy_store(spark, sf))[2]


@query(
    "tbl5_migration_meta",
    O.MIGRATION
    + """SELECT partition, ttl_enabled OR action = 'backfilled' AS ttl_enabled,
  ttl_enabled OR action = 'backfilled' AS migration_done, high AS high_water_ms FROM plan""",
)
def tbl5_meta(spark, sf):
    return state_table.migrate_legacy_ttl(*T.legacy_store(spark, sf))[1]


@query(
    "tbl5_migrate_explicit_window",
    O.MIGRATION.replace("p.high + p.max_ttl AS deadline", f"p.high + {7 * DAY} AS deadline")
    + "SELECT partition, key, status, stamped, expires_at_ms FROM after",
)
def tbl5_window(spark, sf):
    return _flat(state_table.migrate_legacy_ttl(*T.legacy_store(spark, sf), legacy_ttl=7 * DAY)[0])


@query(
    "tbl6_activation_gate",
    O.MIGRATION.replace("'purchase'", "'-'").replace("'click'", "'-'")
    + "SELECT partition, key, status, stamped, expires_at_ms FROM after",
)
def tbl6(spark, sf):
    state, meta, writes = T.legacy_store(spark, sf)
    inert = writes.withColumn("ttl_ms", F.lit(None).cast("bigint"))
    return _flat(state_table.migrate_legacy_ttl(state, meta, inert, legacy_ttl=7 * DAY)[0])


SQL_HALF = O.MIGRATION + f""", half AS (SELECT s.partition, s.key, s.status,
  s.stamped OR hash_even AS stamped,
  CASE WHEN s.stamped THEN s.expires_at_ms WHEN hash_even THEN m.high + {DAY} END AS expires_at_ms,
  m.high FROM (SELECT *, right(key, 1)::INTEGER % 2 = 0 AND NOT stamped AS hash_even FROM state) s
  JOIN meta m USING (partition))
"""


def _interrupted(spark, sf):
    """(state, ledger, meta) of a backfill cut short: keys with an even last digit are stamped."""
    state, meta, _ = T.legacy_store(spark, sf)
    even = (F.substring("key", -1, 1).cast("int") % 2 == 0) & ~F.col("stamped")
    high = meta.select("partition", "high_water_ms")
    half = state.join(high, "partition").withColumn("__even", even)
    state = half.withColumns(
        {
            "expires_at_ms": F.when(F.col("__even"), F.col("high_water_ms") + DAY).otherwise(
                F.col("expires_at_ms")
            ),
            "stamped": F.col("stamped") | F.col("__even"),
        }
    )
    ledger = half.filter("__even").select("partition", "key")
    meta = meta.withColumn("ttl_enabled", F.lit(True))
    return state.select(*state_table.STATE_COLUMNS), ledger, meta


@query(
    "tbl7_resume_migration",
    SQL_HALF
    + f"""SELECT partition, key, status, true AS stamped,
  CASE WHEN stamped THEN expires_at_ms ELSE high + {3 * DAY} END AS expires_at_ms FROM half""",
)
def tbl7(spark, sf):
    return _flat(state_table.resume_migration(*_interrupted(spark, sf), window=3 * DAY)[0])


@query(
    "tbl8_adopt_stamped",
    SQL_HALF
    + """SELECT partition, bool_or(stamped) AS ttl_enabled, bool_and(stamped) AS migration_done,
  any_value(high) AS high_water_ms FROM half GROUP BY partition""",
)
def tbl8(spark, sf):
    state, _, meta = _interrupted(spark, sf)
    unflagged = meta.withColumns({"ttl_enabled": F.lit(False), "migration_done": F.lit(False)})
    return state_table.repair_ttl(state, unflagged, force_flip=True)[1]


@query(
    "tbl9_rollback_ttl",
    O.MIGRATION
    + """SELECT partition, key, status, false AS stamped, NULL::BIGINT AS expires_at_ms FROM state""",
)
def tbl9(spark, sf):
    state, _, meta = _interrupted(spark, sf)
    return _flat(state_table.repair_ttl(state, meta, rollback=True)[0])


@query(
    "tbl10_state_census",
    O.MIGRATION
    + O.census("after", O.JAN_25, "partition <> 3", "partition <> 3"),
    headline=True,
)
def tbl10(spark, sf):
    state, meta, _ = state_table.migrate_legacy_ttl(*T.legacy_store(spark, sf))
    return state_table.state_census(state, meta, JAN_25)


@query(
    "tbl11_migration_invariants",
    O.MIGRATION
    + """, f AS (SELECT (SELECT count(*) FROM state) AS n, (SELECT count(*) FROM after) AS total,
  (SELECT count(*) FROM after WHERE stamped) AS stamped,
  (SELECT count(*) FROM after WHERE NOT stamped) AS unstamped)
SELECT "check", expected, actual, expected = actual AS ok FROM (
  SELECT 'total' AS "check", n::VARCHAR AS expected, total::VARCHAR AS actual FROM f
  UNION ALL SELECT 'stamped', n::VARCHAR, stamped::VARCHAR FROM f
  UNION ALL SELECT 'unstamped', '0', unstamped::VARCHAR FROM f
  UNION ALL SELECT 'double_wrapped', '0', '0'
  UNION ALL SELECT 'decode_clean', total::VARCHAR, stamped::VARCHAR FROM f
  UNION ALL SELECT 'ttl_enabled', 'true', 'false' UNION ALL SELECT 'migration_done', 'true', 'false'
  UNION ALL SELECT 'ledger', '0', '0')""",
)
def tbl11(spark, sf):
    store = T.legacy_store(spark, sf)
    state, meta, _ = state_table.migrate_legacy_ttl(*store)
    census = state_table.state_census(state, meta, JAN_25)
    return state_table.migration_invariants(census, store[0].count())


# ---- restored state into a live stream ----------------------------------------------------------


def sql_seeded(seed: str, ctes: str = "") -> str:
    """Events from Jan 20 on, change-only with a TTL of a day, where `seed` (key, status, expires_at_ms) is stored before."""
    live = "CASE WHEN r.timestamp < s.deadline THEN s.stored END"
    differs = f"({live}) IS DISTINCT FROM r.v"
    return f"""WITH RECURSIVE {ctes} r AS (SELECT *, event_type AS v, {O.KEY} AS key,
  row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS rn FROM {O.E} WHERE timestamp >= {O.JAN_20}),
s AS (SELECT u.key, 0::BIGINT AS rn, q.status AS stored, coalesce(q.expires_at_ms, 9000000000000000000) AS deadline,
    false AS emit FROM (SELECT DISTINCT key FROM r) u LEFT JOIN ({seed}) q USING (key)
  UNION ALL SELECT r.key, r.rn, CASE WHEN {differs} THEN r.v ELSE s.stored END,
    CASE WHEN {differs} THEN r.timestamp + {DAY} ELSE s.deadline END, {differs}
  FROM s JOIN r ON r.key = s.key AND r.rn = s.rn + 1)
SELECT {COLS} FROM r JOIN s USING (key, rn) WHERE s.emit"""


def _seeded(spark, sf, state: DataFrame) -> DataFrame:
    ident = {"user_id": F.expr("cast(substring(key, 7) as bigint)")}
    initial = processor.seed_entries(state, ident, "entry", F.col("value.status"))
    rows = event_stream(spark, sf).select(*EVENT).filter(F.col("timestamp") >= T.JAN_20)
    step = callbacks.on_change("event_type", DAY)
    out = processor.keyed_process_stream(
        rows, "user_id", step, EVENT_DDL, "timestamp", ["timestamp", "event_id"], initial=initial
    )
    return runner.run_available(out)


SQL_RESTORED = f"""SELECT key, status, expires_at_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY partition, key ORDER BY "offset" DESC) AS n
  FROM {O.CHANGELOG} WHERE ts_ms < {O.JAN_20}) WHERE n = 1 AND status IS NOT NULL
  AND (expires_at_ms IS NULL OR expires_at_ms > {O.JAN_20})"""


@query("tbl2_restore_into_stream", sql_seeded(SQL_RESTORED))
def tbl2_stream(spark, sf):
    """Stamped, legacy and never-expiring entries restored from the log as of Jan 20; the stream goes on from there."""
    log = T.changelog(spark, sf).filter(F.col("ts_ms") < T.JAN_20)
    return _seeded(spark, sf, state_table.restore_state(log, T.JAN_20))


@query(
    "tbl7_resume_into_stream",
    sql_seeded(
        f"""SELECT key, status, CASE WHEN stamped THEN expires_at_ms ELSE high + {3 * DAY} END AS expires_at_ms FROM half""",
        SQL_HALF.strip().removeprefix("WITH RECURSIVE").removeprefix("WITH") + ",",
    ),
)
def tbl7_stream(spark, sf):
    """A migration cut short is finished, and the stream goes on with its deadlines."""
    return _seeded(spark, sf, state_table.resume_migration(*_interrupted(spark, sf), window=3 * DAY)[0])


# ---- lake ---------------------------------------------------------------------------------------

LAYOUT = lake.Layout.parse("year,month,day,event_type,~user_id")
LAKE_COLS = ["event_id", "user_id", "event_type", "value", "timestamp", "year", "month", "day"]


def _lake(spark, sf, **options) -> str:
    path = fresh_path(spark, "lake")
    lake.write_lake(events(spark, sf), path, LAYOUT, "timestamp", **options)
    return path


SQL_LAKE = f"SELECT {', '.join(LAKE_COLS)} FROM {O.LAKE}"


@query("lake2_write_lake", SQL_LAKE, headline=True)
def lake2(spark, sf):
    return lake.read_lake(spark, _lake(spark, sf)).select(*LAKE_COLS)


@query("lake2_no_physical_columns", f"SELECT {COLS}, value FROM {O.E}")
def lake2_virtual_only(spark, sf):
    path = fresh_path(spark, "lake")
    layout = lake.Layout.parse("~user_id")
    lake.write_lake(events(spark, sf), path, layout, "timestamp", sort_col="event_id")
    return lake.read_lake(spark, path).select(*EVENT, "value")


@query("snk3_stream_to_lake", SQL_LAKE)
def snk3(spark, sf):
    path, checkpoint = fresh_path(spark, "lake"), fresh_path(spark, "lake-checkpoint")
    sink = (
        event_stream(spark, sf)
        .writeStream.foreachBatch(lake.lake_sink(path, LAYOUT, "timestamp"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    runner.await_end(sink)
    return lake.read_lake(spark, path).select(*LAKE_COLS)


@query(
    "stat1_file_stats",
    f"""WITH f AS (SELECT year, month, day, event_type, min(timestamp) AS t0, max(timestamp) AS t1,
  min(event_id) AS e0, max(event_id) AS e1, count(*) AS n FROM {O.LAKE} GROUP BY ALL)
SELECT year, month, day, event_type, 'timestamp' AS "column", t0 AS "min", t1 AS "max", n AS value_count,
  0 AS null_count FROM f
UNION ALL SELECT year, month, day, event_type, 'event_id', e0, e1, n, 0 FROM f""",
)
def stat1(spark, sf):
    path = _lake(spark, sf)
    rows = lake.scan(spark, path)
    stats = lake.file_stats(rows, LAYOUT, ["timestamp", "event_id"])
    return stats.groupBy("year", "month", "day", "event_type", "column").agg(
        F.min(F.col("min").cast("bigint")).alias("min"),
        F.max(F.col("max").cast("bigint")).alias("max"),
        F.sum("value_count").alias("value_count"),
        F.sum("null_count").alias("null_count"),
    )


@query(
    "stat2_manifest",
    f"""SELECT year, month, day, event_type, count(*) AS rows, 'event_id,timestamp,user_id,value' AS columns
  FROM {O.LAKE} GROUP BY ALL""",
)
def stat2(spark, sf):
    entries = lake.read_manifest(spark, _lake(spark, sf))
    part = F.col("partition_values")
    return entries.groupBy(
        *[part[c].alias(c) for c in LAYOUT.physical],
        F.array_join(F.array_sort(F.map_keys("column_stats")), ",").alias("columns"),
    ).agg(F.sum(F.col("column_stats")["timestamp"]["value_count"]).alias("rows"))


@query(
    "stat3_prune_files",
    SQL_LAKE + f" WHERE timestamp BETWEEN {O.JAN_20} AND {O.JAN_25}",
)
def stat3(spark, sf):
    rows = lake.read_range(spark, _lake(spark, sf), "timestamp", T.JAN_20, JAN_25)
    return rows.select(*LAKE_COLS)


@query(
    "idx1_virtual_index",
    f"SELECT DISTINCT user_id, year, month, day, event_type FROM {O.LAKE}",
)
def idx1(spark, sf):
    index = lake.read_index(spark, _lake(spark, sf), LAYOUT)
    return index.select("user_id", "year", "month", "day", "event_type").distinct()


@query(
    "idx2_lookup_virtual",
    SQL_LAKE
    + """ WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
  AND event_type = 'purchase'""",
)
def idx2(spark, sf):
    orders = T.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
    ids = orders.select(F.col("o_custkey").alias("user_id"))
    rows = lake.read_by_virtual(
        spark, _lake(spark, sf), LAYOUT, ids, F.col("event_type") == "purchase"
    )
    return rows.select(*LAKE_COLS)


@query("idx3_reindex", SQL["idx1_virtual_index"])
def idx3(spark, sf):
    path = _lake(spark, sf)
    lake.reindex(spark, path, LAYOUT, rebuild=True)
    index = lake.read_index(spark, path, LAYOUT)
    return index.select("user_id", "year", "month", "day", "event_type").distinct()


@query("cmp1_compact", SQL_LAKE, headline=True)
def cmp1(spark, sf):
    path = fresh_path(spark, "lake")
    rows = events(spark, sf)
    for k in range(2):
        lake.write_lake(rows.filter(F.col("event_id") % 2 == k), path, LAYOUT, "timestamp")
    lake.compact(spark, path, LAYOUT)
    return lake.read_lake(spark, path).select(*LAKE_COLS)


def _halves(spark, sf, path: str, **options) -> None:
    """Two commits with files in every folder."""
    rows = events(spark, sf)
    for k, name in enumerate("ab"):
        part = rows.filter(F.col("event_id") % 2 == k)
        lake.write_lake(part, path, LAYOUT, "timestamp", commit=name, **options)


@query("cmp1_one_folder", SQL_LAKE)
def cmp1_folder(spark, sf):
    """Four commits; one partition is compacted, files of others stay; then replays of all commits, which add nothing."""
    path, rows = fresh_path(spark, "lake"), events(spark, sf)
    for turn in range(2):
        for k in range(4):
            part = rows.filter(F.col("event_id") % 4 == k)
            lake.write_lake(part, path, LAYOUT, "timestamp", commit=f"batch-{k}")
        if turn == 0:
            where = (F.col("day") == "09") & (F.col("event_type") == "click")
            lake.compact(spark, path, LAYOUT, where=where)
    return lake.read_lake(spark, path).select(*LAKE_COLS)


@query(
    "cmp1_files_by_folder",
    f"""SELECT day, event_type, CASE WHEN day = '09' AND event_type = 'click' THEN 1
  ELSE count(DISTINCT event_id % 4) END AS files, count(*) AS rows FROM {O.LAKE} GROUP BY day, event_type""",
)
def cmp1_files(spark, sf):
    path, rows = fresh_path(spark, "lake"), events(spark, sf)
    for k in range(4):
        part = rows.filter(F.col("event_id") % 4 == k)
        lake.write_lake(part, path, LAYOUT, "timestamp", max_workers=1)
    lake.compact(spark, path, LAYOUT, where=(F.col("day") == "09") & (F.col("event_type") == "click"))
    part = F.col("partition_values")
    return lake.read_manifest(spark, path).groupBy(part["day"].alias("day"), part["event_type"].alias("event_type")).agg(
        F.count("file_path").alias("files"), F.sum("rows").alias("rows")
    )


@query("cmp1_two_at_once", SQL_LAKE)
def cmp1_race(spark, sf):
    """Two compactions of the same files, both published; readers count the first only."""
    path = fresh_path(spark, "lake")
    _halves(spark, sf, path)
    for row in [lake.prepare_compaction(spark, path, LAYOUT) for _ in range(2)]:
        lake_log.publish(spark, path, row)
    lake_log.fold(spark, path)
    return lake.read_lake(spark, path).select(*LAKE_COLS)


@query("snk3_crash_while_publishing", SQL_LAKE)
def snk3_crash(spark, sf):
    """A writer dies with its files written, its row in draft and a folder of the row's name in place; then the replay."""
    path = fresh_path(spark, "lake")
    rows = events(spark, sf)
    lake.write_lake(rows.filter("event_id % 2 = 0"), path, LAYOUT, "timestamp", commit="a")
    dated = K.calendar(rows.filter("event_id % 2 = 1"), "timestamp").drop("hour")
    lake._write_commit(dated, path, LAYOUT, "timestamp", "b.dead", None, 5_000_000)
    rows.limit(0).write.parquet(f"{path}/_commits/b/_temporary")
    lake_log.put_once(spark, f"{path}/_commits/.draft", '{"commit": "b", "se')
    _halves(spark, sf, path)
    return lake.read_lake(spark, path).select(*LAKE_COLS)


@query("snk3_two_checkpoints", f"SELECT day, event_type, 2 * count(*) AS n FROM {O.LAKE} GROUP BY day, event_type")
def snk3_two(spark, sf):
    """Two streams with batch numbers of their own into one table; each row of both counts, and a restart of one adds nothing."""
    path, first, second = (fresh_path(spark, n) for n in ("lake", "lake-checkpoint", "lake-checkpoint"))
    for checkpoint in (first, second, first):
        sink = event_stream(spark, sf).writeStream.foreachBatch(lake.lake_sink(path, LAYOUT, "timestamp"))
        runner.await_end(sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return lake.read_lake(spark, path).groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("snk4_max_workers", f"SELECT count(*) AS rows, true AS within_three FROM {O.E}")
def snk4(spark, sf):
    path = _lake(spark, sf, max_workers=3)
    files = lake.read_manifest(spark, path)
    task = F.regexp_extract("file_path", r"/part-(\d+)-", 1)
    return files.agg(F.sum("rows").alias("rows"), (F.count_distinct(task) <= 3).alias("within_three"))


@query(
    "lake4_validate_layout",
    f"""SELECT layout, accepted, CASE WHEN accepted THEN 2 ELSE 1 END * (SELECT count(*) FROM {O.E}) AS rows FROM (VALUES
  ('year,month,day,event_type,~user_id', true), ('year,month,day,event_type', false), ('event_type,~user_id', false),
  ('year,month,day,~user_id', false), ('year,month,day,event_type,user_id', false)) AS v(layout, accepted)""",
)
def lake4(spark, sf):
    """Each layout against a table of the first: rows there after a write that is taken or refused.

    A refused write must leave the table as it is, so all of them meet the same one; the write that is taken comes last.
    """
    refused = ["year,month,day,event_type", "event_type,~user_id", "year,month,day,~user_id", "year,month,day,event_type,user_id"]
    path, out = _lake(spark, sf), []
    for name in [*refused, "year,month,day,event_type,~user_id"]:
        accepted = True
        try:
            lake.write_lake(events(spark, sf), path, lake.Layout.parse(name), "timestamp")
        except lake.LayoutMismatch:
            accepted = False
        total = lake.read_lake(spark, path).agg(F.count(F.lit(1)).alias("rows"))
        out.append(total.select(F.lit(name).alias("layout"), F.lit(accepted).alias("accepted"), "rows"))
    return reduce(DataFrame.unionByName, out)


@query(
    "lake5_lake6_table_by_name",
    f"""SELECT day, event_type, count(*) AS n, max(event_id) AS last_id, 'year,month,day,event_type,user_id' AS spec,
  'user_id' AS virtual, 'event_id' AS sorted_by, 'timestamp' AS timed_by FROM {O.LAKE}
  WHERE event_type <> 'error' GROUP BY day, event_type""",
)
def lake6(spark, sf):
    """Registered on the first write, followed over a second one and a compaction; read by name."""
    path, name = fresh_path(spark, "lake"), f"ttl_events_{uuid.uuid4().hex}"
    _halves(spark, sf, path, sort_col="event_id", register_as=name)
    lake.compact(spark, path, LAYOUT, register_as=name)
    known = lake_catalog.properties(spark, name)
    rows = spark.sql(
        f"SELECT day, event_type, count(*) AS n, max(event_id) AS last_id FROM {name} WHERE event_type <> 'error' GROUP BY ALL"
    )
    return rows.withColumns(
        {
            "spec": F.lit(",".join(known["partition_spec"])),
            "virtual": F.lit(",".join(known["virtual_partitions"])),
            "sorted_by": F.lit(known["sort_column"]),
            "timed_by": F.lit(known["timestamp_column"]),
        }
    )


@query(
    "stat3_predicates",
    SQL_LAKE
    + f""" WHERE (timestamp >= {O.JAN_20} AND NOT (event_type IN ('view', 'error') OR value > 50))
  OR (value IS NULL AND day = '05') OR event_id IN (3, 77, 5000000)""",
)
def stat3_tree(spark, sf):
    late = (col("timestamp") >= T.JAN_20) & ~(col("event_type").isin("view", "error") | (col("value") > 50.0))
    some = late | (col("value").is_null() & (col("day") == "05")) | col("event_id").isin(3, 77, 5000000)
    return lake.read_where(spark, _lake(spark, sf), some).select(*LAKE_COLS)


@query(
    "idx2_point_lookup",
    SQL_LAKE + " WHERE user_id = (SELECT max(user_id) FROM events) AND event_type <> 'view'",
)
def idx2_point(spark, sf):
    """One id through the merged index, a commit later than it and a compacted partition."""
    path = fresh_path(spark, "lake")
    rows = events(spark, sf)
    lake.write_lake(rows.filter("event_id % 2 = 0"), path, LAYOUT, "timestamp")
    lake.reindex(spark, path, LAYOUT)
    lake.write_lake(rows.filter("event_id % 2 = 1"), path, LAYOUT, "timestamp")
    lake.compact(spark, path, LAYOUT, where=F.col("day") == "20")
    last = rows.agg(F.max("user_id")).first()[0]
    found = lake.read_by_id(spark, path, LAYOUT, F.col("event_type") != "view", user_id=last)
    return found.select(*LAKE_COLS)


@query("idx3_reindex_folder", SQL["idx1_virtual_index"])
def idx3_folder(spark, sf):
    path = fresh_path(spark, "lake")
    _halves(spark, sf, path)
    lake.reindex(spark, path, LAYOUT)
    lake.reindex(spark, path, LAYOUT, rebuild=True, where=F.col("day") == "09")
    index = lake.read_index(spark, path, LAYOUT)
    return index.select("user_id", "year", "month", "day", "event_type").distinct()


@query(
    "flt3_partition_filter",
    SQL_LAKE + " WHERE month = '01' AND day = '09' AND event_type = 'click'",
)
def flt3(spark, sf):
    rows = lake.read_lake(spark, _lake(spark, sf))
    where = "month = '01' AND day = '09' AND event_type = 'click'"
    return rows.filter(where).select(*LAKE_COLS)


@query(
    "qry1_sql_over_lake",
    f"""SELECT day, event_type, count(*) AS n, max(event_id) AS last_id FROM {O.LAKE}
  WHERE event_type <> 'error' GROUP BY day, event_type""",
)
def qry1(spark, sf):
    return lake.query_lake(
        spark, _lake(spark, sf), "ttl_events",
        """WITH kept AS (SELECT * FROM ttl_events WHERE event_type <> 'error')
           SELECT day, event_type, count(*) AS n, max(event_id) AS last_id
           FROM kept GROUP BY day, event_type""",
    )


# ---- projections, keys, sources -----------------------------------------------------------------


@query(
    "prj1_keys_and_scalars",
    f"""SELECT event_id, {O.KEY} AS order_id, {O.KEY} || '-' || event_type AS event_key,
  'key-' || (event_id % 1000) AS slot, 800 AS pad_bytes, user_id::VARCHAR AS entity,
  event_type AS status, timestamp FROM {O.E}""",
)
def prj1(spark, sf):
    rows = events(spark, sf).withColumns(
        {
            "order_id": K.order_id(F.col("user_id")),
            "event_key": K.event_key(K.order_id(F.col("user_id")), F.col("event_type")),
            "slot": K.slot_key(F.col("event_id"), 1000),
            "pad_bytes": F.length(K.padding(800)),
            "raw": F.encode(F.concat_ws("_", F.col("user_id").cast("string"), "event_type"), "utf-8"),
        }
    )
    return K.split_key(rows, "raw", "entity", "status").select(
        "event_id", "order_id", "event_key", "slot", "pad_bytes", "entity", "status", "timestamp"
    )


@query(
    "dat2_calendar",
    f"""SELECT event_id, year, month, day,
  strftime(make_timestamp(timestamp * 1000), '%H') AS hour FROM {O.LAKE}""",
)
def dat2(spark, sf):
    return K.calendar(events(spark, sf), "timestamp").select(
        "event_id", "year", "month", "day", "hour"
    )


@query(
    "bkt1_expiry_bucket",
    f"""SELECT bucket, count(*) AS n FROM (SELECT CASE
  WHEN event_type = 'signup' THEN 'never' WHEN timestamp <= {O.JAN_25} THEN 'expired'
  WHEN timestamp < {O.JAN_25} + {HOUR} THEN 'lt_1h' WHEN timestamp < {O.JAN_25} + {DAY} THEN 'h1_24'
  ELSE 'gt_24h' END AS bucket FROM {O.E}) GROUP BY bucket""",
)
def bkt1(spark, sf):
    deadline = F.when(F.col("event_type") != "signup", F.col("timestamp"))
    rows = events(spark, sf).select(K.expiry_bucket(deadline, JAN_25).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj4_stamp_seq",
    f"""SELECT event_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS seq
  FROM {O.E}""",
)
def prj4(spark, sf):
    rows = events(spark, sf).select("event_id", (F.col("user_id") % 4).alias("partition"))
    return lake.stamp_seq(rows, "partition", "event_id").select("event_id", "seq")


@query(
    "src1_topic_round_trip",
    f"""SELECT {O.KEY} AS order_id, event_type AS status, 'some data' AS payload, timestamp,
  {O.KEY} || '-' || event_type AS __key, (user_id % 4)::INTEGER AS partition, event_id AS "offset",
  timestamp AS record_ms FROM {O.E}""",
)
def src1(spark, sf):
    """JSON out as the kafka sink takes it, and in again as the kafka source gives it."""
    rows = events(spark, sf)
    body = rows.select(
        K.order_id(F.col("user_id")).alias("order_id"),
        F.col("event_type").alias("status"),
        F.lit("some data").alias("payload"),
        "timestamp",
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
    )
    records = body.select(
        K.event_key(F.col("order_id"), F.col("status")).cast("binary").alias("key"),
        F.to_json(F.struct("order_id", "status", "payload", "timestamp")).cast("binary").alias("value"),
        "partition",
        "offset",
        F.timestamp_millis("timestamp").alias("timestamp"),
    )
    return topics.decode_records(records, topics.EVENT_SCHEMA)


@query(
    "snk1_encode_records",
    f"""SELECT user_id::VARCHAR AS key, '{{"event_id":' || event_id || ',"status":"' || event_type
  || '","timestamp":' || timestamp || '}}' AS value FROM {O.E}""",
)
def snk1(spark, sf):
    rows = events(spark, sf).select(
        "event_id", F.col("event_type").alias("status"), "timestamp", "user_id"
    )
    encoded = topics.encode_records(
        rows.withColumnRenamed("user_id", "__user"), F.col("__user")
    )
    # The key column is not part of the record.
    trimmed = F.regexp_replace("value", r',"__user":\d+', "")
    return encoded.select("key", trimmed.alias("value"))


@query(
    "src6_end_offsets",
    f"""SELECT event_type AS topic, sum(e)::BIGINT AS end_offset FROM (
  SELECT event_type, user_id % 4, max(event_id) + 1 AS e FROM {O.E} GROUP BY ALL) GROUP BY ALL
  UNION ALL SELECT DISTINCT event_type || '-absent', 0 FROM events""",
)
def src6(spark, sf):
    records = events(spark, sf).select(
        F.col("event_type").alias("topic"),
        (F.col("user_id") % 4).alias("partition"),
        F.col("event_id").alias("offset"),
    )
    names = records.select("topic").distinct()
    absent = names.select(F.concat("topic", F.lit("-absent")).alias("topic"))
    return topics.end_offsets(records, names.union(absent))


@query(
    "src5_lost_positions",
    f"""SELECT * FROM (SELECT event_type AS topic, user_id AS partition,
  max(event_id) FILTER (timestamp < {O.JAN_20}) AS "offset",
  min(event_id) FILTER (timestamp >= {O.JAN_20}) AS low_watermark FROM {O.E} GROUP BY ALL)
  WHERE "offset" < low_watermark""",
)
def src5(spark, sf):
    """Positions committed before Jan 20, where retention has dropped all that is older."""
    rows = events(spark, sf).select(
        F.col("event_type").alias("topic"), F.col("user_id").alias("partition"), "event_id",
        "timestamp",
    )
    part = ["topic", "partition"]
    committed = rows.filter(F.col("timestamp") < T.JAN_20).groupBy(*part).agg(
        F.max("event_id").alias("offset")
    )
    lows = rows.filter(F.col("timestamp") >= T.JAN_20).groupBy(*part).agg(
        F.min("event_id").alias("offset")
    )
    return topics.lost_positions(committed, lows)


# ---- logs and progress --------------------------------------------------------------------------

TEXT_MARKERS = {"licence": r"[Ll]icen[sc]e", "url": r"https?://", "address": r"[a-z0-9.]+@[a-z0-9.]+"}


@query(
    "log1_extract_markers",
    "SELECT doc_id, marker, count(*) AS lines FROM ("
    + " UNION ALL ".join(
        f"""SELECT doc_id, '{m}' AS marker FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line
  FROM documents) WHERE regexp_matches(line, '{p}')"""
        for m, p in TEXT_MARKERS.items()
    )
    + ") GROUP BY ALL",
    headline=True,
)
def log1(spark, sf):
    lines = T.table(spark, sf, "documents").select(
        "doc_id", F.explode(F.split("text", "\n")).alias("line")
    )
    marked = progress.extract_markers(lines, TEXT_MARKERS)
    return marked.groupBy("doc_id", "marker").agg(F.count(F.lit(1)).alias("lines"))


def _migration_lines(spark, sf) -> DataFrame:
    """Per user (scenario) the lines of a migration, one per event."""
    count = F.col("event_id").cast("string")
    kind = F.col("event_type")
    line = (
        F.when(kind == "signup", F.lit("INFO TTL legacy backfill STARTED: 5 keys"))
        .when(kind == "click", F.lit("INFO TTL legacy backfill FINISHED: done"))
        .when(
            kind == "purchase",
            F.concat(F.lit("Backfilled "), count, F.lit(" legacy records and flipped state store")),
        )
        .when((kind == "error") & (F.col("value") > 60), F.lit("WARN Fail-safe TTL read: key"))
        .otherwise(F.lit("checkpoint"))
    )
    return events(spark, sf).select(
        F.col("user_id").alias("scenario"), "event_id", line.alias("line")
    )


SQL_LINES = f"""(SELECT user_id AS scenario, event_id, CASE
  WHEN event_type = 'signup' THEN 'started' WHEN event_type = 'click' THEN 'finished'
  WHEN event_type = 'purchase' THEN 'flip' WHEN event_type = 'error' AND value > 60 THEN 'failsafe_read'
  ELSE '' END AS hit FROM {O.E})"""


@query(
    "log2_marker_verdicts",
    " UNION ALL ".join(
        f"""SELECT scenario, '{m}' AS marker, '{k}' AS kind, bool_or(hit = '{m}') AS seen,
  bool_or(hit = '{m}') = ({k == "required"}) AS ok FROM {SQL_LINES} GROUP BY scenario"""
        for m, k in [
            ("started", "required"), ("finished", "required"), ("flip", "required"),
            ("failsafe_read", "forbidden"), ("silently_deleting", "forbidden"),
        ]
    ),
)
def log2(spark, sf):
    return progress.marker_verdicts(
        _migration_lines(spark, sf), "scenario", M.MIGRATION_MARKERS,
        ["started", "finished", "flip"], ["failsafe_read", "silently_deleting"],
    )


@query(
    "log2_captured_count",
    f"""SELECT scenario, min(event_id) FILTER (hit = 'flip') AS captured FROM {SQL_LINES}
  GROUP BY scenario""",
)
def log2_count(spark, sf):
    return progress.captured_count(
        _migration_lines(spark, sf), "scenario", M.MIGRATION_MARKERS["flip"], ["event_id"]
    )


@query(
    "log3_store_verdict",
    f"""SELECT user_id AS store, coalesce(string_agg(DISTINCT cap::VARCHAR, ',' ORDER BY cap::VARCHAR), '') AS caps,
  coalesce(string_agg(DISTINCT policy, ',' ORDER BY policy), '') AS policies, count(cap) AS cf_count,
  bool_or(coalesce(cap = 8388608, false) OR coalesce(policy = 'nullptr', false)) AS degraded FROM (
  SELECT user_id, CASE WHEN event_type = 'purchase' THEN 134217728
    WHEN event_type = 'click' AND value > 90 THEN 8388608 END AS cap,
    CASE WHEN event_type = 'view' THEN 'bloomfilter'
    WHEN event_type = 'error' AND value > 90 THEN 'nullptr' END AS policy FROM {O.E})
  WHERE cap IS NOT NULL OR policy IS NOT NULL GROUP BY user_id""",
)
def log3(spark, sf):
    kind, big = F.col("event_type"), F.col("value") > 90
    line = (
        F.when(kind == "purchase", F.lit("    capacity : 134217728"))
        .when((kind == "click") & big, F.lit("    capacity : 8388608"))
        .when(kind == "view", F.lit("  filter_policy: bloomfilter"))
        .when((kind == "error") & big, F.lit("  filter_policy: nullptr"))
        .otherwise(F.lit("  capacity: 128"))
    )
    lines = events(spark, sf).select(F.col("user_id").alias("store"), line.alias("line"))
    texts = F.array_sort(F.transform("block_cache_capacity", lambda c: c.cast("string")))
    return progress.store_verdict(lines).select(
        "store",
        F.array_join(texts, ",").alias("caps"),
        F.array_join("filter_policy", ",").alias("policies"),
        "cf_count",
        "degraded",
    )


@query(
    "log4_cycle_windows",
    O.CHURN + "SELECT deployment, cycle, start_ms, end_ms FROM windows",
)
def log4(spark, sf):
    actions, samples, _ = T.churn(spark, sf)
    return progress.cycle_windows(actions, samples)


@query(
    "log5_assign_cycles",
    O.CHURN
    + """SELECT l.deployment, l.ts_ms, l.line, w.cycle FROM lines l JOIN windows w
  ON l.deployment = w.deployment AND l.ts_ms >= w.start_ms AND l.ts_ms < w.end_ms""",
    headline=True,
)
def log5(spark, sf):
    actions, samples, lines = T.churn(spark, sf)
    return progress.assign_cycles(lines, progress.cycle_windows(actions, samples))


@query("log6_handover", O.CHURN + "SELECT deployment, cycle, handover_s FROM hand")
def log6(spark, sf):
    actions, samples, _ = T.churn(spark, sf)
    return progress.handover(progress.cycle_windows(actions, samples), samples)


@query(
    "log7_longest_stall",
    O.CHURN + "SELECT deployment, cycle, longest_output_stall_s FROM stall",
)
def log7(spark, sf):
    actions, samples, _ = T.churn(spark, sf)
    windows = progress.cycle_windows(actions, samples)
    return progress.longest_stall(progress.assign_cycles(samples, windows))


@query("log8_cycle_report", O.CHURN + "SELECT * FROM report", headline=True)
def log8(spark, sf):
    return progress.cycle_report(*T.churn(spark, sf))


@query(
    "log9_cycle_criteria",
    O.CHURN
    + """, f AS (SELECT deployment, bool_and(max_lock_attempt <= 2) AS bounded_lock_retries,
  bool_or(fast_revoke_seen) AS fast_revoke_present,
  bool_and(coalesce(longest_output_stall_s, 0) < 60) AS bounded_output_stall,
  bool_and(evictions = 0) AS no_eviction,
  bool_and(NOT open_budget_hit AND NOT revoke_flush_timeout) AS budgets_not_exhausted,
  bool_or((evictions > 0 AND (max_lock_attempt > 2 OR lock_retry_count >= 10))
    OR coalesce(longest_output_stall_s, 0) >= 60) AS degraded_seen FROM report GROUP BY deployment)
SELECT *, CASE WHEN deployment = 'feature' THEN CASE WHEN bounded_lock_retries AND fast_revoke_present
  AND bounded_output_stall AND no_eviction AND budgets_not_exhausted THEN 'pass' ELSE 'fail' END
  WHEN degraded_seen THEN 'degraded' ELSE 'inconclusive' END AS verdict FROM f""",
)
def log9(spark, sf):
    return progress.cycle_criteria(progress.cycle_report(*T.churn(spark, sf)), ["feature"])


@query(
    "log9_all_criteria",
    O.CHURN
    + f""", told AS (SELECT w.deployment, w.cycle, l.ts_ms, CASE WHEN line LIKE '%cannot acquire a lock%' THEN 0 ELSE 1 END AS started
  FROM lines l JOIN windows w ON l.deployment = w.deployment AND l.ts_ms >= w.start_ms AND l.ts_ms < w.end_ms
  WHERE line LIKE '%cannot acquire a lock%' OR regexp_matches(line, '{M.FIRST_ATTEMPT}')),
again AS (SELECT deployment, cycle, count(*) FILTER (started = 1 AND p = 0) AS n FROM (SELECT *, lag(started) OVER (
  PARTITION BY deployment, cycle ORDER BY ts_ms, started) AS p FROM told) GROUP BY ALL),
loops AS (SELECT w.deployment, bool_and(coalesce(n, 0) = 0) AS no_crash_loop, bool_or(coalesce(n, 0) >= 2) AS crash_loop_seen
  FROM windows w LEFT JOIN again USING (deployment, cycle) GROUP BY w.deployment),
f AS (SELECT deployment, bool_and(max_lock_attempt <= 2) AS bounded_lock_retries,
  bool_or(fast_revoke_seen) AS fast_revoke_present,
  bool_and(coalesce(longest_output_stall_s, 0) < 60) AS bounded_output_stall, bool_and(evictions = 0) AS no_eviction,
  bool_and(NOT open_budget_hit AND NOT revoke_flush_timeout) AS budgets_not_exhausted,
  bool_or((evictions > 0 AND (max_lock_attempt > 2 OR lock_retry_count >= 10))
    OR coalesce(longest_output_stall_s, 0) >= 60) AS degraded_seen FROM report GROUP BY deployment)
SELECT f.*, no_crash_loop, crash_loop_seen, fast_revoke_present = (deployment = 'feature') AS build_as_expected,
  CASE WHEN deployment = 'feature' THEN CASE WHEN bounded_lock_retries AND fast_revoke_present AND bounded_output_stall
    AND no_eviction AND budgets_not_exhausted AND no_crash_loop THEN 'pass' ELSE 'fail' END
  WHEN fast_revoke_present THEN 'inconclusive' WHEN crash_loop_seen OR degraded_seen THEN 'degraded' ELSE 'inconclusive' END AS verdict
FROM f JOIN loops USING (deployment)""",
)
def log9_all(spark, sf):
    actions, samples, lines = T.churn(spark, sf)
    restarts = progress.lock_restarts(lines, progress.cycle_windows(actions, samples))
    return progress.all_criteria(progress.cycle_report(actions, samples, lines), restarts, ["feature"])


@query(
    "snk2_store_record",
    f"""SELECT 'dedup' AS label, 'final' AS kind, 'ttl' AS mode, 'dedup-v1' AS cg, true AS has_bytes,
  count(DISTINCT user_id) AS exact_keys, count(DISTINCT user_id) AS est_keys FROM {O.E}""",
)
def snk2(spark, sf):
    """A stream that reports its store to one sink that fails and one that works; the last record of the latter."""
    checkpoint, path = fresh_path(spark, "stream-checkpoint"), fresh_path(spark, "records")
    out = processor.keyed_process_stream(
        event_stream(spark, sf).select(*EVENT), "user_id", callbacks.on_change("event_type", DAY),
        EVENT_DDL, "timestamp", ["timestamp", "event_id"],
    )

    def broken(_):
        raise OSError("metrics store is down")

    named = {"label": "dedup", "mode": "ttl", "cg": "dedup-v1"}
    with reporting.reported(spark, broken, **named), reporting.reported(spark, reporting.to_table(spark, path), **named):
        runner.run_available(out, checkpoint=checkpoint)
    reporting.to_table(spark, path)(reporting.final_record(spark, checkpoint, path, **named))
    rows = spark.read.schema(reporting.RECORD).json(path).filter("kind = 'final'")
    return rows.select("label", "kind", "mode", "cg", (F.col("bytes") > 0).alias("has_bytes"), "exact_keys", "est_keys")


@query("src4_named_groups", f"SELECT run, CASE WHEN run = 'again' THEN 0 ELSE count(*) END AS rows FROM {O.E}, (VALUES ('first'), ('again'), ('v2')) AS v(run) GROUP BY run")
def src4(spark, sf):
    """A group sees each row once over its runs, a new version of it sees all."""
    base, out = fresh_path(spark, "groups"), []
    for run, version in (("first", "v1"), ("again", "v1"), ("v2", "v2")):
        seen = fresh_path(spark, "seen")
        rows = event_stream(spark, sf).select(*EVENT)
        at = topics.group_checkpoint(base, "dedup-filter", version)
        query = rows.writeStream.foreachBatch(lambda b, i, seen=seen: b.write.parquet(f"{seen}/batch={i}"))
        runner.await_end(query.option("checkpointLocation", at).trigger(availableNow=True).start())
        total = spark.read.schema(EVENT_DDL).parquet(seen) if lake_log.exists(spark, seen) else rows.sparkSession.createDataFrame([], EVENT_DDL)
        out.append(total.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(run).alias("run"), "rows"))
    return reduce(DataFrame.unionByName, out)


@query(
    "src5_recovered_stream",
    f"""SELECT policy, CASE policy WHEN 'none lost' THEN 0 WHEN 'recover' THEN count(*) ELSE -1 END AS rows FROM {O.E},
  (VALUES ('none lost'), ('recover'), ('fail')) AS v(policy) GROUP BY policy""",
)
def src5_live(spark, sf):
    """Positions kept by a running group, held against low watermarks at the next start: go on, start a new state, or refuse."""
    base, table = fresh_path(spark, "groups"), fresh_path(spark, "positions")
    rows = event_stream(spark, sf).select(*EVENT, (F.col("user_id") % 4).cast("int").alias("partition"))

    def run(checkpoint: str) -> int:
        seen = fresh_path(spark, "seen")

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.select(*EVENT).write.parquet(f"{seen}/batch={batch_id}")
            topics.keep_positions(batch.groupBy("partition").agg((F.max("event_id") + 1).alias("offset")), table, checkpoint, batch_id)

        query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        runner.await_end(query.trigger(availableNow=True).start())
        return spark.read.schema(EVENT_DDL).parquet(seen).count() if lake_log.exists(spark, seen) else 0

    checkpoint = topics.group_checkpoint(base, "dedup-filter", "v1")
    run(checkpoint)
    held = topics.kept_positions(spark, table, checkpoint)
    fine, lost = dict.fromkeys(held, 0), {p: o + 1 for p, o in held.items()}
    found = {}
    for policy, lows, recover in (("none lost", fine, False), ("recover", lost, True), ("fail", lost, False)):
        try:
            found[policy] = run(topics.recover_lost_range(held, lows, checkpoint, recover).checkpoint)
        except topics.LostRange:
            found[policy] = -1
    return spark.createDataFrame(list(found.items()), "policy string, rows bigint")
