"""Upkeep of keyed state held as tables: compaction, restore, expiry, TTL migration, census.

state     : partition int, key string, value struct, stamped boolean, expires_at_ms bigint
            stamped=false is a legacy row; stamped with a null deadline never expires
changelog : partition int, offset bigint, key string, value struct (null = tombstone), stamped,
            expires_at_ms, ts_ms bigint
meta      : partition int, ttl_enabled boolean, migration_done boolean, high_water_ms bigint
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberkey.functions.keys import expiry_bucket
from emberkey.operators.carry import null_safe_join
from emberkey.operators.dedup import Duration
from emberkey.operators.ordered import over_lanes
from emberkey.session import materialize, millis

STATE_COLUMNS = ["partition", "key", "value", "stamped", "expires_at_ms"]
BUCKETS = ["expired", "lt_1h", "h1_24", "gt_24h", "never"]


def compact_changelog(changelog: DataFrame) -> DataFrame:
    """State after the whole log: the latest row per (partition, key), tombstones dropped."""
    latest = F.max_by(F.struct("value", "stamped", "expires_at_ms"), F.col("offset"))
    rows = changelog.groupBy("partition", "key").agg(latest.alias("r"))
    return rows.select("partition", "key", "r.*").filter(F.col("value").isNotNull())


def restore_state(changelog: DataFrame, now_ms: int) -> DataFrame:
    """State rebuilt from its log, without the rows that have expired by wall-clock `now_ms`.

    Only this filter looks at wall-clock; the event-time clock starts with the first new record.
    """
    rows = compact_changelog(changelog)
    return rows.filter(F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now_ms))


def expire_state(
    state: DataFrame, clock_ms: int, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(live, evicted) at `clock_ms`. At most `limit` rows are evicted, earliest deadline first."""
    due = F.col("stamped") & F.coalesce(F.col("expires_at_ms") <= clock_ms, F.lit(False))
    evicted = state.filter(due)
    if limit is None:
        return state.filter(~due), evicted
    evicted = evicted.orderBy("expires_at_ms", "partition", "key").limit(limit)
    keys = ["partition", "key"]
    return null_safe_join(state, evicted.select(*keys), keys, "left_anti"), evicted


def tombstones(evicted: DataFrame, changelog: DataFrame, enabled: bool = True) -> DataFrame:
    """Changelog rows that delete the evicted keys, numbered by key after each partition's end.

    Disabled, the sweep stays local and the log gets nothing.
    """
    ends = changelog.groupBy("partition").agg(F.max("offset").alias("__end"))
    rows = evicted if enabled else evicted.filter(F.lit(False))
    value_type = changelog.schema["value"].dataType
    # A partition is a hot key; over lanes its rows are numbered in chunks.
    rows = over_lanes(
        rows.select("partition", "key").withColumn("__one", F.lit(1).cast("bigint")),
        "partition",
        "key",
        lambda df, lane: lane.running(df, "__n", F.col("__one")),
    )
    # One row per partition, so the join is a broadcast by its size.
    rows = rows.join(materialize(ends, "ends"), "partition", "left")
    return rows.select(
        "partition",
        (F.coalesce("__end", F.lit(-1)) + F.col("__n")).alias("offset"),
        "key",
        F.lit(None).cast(value_type).alias("value"),
        F.lit(False).alias("stamped"),
        F.lit(None).cast("bigint").alias("expires_at_ms"),
        F.lit(None).cast("bigint").alias("ts_ms"),
    )


def _latest_writes(writes: DataFrame) -> DataFrame:
    latest = F.max_by(F.struct("value", "ts_ms", "ttl_ms"), F.col("offset"))
    return writes.groupBy("partition", "key").agg(latest.alias("w")).select(
        "partition", "key", "w.*"
    )


def migrate_legacy_ttl(
    state: DataFrame,
    meta: DataFrame,
    writes: DataFrame,
    legacy_ttl: Duration | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply one batch of writes, and migrate the partitions it first writes with a ttl.

    `writes`: partition, offset, key, value, ts_ms, ttl_ms (null = no ttl). Returns the new state,
    the new meta and a report per partition. Per partition:

    - no write with a ttl: inert, whatever `legacy_ttl` says
    - already in TTL mode: nothing is backfilled
    - empty: the flag is set
    - populated: unstamped rows get high-water + (`legacy_ttl` or the batch's longest ttl) as their
      deadline; rows the batch rewrites keep the deadline of their own write
    """
    pending = writes.groupBy("partition").agg(
        F.max("ttl_ms").alias("max_ttl"), F.max("ts_ms").alias("batch_high")
    )
    counts = state.groupBy("partition").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("stamped")).alias("legacy")
    )
    window = F.lit(millis(legacy_ttl)) if legacy_ttl is not None else F.col("max_ttl")
    plan = (
        meta.join(pending, "partition", "full")
        .join(counts, "partition", "left")
        .withColumns(
            {
                "ttl_enabled": F.coalesce("ttl_enabled", F.lit(False)),
                "migration_done": F.coalesce("migration_done", F.lit(False)),
                "high_water_ms": F.greatest("high_water_ms", "batch_high"),
                "rows": F.coalesce("rows", F.lit(0)),
                "legacy": F.coalesce("legacy", F.lit(0)),
            }
        )
        .withColumn(
            "action",
            F.when(F.col("max_ttl").isNull(), "inert")
            .when(F.col("ttl_enabled") | F.col("migration_done"), "already_migrated")
            .when(F.col("rows") == 0, "flipped_empty")
            .otherwise("backfilled"),
        )
        .withColumn("window_ms", F.when(F.col("action") == "backfilled", window))
        .withColumn("deadline", F.col("high_water_ms") + F.col("window_ms"))
        .withColumn("flips", F.col("action").isin("flipped_empty", "backfilled"))
        .withColumn("in_ttl_mode", F.col("ttl_enabled") | F.col("flips"))
    )
    plan = materialize(plan, "ttl-plan")
    last = _latest_writes(writes)
    kept = null_safe_join(state, last.select("partition", "key"), ["partition", "key"], "left_anti")
    # One row per partition, written, so that its size is known: joined to it, the state is not shuffled by partition.
    facts = plan.select("partition", "deadline", "in_ttl_mode")
    stamp = ~F.col("stamped") & F.col("deadline").isNotNull()
    kept = kept.join(facts, "partition", "left").select(
        "partition",
        "key",
        "value",
        (F.col("stamped") | stamp).alias("stamped"),
        F.when(stamp, F.col("deadline")).otherwise(F.col("expires_at_ms")).alias("expires_at_ms"),
        stamp.alias("__backfilled"),
    )
    written = last.join(facts, "partition", "left").select(
        "partition",
        "key",
        "value",
        F.coalesce("in_ttl_mode", F.lit(False)).alias("stamped"),
        (F.col("ts_ms") + F.col("ttl_ms")).alias("expires_at_ms"),
        F.lit(False).alias("__backfilled"),
    )
    after = kept.unionByName(written)
    new_meta = plan.select(
        "partition",
        "in_ttl_mode",
        (F.col("migration_done") | F.col("flips")).alias("migration_done"),
        "high_water_ms",
    ).withColumnRenamed("in_ttl_mode", "ttl_enabled")
    touched = after.groupBy("partition").agg(F.count_if("__backfilled").alias("backfilled"))
    own = last.groupBy("partition").agg(F.count(F.lit(1)).alias("self_stamped"))
    report = (
        plan.join(touched, "partition", "left")
        .join(own, "partition", "left")
        .select(
            "partition",
            "action",
            F.coalesce("backfilled", F.lit(0)).alias("backfilled"),
            F.coalesce("self_stamped", F.lit(0)).alias("self_stamped"),
            "window_ms",
            (F.col("window_ms").isNotNull() & F.lit(legacy_ttl is None)).alias("derived_window"),
        )
    )
    return after.drop("__backfilled"), new_meta, report


def resume_migration(
    state: DataFrame, ledger: DataFrame, meta: DataFrame, window: Duration
) -> tuple[DataFrame, DataFrame]:
    """Finish an interrupted backfill: stamp what is left, never a row twice; mark it done.

    `ledger` (partition, key) lists the rows stamped before the interruption. Only partitions that
    are in TTL mode without the done marker are touched; the ledger may be dropped afterwards.
    """
    listed = ledger.select("partition", "key").withColumn("__listed", F.lit(True))
    open_parts = meta.filter(F.col("ttl_enabled") & ~F.col("migration_done")).select(
        "partition", (F.col("high_water_ms") + millis(window)).alias("__deadline")
    )
    open_parts = materialize(open_parts, "open-partitions")
    rows = null_safe_join(state, listed, ["partition", "key"], "left")
    rows = rows.join(open_parts, "partition", "left")
    stamp = ~F.col("stamped") & F.col("__listed").isNull() & F.col("__deadline").isNotNull()
    done = rows.withColumns(
        {
            "expires_at_ms": F.when(stamp, F.col("__deadline")).otherwise(F.col("expires_at_ms")),
            "stamped": F.col("stamped") | stamp,
        }
    ).select(*state.columns)
    return done, meta.withColumn("migration_done", F.col("migration_done") | F.col("ttl_enabled"))


def adopt_stamped(state: DataFrame, meta: DataFrame) -> DataFrame:
    """Meta with TTL mode switched on where stamped rows exist without the flag; stamps stay.

    The done marker follows only where no legacy row is left to backfill.
    """
    seen = state.groupBy("partition").agg(
        F.bool_or("stamped").alias("__any"), F.bool_and("stamped").alias("__all")
    )
    rows = seen.join(meta, "partition", "full")
    enabled = F.coalesce("ttl_enabled", F.lit(False))
    adopted = ~enabled & F.coalesce("__any", F.lit(False))
    done = F.coalesce("migration_done", F.lit(False))
    return rows.select(
        "partition",
        (enabled | adopted).alias("ttl_enabled"),
        (done | (adopted & F.col("__all"))).alias("migration_done"),
        "high_water_ms",
    )


def rollback_ttl(state: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Back to legacy: stamps stripped, flag and marker cleared."""
    return (
        state.withColumns(
            {"stamped": F.lit(False), "expires_at_ms": F.lit(None).cast("bigint")}
        ),
        meta.withColumns({"ttl_enabled": F.lit(False), "migration_done": F.lit(False)}),
    )


def repair_ttl(
    state: DataFrame, meta: DataFrame, rollback: bool = False, force_flip: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The two operator levers on opening a store; at most one may be set."""
    if rollback and force_flip:
        raise ValueError("rollback and force_flip are mutually exclusive")
    if rollback:
        return rollback_ttl(state, meta)
    if force_flip:
        return state, adopt_stamped(state, meta)
    return state, meta


def state_census(
    state: DataFrame,
    meta: DataFrame,
    now_ms: int,
    ledger: DataFrame | None = None,
    pending: DataFrame | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """One row per partition and one with null `partition` for the totals.

    `ledger`, `pending` and `index` hold one row per key of those side families.
    """
    if "double_wrapped" not in state.columns:
        state = state.withColumn("double_wrapped", F.lit(False))
    stamped = F.col("stamped")
    bucket = F.when(stamped, expiry_bucket(F.col("expires_at_ms"), now_ms))
    counts = {
        "total_default_keys": F.lit(True),
        "stamped": stamped,
        "unstamped": ~stamped,
        "decode_clean": stamped & ~F.col("double_wrapped"),
        "double_wrapped": stamped & F.col("double_wrapped"),
        **{b: F.col("__bucket") == b for b in BUCKETS},
    }
    per_part = (
        state.withColumn("__bucket", bucket)
        .groupBy("partition")
        .agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    )
    sides = {
        "backfill_ledger_count": ledger,
        "backfill_pending_count": pending,
        "ttl_index_count": index,
    }
    per_part = meta.select("partition", "ttl_enabled", "migration_done").join(
        per_part, "partition", "full"
    )
    for name, side in sides.items():
        if side is None:
            per_part = per_part.withColumn(name, F.lit(0).cast("bigint"))
        else:
            sized = side.groupBy("partition").agg(F.count(F.lit(1)).alias(name))
            per_part = per_part.join(sized, "partition", "left")
    numbers = [*counts, *sides]
    per_part = per_part.select(
        "partition",
        *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers],
        F.coalesce("ttl_enabled", F.lit(False)).alias("ttl_enabled_flag"),
        F.coalesce("migration_done", F.lit(False)).alias("migration_done_marker"),
    )
    return per_part.rollup("partition").agg(
        *[F.sum(n).alias(n) for n in numbers],
        F.bool_and("ttl_enabled_flag").alias("ttl_enabled_flag"),
        F.bool_and("migration_done_marker").alias("migration_done_marker"),
    )


def migration_invariants(
    census: DataFrame,
    expected_rows: int,
    backfilled: int | None = None,
    require_ledger_zero: bool = True,
    require_pending_zero: bool = False,
    require_future_bucket: bool = False,
) -> DataFrame:
    """What must hold after a full migration: one row per check (check, expected, actual, ok)."""
    totals = census.filter(F.col("partition").isNull())
    n = str(expected_rows)
    text = lambda c: F.col(c).cast("string")
    future = F.array(*[F.col(b) for b in BUCKETS[1:4]])
    checks = [
        ("total", F.lit(n), text("total_default_keys")),
        ("stamped", F.lit(n), text("stamped")),
        ("unstamped", F.lit("0"), text("unstamped")),
        ("double_wrapped", F.lit("0"), text("double_wrapped")),
        ("decode_clean", text("total_default_keys"), text("decode_clean")),
        ("ttl_enabled", F.lit("true"), text("ttl_enabled_flag")),
        ("migration_done", F.lit("true"), text("migration_done_marker")),
    ]
    if require_ledger_zero:
        checks.append(("ledger", F.lit("0"), text("backfill_ledger_count")))
    if require_pending_zero:
        checks.append(("pending", F.lit("0"), text("backfill_pending_count")))
    if require_future_bucket:
        checks += [
            ("expired", F.lit("0"), text("expired")),
            ("never", F.lit("0"), text("never")),
            ("future_bucket", text("stamped"), F.array_max(future).cast("string")),
            ("future_buckets", F.lit("1"), F.size(F.filter(future, lambda c: c > 0)).cast("string")),
        ]
    if backfilled is not None:
        within = F.when(
            (F.lit(backfilled) > 0) & (F.lit(backfilled) <= expected_rows), F.lit(str(backfilled))
        ).otherwise(F.lit(f"in (0, {n}]"))
        checks.append(("backfilled", within, F.lit(str(backfilled))))
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("check"), e.alias("expected"), a.alias("actual"))
            for c, e, a in checks
        ]
    )
    return totals.select(F.inline(rows)).withColumn("ok", F.col("expected").eqNullSafe(F.col("actual")))
