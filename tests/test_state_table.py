"""State tables: compaction, expiry, migration in all its cases, resume, census."""

import pytest
from pyspark.sql import functions as F

from emberkey.operators import state_table as st

VALUE = "struct<status: string, pad: string>"
STATE = f"partition int, key string, value {VALUE}, stamped boolean, expires_at_ms bigint"
LOG = (
    f"partition int, offset bigint, key string, value {VALUE}, stamped boolean, "
    "expires_at_ms bigint, ts_ms bigint"
)
META = "partition int, ttl_enabled boolean, migration_done boolean, high_water_ms bigint"
WRITES = f"partition int, offset bigint, key string, value {VALUE}, ts_ms bigint, ttl_ms bigint"
HOUR = 3_600_000
ON, OFF = ("ON", "x"), ("OFF", "x")


def seeded(spark, n, partition=0):
    rows = [(partition, f"order-{i:07d}", ON, False, None) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, STATE)


def meta(spark, *rows):
    return spark.createDataFrame(list(rows), META)


def writes(spark, *rows):
    return spark.createDataFrame([(p, o, k, OFF, ts, ttl) for p, o, k, ts, ttl in rows], WRITES)


def rows_of(df):
    return {(r["partition"], r["key"]): (r["stamped"], r["expires_at_ms"]) for r in df.collect()}


def report_of(df):
    return {
        r["partition"]: (r["action"], r["backfilled"], r["self_stamped"], r["derived_window"])
        for r in df.collect()
    }


@pytest.fixture
def log(spark):
    return spark.createDataFrame(
        [
            (0, 1, "a", ON, False, None, 10),
            (0, 2, "a", OFF, True, 100, 20),
            (0, 3, "b", ON, True, 50, 30),
            (0, 4, "c", ON, True, None, 40),
            (0, 5, "d", ON, True, 500, 50),
            (0, 6, "d", None, False, None, 60),
            (1, 1, "a", ON, False, None, 70),
        ],
        LOG,
    )


def test_compact_and_restore(spark, log):
    assert rows_of(st.compact_changelog(log)) == {
        (0, "a"): (True, 100),
        (0, "b"): (True, 50),
        (0, "c"): (True, None),
        (1, "a"): (False, None),
    }
    # Expired at exactly the deadline; legacy and never-expire rows stay.
    assert set(rows_of(st.restore_state(log, 50))) == {(0, "a"), (0, "c"), (1, "a")}


def test_expire_with_budget_and_tombstones(spark, log):
    state = st.compact_changelog(log)
    live, evicted = st.expire_state(state, 100)
    assert set(rows_of(evicted)) == {(0, "a"), (0, "b")}
    assert set(rows_of(live)) == {(0, "c"), (1, "a")}
    live, evicted = st.expire_state(state, 100, limit=1)
    assert set(rows_of(evicted)) == {(0, "b")} and live.count() == 3
    gone = st.tombstones(evicted, log)
    assert [(r["key"], r["offset"], r["value"]) for r in gone.collect()] == [("b", 7, None)]
    after = st.compact_changelog(log.unionByName(gone))
    assert (0, "b") not in rows_of(after) and after.count() == 3
    assert st.tombstones(evicted, log, enabled=False).count() == 0


def test_migration_cases(spark):
    state = seeded(spark, 5, 0).union(seeded(spark, 3, 1)).union(seeded(spark, 2, 2))
    before = meta(spark, (0, False, False, 1000), (1, False, False, 1000), (2, True, True, 1000))
    batch = writes(
        spark,
        (0, 1, "order-0000001", 2000, 100),
        (0, 2, "order-0000002", 1500, None),  # no ttl: never expires once in TTL mode
        (0, 3, "order-0000001", 2100, 200),  # rewritten in the same batch
        (1, 1, "order-0000001", 9000, None),  # no ttl in this partition: inert
        (2, 1, "order-0000001", 2000, 50),
        (3, 1, "order-9000001", 700, 10),  # empty partition
    )
    after, new_meta, report = st.migrate_legacy_ttl(state, before, batch)
    got = rows_of(after)
    assert got[(0, "order-0000001")] == (True, 2300)
    assert got[(0, "order-0000002")] == (True, None)
    assert {got[(0, f"order-000000{i}")] for i in (3, 4, 5)} == {(True, 2100 + 200)}
    assert {got[(1, f"order-000000{i}")] for i in (1, 2, 3)} == {(False, None)}
    assert got[(2, "order-0000001")] == (True, 2050)
    assert got[(2, "order-0000002")] == (False, None)  # never re-run
    assert got[(3, "order-9000001")] == (True, 710)
    assert len(got) == 11
    assert report_of(report) == {
        0: ("backfilled", 3, 2, True),
        1: ("inert", 0, 1, False),
        2: ("already_migrated", 0, 1, False),
        3: ("flipped_empty", 0, 1, False),
    }
    flags = {r["partition"]: tuple(r)[1:] for r in new_meta.collect()}
    assert flags == {
        0: (True, True, 2100),
        1: (False, False, 9000),
        2: (True, True, 2000),
        3: (True, True, 700),
    }


def test_migration_is_done_once(spark):
    state, first = seeded(spark, 4), writes(spark, (0, 1, "order-0000001", 5000, 100))
    after, flags, _ = st.migrate_legacy_ttl(
        state, meta(spark, (0, False, False, 0)), first, legacy_ttl=7 * 24 * HOUR
    )
    deadline = 5000 + 7 * 24 * HOUR
    assert rows_of(after)[(0, "order-0000004")] == (True, deadline)
    again, _, report = st.migrate_legacy_ttl(
        after, flags, writes(spark, (0, 2, "order-0000002", 6000, 100)), legacy_ttl=HOUR
    )
    got = rows_of(again)
    assert got[(0, "order-0000004")] == (True, deadline)
    assert got[(0, "order-0000002")] == (True, 6100)
    assert report_of(report)[0] == ("already_migrated", 0, 1, False)


def test_resume_never_stamps_twice(spark):
    state = seeded(spark, 6).withColumns(
        {
            "stamped": F.col("key") <= "order-0000002",
            "expires_at_ms": F.when(F.col("key") <= "order-0000002", F.lit(77)),
        }
    )
    # Row 3 is in the ledger though its stamp did not reach the state; row 6 came with its own.
    state = state.withColumns(
        {
            "stamped": F.col("stamped") | (F.col("key") == "order-0000006"),
            "expires_at_ms": F.when(F.col("key") == "order-0000006", 99).otherwise(
                F.col("expires_at_ms")
            ),
        }
    )
    ledger = spark.createDataFrame(
        [(0, f"order-000000{i}") for i in (1, 2, 3)], "partition int, key string"
    )
    flags = meta(spark, (0, True, False, 1000))
    done, flags = st.resume_migration(state, ledger, flags, window=500)
    got = rows_of(done)
    assert [got[(0, f"order-000000{i}")] for i in range(1, 7)] == [
        (True, 77), (True, 77), (False, None), (True, 1500), (True, 1500), (True, 99)
    ]
    twice, flags = st.resume_migration(done, ledger, flags, window=9000)
    assert rows_of(twice) == got
    assert flags.first()["migration_done"] is True


def test_levers(spark):
    state = seeded(spark, 3).withColumns(
        {"stamped": F.lit(True), "expires_at_ms": F.lit(5).cast("bigint")}
    )
    flags = meta(spark, (0, False, False, 10))
    same_state, adopted = st.repair_ttl(state, flags, force_flip=True)
    assert tuple(adopted.first())[1:3] == (True, True)
    assert rows_of(same_state) == rows_of(state)
    stripped, cleared = st.repair_ttl(state, adopted, rollback=True)
    assert set(rows_of(stripped).values()) == {(False, None)}
    assert tuple(cleared.first())[1:3] == (False, False)
    with pytest.raises(ValueError, match="mutually exclusive"):
        st.repair_ttl(state, flags, rollback=True, force_flip=True)


def test_census_and_invariants(spark):
    n = 8
    state = seeded(spark, n)
    seed = st.state_census(state, meta(spark, (0, False, False, 0)), 0)
    total = seed.filter("partition is null").first()
    assert (total["unstamped"], total["stamped"], total["ttl_enabled_flag"]) == (n, 0, False)
    after, flags, report = st.migrate_legacy_ttl(
        state, meta(spark, (0, False, False, 0)),
        writes(spark, (0, 1, "order-0000001", 1000, 2 * HOUR)),
    )
    backfilled = report.first()["backfilled"]
    assert backfilled == n - 1
    pending = spark.createDataFrame([], "partition int, key string")
    census = st.state_census(after, flags, 0, ledger=pending, pending=pending)
    part = census.filter("partition = 0").first()
    assert (part["h1_24"], part["expired"], part["never"]) == (n, 0, 0)
    checks = st.migration_invariants(
        census, n, backfilled, require_pending_zero=True, require_future_bucket=True
    )
    assert checks.filter("not ok").count() == 0 and checks.count() == 14
    failed = st.migration_invariants(seed, n, 0).filter("not ok")
    assert {r["check"] for r in failed.collect()} == {
        "stamped", "unstamped", "decode_clean", "ttl_enabled", "migration_done", "backfilled"
    }
