"""Deduplication: boundaries by hand, hot keys cut in chunks, nulls, arrival order."""

import itertools
import random
from datetime import timedelta

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from emberkey.operators import dedup

SCHEMA = "id int, k string, v string, ts bigint"
MIN = brute.MIN
TTL = timedelta(minutes=5)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    found = [r["id"] for r in df.select("id").collect()]
    assert len(found) == len(set(found))
    return set(found)


def on_change(spark, rows, **options):
    ttl = options.pop("ttl", TTL)
    return ids(
        dedup.dedup_on_change_ttl(frame(spark, rows), "k", "v", "ts", ttl, "id", **options)
    )


def test_toggle_table(spark):
    rows = [
        (0, "a", "ON", 0),  # new: emit
        (1, "a", "ON", MIN),  # same: drop
        (2, "a", "OFF", 2 * MIN),  # toggle: emit
        (3, "a", "OFF", 7 * MIN - 1),  # one ms before the deadline: drop
        (4, "b", "OFF", 0),
        (5, "b", "OFF", 5 * MIN),  # exactly at the deadline: emit
    ]
    assert on_change(spark, rows) == {0, 2, 4, 5}


def test_dropped_duplicates_do_not_prolong(spark):
    rows = [(m, "a", "ON", m * MIN) for m in range(12)]
    assert on_change(spark, rows) == {0, 5, 10}
    assert on_change(spark, rows, refresh="on_seen") == {0}


def test_unknown_refresh_is_refused(spark):
    with pytest.raises(ValueError, match="refresh"):
        on_change(spark, [(0, "a", "ON", 0)], refresh="never")


def test_long_segment_is_folded_in_steps(spark):
    rows = [(i, "a", "ON", i * 100_000) for i in range(5000)]
    assert on_change(spark, rows) == brute.on_change(rows, 5 * MIN)


@pytest.mark.parametrize("values", [("ON", "OFF", None), ("ON",), ("ON", None)])
@pytest.mark.parametrize("hot_rows", [None, 20])
def test_against_brute_force(spark, values, hot_rows):
    rows = brute.skewed_rows(values=values)
    assert on_change(spark, rows, hot_rows=hot_rows) == brute.on_change(rows, 5 * MIN)


def test_regular_chain_over_many_chunks(spark):
    """Evenly spaced rows never let the chains meet, so every chunk depends on the one before."""
    rows = [(i, "hot", "ON", i * 1000) for i in range(300)]
    found = on_change(spark, rows, ttl=37_500, hot_rows=25)
    assert found == brute.on_change(rows, 37_500)


def test_many_steps_per_chunk(spark):
    rows = [(i, "hot", "ON", i * 1000) for i in range(400)]
    found = on_change(spark, rows, ttl=30_000, hot_rows=100)
    assert found == brute.on_change(rows, 30_000)


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_arrival_order_with_late_rows(spark, hot_rows):
    rows = brute.skewed_rows(150, seed=3)
    late = [(i, k, v, ts - (i % 7) * 2 * MIN) for i, k, v, ts in rows]
    found = on_change(spark, late, order_by="id", hot_rows=hot_rows)
    assert found == brute.on_change(late, 5 * MIN, clock_by="arrival")


@pytest.mark.parametrize("hot_rows", [None, 30])
def test_without_ttl_and_on_seen(spark, hot_rows):
    rows = brute.skewed_rows()
    df = frame(spark, rows)
    plain = dedup.dedup_on_change(df, "k", "v", ["ts", "id"], hot_rows=hot_rows)
    assert ids(plain) == brute.on_change(rows)
    seen = on_change(spark, rows, refresh="on_seen", hot_rows=hot_rows)
    assert seen == brute.on_change(rows, 5 * MIN, "on_seen")


@pytest.mark.parametrize("hot_rows", [None, 30])
def test_first_seen(spark, hot_rows):
    rows = brute.skewed_rows()
    df = frame(spark, rows)
    found = dedup.first_seen_ttl(df, "k", "ts", TTL, "id", hot_rows=hot_rows)
    assert ids(found) == brute.once(rows, 5 * MIN)
    assert ids(dedup.first_seen(df, "k", ["ts", "id"])) == brute.once(rows, 10**12)


def test_payload_of_any_type_survives(spark):
    df = spark.sql(
        "select id, 'a' as k, 'ON' as v, id * 60000L as ts, map('n', id) as m, array(id) as arr "
        "from range(12)"
    )
    found = dedup.dedup_on_change_ttl(df, "k", "v", "ts", TTL, "id")
    assert {(r["id"], r["m"]["n"], r["arr"][0]) for r in found.collect()} == {
        (0, 0, 0), (5, 5, 5), (10, 10, 10)
    }
    assert found.columns == df.columns


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_multi_entry_on_a_hot_key(spark, hot_rows):
    rows = brute.skewed_rows()
    ttls = {"last_status": TTL, "last_seen_at": timedelta(minutes=2)}
    found = dedup.dedup_multi_entry(
        frame(spark, rows), "k", "v", "ts", ttls, "id", hot_rows=hot_rows
    )
    want, kept = {}, brute.on_change(rows, 5 * MIN)
    for group in brute.by_key([r for r in rows if r[0] in kept]):
        for last, (i, _, _, ts) in zip([None, *group], group):
            live = last is not None and ts < last[3] + 2 * MIN
            want[i] = last[3] if live else None
    assert {r["id"]: r["previous_seen_at"] for r in found.collect()} == want


def test_multi_entry_clocks_are_separate(spark):
    rows = [(0, "a", "ON", 0), (1, "a", "OFF", MIN), (2, "a", "ON", 4 * MIN)]
    ttls = {"last_status": TTL, "last_seen_at": timedelta(minutes=2)}
    found = dedup.dedup_multi_entry(frame(spark, rows), "k", "v", "ts", ttls, "id")
    assert {(r["id"], r["previous_seen_at"]) for r in found.collect()} == {
        (0, None), (1, 0), (2, None)
    }


def test_mixed_entries(spark):
    rows = [(0, "a", "ON", 0), (1, "a", "OFF", MIN), (2, "a", "ON", 6 * MIN)]
    found = dedup.mixed_entries(frame(spark, rows), "k", "v", "ts", TTL, "id")
    assert {(r["id"], r["first_at"], r["recent_value"]) for r in found.collect()} == {
        (0, None, None), (1, 0, "ON"), (2, 0, None)
    }


def test_toggle_by_key(spark):
    rows = [
        (0, "window_open_ON", 0),
        (1, "window_open_OFF", MIN),
        (2, "window_open_OFF", 2 * MIN),
        (3, "abc", 0),
        (4, "a_", 0),
    ]
    df = spark.createDataFrame(rows, "id int, key string, ts bigint")
    found = dedup.toggle_by_key(df, "key", "ts", TTL, "id").collect()
    assert {(r["id"], r["_entity"], r["_status"]) for r in found} == {
        (0, "window_open", "ON"), (1, "window_open", "OFF"), (3, "", "abc"), (4, "a", "")
    }


def test_emitted_keys(spark):
    df = frame(spark, brute.skewed_rows())
    assert dedup.emitted_keys(df.na.fill("none", ["k"]), "k").first()["session_seen"] == 4
    sketch = dedup.emitted_keys(df.na.fill("none", ["k"]), "k", approximate=True)
    assert sketch.first()["session_seen"] == 4


def test_keys_over_runs(spark, tmp_path):
    """Runs overlap, one is repeated and one is empty: a key counts once, and the estimate is within its error."""
    table = str(tmp_path / "keys")
    runs = {run: spark.range(lo, hi).selectExpr("cast(id as string) k") for run, (lo, hi) in enumerate([(0, 30_000), (20_000, 50_000), (0, 0)])}
    for run in (0, 1, 1, 2):
        dedup.record_keys(runs[run], "k", table, run)
    stored = spark.read.parquet(table)
    assert stored.count() == 3
    assert abs(dedup.merged_keys(stored).first()["session_seen"] - 50_000) <= 50_000 * dedup.sketch_error()
    each = {r["run"]: r["session_seen"] for r in dedup.merged_keys(stored, "run").collect()}
    assert each[2] == 0 and all(abs(each[r] - 30_000) <= 30_000 * dedup.sketch_error() for r in (0, 1))
    pairs = spark.createDataFrame([(None, "a"), ("a", None), ("a", "a"), ("a", None)], "k string, l string")
    assert dedup.merged_keys(dedup.key_sketches(pairs, ["k", "l"])).first()["session_seen"] == 3
    few = spark.createDataFrame([(None,), (None,), ("a",)], "k string")
    assert dedup.merged_keys(dedup.key_sketches(few, "k")).first()["session_seen"] == 2
    assert dedup.merged_keys(dedup.key_sketches(few.limit(0), "k")).first()["session_seen"] == 0


def test_keys_over_micro_batches(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "keys")
    for part in range(3):
        spark.range(part * 400, part * 400 + 1000).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        stream.writeStream.foreachBatch(lambda rows, batch: dedup.record_keys(rows, "id", table, batch))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(120)
    stored = spark.read.parquet(table)
    assert stored.count() > 1
    assert abs(dedup.merged_keys(stored).first()["session_seen"] - 1800) <= 1800 * dedup.sketch_error()


def test_jobs_of_a_chain_do_not_grow_with_its_chunks(spark):
    def jobs(n):
        group = f"chain-{n}"
        spark.sparkContext.setJobGroup(group, group)
        rows = [(i, "hot", "ON", i * 1000) for i in range(n)]
        assert on_change(spark, rows, ttl=7_500, hot_rows=16) == brute.on_change(rows, 7_500)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = jobs(60), jobs(480)  # 16 and 121 chunks: 3 more levels of the tree
    assert many - few < 60


def test_hops_are_the_row_by_row_rule():
    rng = random.Random(8)
    for _ in range(300):
        n, ttl = rng.randint(1, 40), rng.randint(1, 9)
        own = [rng.randint(0, 60) for _ in range(n)]
        clock = list(itertools.accumulate(own, max))
        null = [rng.random() < 0.3 for _ in range(n)]
        deadline = start = rng.randint(0, 30)
        want = []
        for c, o, missing in zip(clock, own, null):
            want.append(c < deadline if missing else c >= deadline)
            if not missing and c >= deadline:
                deadline = o + ttl
        cut = rng.randint(0, n)
        got, at = [], start
        for a, b in ((0, cut), (cut, n)):  # as it comes in two batches
            hit, at = dedup.hops(np.array(clock[a:b], dtype=np.int64), np.array(own[a:b], dtype=np.int64), np.array(null[a:b], dtype=bool), at, ttl)
            got += hit.tolist()
        assert got == want and at == deadline


def test_long_segments_of_wide_rows(spark):
    """One key, one value, a kilobyte a row: the fold keeps no rows."""
    rows = spark.range(20_000).select(F.lit(1).alias("k"), F.lit("ON").alias("status"), (F.col("id") * 10).alias("ts"), "id", F.repeat(F.lit("x"), 1000).alias("pad"))
    got = dedup.dedup_on_change_ttl(rows, "k", "status", "ts", 1000, "id")
    plan = got._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    assert sorted(r["ts"] for r in got.select("ts", "pad").collect()) == list(range(0, 200_000, 1000))
