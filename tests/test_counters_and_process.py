"""Counters, cached enrichment, user callbacks in batch."""

from datetime import timedelta

import brute
import pytest
from pyspark.sql import functions as F

from emberkey.operators import counters, enrich, process
from emberkey.streaming import callbacks

MIN = brute.MIN
TTL = timedelta(minutes=5)
SCHEMA = "id int, k string, v string, ts bigint"


def counted(df):
    return {r["id"]: r["count"] for r in df.collect()}


@pytest.mark.parametrize("hot_rows", [None, 30])
def test_counters(spark, hot_rows):
    rows = brute.skewed_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    running = counters.running_count(df, "k", ["ts", "id"], hot_rows=hot_rows)
    assert counted(running) == brute.counts(rows)
    expiring = counters.counter_ttl(df, "k", "ts", 2 * MIN, "id", hot_rows=hot_rows)
    assert counted(expiring) == brute.counts(rows, 2 * MIN)


def test_counter_restarts_exactly_at_the_gap(spark):
    rows = [(0, "a", "x", 0), (1, "a", "x", 5 * MIN - 1), (2, "a", "x", 10 * MIN - 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert counted(counters.counter_ttl(df, "k", "ts", TTL, "id")) == {0: 1, 1: 2, 2: 1}


@pytest.mark.parametrize("hot_rows", [None, 30])
def test_dedup_then_count(spark, hot_rows):
    rows = brute.skewed_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    kept = brute.on_change(rows, 5 * MIN)
    want = brute.counts([r for r in rows if r[0] in kept], 5 * MIN)
    assert counted(
        counters.dedup_then_count(df, "k", "v", "ts", TTL, "id", hot_rows=hot_rows)
    ) == want


@pytest.mark.parametrize("hot_rows", [None, 4])
def test_cached_enrich(spark, hot_rows):
    rows = [(i, "a", "x", i * MIN) for i in range(10)]
    versions = [("a", 2 * MIN, "p1"), ("a", 4 * MIN, "p2"), ("a", 9 * MIN, "p3")]
    df = spark.createDataFrame(rows, SCHEMA)
    dim = spark.createDataFrame(versions, "k string, version bigint, profile string")
    out = enrich.cached_enrich(
        df, dim, "k", "ts", 3 * MIN, "version", "profile", "id", hot_rows=hot_rows
    )
    got = {r["id"]: (r["profile"], r["fetched_at"]) for r in out.collect()}
    first, second, third = ("p1", 2 * MIN), ("p2", 5 * MIN), ("p2", 8 * MIN)
    assert got == {
        0: (None, None), 1: (None, None), 2: first, 3: first, 4: first,
        5: second, 6: second, 7: second, 8: third, 9: third,
    }


def test_upsert_latest(spark):
    df = spark.createDataFrame(brute.skewed_rows(values=("ON", "OFF")), SCHEMA)
    passed, state = enrich.upsert_latest(df, "k", "v", ["ts", "id"], pad_bytes=5)
    assert passed.count() == 360
    latest = {r[1]: r[2] for r in sorted(brute.skewed_rows(values=("ON", "OFF")), key=lambda r: (r[3], r[0]))}
    assert {r["k"]: r["entry"]["status"] for r in state.collect()} == latest
    assert state.first()["entry"]["pad"] == "xxxxx"


def test_callback_equals_operator(spark):
    rows = brute.skewed_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    out = process.keyed_process(
        df, "k", callbacks.on_change("v", TTL), SCHEMA, "ts", ["ts", "id"]
    )
    assert {r["id"] for r in out.collect()} == brute.on_change(rows, 5 * MIN)


def test_callback_on_a_hot_key_cut_at_pauses(spark):
    rows = [(i, "hot", "x", ts) for i, (_, _, _, ts) in enumerate(brute.skewed_rows(300))]
    df = spark.createDataFrame(rows, SCHEMA)
    out = process.keyed_process(
        df, "k", callbacks.count_up(2 * MIN), SCHEMA + ", count bigint", "ts", ["ts", "id"],
        max_ttl=2 * MIN, hot_rows=40,
    )
    assert counted(out) == brute.counts(rows, 2 * MIN)


def test_callback_sees_exact_values(spark):
    big = 2**60 + 1

    def echo(row, key, ts, state):
        state.set("sum", state.get("sum", 0) + (row["n"] or 0))
        yield {"k": key[0], "n": row["n"], "total": state.get("sum"), "at": row["at"]}

    df = spark.createDataFrame([("a", big, 0), ("a", None, 1)], "k string, n bigint, ts bigint")
    df = df.withColumn("at", F.timestamp_millis("ts"))
    out = process.keyed_process(
        df, "k", echo, "k string, n bigint, total bigint, at timestamp", "ts", "ts"
    )
    assert sorted((r["n"] or 0, r["total"]) for r in out.collect()) == [(0, big), (big, big)]
    assert out.filter("unix_millis(at) in (0, 1)").count() == 2


def test_state_entries():
    state = process.State().at(0)
    state.set("forever", 1)
    state.set("short", 2, ttl=10)
    assert (state.at(9).get("short"), state.last_deadline()) == (2, None)
    assert (state.at(10).get("short"), state.get("forever")) == (None, 1)
    state.delete("forever")
    assert state.last_deadline() == 10
    again = process.State(state.dumps(), state.clock)
    assert again.at(5).get("short", "gone") == "gone"  # the clock does not go back
