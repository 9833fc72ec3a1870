"""Streams give what the batch operators give: in one batch, in many, over a restart."""

import json
import os
import time

import brute
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberkey.operators import counters, dedup
from emberkey.sources import topics
from emberkey.streaming import callbacks, processor, runner

MIN = brute.MIN
SCHEMA = "id int, k string, v string, ts bigint"


def feed(folder, rows, part):
    """One JSON file per micro-batch, in order."""
    path = os.path.join(folder, f"{part:04d}.json")
    with open(path + ".tmp", "w") as out:
        for row in rows:
            out.write(json.dumps(dict(zip(("id", "k", "v", "ts"), row))) + "\n")
    stamp = time.time() - 1000 + part
    os.utime(path + ".tmp", (stamp, stamp))
    os.rename(path + ".tmp", path)


def source(spark, folder):
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
    return reader.option("pathGlobFilter", "*.json").json(str(folder))


def stream(spark, folder, fn, extra="", **options):
    return processor.keyed_process_stream(
        source(spark, folder), "k", fn, SCHEMA + extra, "ts", ["ts", "id"], **options
    )


def split(rows, parts):
    size = -(-len(rows) // parts)
    return [rows[i * size : (i + 1) * size] for i in range(parts)]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_change_filter_equals_batch(spark, tmp_path, parts):
    rows = brute.skewed_rows(120)
    for n, piece in enumerate(split(rows, parts)):
        feed(tmp_path, piece, n)
    out = runner.run_available(stream(spark, tmp_path, callbacks.on_change("v", 5 * MIN)))
    batch = dedup.dedup_on_change_ttl(
        spark.createDataFrame(rows, SCHEMA), "k", "v", "ts", 5 * MIN, "id"
    )
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_state_survives_a_restart(spark, tmp_path):
    rows = brute.skewed_rows(120)
    first, second = split(rows, 2)
    inbox = tmp_path / "in"
    inbox.mkdir()
    paths = {"path": str(tmp_path / "out"), "checkpoint": str(tmp_path / "ck")}
    fn = callbacks.count_up(5 * MIN)
    feed(inbox, first, 0)
    runner.run_available(stream(spark, inbox, fn, ", count bigint"), **paths)
    feed(inbox, second, 1)
    out = runner.run_available(stream(spark, inbox, fn, ", count bigint"), **paths)
    batch = counters.counter_ttl(spark.createDataFrame(rows, SCHEMA), "k", "ts", 5 * MIN, "id")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    assert processor.store_rows(spark, paths["checkpoint"]).count() == 4


def test_late_rows_are_handled_in_arrival_order(spark, tmp_path):
    rows = brute.skewed_rows(60)
    late = [(i, k, v, ts - (i % 5) * 2 * MIN) for i, k, v, ts in rows]
    for n, piece in enumerate(split(late, 60)):
        if n < 12:
            feed(tmp_path, piece, n)
    out = runner.run_available(stream(spark, tmp_path, callbacks.on_change("v", 5 * MIN)))
    want = brute.on_change(late[:12], 5 * MIN, clock_by="arrival")
    assert {r["id"] for r in out.collect()} == want


def test_eviction_keeps_results_and_empties_the_store(spark, tmp_path):
    start = 1_700_000_000_000
    rows = [(i, f"k{i % 3}", "ON", start + i * MIN) for i in range(30)]
    rows += [(n, "last", "ON", start + (10_000 + n) * MIN) for n in (100, 101)]
    inbox = tmp_path / "in"
    inbox.mkdir()
    for n, piece in enumerate([rows[:30], rows[30:31], rows[31:]]):
        feed(inbox, piece, n)
    checkpoint = str(tmp_path / "ck")
    out = runner.run_available(
        stream(
            spark, inbox, callbacks.on_change("v", 5 * MIN), eviction="event_time",
            late_tolerance=MIN,
        ),
        checkpoint=checkpoint,
    )
    assert {r["id"] for r in out.collect()} == brute.on_change(rows, 5 * MIN)
    assert processor.store_rows(spark, checkpoint).count() == 1


def test_bad_eviction_settings_are_refused(spark, tmp_path):
    for options in ({"eviction": "sometimes"}, {"eviction": "event_time"}):
        with pytest.raises(ValueError):
            stream(spark, tmp_path, callbacks.once(), **options)


def test_first_seen_stream(spark, tmp_path):
    for n, piece in enumerate(split(brute.skewed_rows(60), 3)):
        feed(tmp_path, piece, n)
    out = runner.run_available(processor.first_seen_stream(source(spark, tmp_path), "k"))
    assert sorted(str(r["k"]) for r in out.collect()) == ["None", "a", "b", "hot"]


def test_side_output_never_stops_the_stream(spark, tmp_path):
    inbox, kept, metrics = tmp_path / "in", str(tmp_path / "kept"), str(tmp_path / "metrics")
    inbox.mkdir()
    for n, piece in enumerate(split(brute.skewed_rows(40), 2)):
        feed(inbox, piece, n)

    def main(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{kept}/batch={batch_id}")

    def measure(batch, batch_id):
        if batch_id == 1:
            raise RuntimeError("no metrics today")
        return batch.groupBy("k").count()

    query = (
        source(spark, inbox)
        .writeStream.foreachBatch(topics.with_side_output(main, measure, metrics))
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    runner.await_end(query, 300)
    assert spark.read.parquet(kept).count() == 40
    assert spark.read.parquet(metrics).select("batch").distinct().count() == 1


def test_store_stats(spark, tmp_path):
    feed(tmp_path, brute.skewed_rows(40), 0)
    query = (
        stream(spark, tmp_path, callbacks.upsert("v", 4))
        .writeStream.format("noop")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    runner.await_end(query, 300)
    stats = runner.store_stats(query)
    assert len(stats) == 1 and stats[0]["est_keys"] == 4


def test_odd_column_names_and_nullable_numbers(spark, tmp_path):
    """Names that are no identifiers, and whole numbers next to nulls, come through unchanged."""
    big = 2**53

    def echo(row, key, ts, state):
        before = state.get("n")
        state.set("n", row["n"])
        yield {**row, "before": before}

    rows = [("a", 1, 0, "x"), ("a", None, 1, "y"), ("a", big, 2, None)]
    schema = "k string, n bigint, ts bigint, __key string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    df = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = processor.keyed_process_stream(
        df, "k", echo, schema + ", before bigint", "ts", "ts"
    )
    got = {tuple(r) for r in runner.run_available(out).collect()}
    assert got == {("a", 1, 0, "x", None), ("a", None, 1, "y", 1), ("a", big, 2, None, None)}


def test_large_numbers_beside_nulls_stay_exact(spark, tmp_path):
    big = 2**53 + 1
    rows = [("k", 1, big), ("k", 2, None), ("k", 3, big + 2)]
    spark.createDataFrame(rows, "k string, at bigint, v bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, at bigint, v bigint").parquet(str(tmp_path / "in"))

    def same(row, key, timestamp, state):
        yield row

    out = processor.keyed_process_stream(stream, "k", same, stream.schema, ts="at", order="at")
    got = runner.run_available(out)
    assert sorted((r["at"], r["v"]) for r in got.collect()) == [(1, big), (2, None), (3, big + 2)]


def test_state_is_alike_in_batch_and_stream(spark, tmp_path):
    """Objects with number keys, tuples, objects changed in place, and nulls in an order column."""
    from emberkey.operators.process import keyed_process

    def step(row, key, ts, state):
        held = state.get("held", {})
        held.setdefault("seen", []).append(row["id"])  # not set, so forgotten
        known = state.get("by_number", {})
        state.set("by_number", {row["id"]: (ts, None)})
        yield {"id": row["id"], "text": repr(known) + repr(state.get("held"))}

    schema = "id bigint, text string"
    rows = spark.createDataFrame([(1, 5, 10, None), (1, 6, 10, 3), (1, 7, 20, None), (2, 8, 5, 1), (1, 9, 20, 2)], "k int, id bigint, ts bigint, part int")
    inbox = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(inbox)
    batch = keyed_process(rows, "k", step, schema, "ts", ["ts", "part"])
    stream = processor.keyed_process_stream(spark.readStream.schema(rows.schema).parquet(inbox), "k", step, schema, "ts", ["ts", "part"])
    got = runner.run_available(stream)
    want = sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, got.collect())) == want
    assert want[0] == (5, "{}None") and want[1] == (6, "{'5': [10, None]}None") and want[2] == (7, "{'6': [10, None]}None")


def test_seeded_stream_keeps_its_state_over_restarts(spark, tmp_path):
    schema = "k string, v string, ts bigint, id bigint"
    state = spark.createDataFrame(
        [(0, "a", ("ON",), True, 100), (0, "b", ("ON",), True, None), (0, "c", ("ON",), False, None), (0, "gone", ("ON",), True, 5)],
        "partition int, key string, value struct<status:string>, stamped boolean, expires_at_ms bigint",
    )
    initial = processor.seed_entries(state, {"k": F.col("key")}, "entry", F.col("value.status"))
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    batches = [
        [("a", "ON", 99, 1), ("b", "ON", 10**9, 2), ("c", "ON", 10**9, 3), ("d", "ON", 7, 4), ("gone", "ON", 6, 5)],
        [("a", "ON", 100, 6), ("b", "OFF", 10**9 + 1, 7), ("d", "ON", 8, 8), ("c", "ON", 10**9, 9)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = processor.keyed_process_stream(
            spark.readStream.schema(schema).parquet(inbox), "k", callbacks.on_change("v", 1000), schema, "ts", ["ts", "id"], initial=initial
        )
        got = runner.run_available(stream, out, checkpoint)
    assert sorted(r["id"] for r in got.collect()) == [4, 5, 6, 7]


def test_processor_works_on_plain_rows():
    """No frame for each key: rows come and go as rows, and a key's entries come one by one."""

    class Held:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    schema = T._parse_datatype_string("k string, v bigint, at bigint")
    made = processor.CallbackProcessor(callbacks.on_change("v"), schema, "at", ["at"], schema.fieldNames(), False)
    made.store = Held()
    seed = Row(*processor.SEED)
    made.handleInitialState(("a",), seed("entry", '{"v": 1}', None), None)
    made.handleInitialState(("a",), seed("other", '{"v": 2}', "90"), None)
    rows = Row("k", "v", "at")
    out = made.handleInputRows(("a",), iter([rows("a", 3, 8), rows("a", None, 7), rows("a", 1, 6)]), None)
    assert [tuple(r) for r in out] == [("a", None, 7), ("a", 3, 8)]
    state, clock = made.store.value
    assert clock == 8 and '"other"' in state
