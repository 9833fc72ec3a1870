"""Callbacks on streams: one processor that keeps a key's entries in Spark's state store."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberkey.operators.dedup import Cols, Duration
from emberkey.operators.ordered import as_list
from emberkey.operators.process import Callback, State
from emberkey.session import ROCKSDB_PROVIDER, millis
from emberkey.streaming.callbacks import cached_lookup

# Entries as JSON with their deadlines, and the key's event-time clock.
STATE_SCHEMA = "entries string, clock_ms bigint"
# One entry to start with: its name, the value as JSON {"v": ...}, and the deadline as text or null.
SEED = ["__entry", "__value", "__deadline"]


def _plain(value: Any) -> Any:
    """A float that is no number counts as null."""
    return None if isinstance(value, float) and value != value else value


class CallbackProcessor(StatefulProcessor):
    def __init__(
        self, fn: Callback, schema: T.StructType, ts: str, order: list[str], names: list[str],
        evict: bool,
    ):
        self.fn, self.columns, self.ts = fn, schema.fieldNames(), ts
        self.order, self.names, self.evict = order, names, evict
        self.made = Row(*names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.store = handle.getValueState("state", STATE_SCHEMA)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        """Called once for each entry. The event-time clock starts with the key's first new record."""
        state = State(*(self.store.get() or (None, None)))
        name, value, deadline = (initialState[c] for c in SEED)
        state.entries[name] = [json.loads(value)["v"], None if deadline is None else int(deadline)]
        self.store.update((state.dumps(), None))
        self._watch(state)

    def _watch(self, state: State) -> None:
        if not self.evict:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if (deadline := state.last_deadline()) is not None:
            self.handle.registerTimer(deadline)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # One key's rows of one micro-batch; their order after the shuffle is not promised.
        batch = [{c: _plain(v) for c, v in zip(self.columns, row)} for row in rows]
        batch.sort(key=lambda row: [(row[c] is not None, row[c]) for c in self.order])  # nulls first
        state = State(*(self.store.get() or (None, None)))
        out: list[dict] = []
        for row in batch:
            when = int(row[self.ts])
            out.extend(self.fn(row, tuple(key), when, state.at(when)) or ())
        self.store.update((state.dumps(), state.clock))
        self._watch(state)
        return (self.made(*(r.get(n) for n in self.names)) for r in out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.store.clear()  # the timer stands at the last deadline, so nothing live is lost
        return iter(())

    def close(self) -> None:
        pass


def keyed_process_stream(
    df: DataFrame,
    key: Cols,
    fn: Callback,
    schema: T.StructType | str,
    ts: str,
    order: Cols,
    eviction: str = "none",
    late_tolerance: Duration | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """`fn(row, key, timestamp, state)` over a stream; the same callback runs in `keyed_process`.

    `order` sorts a key's rows inside a micro-batch; across batches arrival order rules.
    ``eviction="none"`` takes late rows whatever their age, and keeps expired entries in the store.
    ``eviction="event_time"`` deletes a key once its last entry is past its deadline by
    `late_tolerance`; rows later than that are dropped, results for other rows stay the same.
    `initial` (see `seed_entries`) is the state to start with; a checkpoint that has state keeps its own.
    """
    keys, order = as_list(key), as_list(order)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    given = df.schema
    if eviction not in ("none", "event_time"):
        raise ValueError(f"eviction must be 'none' or 'event_time', got {eviction!r}")
    evict = eviction == "event_time"
    if evict:
        if late_tolerance is None:
            raise ValueError("eviction='event_time' needs late_tolerance")
        df = df.withColumn("__event_time", F.timestamp_millis(F.col(ts))).withWatermark(
            "__event_time", f"{millis(late_tolerance)} milliseconds"
        )
    processor = CallbackProcessor(fn, given, ts, order, schema.fieldNames(), evict)
    # Row by row: a pandas frame for each key costs far more than its few rows.
    return df.groupBy(*keys).transformWithState(
        processor,
        schema,
        "append",
        "EventTime" if evict else "None",
        initialState=None if initial is None else initial.groupBy(*keys),
    )


def seed_entries(state: DataFrame, keys: dict[str, Column], entry: str, value: Column) -> DataFrame:
    """Rows of a state table (see `state_table`) as entries that a stream starts with.

    `keys` are the stream's key columns made from the state's, `value` is what the callback keeps under `entry`.
    Legacy rows and rows without a deadline never expire; deadlines stay those of the table.
    Several entries of a key are the union of several calls.
    """
    held = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    deadline = F.when(F.col("stamped"), F.col("expires_at_ms")).cast("string")
    return state.select(
        *[c.alias(k) for k, c in keys.items()],
        F.lit(entry).alias("__entry"),
        held.alias("__value"),
        deadline.alias("__deadline"),
    )


def cached_enrich_stream(
    df: DataFrame,
    versions: DataFrame,
    key: str,
    ts: str,
    ttl: Duration,
    version: str,
    value: str,
    tiebreak: str,
    name: str = "profile",
    **options,
) -> DataFrame:
    """`cached_enrich` on a stream of records and a stream of versions (key, version, value)."""
    records = df.withColumn("__side", F.lit(1))
    news = versions.select(
        key, F.col(version).alias(ts), F.lit(0).alias("__side"), F.col(value).alias("__value")
    )
    both = records.unionByName(news, allowMissingColumns=True)
    both = both.withColumn(tiebreak, F.coalesce(tiebreak, F.lit(0)))
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField(name, versions.schema[value].dataType),
            T.StructField("fetched_at", T.LongType()),
        ]
    )
    step = cached_lookup(ttl, name)
    return keyed_process_stream(both, key, step, schema, ts, [ts, "__side", tiebreak], **options)


def first_seen_stream(df: DataFrame, key: Cols) -> DataFrame:
    """Each key once for ever, on Spark's own operator (stays in the JVM)."""
    return df.dropDuplicates(as_list(key))


def store_rows(spark, checkpoint: str, operator_id: int = 0) -> DataFrame:
    """The entries a query holds, read from its checkpoint with the state-store reader."""
    return (
        spark.read.format("statestore")
        .option("operatorId", operator_id)
        .option("stateVarName", "state")
        .load(checkpoint)
        .select("key", "value", "partition_id")
    )
