"""A user's own stateful callback per key, in batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from emberkey.operators.dedup import Cols, Duration
from emberkey.operators.ordered import CHUNK, Lane, as_list, over_lanes
from emberkey.session import millis

PLAIN = (str, bool, int, float, type(None))


def _as_json(value: Any) -> Any:
    return value if type(value) in PLAIN else json.loads(json.dumps(value))


# (row, key, timestamp in ms, state) -> rows to emit
Callback = Callable[[dict, tuple, int, "State"], Iterable[dict]]


class State:
    """Named entries of one key. An entry set with a ttl is gone once the clock reaches its deadline."""

    def __init__(self, text: str | None = None, clock: int | None = None):
        self.entries: dict[str, list] = json.loads(text) if text else {}
        self.clock = clock
        self.now: int | None = None

    def at(self, ts: int) -> State:
        """Handle the record with this time: moves the clock, which never goes back."""
        self.now = ts
        self.clock = ts if self.clock is None else max(self.clock, ts)
        return self

    def get(self, name: str, default: Any = None) -> Any:
        value, deadline = self.entries.get(name, (None, None))
        if name not in self.entries or (deadline is not None and self.clock >= deadline):
            return default
        # A copy: what a callback does to it counts once it is set.
        return _as_json(value)

    def set(self, name: str, value: Any, ttl: Duration | None = None) -> None:
        """Store JSON-like `value`; without `ttl` it never expires.

        Kept is what JSON makes of it (keys of objects are text, tuples are lists), in batch as in streams.
        """
        self.entries[name] = [_as_json(value), None if ttl is None else self.now + millis(ttl)]

    def delete(self, name: str) -> None:
        self.entries.pop(name, None)

    def last_deadline(self) -> int | None:
        """When the last entry expires; None if one never does or there is none."""
        deadlines = [d for _, d in self.entries.values()]
        return None if not deadlines or None in deadlines else max(deadlines)

    def dumps(self) -> str:
        return json.dumps(self.entries)


def keyed_process(
    df: DataFrame,
    key: Cols,
    fn: Callback,
    schema: T.StructType | str,
    ts: str,
    order: Cols,
    max_ttl: Duration | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Run `fn(row, key, timestamp, state)` over each key's rows in `order`; emit what it yields.

    Rows stream through the task sorted, in Arrow batches, so a key is never held as a whole. A callback
    may depend on everything before it, so a key is one sequence of work; give `max_ttl`, the longest
    ttl `fn` ever sets (and no entry without one), to let long keys be cut wherever the rows pause
    for that long, since no state outlives such a pause.
    """
    keys, order = as_list(key), as_list(order)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(schema)
    scope, extra = keys, []
    if max_ttl is not None:
        gap = millis(max_ttl)

        def cut(rows: DataFrame, lane: Lane) -> DataFrame:
            if not lane.chunked:
                return rows.withColumn("__piece", F.lit(0))
            rows = lane.running(rows, "__clock", F.col(ts), F.max)
            rows = lane.previous(rows, "__prev", {"c": F.col("__clock")})
            fresh = F.coalesce(F.col("__clock") - F.col("__prev.c") >= gap, F.lit(True))
            rows = lane.last(rows, "__piece", F.when(fresh, F.col(CHUNK)))
            return rows.drop("__clock", "__prev")

        df = over_lanes(df, keys, order, cut, hot_rows)
        # A piece is named by the chunk it starts in; several in one group are still apart in time.
        scope, extra = [*keys, "__piece"], ["__piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, State()
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                group = tuple(row[c] for c in scope)
                if group != current:
                    current, state = group, State()
                for c in extra:
                    del row[c]
                when = row[ts]
                out.extend(fn(row, group[: len(keys)], when, state.at(when)) or ())
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return (
        df.repartition(*scope).sortWithinPartitions(*scope, *order).mapInArrow(run, schema)
    )
