"""The built-in stateful operators as callbacks, for streams and for `keyed_process`.

Each is what a user would write by hand: read the entry, compare, set it with a ttl.
"""

from __future__ import annotations

from collections.abc import Iterator

from emberkey.operators.dedup import Duration
from emberkey.operators.process import Callback, State


def on_change(value: str, ttl: Duration | None = None, refresh: str = "on_emit") -> Callback:
    """Pass a row whose value differs from the live stored one."""

    def step(row: dict, key: tuple, ts: int, state: State) -> Iterator[dict]:
        changed = state.get("entry") != row[value]
        if changed or refresh == "on_seen":
            state.set("entry", row[value], ttl)
        if changed:
            yield row

    return step


def once(ttl: Duration | None = None) -> Callback:
    """Pass a row when nothing live says that the key was seen."""

    def step(row: dict, key: tuple, ts: int, state: State) -> Iterator[dict]:
        if not state.get("seen"):
            state.set("seen", True, ttl)
            yield row

    return step


def count_up(ttl: Duration | None = None, name: str = "count") -> Callback:
    """Add a count that every row prolongs."""

    def step(row: dict, key: tuple, ts: int, state: State) -> Iterator[dict]:
        count = state.get("count", 0) + 1
        state.set("count", count, ttl)
        yield {**row, name: count}

    return step


def change_then_count(value: str, ttl: Duration, name: str = "count") -> Callback:
    change, count = on_change(value, ttl), count_up(ttl, name)

    def step(row: dict, key: tuple, ts: int, state: State) -> Iterator[dict]:
        for kept in change(row, key, ts, state):
            yield from count(kept, key, ts, state)

    return step


def multi_entry(value: str, ts_column: str, ttls: dict[str, Duration]) -> Callback:
    def step(row: dict, key: tuple, ts: int, state: State) -> Iterator[dict]:
        if state.get("last_status") == row[value]:
            return
        before = state.get("last_seen_at")
        state.set("last_status", row[value], ttls["last_status"])
        state.set("last_seen_at", row[ts_column], ttls["last_seen_at"])
        yield {**row, "previous_seen_at": before}

    return step


def mixed(value: str, ts_column: str, ttl: Duration) -> Callback:
    def step(row: dict, key: tuple, ts: int, state: State) -> Iterator[dict]:
        first, recent = state.get("first_at"), state.get("recent_value")
        if first is None:
            state.set("first_at", row[ts_column])
        state.set("recent_value", row[value], ttl)
        yield {**row, "first_at": first, "recent_value": recent}

    return step


def upsert(value: str, pad_bytes: int = 0) -> Callback:
    """Keep the latest value per key under one entry and pass every row."""

    def step(row: dict, key: tuple, ts: int, state: State) -> Iterator[dict]:
        state.set("entry", {"status": row[value], "pad": "x" * pad_bytes})
        yield row

    return step


def cached_lookup(ttl: Duration, name: str = "profile") -> Callback:
    """Answer records from a cache that a fetch fills for `ttl`.

    Rows with `__side` 0 carry a new version in `__value`; the others are records. A fetch takes the
    newest version that came before.
    """

    def step(row: dict, key: tuple, ts: int, state: State) -> Iterator[dict]:
        if row["__side"] == 0:
            state.set("version", row["__value"])
            return
        cached = state.get("cached")
        if cached is None and state.get("version") is not None:
            cached = [state.get("version"), ts]
            state.set("cached", cached, ttl)
        value, fetched_at = cached or (None, None)
        yield {**row, name: value, "fetched_at": fetched_at}

    return step
