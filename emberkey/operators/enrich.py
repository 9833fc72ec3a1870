"""Enrichment from a short-lived cache, and latest-value state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberkey.functions.keys import padding
from emberkey.operators.dedup import Cols, Duration, on_emit
from emberkey.operators.ordered import CHUNK, Lane, as_list, over_lanes
from emberkey.session import millis


def latest_before(
    left: DataFrame,
    right: DataFrame,
    key: Cols,
    left_order: list[str],
    right_order: list[str],
    name: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """Each left row with the latest right row of its key at or before it, as struct `name`.

    The orders pair up by position; where all of them are equal the right row counts as earlier.
    One shuffle of both sides on the key, no join.
    """
    keys = as_list(key)
    slots = [f"__o{i}" for i in range(len(left_order))]
    payload = F.struct(*[c for c in right.columns])
    lefts = left.select(
        *[F.col(c) for c in left.columns],
        *[F.col(c).alias(s) for c, s in zip(left_order, slots)],
        F.lit(1).alias("__side"),
    )
    rights = right.select(
        *keys,
        *[F.col(c).alias(s) for c, s in zip(right_order, slots)],
        F.lit(0).alias("__side"),
        payload.alias("__right"),
    )

    def body(rows: DataFrame, lane: Lane) -> DataFrame:
        return lane.last(rows, name, F.col("__right"))

    both = lefts.unionByName(rights, allowMissingColumns=True)
    joined = over_lanes(both, keys, [*slots, "__side"], body, hot_rows)
    return joined.filter(F.col("__side") == 1).drop("__side", "__right", *slots)


def cached_enrich(
    df: DataFrame,
    dim: DataFrame,
    key: str,
    ts: str,
    ttl: Duration,
    version: str,
    value: str,
    tiebreak: str,
    name: str = "profile",
    hot_rows: int | None = None,
) -> DataFrame:
    """Every row with the key's `value` from `dim`, as cached when it was last fetched.

    A row fetches when nothing is cached or `ttl` has passed since the fetch; a fetch sees the
    newest version in `dim` (columns `key`, `version`, `value`) at or before the row's time. Also
    adds `fetched_at`.

    As in a hand-written callback, a fetch that finds nothing caches nothing, so the next row
    fetches again: each key's rows before its first version are left out of the ttl chain.
    """
    columns = df.columns
    slots = ["__o0", "__o1", "__side"]
    rows = df.select(
        *columns,
        F.col(ts).alias("__o0"),
        F.col(tiebreak).alias("__o1"),
        F.lit(2).alias("__side"),
    )
    # A version's missing tiebreak sorts first, so one at the row's own time counts.
    versions = dim.filter(F.col(value).isNotNull()).select(
        key, F.col(version).alias("__o0"), F.lit(0).alias("__side"), F.col(value).alias("__value")
    )
    refetch = on_emit("__seen", "__o0", millis(ttl))

    def body(both: DataFrame, lane: Lane) -> DataFrame:
        seen = lane.last(both, "__now", F.col("__value")).filter(F.col("__side") == 2)
        narrow = [*lane.scope, *slots]
        found = seen.filter(F.col("__now").isNotNull()).select(
            *narrow, "__now", F.lit(True).alias("__seen")
        )
        # A fetch goes in just before its own row; each row then takes the latest fetch.
        fetches = refetch(found, lane).select(
            *[F.lit(1).alias(c) if c == "__side" else c for c in narrow],
            F.struct(F.col("__now").alias("value"), F.col("__o0").alias("at")).alias("__fetch"),
        )
        merged = seen.drop("__now", "__value").unionByName(fetches, allowMissingColumns=True)
        cached = lane.last(merged, "__cached", F.col("__fetch")).filter(F.col("__side") == 2)
        return cached.select(
            *columns,
            *([CHUNK] if lane.chunked else []),
            F.col("__cached.value").alias(name),
            F.col("__cached.at").alias("fetched_at"),
        )

    both = rows.unionByName(versions, allowMissingColumns=True)
    return over_lanes(both, key, slots, body, hot_rows)


def upsert_latest(
    df: DataFrame, key: Cols, value: str, order: Cols, pad_bytes: int = 0
) -> tuple[DataFrame, DataFrame]:
    """All rows unchanged, and the state they leave: one entry per key with the latest value."""
    entry = F.max_by(F.struct(F.col(value).alias("status")), F.struct(*as_list(order)))
    state = df.groupBy(*as_list(key)).agg(entry.alias("__e"))
    state = state.select(
        *as_list(key), F.struct("__e.status", padding(pad_bytes).alias("pad")).alias("entry")
    )
    return df, state
