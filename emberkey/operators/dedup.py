"""Change-only and first-seen filters over keyed state, with and without expiry."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberkey.functions.keys import split_key
from emberkey.operators.carry import carried_deadlines, null_safe_join
from emberkey.operators.ordered import CHUNK, Body, Lane, as_list, over_lanes
from emberkey.session import millis

Cols = str | Sequence[str]
Duration = timedelta | int


def processing_order(ts: str, tiebreak: Cols, order_by: Cols | None) -> list[str]:
    """Columns that fix the order in which a key's rows are handled; must be unique per key."""
    return as_list(order_by) if order_by else [ts, *as_list(tiebreak)]


def with_clock(df: DataFrame, lane: Lane, ts: str, order_by: Cols | None) -> DataFrame:
    """Event-time clock of the key: the running maximum of `ts` in processing order."""
    if order_by is None:
        return df.withColumn("__clock", F.col(ts))
    return lane.running(df, "__clock", F.col(ts), F.max)


def dedup_on_change(
    df: DataFrame, key: Cols, value: str, order: Cols, hot_rows: int | None = None
) -> DataFrame:
    """Rows whose value differs from the key's last stored value; nothing expires.

    A key starts out with no stored value, which reads as null.
    """

    def body(rows: DataFrame, lane: Lane) -> DataFrame:
        rows = lane.previous(rows, "__prev", {"v": F.col(value)})
        return rows.filter(~F.col("__prev.v").eqNullSafe(F.col(value))).drop("__prev")

    return over_lanes(df, key, order, body, hot_rows)


def dedup_on_change_ttl(
    df: DataFrame,
    key: Cols,
    value: str,
    ts: str,
    ttl: Duration,
    tiebreak: Cols = (),
    order_by: Cols | None = None,
    refresh: str = "on_emit",
    hot_rows: int | None = None,
) -> DataFrame:
    """Rows whose value changed, or whose stored entry has expired at the row's time.

    `ts` is epoch milliseconds. With ``refresh="on_emit"`` only an emitted row restarts the clock;
    with ``"on_seen"`` every row does. An entry is expired from its deadline on (`clock >= deadline`).
    """
    ttl_ms = millis(ttl)
    if refresh == "on_seen":
        body = _on_seen(value, ts, ttl_ms, order_by)
    elif refresh == "on_emit":
        body = on_emit(value, ts, ttl_ms, order_by)
    else:
        raise ValueError(f"refresh must be 'on_emit' or 'on_seen', got {refresh!r}")
    return over_lanes(df, key, processing_order(ts, tiebreak, order_by), body, hot_rows)


def on_emit(value: str, ts: str, ttl_ms: int, order_by: Cols | None = None) -> Body:
    """The filter of `dedup_on_change_ttl` for one lane, to be chained with others."""

    def body(rows: DataFrame, lane: Lane) -> DataFrame:
        columns = rows.columns
        marked = _mark_segments(rows, lane, value, ts, ttl_ms, order_by)
        starts = marked.filter("__start")
        # Inside a segment nothing can emit before the first deadline; the rest is folded.
        later = marked.filter(
            ~F.col("__start")
            & F.col("__seg").isNotNull()
            & (F.col(value).isNull() | (F.col("__clock") >= F.col("__seg.own") + ttl_ms))
        )
        folded = _fold_segments(later, lane, value, ts, ttl_ms, columns)
        return starts.select(*columns).unionByName(folded)

    return body


def _on_seen(value: str, ts: str, ttl_ms: int, order_by: Cols | None) -> Body:
    def body(rows: DataFrame, lane: Lane) -> DataFrame:
        rows = with_clock(rows, lane, ts, order_by)
        rows = lane.previous(rows, "__prev", {"v": F.col(value), "own": F.col(ts)})
        live = F.when(F.col("__clock") < F.col("__prev.own") + ttl_ms, F.col("__prev.v"))
        return rows.filter(~live.eqNullSafe(F.col(value))).drop("__prev", "__clock")

    return body


def _mark_segments(
    rows: DataFrame, lane: Lane, value: str, ts: str, ttl_ms: int, order_by: Cols | None
) -> DataFrame:
    """Cut each key's rows into segments whose first row emits whatever came before it.

    A segment starts where a non-null value differs from the row before, or where the clock moved a
    whole ttl since that row. `__seg` identifies the start row. Of a run of nulls only the first row
    is kept and stays with the segment before it: it emits while that segment's entry is live.
    """
    rows = with_clock(rows, lane, ts, order_by)
    rows = lane.previous(rows, "__prev", {"v": F.col(value), "c": F.col("__clock")})
    rows = rows.filter(F.col(value).isNotNull() | F.col("__prev.v").isNotNull())
    start = F.col(value).isNotNull() & (
        ~F.col("__prev.v").eqNullSafe(F.col(value))
        | F.coalesce(F.col("__clock") - F.col("__prev.c") >= ttl_ms, F.lit(True))
    )
    rows = rows.withColumn("__start", start)
    origin = [F.col(ts).alias("own"), F.struct(*lane.order).alias("at")]
    if lane.chunked:
        origin.append(F.col(CHUNK).alias("chunk"))
    return lane.last(rows, "__seg", F.when(F.col("__start"), F.struct(*origin)))


def _fold_segments(
    rows: DataFrame,
    lane: Lane,
    value: str,
    ts: str,
    ttl_ms: int,
    columns: list[str],
) -> DataFrame:
    """Rows of `rows` that find the segment's entry expired (or, for nulls, live).

    A segment's rows pass sorted through one task in Arrow batches, as they are, and only the deadline is
    kept between batches, so neither wide rows nor long segments take memory.
    """
    scope = [*lane.scope, "__seg"]
    rows = rows.withColumn("__deadline", F.col("__seg.own") + ttl_ms)
    if lane.chunked:
        known = carried_deadlines(rows, lane, ts, ttl_ms, value)
        if known is not None:
            rows = null_safe_join(rows, known, [*lane.keys, "__seg", CHUNK], "left")
            rows = rows.withColumn("__deadline", F.coalesce("__known", "__deadline"))
    work = ["__new", "__null", "__clock", "__own", "__deadline"]
    clock = F.col("__clock").cast("bigint")
    rows = rows.withColumns(
        {"__null": F.col(value).isNull(), "__clock": clock, "__own": F.coalesce(F.col(ts).cast("bigint"), clock)}
    )
    rows = rows.filter(F.col("__clock").isNotNull() & F.col("__deadline").isNotNull())  # others never emit
    # This window also puts the rows of a segment next to each other, in order.
    rows = rows.withColumn("__new", F.row_number().over(Window.partitionBy(*scope).orderBy(*lane.order)) == 1)
    wide = rows.select(*[F.col(c) for c in columns], *work)
    schema = wide.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deadline = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new, null, clock, own, given = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in work)
            cuts = np.flatnonzero(new)
            hit = np.zeros(len(new), dtype=bool)
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(new)), strict=True):
                if a == b:
                    continue
                if new[a]:
                    deadline = int(given[a])
                hit[a:b], deadline = hops(clock[a:b], own[a:b], null[a:b], deadline, ttl_ms)
            yield pa.RecordBatch.from_arrays(batch.columns[: len(columns)], names=columns).filter(pa.array(hit))

    return wide.mapInArrow(run, schema)


def hops(clock: np.ndarray, own: np.ndarray, null: np.ndarray, deadline: int, ttl_ms: int) -> tuple[np.ndarray, int]:
    """Which rows of one segment emit, and the deadline after them.

    The clock never falls, so the next row that finds the entry expired is found by bisection.
    """
    hit = np.zeros(len(clock), dtype=bool)
    full = np.flatnonzero(~null)
    at = 0
    while at < len(clock):
        expired = int(np.searchsorted(clock[at:], deadline)) + at
        hit[at:expired] = null[at:expired]  # nulls pass while the entry is live
        k = int(np.searchsorted(full, expired))
        if k == len(full):
            return hit, deadline
        at = int(full[k])
        hit[at] = True
        deadline = int(own[at]) + ttl_ms
        at += 1
    return hit, deadline


def first_seen(df: DataFrame, key: Cols, order: Cols) -> DataFrame:
    """The first row of each key, once for ever. Pre-aggregates, so a hot key costs nothing extra."""
    keys, order = as_list(key), as_list(order)
    packed = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__row")
    return df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(packed).select("__row.*")


def first_seen_ttl(
    df: DataFrame,
    key: Cols,
    ts: str,
    ttl: Duration,
    tiebreak: Cols = (),
    order_by: Cols | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """A key's first row, and again each row that comes a whole ttl after the last emitted one."""
    marked = df.withColumn("__seen", F.lit(True))
    return dedup_on_change_ttl(
        marked, key, "__seen", ts, ttl, tiebreak, order_by, hot_rows=hot_rows
    ).drop("__seen")


def dedup_multi_entry(
    df: DataFrame,
    key: Cols,
    value: str,
    ts: str,
    ttls: dict[str, Duration],
    tiebreak: Cols = (),
    hot_rows: int | None = None,
) -> DataFrame:
    """Change-only rows under two entries, `last_status` and `last_seen_at`, each with its own ttl.

    Both are written when a row is emitted. `previous_seen_at` is what `last_seen_at` held, as seen
    by the emitted row: null when it was never set or has expired.
    """
    changed = on_emit(value, ts, millis(ttls["last_status"]))
    seen_ms = millis(ttls["last_seen_at"])

    def body(rows: DataFrame, lane: Lane) -> DataFrame:
        rows = lane.previous(changed(rows, lane), "__prev", {"own": F.col(ts)})
        live = F.col(ts) < F.col("__prev.own") + seen_ms
        return rows.withColumn("previous_seen_at", F.when(live, F.col("__prev.own"))).drop("__prev")

    return over_lanes(df, key, processing_order(ts, tiebreak, None), body, hot_rows)


def toggle_by_key(
    df: DataFrame,
    raw_key: str,
    ts: str,
    ttl: Duration,
    tiebreak: Cols = (),
    hot_rows: int | None = None,
) -> DataFrame:
    """Change-only rows where the status is the last `_` part of the key and the rest the entity."""
    split = split_key(df, raw_key, "_entity", "_status")
    return dedup_on_change_ttl(split, "_entity", "_status", ts, ttl, tiebreak, hot_rows=hot_rows)


def mixed_entries(
    df: DataFrame,
    key: Cols,
    value: str,
    ts: str,
    ttl: Duration,
    tiebreak: Cols = (),
    hot_rows: int | None = None,
) -> DataFrame:
    """Every row with two entries read before it is handled: one permanent, one expiring.

    `first_at` is set once per key and never expires; `recent_value` is set by every row with `ttl`.
    """
    ttl_ms = millis(ttl)

    def body(rows: DataFrame, lane: Lane) -> DataFrame:
        rows = lane.previous(rows, "__prev", {"v": F.col(value), "own": F.col(ts)})
        rows = lane.last(rows, "__first", F.when(F.col("__prev").isNull(), F.col(ts)))
        live = F.col(ts) < F.col("__prev.own") + ttl_ms
        return rows.withColumns(
            {
                "first_at": F.when(F.col("__prev").isNotNull(), F.col("__first")),
                "recent_value": F.when(live, F.col("__prev.v")),
            }
        ).drop("__prev", "__first")

    return over_lanes(df, key, processing_order(ts, tiebreak, None), body, hot_rows)


def emitted_keys(df: DataFrame, key: Cols, approximate: bool = False) -> DataFrame:
    """How many distinct keys a run emitted; the sketch avoids the shuffle on the key."""
    packed = F.struct(*as_list(key))
    if approximate:
        return df.agg(F.approx_count_distinct(F.xxhash64(*as_list(key))).alias("session_seen"))
    return df.agg(F.count_distinct(packed).alias("session_seen"))


SKETCH_LOG = 12  # a sketch has 2**12 registers, about 4 KB


def sketch_error(log_registers: int = SKETCH_LOG) -> float:
    """Relative error that an estimate of merged sketches exceeds in about three cases of a thousand."""
    return 3 * 1.04 / 2 ** (log_registers / 2)


def key_sketches(df: DataFrame, key: Cols, by: Cols = (), log_registers: int = SKETCH_LOG) -> DataFrame:
    """A mergeable sketch of the distinct keys for each group `by` (none: one row). Nulls are a key like others."""
    # The hash passes over nulls, so it is told where they are.
    parts = [part for c in as_list(key) for part in (F.col(c), F.col(c).isNull())]
    sketch = F.hll_sketch_agg(F.xxhash64(*parts), log_registers).alias("key_sketch")
    return df.groupBy(*as_list(by)).agg(sketch)


def merged_keys(sketches: DataFrame, by: Cols = ()) -> DataFrame:
    """Estimated distinct keys, `session_seen`, over the sketches of each group `by`: a key in many of them counts once."""
    union = F.hll_union_agg("key_sketch", F.lit(True))
    return sketches.groupBy(*as_list(by)).agg(F.coalesce(F.hll_sketch_estimate(union), F.lit(0)).alias("session_seen"))


def record_keys(df: DataFrame, key: Cols, table: str, run: str | int, log_registers: int = SKETCH_LOG) -> None:
    """Store the key sketch of one run or micro-batch in `table`; a run that is repeated replaces its own row.

    One row of a few KB a run, so keys of all runs are counted without reading what they emitted. For a
    stream, call it in `foreachBatch` with the batch's number.
    """
    found = key_sketches(df, key, log_registers=log_registers)
    found.coalesce(1).write.mode("overwrite").parquet(f"{table}/run={run}")
