"""Per-key counters, for ever or until the key goes quiet for a ttl."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberkey.operators.dedup import Cols, Duration, on_emit, processing_order, with_clock
from emberkey.operators.ordered import Body, Lane, over_lanes
from emberkey.session import millis


def running_count(
    df: DataFrame, key: Cols, order: Cols, name: str = "count", hot_rows: int | None = None
) -> DataFrame:
    """Every row with the number of rows its key has had so far, itself included."""
    return over_lanes(
        df, key, order, lambda rows, lane: lane.running(rows, name, F.lit(1)), hot_rows
    )


def counter_ttl(
    df: DataFrame,
    key: Cols,
    ts: str,
    ttl: Duration,
    tiebreak: Cols = (),
    order_by: Cols | None = None,
    name: str = "count",
    hot_rows: int | None = None,
) -> DataFrame:
    """Every row with a count that each row prolongs by `ttl`; a gap of `ttl` restarts it at 1."""
    body = _count_body(ts, millis(ttl), name, order_by)
    return over_lanes(df, key, processing_order(ts, tiebreak, order_by), body, hot_rows)


def _count_body(ts: str, ttl_ms: int, name: str, order_by: Cols | None = None) -> Body:
    def body(rows: DataFrame, lane: Lane) -> DataFrame:
        rows = with_clock(rows, lane, ts, order_by)
        rows = lane.previous(rows, "__prev", {"own": F.col(ts)})
        rows = lane.running(rows, "__n", F.lit(1))
        restart = F.coalesce(F.col("__clock") >= F.col("__prev.own") + ttl_ms, F.lit(True))
        rows = lane.last(rows, "__from", F.when(restart, F.col("__n")))
        count = (F.col("__n") - F.col("__from") + 1).cast("bigint")
        return rows.withColumn(name, count).drop("__prev", "__n", "__from", "__clock")

    return body


def dedup_then_count(
    df: DataFrame,
    key: Cols,
    value: str,
    ts: str,
    ttl: Duration,
    tiebreak: Cols = (),
    name: str = "count",
    hot_rows: int | None = None,
) -> DataFrame:
    """Change-only rows, each with a counter that only those rows feed, under one ttl."""
    changed, counted = on_emit(value, ts, millis(ttl)), _count_body(ts, millis(ttl), name)

    def body(rows: DataFrame, lane: Lane) -> DataFrame:
        return counted(changed(rows, lane), lane)

    return over_lanes(df, key, processing_order(ts, tiebreak, None), body, hot_rows)
