"""Keys, padding, epoch milliseconds and calendar columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The entity is everything before the last underscore; without one it is empty.
LAST_UNDERSCORE = r"(?s)^(?:(.*)_)?([^_]*)$"

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS


def split_key(df: DataFrame, raw_key: str, entity: str, status: str) -> DataFrame:
    """Split `raw_key` (string or bytes) on its last underscore into `entity` and `status`."""
    text = F.col(raw_key).cast("string")
    return df.withColumns(
        {
            entity: F.regexp_extract(text, LAST_UNDERSCORE, 1),
            status: F.regexp_extract(text, LAST_UNDERSCORE, 2),
        }
    )


def order_id(number: Column) -> Column:
    """`order-` and the number padded to seven digits; longer numbers are kept whole."""
    return F.format_string("order-%07d", number)


def event_key(entity: Column, status: Column) -> Column:
    return F.concat_ws("-", entity, status)


def slot_key(sequence: Column, slots: int) -> Column:
    """`key-{sequence mod slots}`."""
    return F.concat(F.lit("key-"), F.pmod(sequence, F.lit(slots)).cast("string"))


def padding(size: int) -> Column:
    return F.repeat(F.lit("x"), size)


def to_millis(moment: Column) -> Column:
    """Epoch milliseconds of a timestamp, with or without time zone (session zone UTC)."""
    return F.unix_millis(moment.cast("timestamp"))


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def calendar(df: DataFrame, ts: str) -> DataFrame:
    """Add `year`, `month`, `day`, `hour` of the epoch-millisecond column as zero-padded strings."""
    moment = F.timestamp_millis(F.col(ts))
    return df.withColumns(
        {
            "year": F.date_format(moment, "yyyy"),
            "month": F.date_format(moment, "MM"),
            "day": F.date_format(moment, "dd"),
            "hour": F.date_format(moment, "HH"),
        }
    )


def expiry_bucket(expires_at: Column, now_ms: int | Column) -> Column:
    """expired / lt_1h / h1_24 / gt_24h / never, for rows that carry a stamp."""
    left = expires_at - now_ms
    return (
        F.when(expires_at.isNull(), "never")
        .when(left <= 0, "expired")
        .when(left < HOUR_MS, "lt_1h")
        .when(left < DAY_MS, "h1_24")
        .otherwise("gt_24h")
    )
