"""Topics in and out: JSON records, start positions, lost ranges, side outputs."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from emberkey.operators.carry import null_safe_join

log = logging.getLogger(__name__)
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("timestamp", T.LongType()),
    ]
)


class LostRange(RuntimeError):
    """The committed position is below the source's low watermark and recovery is switched off."""


def topic_options(
    servers: str, topic: str, start: str = "earliest", max_records: int | None = None
) -> dict[str, str]:
    """Options of the kafka source. `start` counts only where the checkpoint has no position yet."""
    if start not in ("earliest", "latest"):
        json.loads(start)  # else per-partition offsets
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": start,
        "includeHeaders": "true",
        "failOnDataLoss": "true",
    }
    if max_records is not None:
        options["maxOffsetsPerTrigger"] = str(max_records)
    return options


def read_topic(
    spark: SparkSession, options: dict[str, str], schema: T.StructType, streaming: bool = True
) -> DataFrame:
    """Records of a topic: the JSON fields, `__key`, `__headers`, position and record time."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    return decode_records(reader.options(**options).load(), schema)


def decode_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of kafka-shaped records; a value that is no JSON of this schema fails the query."""
    value = F.from_json(F.col("value").cast("string"), schema, {"mode": "FAILFAST"})
    headers = ["headers"] if "headers" in records.columns else []
    return records.select(
        value.alias("v"),
        F.col("key").cast("string").alias("__key"),
        "partition",
        "offset",
        F.unix_millis("timestamp").alias("record_ms"),
        *[F.col(h).alias(f"__{h}") for h in headers],
    ).select("v.*", "__key", "partition", "offset", "record_ms", *[f"__{h}" for h in headers])


def encode_records(df: DataFrame, key: Column) -> DataFrame:
    """(key, value) with all columns as one JSON object, the shape the kafka sink takes."""
    return df.select(key.cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_topic(
    df: DataFrame, servers: str, topic: str, key: Column, checkpoint: str | None = None
) -> StreamingQuery | None:
    """To a topic, keyed by `key`; a stream needs `checkpoint`."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic}
    rows = encode_records(df, key)
    if not df.isStreaming:
        rows.write.format("kafka").options(**options).save()
        return None
    return (
        rows.writeStream.format("kafka").options(**options, checkpointLocation=checkpoint).start()
    )


def group_checkpoint(base: str, prefix: str, version: str) -> str:
    """Where a named group keeps its position and state; a new version starts afresh."""
    return f"{base.rstrip('/')}/{prefix}-{version}"


@dataclass(frozen=True)
class Recovery:
    """How to start a query: under which checkpoint and from which position."""

    checkpoint: str
    start: str
    state_dropped: bool


def recover_lost_range(
    committed: dict[int, int],
    low_watermarks: dict[int, int],
    checkpoint: str,
    auto_recover: bool = True,
    offset_reset: str = "earliest",
) -> Recovery:
    """What to do when retention has passed the committed position (`0 <= committed < low`).

    Nothing lost: carry on. Else, without `auto_recover`, raise and leave the state alone; with it,
    give up the state (a new checkpoint) and start at the low (`earliest`) or high (`latest`) end.
    Positions are one number per source partition.
    """
    if offset_reset not in ("earliest", "latest"):
        raise ValueError(f"offset_reset must be 'earliest' or 'latest', got {offset_reset!r}")
    lost = {p: o for p, o in committed.items() if 0 <= o < low_watermarks.get(p, 0)}
    if not lost:
        return Recovery(checkpoint, offset_reset, False)
    if not auto_recover:
        raise LostRange(
            f"committed offsets {lost} are below the low watermarks "
            f"{ {p: low_watermarks[p] for p in lost} }; state cannot be recovered safely"
        )
    mark = "-".join(f"{p}.{low_watermarks[p]}" for p in sorted(lost))
    return Recovery(f"{checkpoint.rstrip('/')}-reset-{mark}", offset_reset, True)


def keep_positions(ends: DataFrame, table: str, checkpoint: str, batch_id: int) -> None:
    """From `foreachBatch`: note the next offset of each partition (partition, offset) that a batch brought.

    One row per partition; a replayed batch writes its folder anew. The newest note of a partition counts.
    """
    at = f"{table}/group={sha256(checkpoint.encode()).hexdigest()[:16]}/batch={batch_id:012d}"
    ends.select(F.col("partition").cast("int"), F.col("offset").cast("bigint")).write.mode("overwrite").parquet(at)


def kept_positions(spark: SparkSession, table: str, checkpoint: str) -> dict[int, int]:
    """The committed positions of a group, as `recover_lost_range` takes them; one number per partition."""
    at = f"{table}/group={sha256(checkpoint.encode()).hexdigest()[:16]}"
    rows = spark.read.schema("partition int, offset bigint, batch bigint").option("basePath", at).parquet(at)
    last = rows.groupBy("partition").agg(F.max_by("offset", "batch").alias("offset"))
    return {r["partition"]: r["offset"] for r in last.collect()}


def lost_positions(committed: DataFrame, lows: DataFrame) -> DataFrame:
    """Positions (topic, partition, offset) that retention has overtaken, with the low watermark."""
    low = lows.select("topic", "partition", F.col("offset").alias("low_watermark"))
    rows = null_safe_join(committed, low, ["topic", "partition"], "inner")
    return rows.filter((F.col("offset") >= 0) & (F.col("offset") < F.col("low_watermark")))


def end_offsets(records: DataFrame, topics: DataFrame) -> DataFrame:
    """Sum over partitions of the end offset of each topic in `topics`; 0 for an absent topic."""
    ends = records.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end"))
    totals = ends.groupBy("topic").agg(F.sum("end").alias("end"))
    return topics.join(totals, "topic", "left").select(
        "topic", F.coalesce("end", F.lit(0)).alias("end_offset")
    )


def with_side_output(
    main: Callable[[DataFrame, int], None],
    metrics: Callable[[DataFrame, int], DataFrame],
    path: str,
) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that also writes metrics rows; those never fail the main flow.

    Each batch overwrites its own folder, so a replayed batch counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        main(batch, batch_id)
        try:
            rows = metrics(batch, batch_id)
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        except Exception as problem:  # reporting must not stop the stream
            log.warning("metrics of batch %s not written: %s", batch_id, problem)

    return write
