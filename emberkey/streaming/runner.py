"""Run a stream to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from emberkey.session import fresh_path


class StreamTimeout(RuntimeError):
    """The stream had not caught up within the time given."""


def await_end(query: StreamingQuery, timeout_s: int | None = None) -> None:
    """Wait until the stream has ended; with a timeout, stop it then and raise."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise StreamTimeout(f"query {query.name or query.id} ran longer than {timeout_s} s")


def run_available(
    stream: DataFrame,
    path: str | None = None,
    checkpoint: str | None = None,
    timeout_s: int | None = None,
) -> DataFrame:
    """Process what the source has now into a parquet table, exactly once, and read the table."""
    spark: SparkSession = stream.sparkSession
    path = path or fresh_path(spark, "stream-out")
    checkpoint = checkpoint or fresh_path(spark, "stream-checkpoint")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    await_end(query, timeout_s)
    return spark.read.schema(stream.schema).parquet(path)


def store_stats(query: StreamingQuery) -> list[dict]:
    """Size of the state per operator after the last batch, from the query's own progress."""
    progress = query.lastProgress
    return [
        {
            "operator": op["operatorName"],
            "bytes": op["memoryUsedBytes"],
            "est_keys": op["numRowsTotal"],
            "dropped_late": op["numRowsDroppedByWatermark"],
        }
        for op in (progress["stateOperators"] if progress else [])
    ]
