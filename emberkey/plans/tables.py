"""The given tables, and the shapes the operators take, derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberkey.functions.keys import HOUR_MS, order_id, to_millis
from emberkey.operators.ordered import Lane, over_lanes

HOUR = HOUR_MS
DAY = 24 * HOUR
JAN_20 = 1705708800000  # 2024-01-20 00:00 UTC
JAN_25 = 1706140800000
JAN_31 = 1706659200000

EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` with its time as epoch milliseconds in `timestamp`."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _timed(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a stream."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    files = (
        spark.readStream.schema(EVENTS_SCHEMA)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    return _timed(files)


def _timed(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id", "user_id", "event_type", "value", to_millis(F.col("ts")).alias("timestamp")
    )


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a state write: errors delete, views are legacy rows, signups never expire."""
    kind = F.col("event_type")
    stamped = ~kind.isin("view", "error")
    return events(spark, sf_dir).select(
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        order_id(F.col("user_id")).alias("key"),
        F.when(kind != "error", F.struct(kind.alias("status"), F.repeat(F.lit("x"), 8).alias("pad")))
        .alias("value"),
        stamped.alias("stamped"),
        F.when(stamped & (kind != "signup"), F.col("timestamp") + 6 * HOUR).alias("expires_at_ms"),
        F.col("timestamp").alias("ts_ms"),
    )


def legacy_store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, meta, writes): the state left by the events before Jan 20, and the writes since.

    Partition 2 is in TTL mode already, the rest is legacy; partition 3 never writes with a ttl.
    """
    rows = events(spark, sf_dir).select(
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        order_id(F.col("user_id")).alias("key"),
        F.struct(F.col("event_type").alias("status"), F.repeat(F.lit("x"), 8).alias("pad")).alias(
            "value"
        ),
        F.col("timestamp").alias("ts_ms"),
        F.col("event_type").alias("__kind"),
    )
    old = rows.filter(F.col("ts_ms") < JAN_20)
    latest = old.groupBy("partition", "key").agg(
        F.max_by(F.struct("value", "ts_ms"), "offset").alias("r")
    )
    done = F.col("partition") == 2
    state = latest.select(
        "partition",
        "key",
        "r.value",
        done.alias("stamped"),
        F.when(done, F.col("r.ts_ms") + 30 * DAY).alias("expires_at_ms"),
    )
    meta = old.groupBy("partition").agg(F.max("ts_ms").alias("high_water_ms")).select(
        "partition", done.alias("ttl_enabled"), done.alias("migration_done"), "high_water_ms"
    )
    ttl = F.when(F.col("__kind") == "purchase", 3 * DAY).when(F.col("__kind") == "click", DAY)
    writes = rows.filter(F.col("ts_ms") >= JAN_20).withColumn(
        "ttl_ms", F.when(F.col("partition") != 3, ttl).cast("bigint")
    )
    return state, meta, writes.drop("__kind")


def churn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(actions, samples, lines) of two deployments; a cycle is a day, signups are the actions.

    The high-water of a deployment is the number of its purchases so far.
    """
    rows = events(spark, sf_dir).select(
        F.when(F.col("user_id") % 2 == 0, "feature").otherwise("stable").alias("deployment"),
        F.col("timestamp").alias("ts_ms"),
        "event_id",
        "event_type",
        "user_id",
    )
    actions = rows.filter(F.col("event_type") == "signup").select(
        "deployment", F.floor(F.col("ts_ms") / DAY).cast("int").alias("cycle"), "ts_ms"
    )
    bought = F.when(F.col("event_type") == "purchase", 1).otherwise(0)

    def count(part: DataFrame, lane: Lane) -> DataFrame:
        return lane.running(part, "hwm", bought)

    samples = over_lanes(rows, "deployment", ["ts_ms", "event_id"], count).select(
        "deployment", "ts_ms", "hwm"
    )
    tries = (F.col("event_id") % 10 + 1).cast("string")
    kind = F.col("event_type")
    line = (
        F.when(
            (kind == "error") & (F.col("deployment") == "feature"),
            F.concat(
                F.lit('Failed to open "/state/'), F.col("user_id").cast("string"),
                F.lit('", cannot acquire a lock (attempt '), tries, F.lit("/10). Retrying in 3sec."),
            ),
        )
        .when(
            kind == "error",
            F.lit("Failed to open rocksdb partition , cannot acquire a lock. Retrying in 3sec."),
        )
        .when(
            kind == "view",
            F.concat(
                F.lit('Opening rocksdb partition on "/state/'), F.col("user_id").cast("string"),
                F.lit('" attempt='), tries,
            ),
        )
        .when(kind == "click", F.lit("Fast revoke: skipping local state flush"))
        .when(
            F.col("user_id") % 50 == 7, F.lit("Application maximum poll interval (60000ms) exceeded")
        )
        .otherwise(F.lit("checkpoint committed"))
    )
    return actions, samples, rows.select("deployment", "ts_ms", line.alias("line"))
