"""Topic options, JSON records, lost positions, key functions."""

import pytest
from pyspark.sql import functions as F

from emberkey.functions import keys as K
from emberkey.session import millis
from emberkey.sources import topics


def test_topic_options():
    options = topics.topic_options("host:9092", "raw-events", "latest", max_records=1000)
    assert options == {
        "kafka.bootstrap.servers": "host:9092", "subscribe": "raw-events",
        "startingOffsets": "latest", "includeHeaders": "true", "failOnDataLoss": "true",
        "maxOffsetsPerTrigger": "1000",
    }
    assert topics.topic_options("h", "t", '{"t":{"0":5}}')["startingOffsets"] == '{"t":{"0":5}}'
    with pytest.raises(ValueError):
        topics.topic_options("h", "t", "match")
    assert topics.group_checkpoint("/base/", "dedup-filter", "v1") == "/base/dedup-filter-v1"


def test_lost_range_policy():
    committed, lows = {0: 5, 1: 50, 2: -1}, {0: 10, 1: 20, 2: 30}
    recovered = topics.recover_lost_range(committed, lows, "/ck", offset_reset="latest")
    assert recovered.state_dropped and recovered.start == "latest"
    assert recovered.checkpoint != "/ck"
    with pytest.raises(topics.LostRange, match="low watermarks"):
        topics.recover_lost_range(committed, lows, "/ck", auto_recover=False)
    fine = topics.recover_lost_range({0: 10}, lows, "/ck", auto_recover=False)
    assert fine == topics.Recovery("/ck", "earliest", False)
    with pytest.raises(ValueError):
        topics.recover_lost_range(committed, lows, "/ck", offset_reset="match")


def test_records_round_trip(spark):
    rows = spark.createDataFrame(
        [("order-0000001", "ON", "some data", 123), ("order-0000002", None, "x", 5)],
        topics.EVENT_SCHEMA,
    )
    out = topics.encode_records(rows, K.event_key(F.col("order_id"), F.col("status")))
    assert [r["key"] for r in out.collect()] == ["order-0000001-ON", "order-0000002"]
    raw = out.select(
        F.col("key").cast("binary"), F.col("value").cast("binary"), F.lit(0).alias("partition"),
        F.lit(7).cast("bigint").alias("offset"), F.timestamp_millis(F.lit(99)).alias("timestamp"),
        F.array(F.struct(F.lit("h").alias("key"), F.lit(b"1").alias("value"))).alias("headers"),
    )
    back = topics.decode_records(raw, topics.EVENT_SCHEMA)
    assert back.select(*rows.columns).collect() == rows.collect()
    assert back.columns[-1] == "__headers" and back.first()["record_ms"] == 99


def test_a_record_that_is_no_json_fails(spark):
    raw = spark.createDataFrame(
        [(b"k", b"{not json", 0, 1)], "key binary, value binary, partition int, offset bigint"
    ).withColumn("timestamp", F.timestamp_millis(F.lit(1)))
    with pytest.raises(Exception, match="MALFORMED"):
        topics.decode_records(raw, topics.EVENT_SCHEMA).collect()


def test_end_offsets(spark):
    records = spark.createDataFrame(
        [("t", 0, 4), ("t", 0, 9), ("t", 1, 0)], "topic string, partition int, offset bigint"
    )
    names = spark.createDataFrame([("t",), ("gone",)], "topic string")
    got = {r["topic"]: r["end_offset"] for r in topics.end_offsets(records, names).collect()}
    assert got == {"t": 11, "gone": 0}


def test_keys(spark):
    raw = ["window_open_ON", "abc", "a_", "_b", "", "x\ny_Z"]
    df = spark.createDataFrame([(r,) for r in raw], "key string")
    got = [(r["e"], r["s"]) for r in K.split_key(df, "key", "e", "s").collect()]
    assert got == [(r.rpartition("_")[0], r.rpartition("_")[2]) for r in raw]
    as_bytes = df.withColumn("key", F.col("key").cast("binary"))
    assert [(r["e"], r["s"]) for r in K.split_key(as_bytes, "key", "e", "s").collect()] == got
    one = spark.range(1).select(
        K.order_id(F.lit(42)).alias("a"), K.order_id(F.lit(123456789)).alias("b"),
        K.slot_key(F.lit(2005), 1000).alias("c"), K.padding(3).alias("d"),
        K.expiry_bucket(F.lit(100), 100).alias("e"), K.expiry_bucket(F.lit(101), 100).alias("f"),
        K.expiry_bucket(F.lit(100 + K.HOUR_MS), 100).alias("g"),
        K.expiry_bucket(F.lit(100 + K.DAY_MS), 100).alias("h"),
        K.expiry_bucket(F.lit(None).cast("bigint"), 100).alias("i"),
        K.to_millis(K.from_millis(F.lit(1234))).alias("j"),
    )
    assert tuple(one.first()) == (
        "order-0000042", "order-123456789", "key-5", "xxx",
        "expired", "lt_1h", "h1_24", "gt_24h", "never", 1234,
    )
    assert millis(5) == 5
