"""Lake tables: layout, commits, statistics, index, compaction."""

import os

import pytest
from pyspark.sql import functions as F

from emberkey.operators import lake
from emberkey.plans import queries
from emberkey.streaming import runner

LAYOUT = lake.Layout.parse("year,month,day,hour,status,~order_id")
SMALL = "/root/testdata/sf0.001"
START = 1_725_372_000_000  # 2024-09-03 14:00 UTC


@pytest.fixture
def rows(spark):
    return spark.range(200).select(
        F.format_string("order-%07d", F.col("id") % 37).alias("order_id"),
        F.when(F.col("id") % 3 == 0, "OFF").otherwise("ON").alias("status"),
        F.lit("some data").alias("payload"),
        (F.lit(START) + F.col("id") * 60_000).alias("timestamp"),
        F.col("id").alias("seq"),
        F.concat_ws("-", F.lit("k"), "id").alias("__key"),
        F.when(F.col("id") > 150, F.col("id") / 2).alias("reading"),
    )


def write(rows, table, **options):
    options.setdefault("sort_col", "seq")
    return lake.write_lake(rows, table, LAYOUT, "timestamp", **options)


def everything(df):
    columns = [c for c in sorted(df.columns) if c not in lake.CALENDAR]
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def data_files(table):
    return [
        os.path.join(d, f) for d, _, fs in os.walk(f"{table}/data") for f in fs if f.endswith(".parquet")
    ]


def test_names_and_lists():
    assert lake.parse_columns(" year, ,~order_id ,") == ["year", "~order_id"]
    assert lake.parse_columns("") == lake.parse_columns(None) == []
    assert (lake.table_name("ttl_events", "v1"), lake.table_name("a")) == ("ttl_events_v1", "a")
    with pytest.raises(ValueError, match="invalid table name"):
        lake.table_name("_hidden")
    with pytest.raises(ValueError, match="physical only"):
        lake.Layout.parse("~year")


def test_round_trip_and_layout(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    write(rows, table)
    back = lake.read_lake(spark, table)
    assert everything(back.select(*rows.columns)) == everything(rows)
    assert back.select("month", "day", "hour").distinct().count() == 4
    assert {r[0] for r in back.select("month").distinct().collect()} == {"09"}
    files = data_files(table)
    assert all("/year=2024/month=09/day=03/hour=" in f and "/status=" in f for f in files)
    assert not any("order_id=" in f for f in files)
    inside = spark.read.parquet(files[0]).columns
    assert {"order_id", "seq", "__key"} <= set(inside) and not {"year", "status"} & set(inside)


def test_properties(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    write(rows, table)
    known = lake.properties(spark, table)
    assert known["partition_spec"] == ["year", "month", "day", "hour", "status", "order_id"]
    assert known["virtual_partitions"] == ["order_id"]
    assert (known["sort_column"], known["timestamp_column"]) == ("seq", "timestamp")
    # Unset falls back to the timestamp; another sort column needs a fresh table.
    other = str(tmp_path / "u")
    write(rows, other, sort_col=None)
    with pytest.raises(lake.LayoutMismatch):
        write(rows, other, sort_col="seq")
    write(rows, other, sort_col=None)
    assert lake.properties(spark, other)["sort_column"] == "timestamp"


def test_mismatching_layout_is_refused_before_writing(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    write(rows, table)
    before = data_files(table)
    for columns in ("year,month,day,hour,~order_id", "status,~order_id", "year,month,day,hour,status"):
        with pytest.raises(lake.LayoutMismatch):
            lake.write_lake(rows, table, lake.Layout.parse(columns), "timestamp")
    assert data_files(table) == before
    # Without a record the folders alone decide.
    bare = str(tmp_path / "bare")
    write(rows, bare, auto_discover=False)
    assert lake.properties(spark, bare) is None
    assert not os.path.exists(f"{bare}/_manifest")
    with pytest.raises(lake.LayoutMismatch, match="folders on disk"):
        lake.write_lake(rows, bare, lake.Layout.parse("status"), "timestamp")
    assert lake.read_lake(spark, bare).count() == 200


def test_missing_partition_column_fails(rows, tmp_path):
    with pytest.raises(ValueError, match="region"):
        lake.write_lake(rows, str(tmp_path / "t"), lake.Layout.parse("region"), "timestamp")


def test_virtual_only_and_empty_layouts(spark, rows, tmp_path):
    for columns in ("~order_id", ""):
        table = str(tmp_path / f"t{len(columns)}")
        layout = lake.Layout.parse(columns)
        lake.write_lake(rows, table, layout, "timestamp", sort_col="seq")
        assert everything(lake.read_lake(spark, table)) == everything(rows)
        assert not any("=" in f.split("/data/commit=")[1].split("/", 1)[1] for f in data_files(table))


def test_same_commit_again_counts_once(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    write(rows, table, commit="batch-1")
    write(rows, table, commit="batch-1")
    write(rows.limit(10), table, commit="batch-2")
    assert lake.read_lake(spark, table).count() == 210


def test_unpublished_files_are_invisible(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    write(rows, table)
    lake._write_commit(rows.drop("order_id"), table, lake.Layout.parse("status"), "seq", "lost", None, 10)
    assert lake.read_lake(spark, table).count() == 200


def test_a_large_folder_is_spread_over_tasks(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = spark.range(5000).select(
        F.when(F.col("id") % 10 == 0, "OFF").otherwise("ON").alias("status"),
        F.col("id").alias("timestamp"),
    )
    lake.write_lake(rows, table, lake.Layout.parse("status"), "timestamp", max_workers=8)
    stats = lake.file_stats(lake.scan(spark, table), lake.Layout.parse("status")).collect()
    large = sorted((int(r["min"]), int(r["max"])) for r in stats if r["status"] == "ON")
    assert len(large) >= 6
    assert all(a[1] < b[0] for a, b in zip(large, large[1:]))  # separate ranges


def test_statistics_and_manifest(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    write(rows, table)
    entries = lake.read_manifest(spark, table).collect()
    assert len(entries) == len(data_files(table))
    for entry in entries:
        assert set(entry["partition_values"]) == set(LAYOUT.physical)
        assert set(entry["column_stats"]) == {"timestamp", "seq", "reading"}
    assert sum(e["column_stats"]["seq"]["value_count"] for e in entries) == 200
    assert sum(e["column_stats"]["reading"]["null_count"] for e in entries) == 151
    only = str(tmp_path / "u")
    write(rows, only, stats_columns=["timestamp"])
    assert set(lake.read_manifest(spark, only).first()["column_stats"]) == {"timestamp"}


def test_pruned_reads_equal_full_reads(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    write(rows, table, max_workers=8)
    entries, schema = lake.read_manifest(spark, table), lake.table_schema(spark, table)
    for column, low, high in [("seq", 40, 60), ("reading", 80.0, None), ("timestamp", None, START)]:
        kept = lake.prune_files(entries, schema, {column: (low, high)})
        assert 0 < kept.count() < entries.count()
        found = lake.read_range(spark, table, column, low, high)
        full = lake.read_lake(spark, table)
        full = full.filter(F.col(column) >= low) if low is not None else full
        full = full.filter(F.col(column) <= high) if high is not None else full
        assert everything(found) == everything(full)
    none = lake.read_range(spark, table, "seq", 10_000, None)
    assert none.count() == 0
    part = lake.read_range(spark, table, "seq", 0, 500, {"status": "OFF"})
    assert part.count() == 67
    # A column without statistics must not lose files.
    assert lake.prune_files(entries, schema, {"order_id": ("a", "b")}).count() == entries.count()


def test_timestamp_statistics_do_not_depend_on_the_zone(spark, tmp_path):
    table, layout = str(tmp_path / "t"), lake.Layout.parse("")
    rows = spark.range(48).select(F.timestamp_millis(F.col("id") * 3_600_000).alias("at"), "id")
    lake.write_lake(rows, table, layout, "at", max_workers=6)
    low = F.timestamp_millis(F.lit(10 * 3_600_000))
    high = F.timestamp_millis(F.lit(20 * 3_600_000))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        entries = lake.read_manifest(spark, table)
        kept = lake.prune_files(entries, rows.schema, {"at": (low, high)})
        assert kept.count() < entries.count()
        assert lake.read_files(spark, table, kept).filter("id between 10 and 20").count() == 11
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_virtual_index(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    write(rows, table, max_workers=8)
    index = lake.read_index(spark, table, LAYOUT)
    ids = spark.createDataFrame([("order-0000005",)], "order_id string")
    files = lake.lookup_virtual(index, ids)
    assert 0 < files.count() < len(data_files(table))
    found = lake.read_by_virtual(spark, table, LAYOUT, ids)
    want = rows.filter("order_id = 'order-0000005'")
    assert everything(found.select(*rows.columns)) == everything(want)
    narrow = lake.read_by_virtual(spark, table, LAYOUT, ids, F.col("status") == "OFF")
    assert narrow.count() == rows.filter("order_id = 'order-0000005' and status = 'OFF'").count()


def test_missing_index_costs_no_rows_and_heals(spark, rows, tmp_path, monkeypatch):
    table = str(tmp_path / "t")

    def broken(*_):
        raise OSError("index store is down")

    with monkeypatch.context() as patch:
        patch.setattr(lake, "_write_index", broken)
        write(rows, table)
    ids = spark.createDataFrame([("order-0000005",)], "order_id string")
    assert lake.read_by_virtual(spark, table, LAYOUT, ids).count() == 6
    assert lake.reindex(spark, table, LAYOUT) == 1
    assert lake.reindex(spark, table, LAYOUT) == 0
    assert lake.read_index(spark, table, LAYOUT).count() > 0
    assert lake.read_by_virtual(spark, table, LAYOUT, ids).count() == 6


def test_compaction_keeps_the_rows(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    for part in range(4):
        write(rows.filter(F.col("seq") % 4 == part), table)
    before, many = everything(lake.read_lake(spark, table)), lake.read_manifest(spark, table).count()
    lake.compact(spark, table, LAYOUT)
    assert everything(lake.read_lake(spark, table)) == before
    assert lake.read_manifest(spark, table).count() < many
    assert len(lake.commits(spark, table)) == 1
    write(rows.limit(3), table)
    assert lake.read_lake(spark, table).count() == 203
    lake.compact(spark, table, LAYOUT)
    assert lake.read_lake(spark, table).count() == 203


def test_partition_filter_prunes_folders(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    write(rows, table)
    plan = lake.read_lake(spark, table).filter("status = 'OFF'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(status" in plan


def test_sql(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    write(rows, table)
    out = lake.query_lake(
        spark, table, "ttl_events",
        "SELECT order_id, seq, timestamp FROM ttl_events WHERE status = 'OFF' LIMIT 20",
    )
    assert out.count() == 20


def test_stamp_seq(spark, rows):
    plain = lake.stamp_seq(rows.drop("seq"))
    assert plain.select("seq").distinct().count() == 200
    fixed = lake.stamp_seq(rows.drop("seq"), "status", "timestamp")
    got = sorted(r["seq"] for r in fixed.filter("status = 'OFF'").collect())
    assert got == list(range(67))


def test_stream_sink_and_replay(spark, rows, tmp_path):
    inbox, table = str(tmp_path / "in"), str(tmp_path / "t")
    rows.repartition(3).write.parquet(inbox)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    sink = lake.lake_sink(table, LAYOUT, "timestamp", writer="w", sort_col="seq")
    query = (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    runner.await_end(query, 300)
    assert everything(lake.read_lake(spark, table).select(*rows.columns)) == everything(rows)
    assert len(lake.commits(spark, table)) == 3
    files = sorted(f for f in os.listdir(inbox) if f.endswith(".parquet"))
    sink(spark.read.schema(rows.schema).parquet(f"{inbox}/{files[0]}"), 0)  # batch 0 once more
    assert len(lake.commits(spark, table)) == 3


def test_two_writers_compaction_and_replay(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    first, second = rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1")
    for who, half in (("a", first), ("b", second)):
        lake.lake_sink(table, LAYOUT, "timestamp", writer=who, sort_col="seq")(half, 0)
    assert everything(lake.read_lake(spark, table).select(*rows.columns)) == everything(rows)
    lake.compact(spark, table, LAYOUT)
    lake.lake_sink(table, LAYOUT, "timestamp", writer="a", sort_col="seq")(first, 0)  # a replay
    assert everything(lake.read_lake(spark, table).select(*rows.columns)) == everything(rows)
    lake.lake_sink(table, LAYOUT, "timestamp", writer="a", sort_col="seq")(first, 1)
    assert lake.read_lake(spark, table).count() == rows.count() + first.count()


def test_append_refuses_another_schema_or_sort(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    lake.write_lake(rows, table, LAYOUT, "timestamp", sort_col="seq")
    with pytest.raises(lake.LayoutMismatch):
        lake.write_lake(rows.withColumn("extra", F.lit(1)), table, LAYOUT, "timestamp")
    with pytest.raises(lake.LayoutMismatch):
        lake.write_lake(rows, table, LAYOUT, "timestamp", sort_col="timestamp")


def test_commit_without_manifest_is_read(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    lake.write_lake(rows, table, LAYOUT, "timestamp", sort_col="seq")
    lake.write_lake(rows, table, LAYOUT, "timestamp", sort_col="seq", auto_discover=False)
    assert lake.read_range(spark, table, "seq", 10, 19).count() == 2 * rows.filter("seq between 10 and 19").count()


def test_layouts_are_refused_on_one_table(spark, monkeypatch):
    """Only the table itself and the layout that is taken are written, however many are refused."""
    written, write = [], lake._write_commit
    monkeypatch.setattr(lake, "_write_commit", lambda *a, **k: (written.append(a[1]), write(*a, **k)))
    got = {r["layout"]: (r["accepted"], r["rows"]) for r in queries.QUERIES["lake4_validate_layout"](spark, SMALL).collect()}
    n = spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert len(got) == 5 and len(written) == 2 and len(set(written)) == 1
    assert [v for v in got.values() if v[0]] == [(True, 2 * n)] and [v for v in got.values() if not v[0]] == [(False, n)] * 4
