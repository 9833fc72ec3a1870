"""The commit log, compaction by folder, tables by name, predicates on files, point lookups."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from emberkey.operators import lake, lake_catalog, lake_log
from emberkey.operators.pruning import col
from emberkey.streaming import runner

LAYOUT = lake.Layout.parse("half,status,~order_id")


@pytest.fixture
def rows(spark):
    return spark.range(300).select(
        F.format_string("order-%03d", F.col("id") % 40).alias("order_id"),
        F.when(F.col("id") % 3 == 0, "OFF").otherwise("ON").alias("status"),
        F.format_string("%02d", F.col("id") % 2).alias("half"),
        (F.col("id") * 1000).alias("timestamp"),
        F.col("id").alias("seq"),
        F.when(F.col("id") % 5 > 0, F.col("id") / 4).alias("reading"),
    )


def write(rows, table, **options):
    return lake.write_lake(rows, table, LAYOUT, "timestamp", "seq", **options)


def ids(df):
    return sorted(r["seq"] for r in df.collect())


def files(table):
    out = {}
    for folder, _, names in os.walk(f"{table}/data"):
        for name in names:
            if name.endswith(".parquet"):
                with open(f"{folder}/{name}", "rb") as file:
                    out[f"{folder}/{name}"] = hashlib.sha1(file.read()).hexdigest()
    return out


def live_files(spark, table):
    return {r["file_path"].removeprefix("file:").replace("%20", " ") for r in lake.read_manifest(spark, table).collect()}


def test_a_crash_while_publishing_loses_nothing(spark, rows, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    write(rows.filter("seq < 100"), table, commit="batch-0")
    half = rows.filter("seq >= 100")
    with monkeypatch.context() as patch:
        patch.setattr(lake_log, "publish", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            write(half, table, commit="batch-1")
    os.makedirs(f"{table}/_commits/_temporary/0")  # and what a dying writer may leave beside it
    with open(f"{table}/_commits/.draft", "w") as file:
        file.write('{"commit": "batch-1", "se')
    assert ids(lake.read_lake(spark, table)) == list(range(100))
    write(half, table, commit="batch-1")
    write(half, table, commit="batch-1")
    assert ids(lake.read_lake(spark, table)) == list(range(300))


def test_one_batch_written_twice_at_a_time_counts_once(spark, rows, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    monkeypatch.setattr(lake_log, "published", lambda *_: False)  # both look before either has published
    write(rows, table, commit="batch-0")
    write(rows, table, commit="batch-0")
    assert ids(lake.read_lake(spark, table)) == list(range(300))
    assert len(lake.commits(spark, table)) == 1


def test_two_compactions_at_once(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    for k in range(3):
        write(rows.filter(F.col("seq") % 3 == k), table)
    first, second = (lake.prepare_compaction(spark, table, LAYOUT) for _ in range(2))
    assert lake.publish_compaction(spark, table, first) and not lake.publish_compaction(spark, table, second)
    assert ids(lake.read_lake(spark, table)) == list(range(300))
    # Even if both look before either publishes, readers count one.
    lake_log.publish(spark, table, second)
    assert ids(lake.read_lake(spark, table)) == list(range(300))
    assert lake.read_manifest(spark, table).agg(F.sum("rows")).first()[0] == 300
    write(rows.filter("seq < 10"), table)
    assert lake_log.fold(spark, table) > 1
    assert len(lake_log.names_in(spark, f"{table}/_commits")) == 1 or all(
        n.startswith((".", "fold")) for n in lake_log.names_in(spark, f"{table}/_commits")
    )
    assert lake.read_lake(spark, table).count() == 310
    lake_log.publish(spark, table, first)  # a late row of what was folded
    assert lake.read_lake(spark, table).count() == 310


def test_one_folder_is_compacted_and_other_files_stay(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    for k in range(4):
        write(rows.filter(F.col("seq") % 4 == k), table, commit=f"batch-{k}")
    before, counted = files(table), live_files(spark, table)
    where = (F.col("half") == "01") & (F.col("status") == "ON")
    assert lake.compact(spark, table, LAYOUT, where=where)
    after = files(table)
    assert all(after[f] == h for f, h in before.items())
    now = live_files(spark, table)
    touched = {f for f in counted if "/half=01/status=ON/" in f}
    assert len(touched) > 1 and counted - now == touched
    assert [f.split("/data/")[1].split("/")[1:3] for f in now - counted] == [["half=01", "status=ON"]]
    assert ids(lake.read_lake(spark, table)) == list(range(300))
    assert lake.read_manifest(spark, table).agg(F.sum("rows")).first()[0] == 300
    # Commits that are live in part are read in part, and a replay of any of them writes nothing, folded or not.
    assert ids(lake.read_where(spark, table, col("half") == "01")) == ids(rows.filter("half = '01'"))
    for k in range(4):
        write(rows.filter(F.col("seq") % 4 == k), table, commit=f"batch-{k}")
    assert ids(lake.read_lake(spark, table)) == list(range(300))
    point = lake.read_by_id(spark, table, LAYOUT, order_id="order-007")
    assert ids(point) == ids(rows.filter("order_id = 'order-007'"))
    assert lake.compact(spark, table, LAYOUT, where=where) is None  # a single file is left there
    assert lake.compact(spark, table, LAYOUT) and lake.read_manifest(spark, table).count() == 4
    assert ids(lake.read_lake(spark, table)) == list(range(300))
    assert lake.compact(spark, table, LAYOUT) is None


def test_files_are_packed_by_size_and_in_order(spark, rows, tmp_path):
    table, layout = str(tmp_path / "t"), lake.Layout.parse("")
    for k in range(8):
        lake.write_lake(rows.filter(F.col("seq").between(k * 40, k * 40 + 39)), table, layout, "timestamp", "seq", max_workers=1)
    sizes = [r["bytes"] for r in lake.read_manifest(spark, table).collect()]
    lake.compact(spark, table, layout, target_bytes=int(max(sizes) * 2 - 1))
    entries = lake.read_manifest(spark, table).collect()
    assert len(entries) == 4
    spans = sorted((int(e["column_stats"]["seq"]["min"]), int(e["column_stats"]["seq"]["max"])) for e in entries)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert ids(lake.read_lake(spark, table)) == list(range(300))
    large = str(tmp_path / "u")
    lake.write_lake(rows, large, layout, "timestamp", "seq", max_workers=3)
    assert lake.compact(spark, large, layout, target_bytes=100) is None  # none is small


def test_table_by_name(spark, rows, tmp_path):
    table, odd = str(tmp_path / "t"), F.when(F.col("seq") % 50 > 1, F.col("status")).when(F.col("seq") % 50 == 1, "a/b c+'%")
    rows = rows.withColumn("status", odd)
    for k in range(2):
        write(rows.filter(F.floor(F.col("seq") / 2) % 2 == k), table, register_as="ttl-events.v1")
    named = lambda where: ids(spark.sql(f"SELECT * FROM ttl_events_v1 WHERE {where}"))
    everything = ("true", "status = 'ON'", "status is null", "half = '00'", "status = \"a/b c+'%\"", "seq < 7")
    for where in everything:
        assert named(where) == ids(rows.filter(where)), where
    plan = spark.sql("SELECT seq FROM ttl_events_v1 WHERE status = 'OFF'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(status" in plan
    assert lake_catalog.properties(spark, "ttl-events.v1") == {
        "partition_spec": ["half", "status", "order_id"], "virtual_partitions": ["order_id"], "sort_column": "seq", "timestamp_column": "timestamp",
    }
    assert lake.compact(spark, table, LAYOUT, register_as="ttl-events.v1")
    for where in everything:
        assert named(where) == ids(rows.filter(where)), where
        assert ids(lake.read_lake(spark, table).filter(where)) == ids(rows.filter(where)), where
    # A commit that the catalog missed is found by the next sync.
    write(rows.filter("seq < 3"), table)
    assert len(named("true")) == 300 and lake_catalog.sync(spark, table, "ttl-events.v1")[0] > 0 and len(named("true")) == 303
    assert lake_catalog.sync(spark, table, "ttl-events.v1") == (0, 0)
    with pytest.raises(lake_catalog.CatalogMismatch):
        lake.write_lake(rows, str(tmp_path / "u"), LAYOUT, "timestamp", "timestamp", register_as="ttl-events.v1")
    write(rows, str(tmp_path / "v"), auto_discover=False, register_as="plain")
    assert not spark.catalog.tableExists("plain")
    spark.sql("DROP TABLE ttl_events_v1")
    assert lake.read_lake(spark, table).count() == 303


def random_predicate(rng, depth=0):
    if depth < 3 and rng.random() < 0.6:
        left, right = (random_predicate(rng, depth + 1) for _ in range(2))
        return rng.choice([lambda: left & right, lambda: left | right, lambda: ~left])()
    name = rng.choice(["seq", "reading", "status", "half", "order_id", "timestamp"])
    values = {
        "seq": [rng.randint(-20, 320), rng.randint(0, 300) + 0.5], "reading": [rng.uniform(-5, 80), rng.randint(0, 75)],
        "status": ["ON", "OFF", "NO"], "half": ["00", "01"], "order_id": ["order-003", "order-9"], "timestamp": [rng.randint(0, 300_000)],
    }[name]
    value, c = rng.choice(values), col(name)
    return rng.choice(
        [lambda: c < value, lambda: c <= value, lambda: c > value, lambda: c >= value, lambda: c == value, lambda: c != value,
         lambda: c.isin(*rng.choices(values, k=2)), lambda: c.isin(value, None), c.is_null, lambda: c == None]  # noqa: E711
    )()


def test_random_predicates_equal_the_full_read(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    write(rows.filter("seq < 200"), table, max_workers=6)
    write(rows.filter("seq >= 200"), table, auto_discover=False)  # files without bounds
    full, entries, schema = lake.read_lake(spark, table).persist(), lake.read_manifest(spark, table).persist(), lake.table_schema(spark, table)
    where = {r["file_path"]: set() for r in entries.collect()}
    for r in lake.scan(spark, table).select("_metadata.file_path", "seq").collect():
        where[r["file_path"]].add(r["seq"])
    rng, fewer = random.Random(11), 0
    for _ in range(60):
        predicate = random_predicate(rng)
        want = set(ids(full.filter(predicate.rows())))
        kept = {r["file_path"] for r in lake.prune_where(entries, schema, predicate).select("file_path").collect()}
        assert all(f in kept for f, held in where.items() if held & want), predicate
        fewer += len(kept) < len(where)
    assert fewer > 15
    some = (col("seq") >= 50) & ~col("status").isin("ON") & (col("reading").is_null() | (col("reading") < 20))
    assert ids(lake.read_where(spark, table, some)) == ids(full.filter(some.rows()))


def test_point_lookup_and_merged_index(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    for k in range(3):
        write(rows.filter(F.col("seq") % 3 == k), table)
    want = ids(rows.filter("order_id = 'order-011'"))
    assert ids(lake.read_by_id(spark, table, LAYOUT, order_id="order-011")) == want
    before = set(map(tuple, lake.read_index(spark, table, LAYOUT).collect()))
    assert lake.reindex(spark, table, LAYOUT) == 0 and lake.reindex(spark, table, LAYOUT) == 0
    index = lake.read_index(spark, table, LAYOUT)
    assert set(map(tuple, index.collect())) == before and len({f.rsplit("/", 1)[0] for f in index.inputFiles()}) == 1
    assert "EqualTo(order_id,order-011)" in lake.lookup_id(index, order_id="order-011")._jdf.queryExecution().toString()
    assert ids(lake.read_by_id(spark, table, LAYOUT, order_id="order-011")) == want
    # One partition anew, after which its folder is compacted and a commit added.
    assert lake.reindex(spark, table, LAYOUT, rebuild=True, where=F.col("half") == "00") == 3
    assert set(map(tuple, lake.read_index(spark, table, LAYOUT).collect())) == before
    assert lake.compact(spark, table, LAYOUT, where=F.col("half") == "00")
    write(rows.filter("seq < 20"), table)
    twice = want + ids(rows.filter("order_id = 'order-011' and seq < 20"))
    for _ in range(2):
        assert ids(lake.read_by_id(spark, table, LAYOUT, order_id="order-011")) == sorted(twice)
        assert ids(lake.read_by_id(spark, table, LAYOUT, F.col("status") == "ON", order_id="order-011")) == sorted(
            i for i in twice if i % 3
        )
        alive = live_files(spark, table)
        assert {r["data_file"].removeprefix("file:") for r in lake.read_index(spark, table, LAYOUT).collect()} == alive
        lake.reindex(spark, table, LAYOUT, rebuild=True)


def test_stream_with_flushes_and_folds(spark, rows, tmp_path):
    inbox, table = str(tmp_path / "in"), str(tmp_path / "t")
    rows.repartition(3).write.parquet(inbox)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    query = lake.start_lake_sink(
        stream, table, LAYOUT, "timestamp", str(tmp_path / "ck"), every_s=0.1, fold_every=2, sort_col="seq", register_as="streamed"
    )
    query.processAllAvailable()
    query.stop()
    assert ids(lake.read_lake(spark, table)) == list(range(300))
    assert spark.table("streamed").count() == 300
    assert any(n.startswith("fold-") for n in lake_log.names_in(spark, f"{table}/_commits"))
    again = spark.readStream.schema(rows.schema).parquet(inbox)
    sink = lake.lake_sink(table, LAYOUT, "timestamp", writer="w", sort_col="seq")
    runner.await_end(again.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start(), 300)
    assert lake.read_lake(spark, table).count() == 600  # another writer's stream is other data
