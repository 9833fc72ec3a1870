"""Partitioned parquet tables with virtual partitions, per-file statistics and an index.

    {table}/data/commit={folder}/{col}={value}/...parquet   physical columns are folders, not in the file
    {table}/.vidx/commit={folder}/                          virtual index: one row per file and tuple
    {table}/_manifest/commit={folder}/                      one row per file: partition values, zone maps
    {table}/_commits/                                       the log of published commits, see `lake_log`
    {table}/_meta/                                          properties, written at creation only

Every attempt to write fills a folder of its own and is then published by one small row, atomically. An unpublished folder
is invisible, so a batch that is written again (same commit id) counts once, also if it died while publishing or is
written twice at a time. Compaction publishes new folders together with the names of those they replace; other
files stay as they are.
"""

from __future__ import annotations

import json
import logging
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from emberkey.functions.keys import calendar
from emberkey.operators import lake_catalog, lake_log
from emberkey.operators.carry import null_safe_join
from emberkey.operators.lake_log import Commit
from emberkey.operators.ordered import over_lanes
from emberkey.operators.pruning import Bounds, Predicate
from emberkey.session import materialize

log = logging.getLogger(__name__)
CALENDAR = ("year", "month", "day", "hour")
# Fixed value: what a table may be called.
TABLE_NAME = re.compile(r"^[a-zA-Z0-9][a-zA-Z0-9._-]*$")
TARGET_BYTES = 128 << 20
# A folder of a commit counts as small if its files are smaller than this share of the target, on average.
SMALL_SHARE = 0.75


class LayoutMismatch(ValueError):
    """The configured partition columns differ from the table's."""


@dataclass(frozen=True)
class Layout:
    """Partition columns in tree order; virtual ones get no folder and stay in the file."""

    physical: tuple[str, ...]
    virtual: tuple[str, ...]
    spec: tuple[str, ...]

    @classmethod
    def parse(cls, columns: str | list[str]) -> Layout:
        names = parse_columns(columns) if isinstance(columns, str) else list(columns)
        layout = cls(
            tuple(n for n in names if not n.startswith("~")),
            tuple(n[1:] for n in names if n.startswith("~")),
            tuple(n.lstrip("~") for n in names),
        )
        if bad := set(layout.virtual) & set(CALENDAR):
            raise ValueError(f"{sorted(bad)} are derived from the timestamp and physical only")
        return layout


def parse_columns(text: str | None) -> list[str]:
    """A comma list, trimmed, without blanks; a leading `~` stays."""
    return [part.strip() for part in (text or "").split(",") if part.strip()]


def table_name(name: str, version: str = "") -> str:
    full = f"{name}_{version}" if version else name
    if not TABLE_NAME.match(full):
        raise ValueError(f"invalid table name {full!r}")
    return full


def stamp_seq(
    df: DataFrame, partition: str | None = None, offset: str | None = None, name: str = "seq"
) -> DataFrame:
    """Number the records. Without arguments unique and rising per task, as each run gives it anew;
    with them, 0, 1, ... per source partition in offset order, the same in every run."""
    if partition is None:
        return df.withColumn(name, F.monotonically_increasing_id())
    counted = over_lanes(
        df, partition, offset, lambda rows, lane: lane.running(rows, name, F.lit(1))
    )
    return counted.withColumn(name, F.col(name) - 1)


def properties(spark: SparkSession, table: str) -> dict | None:
    """What was recorded when the table was created; None if nothing was."""
    if not lake_log.exists(spark, f"{table}/_meta/_SUCCESS"):
        return None
    return json.loads(spark.read.schema("json string").parquet(f"{table}/_meta").first()["json"])


def disk_layout(spark: SparkSession, table: str) -> list[str] | None:
    """The partition columns of the folders on disk, down from one published commit; None without any.

    Every write is held against them, so one commit stands for all.
    """
    for row in lake_log.live(lake_log.read(spark, table)).commits:
        if row.dirs:
            return [part.split("=")[0] for part in row.dirs[0].split("/")[1:]]
    for name in lake_log.names_in(spark, f"{table}/data"):  # files that no log knows
        chain, below = [], [name]
        while below:
            at = f"{table}/data/" + "/".join([name, *chain])
            below = [n for n in lake_log.names_in(spark, at) if "=" in n]
            chain += below[:1]
        if lake_log.names_in(spark, f"{table}/data/{name}"):
            return [c.split("=")[0] for c in chain]
    return None


def validate_layout(spark: SparkSession, table: str, layout: Layout) -> dict | None:
    """Raise unless `layout` is the table's own, both as recorded and as found on disk."""
    known = properties(spark, table)
    if known is not None:
        if tuple(known["partition_spec"]) != layout.spec:
            raise LayoutMismatch(f"table has {known['partition_spec']}, asked {list(layout.spec)}")
        if tuple(known["virtual_partitions"]) != layout.virtual:
            raise LayoutMismatch(
                f"virtual columns are {known['virtual_partitions']}, asked {list(layout.virtual)}"
            )
    chain = disk_layout(spark, table)
    if chain is not None and tuple(chain) != layout.physical:
        raise LayoutMismatch(f"folders on disk are {chain}, asked {list(layout.physical)}")
    return known


def commits(spark: SparkSession, table: str) -> list[str]:
    """Published commits with files that no other one has replaced."""
    return lake_log.live(lake_log.read(spark, table)).names


def write_lake(
    df: DataFrame,
    table: str,
    layout: Layout,
    ts_col: str,
    sort_col: str | None = None,
    commit: str | None = None,
    stats_columns: list[str] | None = None,
    auto_discover: bool = True,
    max_workers: int | None = None,
    rows_per_file: int = 5_000_000,
    check: bool = True,
    register_as: str | None = None,
) -> str:
    """Append `df` as one commit and return its id; an id that was published before writes nothing.

    A table keeps its layout, sort and timestamp columns and its schema; other ones are refused.

    Rows are range-partitioned on (folder, sort column): a folder of any size is spread over as many
    tasks as its share of the rows asks for, small folders share a task, and files of one folder
    cover separate ranges of the sort column. `max_workers` fixes the number of tasks. Without `auto_discover` neither
    properties nor statistics are recorded, nor is the table registered. `register_as` names it in the session's catalog.
    """
    spark = df.sparkSession
    if commit and lake_log.published(spark, table, commit):
        return commit
    known = validate_layout(spark, table, layout) if check else properties(spark, table)
    asked = {"timestamp_column": ts_col, "sort_column": sort_col}
    for name, column in asked.items():
        if known and column is not None and column != known[name]:
            raise LayoutMismatch(f"{name} is {known[name]}, asked {column}")
    sort_col = sort_col or (known or {}).get("sort_column") or ts_col
    if set(layout.physical) & set(CALENDAR):
        columns = df.columns
        df = calendar(df, ts_col).select(
            *columns, *[c for c in CALENDAR if c in layout.physical and c not in columns]
        )
    missing = [c for c in (*layout.spec, sort_col) if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in the rows")
    if known:
        kinds = {f["name"]: f["type"] for f in known["schema"]["fields"]}
        given = {f["name"]: f["type"] for f in json.loads(df.schema.json())["fields"]}
        if kinds != given:
            odd = sorted(n for n in kinds.keys() | given.keys() if kinds.get(n) != given.get(n))
            raise LayoutMismatch(f"columns {odd} are not as in the table")
    if known is None and auto_discover:
        record = {
            "partition_spec": layout.spec,
            "virtual_partitions": layout.virtual,
            "sort_column": sort_col,
            "timestamp_column": ts_col,
            "stats_columns": stats_columns,
            "schema": json.loads(df.schema.json()),
        }
        meta = spark.createDataFrame([(json.dumps(record),)], "json string")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{table}/_meta")
    commit = commit or uuid.uuid4().hex
    folder = f"{commit}.{uuid.uuid4().hex[:8]}"
    _write_commit(df, table, layout, sort_col, folder, max_workers, rows_per_file)
    row = _describe(spark, table, layout, commit, folder, df.schema, stats_columns, auto_discover)
    if lake_log.publish(spark, table, row) and register_as and auto_discover:
        lake_catalog.register(spark, table, register_as, properties(spark, table))
    return commit


def _write_commit(df, table, layout, sort_col, folder, max_workers, rows_per_file) -> None:
    by = [*layout.physical, sort_col]
    ranged = df.repartitionByRange(max_workers, *by) if max_workers else df.repartitionByRange(*by)
    _save(ranged.sortWithinPartitions(*by), table, layout, folder, rows_per_file)


def _save(rows: DataFrame, table: str, layout: Layout, folder: str, rows_per_file: int) -> None:
    writer = rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    if layout.physical:
        writer = writer.partitionBy(*layout.physical)
    writer.parquet(f"{table}/data/commit={folder}")


def _dir_of(file: Column) -> Column:
    """The folder of a data file, relative to {table}/data, as `_metadata.file_path` writes it."""
    return F.regexp_extract(file, r"/data/(commit=.*)/[^/]+$", 1)


def _describe(spark, table, layout, commit, folder, schema, stats_columns, record_stats) -> Commit:
    """Record what an attempt has written; the row that publishes it."""
    written = _read_roots(spark, table, [f"{table}/data/commit={folder}"], schema)
    if record_stats:
        manifest(written, layout, stats_columns).write.mode("overwrite").parquet(
            f"{table}/_manifest/commit={folder}"
        )
        files = spark.read.schema(MANIFEST).parquet(f"{table}/_manifest/commit={folder}")
    else:
        files = written.select("_metadata.file_path")
    dirs = sorted(r[0] for r in files.select(_dir_of(F.col("file_path"))).distinct().collect())
    indexed = False
    if layout.virtual:
        try:
            _write_index(build_virtual_index(written, layout), table, layout, folder)
            indexed = True
        except Exception as problem:  # the data is whole without it; `reindex` heals it
            log.warning("index of commit %s not written: %s", commit, problem)
    seq = 1 + max((c.seq for c in lake_log.read(spark, table)), default=0)
    return Commit(commit, seq, "write", folder, tuple(dirs), (), record_stats, indexed)


def _read_roots(spark: SparkSession, table: str, roots: list[str], schema: T.StructType) -> DataFrame:
    """Rows below some folders with `commit` and `_metadata`. The schema keeps `09` a string."""
    full = T.StructType([*schema.fields, T.StructField("commit", T.StringType())])
    return spark.read.schema(full).option("basePath", f"{table}/data").parquet(*roots)


def table_schema(spark: SparkSession, table: str) -> T.StructType:
    known = properties(spark, table)
    if known:
        return T.StructType.fromJson(known["schema"])
    name = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        found = spark.read.parquet(f"{table}/data").schema
    finally:
        spark.conf.set(name, before)
    return T.StructType([f for f in found.fields if f.name != "commit"])


def read_lake(spark: SparkSession, table: str) -> DataFrame:
    """All published rows. Filters on physical columns prune folders."""
    return scan(spark, table).drop("commit")


def scan(spark: SparkSession, table: str) -> DataFrame:
    """All published rows with their `commit` and `_metadata`, as `file_stats` takes them."""
    roots = lake_log.live(lake_log.read(spark, table)).roots(table)
    schema = table_schema(spark, table)
    if not roots:
        return spark.createDataFrame([], schema.add("commit", "string"))
    return _read_roots(spark, table, roots, schema)


def query_lake(spark: SparkSession, table: str, view: str, sql: str) -> DataFrame:
    """Run SQL with the table registered as `view`."""
    read_lake(spark, table).createOrReplaceTempView(view)
    return spark.sql(sql)


def lake_sink(
    table: str, layout: Layout, ts_col: str, writer: str | None = None, **options
) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: one commit per batch and writer, so a replay counts once.

    Batch numbers start anew with every checkpoint, so a commit is named by its writer too: the
    stream's id, which its checkpoint keeps over restarts, unless `writer` names one. A batch that was
    published before, even if compacted since, writes nothing. The layout is checked against the table once, before the first batch.
    """
    checked = False

    def write(batch: DataFrame, batch_id: int) -> None:
        nonlocal checked
        context = batch.sparkSession.sparkContext
        who = writer or context.getLocalProperty("sql.streaming.queryId")
        if not who:
            raise ValueError("outside a stream, name the writer")
        name = f"{who}-batch-{batch_id:012d}"
        write_lake(batch, table, layout, ts_col, commit=name, check=not checked, **options)
        checked = True

    return write


def start_lake_sink(
    stream: DataFrame,
    table: str,
    layout: Layout,
    ts_col: str,
    checkpoint: str,
    every_s: float = 30,
    fold_every: int | None = 1000,
    **options,
) -> StreamingQuery:
    """A stream into the table, flushed every `every_s` seconds, or at once when the source's own limit is reached.

    How many records a flush takes is the source's to say: `maxOffsetsPerTrigger` of a topic (`topic_options(max_records=...)`),
    `maxFilesPerTrigger` of files. With more waiting than that, the next flush follows at once. Every `fold_every` batches
    the log is folded into one file.
    """
    sink = lake_sink(table, layout, ts_col, **options)

    def write(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        if fold_every and batch_id % fold_every == fold_every - 1:
            lake_log.fold(batch.sparkSession, table)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{every_s} seconds").start()


# ---- statistics ---------------------------------------------------------------------------------


def stats_candidates(schema: T.StructType, layout: Layout) -> list[str]:
    """Numeric and timestamp columns kept in the files, internal `__` columns left out."""
    kinds = (T.NumericType, T.TimestampType, T.TimestampNTZType)
    return [
        f.name
        for f in schema.fields
        if isinstance(f.dataType, kinds)
        and not f.name.startswith("__")
        and f.name != "commit"
        and f.name not in layout.physical
    ]


def _as_text(bound: Column, kind: T.DataType) -> Column:
    """Bounds as text; moments as epoch microseconds, whatever the session's time zone."""
    if isinstance(kind, T.TimestampType):
        bound = F.unix_micros(bound)
    return bound.cast("string")


def _from_text(bound: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(bound.cast("bigint"))
    return bound.cast(kind)


def file_stats(
    rows: DataFrame, layout: Layout, columns: list[str] | None = None, sizes: bool = False
) -> DataFrame:
    """Zone maps: one row per file and column. Bounds are exact, as text of the column's own type;
    `value_count` counts all values, nulls included."""
    columns = columns or stats_candidates(rows.schema, layout)
    aggregates = [F.count(F.lit(1)).alias("__n"), F.first("__bytes").alias("bytes")]
    for i, c in enumerate(columns):
        aggregates += [
            F.min(c).alias(f"__min{i}"),
            F.max(c).alias(f"__max{i}"),
            F.count_if(F.col(c).isNull()).alias(f"__null{i}"),
        ]
    constants = [F.first(c).alias(c) for c in (*layout.physical, "commit")]
    per_file = (
        rows.select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_size").alias("__bytes"),
            *dict.fromkeys([*columns, *layout.physical, "commit"]),
        )
        .groupBy("file_path")
        .agg(*aggregates, *constants)
    )
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(
                "numeric" if isinstance(rows.schema[c].dataType, T.NumericType) else "timestamp"
            ).alias("type"),
            _as_text(F.col(f"__min{i}"), rows.schema[c].dataType).alias("min"),
            _as_text(F.col(f"__max{i}"), rows.schema[c].dataType).alias("max"),
            F.col(f"__null{i}").alias("null_count"),
            F.col("__n").alias("value_count"),
        )
        for i, c in enumerate(columns)
    ]
    more = ["bytes"] if sizes else []
    return per_file.select(
        "file_path", "commit", *layout.physical, *more, F.inline_outer(F.array(*entries))
    )


def manifest(rows: DataFrame, layout: Layout, columns: list[str] | None = None) -> DataFrame:
    """One row per file: path, physical partition values, column statistics by name, rows and bytes."""
    stats = file_stats(rows, layout, columns, sizes=True)
    pairs = [x for c in layout.physical for x in (F.lit(c), F.first(c))]
    values = F.create_map(*pairs) if pairs else F.map_from_arrays(F.array(), F.array())
    entry = F.struct("column", F.struct("type", "min", "max", "null_count", "value_count"))
    return stats.groupBy("file_path", "commit").agg(
        values.cast("map<string,string>").alias("partition_values"),
        F.map_from_entries(F.collect_list(entry)).alias("column_stats"),
        F.first("value_count").alias("rows"),
        F.first("bytes").alias("bytes"),
    )


MANIFEST = (
    "file_path string, partition_values map<string,string>, column_stats map<string, struct<"
    "type:string,min:string,max:string,null_count:bigint,value_count:bigint>>, rows bigint, bytes bigint, commit string"
)


def _live_rows(
    spark: SparkSession, base: str, schema: T.StructType, state: lake_log.Live, rows: list[Commit], file: str
) -> DataFrame:
    """Rows about the live files of some commits, from what their writers left below `base`."""
    parts = {c.commit for c in state.parts()}
    held = spark.createDataFrame([(d,) for c in parts for d in state.dirs[c]], "__dir string")

    def read(some: list[Commit]) -> DataFrame:
        if not some:
            return spark.createDataFrame([], schema)
        paths = [f"{base}/commit={c.folder}" for c in some]
        return spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.fieldNames())

    whole = read([c for c in rows if c.commit not in parts])
    if not parts:
        return whole
    rest = read([c for c in rows if c.commit in parts]).withColumn("__dir", _dir_of(F.col(file)))
    return whole.unionByName(rest.join(held, "__dir", "left_semi").drop("__dir"))


def read_manifest(spark: SparkSession, table: str, state: lake_log.Live | None = None) -> DataFrame:
    """Manifest rows of the live files; files of commits without one have no bounds."""
    state = state or lake_log.live(lake_log.read(spark, table))
    schema = T._parse_datatype_string(MANIFEST)
    alive = [c for c in state.commits if state.dirs.get(c.commit)]
    described = [c for c in alive if c.described]
    rows = _live_rows(spark, f"{table}/_manifest", schema, state, described, "file_path")
    plain = [d for c in alive if not c.described for d in state.dirs[c.commit]]
    if plain:
        roots = [f"{table}/data/{unquote(d)}" for d in plain]
        files = _read_roots(spark, table, roots, table_schema(spark, table))
        files = files.groupBy("_metadata.file_path", "commit").agg(
            F.count(F.lit(1)).alias("rows"), F.first("_metadata.file_size").alias("bytes")
        )
        rows = rows.unionByName(files, allowMissingColumns=True)
    return rows


def prune_files(
    entries: DataFrame,
    schema: T.StructType,
    ranges: dict[str, tuple],
    partitions: dict[str, str] | None = None,
) -> DataFrame:
    """Manifest rows of the files that may hold a match.

    `ranges` maps a column to inclusive (low, high), either of them None for open. A file is skipped
    only if its bounds, or its lack of non-null values, rule a match out.
    """
    for column, value in (partitions or {}).items():
        held = F.col("partition_values")
        entries = entries.filter(held.isNull() | (held[column] == value))
    for column, (low, high) in ranges.items():
        kind = schema[column].dataType
        stats = F.col("column_stats")[column]
        keep = stats["min"].isNotNull()
        if low is not None:
            keep &= _from_text(stats["max"], kind) >= F.lit(low).cast(kind)
        if high is not None:
            keep &= _from_text(stats["min"], kind) <= F.lit(high).cast(kind)
        entries = entries.filter(stats.isNull() | keep)
    return entries


def prune_where(entries: DataFrame, schema: T.StructType, predicate: Predicate) -> DataFrame:
    """Manifest rows of the files in which some row may satisfy `predicate` (see `pruning`).

    A column without statistics, or a file without a manifest, rules nothing out.
    """
    bounds = {}
    for name in predicate.columns():
        kind, stats, parts = schema[name].dataType, F.col("column_stats")[name], F.col("partition_values")
        # A physical column has one value per file.
        fixed = F.coalesce(F.array_contains(F.map_keys(parts), name), F.lit(False))
        value = parts[name].cast(kind)
        bounds[name] = Bounds(
            low=F.when(fixed, value).otherwise(_from_text(stats["min"], kind)),
            high=F.when(fixed, value).otherwise(_from_text(stats["max"], kind)),
            nulls=F.when(fixed, value.isNull()).otherwise(stats["null_count"] > 0),
            values=F.when(fixed, value.isNotNull()).otherwise(stats["null_count"] < stats["value_count"]),
            known=fixed | stats.isNotNull(),
        )
    return entries.filter(predicate.may(bounds)[0])


def read_where(spark: SparkSession, table: str, predicate: Predicate) -> DataFrame:
    """Rows that satisfy `predicate`, from the files whose zone maps and partition values allow one."""
    files = prune_where(read_manifest(spark, table), table_schema(spark, table), predicate)
    return read_files(spark, table, files).filter(predicate.rows())


def read_files(spark: SparkSession, table: str, files: DataFrame) -> DataFrame:
    """Rows of the listed data files (column `file_path`) only."""
    schema = table_schema(spark, table)
    # Paths only, as many as Spark would list itself for a scan of these files.
    paths = [unquote(r[0]) for r in files.select("file_path").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    return _read_roots(spark, table, paths, schema).drop("commit")


def read_range(
    spark: SparkSession, table: str, column: str, low=None, high=None, partitions=None
) -> DataFrame:
    """Rows with `low <= column <= high`, from the files whose zone maps allow a match."""
    schema = table_schema(spark, table)
    files = prune_files(read_manifest(spark, table), schema, {column: (low, high)}, partitions)
    rows = read_files(spark, table, files)
    if low is not None:
        rows = rows.filter(F.col(column) >= F.lit(low))
    if high is not None:
        rows = rows.filter(F.col(column) <= F.lit(high))
    for name, value in (partitions or {}).items():
        rows = rows.filter(F.col(name) == value)
    return rows


# ---- virtual index ------------------------------------------------------------------------------


def build_virtual_index(rows: DataFrame, layout: Layout) -> DataFrame:
    """One row per file and distinct virtual tuple, with the physical values as constants."""
    return rows.select(
        F.col("_metadata.file_path").alias("data_file"), *layout.virtual, *layout.physical
    ).distinct()


def _write_index(index: DataFrame, table: str, layout: Layout, folder: str) -> None:
    # Sorted by id, and with Bloom filters on it, so that a lookup reads few row groups.
    by = [*layout.virtual, "data_file"]
    writer = index.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite")
    for name in layout.virtual:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.parquet(f"{table}/.vidx/commit={folder}")


def _index_schema(spark: SparkSession, table: str, layout: Layout) -> T.StructType:
    schema = table_schema(spark, table)
    fields = [T.StructField("data_file", T.StringType())]
    return T.StructType([*fields, *[schema[c] for c in (*layout.virtual, *layout.physical)]])


def _indexed(state: lake_log.Live) -> tuple[Commit | None, list[Commit]]:
    """The newest merged index, and the live commits with an index of their own that it doesn't cover."""
    merged = next((c for c in reversed(state.commits) if c.kind == "index"), None)
    covered = set(merged.covers) if merged else set()
    alive = [c for c in state.commits if state.dirs.get(c.commit)]
    return merged, [c for c in alive if c.indexed and c.folder not in covered]


def read_index(spark: SparkSession, table: str, layout: Layout) -> DataFrame:
    """Index rows of the live files: those of the newest merged index and of the commits since."""
    state = lake_log.live(lake_log.read(spark, table))
    schema = _index_schema(spark, table, layout)
    merged, own = _indexed(state)
    rows = _live_rows(spark, f"{table}/.vidx", schema, state, own, "data_file")
    if merged:
        old = spark.read.schema(schema).parquet(f"{table}/.vidx/commit={merged.folder}")
        alive = state.all_dirs()
        known = {d for c in state.commits if c.folder in set(merged.covers) for d in c.dirs}
        # Folders replaced since: few, or none right after `reindex`. Others are forgotten by the log.
        if known - alive or any(c.partial or not c.dirs for c in state.commits if c.folder in set(merged.covers)):
            held = spark.createDataFrame([(d,) for d in alive], "__dir string")
            old = old.withColumn("__dir", _dir_of(F.col("data_file"))).join(held, "__dir", "left_semi").drop("__dir")
        rows = rows.unionByName(old)
    return rows


def lookup_virtual(index: DataFrame, ids: DataFrame, where: Column | None = None) -> DataFrame:
    """Files that hold any of `ids` (columns of the virtual tuple), within physical filter `where`."""
    rows = index if where is None else index.filter(where)
    found = null_safe_join(rows, ids.distinct(), ids.columns, "left_semi")
    return found.select(F.col("data_file").alias("file_path")).distinct()


def lookup_id(index: DataFrame, where: Column | None = None, **ids) -> DataFrame:
    """Files that hold one id (values of virtual columns): a filter that reaches the scan, where bounds and
    Bloom filters of the index skip its row groups."""
    rows = index if where is None else index.filter(where)
    for name, value in ids.items():
        rows = rows.filter(F.col(name) == F.lit(value))
    return rows.select(F.col("data_file").alias("file_path")).distinct()


def read_by_virtual(
    spark: SparkSession, table: str, layout: Layout, ids: DataFrame, where: Column | None = None
) -> DataFrame:
    """Rows of `ids`, from the files the index names. Files without index rows are read as well."""
    index = read_index(spark, table, layout)
    files = lookup_virtual(index, ids, where).union(_unindexed(spark, table))
    rows = read_files(spark, table, files)
    if where is not None:
        rows = rows.filter(where)
    return null_safe_join(rows, ids.distinct(), ids.columns, "left_semi")


def read_by_id(spark: SparkSession, table: str, layout: Layout, where: Column | None = None, **ids) -> DataFrame:
    """Rows of one id (values of virtual columns) by a point lookup in the index."""
    files = lookup_id(read_index(spark, table, layout), where, **ids).union(_unindexed(spark, table))
    rows = read_files(spark, table, files)
    for name, value in ids.items():
        rows = rows.filter(F.col(name) == F.lit(value))
    return rows if where is None else rows.filter(where)


def _unindexed(spark: SparkSession, table: str) -> DataFrame:
    """Files of the commits whose index is missing."""
    state = lake_log.live(lake_log.read(spark, table))
    merged, own = _indexed(state)
    have = {c.folder for c in own} | set(merged.covers if merged else ())
    bare = [c for c in state.commits if state.dirs.get(c.commit) and c.folder not in have]
    if not bare:
        return spark.createDataFrame([], "file_path string")
    missing = lake_log.Live(bare, {c.commit: state.dirs[c.commit] for c in bare})
    return read_manifest(spark, table, missing).select("file_path")


def reindex(
    spark: SparkSession, table: str, layout: Layout, rebuild: bool = False, where: Column | None = None
) -> int:
    """Collapse the index into one merged index of all live files; how many commits were read to index them.

    Commits with an index of their own, or in the merged one, are taken from there. Those without are read; with
    `rebuild` all are, or those with files in the folders that `where` (on physical columns) selects. One
    job, one published row; nothing happens if all is merged already.
    """
    state = lake_log.live(lake_log.read(spark, table))
    alive = [c for c in state.commits if state.dirs.get(c.commit)]
    merged, own = _indexed(state)
    have = {c.folder for c in own} | set(merged.covers if merged else ())
    todo = [c for c in alive if rebuild or c.folder not in have]
    if rebuild and where is not None:
        chosen = _files_in(read_manifest(spark, table, state), table_schema(spark, table), layout, where)
        dirs = {r[0] for r in chosen.select(_dir_of(F.col("file_path"))).distinct().collect()}
    else:
        dirs = {d for c in todo for d in state.dirs[c.commit]}
    if not dirs and not own:
        return 0
    kept = read_index(spark, table, layout)
    anew = spark.createDataFrame([(d,) for d in dirs], "__dir string")
    kept = kept.withColumn("__dir", _dir_of(F.col("data_file"))).join(anew, "__dir", "left_anti").drop("__dir")
    if dirs:
        roots = [f"{table}/data/{unquote(d)}" for d in sorted(dirs)]
        fresh = build_virtual_index(_read_roots(spark, table, roots, table_schema(spark, table)), layout)
        kept = kept.unionByName(fresh)
    name = f"index-{uuid.uuid4().hex}"
    _write_index(kept, table, layout, name)
    seq = 1 + max(c.seq for c in state.commits)
    lake_log.publish(spark, table, Commit(name, seq, "index", name, covers=tuple(c.folder for c in alive)))
    return len({c.commit for c in alive if set(state.dirs[c.commit]) & dirs})


def _files_in(entries: DataFrame, schema: T.StructType, layout: Layout, where: Column) -> DataFrame:
    """Manifest rows of the folders that `where`, a condition on physical columns, selects."""
    parts = [F.col("partition_values")[c].cast(schema[c].dataType).alias(c) for c in layout.physical]
    return entries.select(F.struct("*").alias("__entry"), *parts).filter(where).select("__entry.*")


# ---- compaction ---------------------------------------------------------------------------------


def prepare_compaction(
    spark: SparkSession,
    table: str,
    layout: Layout,
    sort_col: str | None = None,
    rows_per_file: int = 5_000_000,
    max_workers: int | None = None,
    where: Column | None = None,
    target_bytes: int = TARGET_BYTES,
) -> Commit | None:
    """Rewrite small files, and return the commit that would swap them in; None if there are none.

    Small are the files of a commit's folder that are below three quarters of the target on average. In each
    partition with several of them they are packed, in the order of their least sort value, into bins of about the
    target, and each bin becomes one file, ordered by the sort column. Partitions that `where` (on physical columns)
    leaves out, and large files, stay as they are. Sizes and bounds come from the manifest.
    """
    known = validate_layout(spark, table, layout) or {}
    sort_col = sort_col or known.get("sort_column")
    if sort_col is None:
        raise ValueError("the table has no recorded sort column, name one")
    schema = table_schema(spark, table)
    files = read_manifest(spark, table)
    if where is not None:
        files = _files_in(files, schema, layout, where)
    low = _from_text(F.col("column_stats")[sort_col]["min"], schema[sort_col].dataType)
    files = files.select("file_path", _dir_of(F.col("file_path")).alias("dir"), "bytes", low.alias("low"))
    place = F.regexp_replace("dir", "^commit=[^/]*/?", "")
    files = files.withColumn("place", place).withColumn("mean", F.avg("bytes").over(Window.partitionBy("dir")))
    small = files.filter(F.col("mean") < target_bytes * SMALL_SHARE)
    partition = Window.partitionBy("place")
    small = small.withColumn("several", F.count("file_path").over(partition) > 1).filter("several")
    before = partition.orderBy(F.col("low").asc_nulls_first(), "file_path").rowsBetween(Window.unboundedPreceding, -1)
    packed = F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / target_bytes)
    plan = materialize(small.select("file_path", "dir", "place", packed.alias("bin")), "compaction")
    # One row per file to write.
    bins = plan.select("place", "bin").distinct()
    bins = materialize(bins.withColumn("__bin", F.row_number().over(Window.orderBy("place", "bin")) - 1), "bins")
    count, replaces = bins.count(), sorted(r[0] for r in plan.select("dir").distinct().collect())
    if not count:
        return None
    name = f"compact-{uuid.uuid4().hex}"
    rows = _read_roots(spark, table, [f"{table}/data/{unquote(d)}" for d in replaces], schema).drop("commit")
    target = plan.join(bins, ["place", "bin"]).select(F.col("file_path").alias("__file"), "__bin")
    rows = rows.withColumn("__file", F.col("_metadata.file_path")).join(target, "__file")
    tasks = min(count, max_workers or count)
    rows = rows.repartitionById(tasks, F.pmod(F.col("__bin"), F.lit(tasks)).cast("int"))
    rows = rows.sortWithinPartitions(*layout.physical, "__bin", sort_col).drop("__file", "__bin")
    _save(rows, table, layout, name, rows_per_file)
    row = _describe(spark, table, layout, name, name, schema, known.get("stats_columns"), bool(known))
    return replace(row, kind="compact", replaces=tuple(replaces))


def publish_compaction(spark: SparkSession, table: str, row: Commit) -> bool:
    """Swap the files in, unless some of those it replaces were replaced meanwhile: then it is void, and False."""
    state = lake_log.live(lake_log.read(spark, table))
    if set(row.replaces) <= state.all_dirs():
        lake_log.publish(spark, table, replace(row, seq=1 + max(c.seq for c in state.commits)))
        if row.commit in lake_log.live(lake_log.read(spark, table)).names:
            return True
    log.warning("compaction %s is void: another one was first", row.commit)
    return False


def compact(
    spark: SparkSession, table: str, layout: Layout, register_as: str | None = None, **options
) -> str | None:
    """Compact the table, or the partitions that `where` selects (see `prepare_compaction`); the same rows afterwards.

    Readers see the old files until the new ones are published. Of two compactions of the same files at a time the
    second is void. Returns the commit, or None if nothing was small or it was void. Old files stay on disk. The log is
    folded into one file.
    """
    row = prepare_compaction(spark, table, layout, **options)
    if row is None or not publish_compaction(spark, table, row):
        return None
    lake_log.fold(spark, table)
    if register_as:
        lake_catalog.register(spark, table, register_as, properties(spark, table))
    return row.commit
