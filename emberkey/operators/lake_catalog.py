"""Lake tables by name: an external partitioned table in the session's catalog that follows the log.

The catalog's partitions are the live folders, so a query by name prunes them like any other table's. The
log stays the truth: `sync` makes the partitions equal to it, in whatever state an earlier run left them.
"""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from emberkey.operators import lake_log

# What is recorded at creation and never changed.
RECORDED = ("partition_spec", "virtual_partitions", "sort_column", "timestamp_column")
PER_STATEMENT = 200
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder name for null


class CatalogMismatch(ValueError):
    """A table of this name has other properties."""


def identifier(name: str) -> str:
    """A lake table's name as the catalog takes it: dots and hyphens become underscores."""
    return f"`{re.sub('[.-]', '_', name)}`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession, table: str, name: str, known: dict | None) -> None:
    """Create the catalog's table with the recorded properties, unless it is there, and `sync` it.

    Without recorded properties (`auto_discover` off) nothing is registered. A table of this name with other properties is refused.
    """
    if known is None:
        return
    recorded = {k: known[k] if isinstance(known[k], str) else json.dumps(known[k]) for k in RECORDED}
    target = identifier(name)
    if not spark.catalog.tableExists(target):
        schema = T.StructType.fromJson(known["schema"])
        physical = [c for c in known["partition_spec"] if c not in known["virtual_partitions"]]
        columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name not in physical]
        columns += ["`commit` string", *[f"`{c}` {schema[c].dataType.simpleString()}" for c in physical]]
        parts = ", ".join(f"`{c}`" for c in ("commit", *physical))
        extra = ", ".join(f"{_text(k)} = {_text(v)}" for k, v in recorded.items())
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {target} ({', '.join(columns)}) USING parquet PARTITIONED BY ({parts}) "
            f"TBLPROPERTIES ({extra}) LOCATION {_text(table + '/data')}"
        )
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {target}").collect()}
    odd = [k for k in RECORDED if found.get(k) != recorded[k]]
    if odd:
        raise CatalogMismatch(f"{name} is registered with other {odd}")
    sync(spark, table, name)


def sync(spark: SparkSession, table: str, name: str) -> tuple[int, int]:
    """Add the live folders that the catalog lacks and drop those that were replaced; how many of each.

    Dropped first: a query by name in between may miss rows for a moment, but never counts any twice. `read_lake` always sees one state.
    """
    target = identifier(name)
    live = {unquote(d) for d in lake_log.live(lake_log.read(spark, table)).all_dirs()}
    have = {r["partition"] for r in spark.sql(f"SHOW PARTITIONS {target}").collect()}
    gone, new = sorted(have - live), sorted(live - have)
    for at in range(0, len(gone), PER_STATEMENT):
        some = ", ".join(_partition(d) for d in gone[at : at + PER_STATEMENT])
        spark.sql(f"ALTER TABLE {target} DROP IF EXISTS {some}")
    for at in range(0, len(new), PER_STATEMENT):
        some = " ".join(f"{_partition(d)} LOCATION {_text(f'{table}/data/{d}')}" for d in new[at : at + PER_STATEMENT])
        spark.sql(f"ALTER TABLE {target} ADD IF NOT EXISTS {some}")
    return len(new), len(gone)


def _partition(folder: str) -> str:
    """PARTITION (...) of a folder; its names escape what a path can't hold."""
    pairs = [part.split("=", 1) for part in folder.split("/")]
    values = [(k, "null" if v == NO_VALUE else _text(unquote(v))) for k, v in pairs]
    return "PARTITION (" + ", ".join(f"`{unquote(k)}` = {v}" for k, v in values) + ")"


def properties(spark: SparkSession, name: str) -> dict[str, str | list[str]]:
    """What the catalog has recorded of a table."""
    rows = spark.sql(f"SHOW TBLPROPERTIES {identifier(name)}").collect()
    found = {r["key"]: r["value"] for r in rows if r["key"] in RECORDED}
    return {k: json.loads(v) if v.startswith("[") else v for k, v in found.items()}
