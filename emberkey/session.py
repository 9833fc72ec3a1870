"""Session settings, shared working folders and durations."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "emberkey", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on; `conf` wins over the defaults.

    Keys of `conf` use `_` for `.`, as in ``spark_sql_shuffle_partitions=8``.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
        **{k.replace("_", "."): str(v) for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def millis(duration: timedelta | int) -> int:
    """A duration as whole milliseconds; plain integers are milliseconds already."""
    if isinstance(duration, timedelta):
        return int(duration / timedelta(milliseconds=1))
    return int(duration)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by `spark.checkpoint.dir`.

    In local mode, where driver and executors are one process, a session that names none gets a temporary
    folder, which goes when Python ends. Anywhere else the name is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="emberkey-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives Spark the true size, so that a later
    join broadcasts it only when it is in fact small.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
