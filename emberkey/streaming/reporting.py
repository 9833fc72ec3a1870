"""What streams say of their stores: one record of size and keys, told beside the main flow and never failing it."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from emberkey.operators import lake_log
from emberkey.streaming.processor import store_rows

log = logging.getLogger(__name__)
RECORD = "label string, kind string, mode string, cg string, bytes bigint, exact_keys bigint, est_keys bigint"
Sink = Callable[[dict], None]


class StoreListener(StreamingQueryListener):
    """Tells `sink` after every batch what the query's stores hold, by the query's own account.

    A sink that fails is logged; the stream doesn't notice.
    """

    def __init__(self, sink: Sink, label: str, mode: str, cg: str):
        self.sink, self.named = sink, {"label": label, "mode": mode, "cg": cg}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        stores = event.progress.stateOperators
        if not stores:
            return
        size = {"bytes": sum(s.memoryUsedBytes for s in stores), "est_keys": max(s.numRowsTotal for s in stores)}
        try:
            self.sink({**self.named, "kind": "progress", **size, "exact_keys": None})
        except Exception as problem:
            log.warning("store record not written: %s", problem)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


@contextmanager
def reported(spark: SparkSession, sink: Sink, label: str, mode: str, cg: str) -> Iterator[None]:
    """Streams that run inside are reported to `sink`; events still on their way at the end are waited for."""
    listener = StoreListener(sink, label, mode, cg)
    spark.streams.addListener(listener)
    try:
        yield
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)


def to_table(spark: SparkSession, path: str) -> Sink:
    """A sink that puts each record into a file of its own, whole or not at all."""

    def write(record: dict) -> None:
        lake_log.put_once(spark, f"{path}/{uuid.uuid4().hex}.json", json.dumps(record) + "\n")

    return write


def final_record(spark: SparkSession, checkpoint: str, path: str, label: str, mode: str, cg: str) -> dict:
    """Bytes and estimated keys as last reported below `path`, and the exact number of keys, counted in the checkpoint."""
    rows = spark.read.schema(RECORD).json(path).filter("kind = 'progress'")
    last = rows.selectExpr("max_by(bytes, est_keys) AS bytes", "max(est_keys) AS est_keys").first()
    exact = store_rows(spark, checkpoint).count()
    return {"label": label, "kind": "final", "mode": mode, "cg": cg, "bytes": last["bytes"], "exact_keys": exact, "est_keys": last["est_keys"]}
