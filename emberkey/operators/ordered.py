"""Per-key ordered primitives that stay parallel when one key holds most of the rows.

`over_lanes` is the entry point. Keys of ordinary size run as plain window functions, one
exchange on the key. A key with more than `hot_rows` rows is range-partitioned on
(key, order) into chunks; windows then run per (key, chunk), and one small row per chunk carries the
result across the chunk edge.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberkey.session import materialize

CHUNK = "__chunk"
HOT_ROWS = 1_000_000
# Hot keys are cut into chunks of a quarter of the limit, the size of an ordinary task.
CHUNKS_PER_LIMIT = 4


def as_list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def same(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    """Null-safe equality of `cols` on both sides."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


@dataclass(frozen=True)
class Lane:
    """Key and order of the rows; `chunked` when hot keys were cut into chunks."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunked: bool = False

    @property
    def scope(self) -> list[str]:
        return [*self.keys, CHUNK] if self.chunked else list(self.keys)

    @property
    def window(self):
        return Window.partitionBy(*self.scope).orderBy(*self.order)

    def _carry(self, df: DataFrame, summary: Column, across: Callable, name: str) -> DataFrame:
        """Attach to each row what the earlier chunks of its key hand over, as column `name`."""
        per_chunk = df.groupBy(*self.scope).agg(summary.alias("__s"))
        edge = Window.partitionBy(*self.keys).orderBy(CHUNK)
        carried = materialize(
            per_chunk.select(*self.scope, across(F.col("__s"), edge).alias(name)), "carry"
        )
        renamed = carried.select(*[F.col(c).alias(f"__r_{c}") for c in self.scope], name)
        match = reduce(
            lambda a, b: a & b,
            [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in self.keys]
            + [F.col(CHUNK) == F.col(f"__r_{CHUNK}")],
        )
        return df.join(renamed, match, "left").drop(*[f"__r_{c}" for c in self.scope])

    def previous(self, df: DataFrame, name: str, cols: dict[str, Column]) -> DataFrame:
        """Struct of `cols` on the previous row of the key; null on the first row."""
        packed = F.struct(*[c.alias(n) for n, c in cols.items()])
        if not self.chunked:
            return df.withColumn(name, F.lag(packed).over(self.window))
        df = self._carry(
            df,
            F.max_by(packed, F.struct(*self.order)),
            lambda s, edge: F.lag(s).over(edge),
            "__c",
        )
        return df.withColumn(name, F.coalesce(F.lag(packed).over(self.window), "__c")).drop("__c")

    def last(self, df: DataFrame, name: str, value: Column) -> DataFrame:
        """Latest non-null `value` up to and including the row."""
        frame = self.window.rowsBetween(Window.unboundedPreceding, 0)
        local = F.last(value, ignorenulls=True).over(frame)
        if not self.chunked:
            return df.withColumn(name, local)
        df = self._carry(
            df,
            F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order))),
            lambda s, edge: F.last(s, ignorenulls=True).over(
                edge.rowsBetween(Window.unboundedPreceding, -1)
            ),
            "__c",
        )
        return df.withColumn(name, F.coalesce(local, "__c")).drop("__c")

    def running(self, df: DataFrame, name: str, value: Column, how: Callable = F.sum) -> DataFrame:
        """Running `how` (sum or max) of `value` up to and including the row."""
        local = how(value).over(self.window.rowsBetween(Window.unboundedPreceding, 0))
        if not self.chunked:
            return df.withColumn(name, local)
        df = self._carry(
            df,
            how(value),
            lambda s, edge: how(s).over(edge.rowsBetween(Window.unboundedPreceding, -1)),
            "__c",
        )
        joined = (
            F.col("__l") + F.coalesce("__c", F.lit(0))
            if how is F.sum
            else F.greatest("__l", "__c")
        )
        return df.withColumn("__l", local).withColumn(name, joined).drop("__c", "__l")


Body = Callable[[DataFrame, Lane], DataFrame]


def hot_keys(
    df: DataFrame, keys: Sequence[str], hot_rows: int | None
) -> tuple[DataFrame, int] | None:
    """Keys with more than `hot_rows` rows, and the rows they hold together; None if there are none.

    Reads the key columns only and pre-aggregates before the shuffle. The keys stay a table; only
    their total reaches the driver.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = materialize(counts.filter(F.col("__n") > (hot_rows or HOT_ROWS)), "hot-keys")
    total = hot.agg(F.sum("__n")).first()[0]
    return (hot.drop("__n"), total) if total else None


def over_lanes(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str],
    body: Body,
    hot_rows: int | None = None,
) -> DataFrame:
    """Run `body(rows, lane)` on the ordinary keys and, chunked, on the hot keys.

    A body keeps the columns it does not know, so that bodies can be chained inside one call: hot
    keys are then looked for, and cut, only once.
    """
    keys, order = as_list(keys), as_list(order)
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return body(df, Lane(tuple(keys), tuple(order)))
    frame, rows = hot
    chunks = CHUNKS_PER_LIMIT * rows // (hot_rows or HOT_ROWS) + 1
    listed = frame  # joined by its size, which is known
    cold = df.join(listed, same(df, listed, keys), "left_anti")
    cut = (
        df.join(listed, same(df, listed, keys), "left_semi")
        .repartitionByRange(chunks, *keys, *order)
        .withColumn(CHUNK, F.spark_partition_id())
    )
    # Written once, so that the sampled range bounds are the same for every later pass.
    cut = materialize(cut, "chunks")
    return body(cold, Lane(tuple(keys), tuple(order))).unionByName(
        body(cut, Lane(tuple(keys), tuple(order), chunked=True)).drop(CHUNK)
    )

