"""Deadlines handed from chunk to chunk of one hot key.

Where a segment runs over several chunks, a chunk can be folded only once the deadline of the entry
stored by the chunks before it is known. Each chunk therefore states, for every deadline that could
come in, the deadline that goes out: a step function. Functions of neighbours are composed in pairs,
then pairs of pairs, and the known deadline of the segment's start is handed down the same tree. So a
segment of n chunks takes 2 * log2(n) rounds of joins and aggregates on the executors; what reaches
the driver is the depth of the tree.

A deadline that comes in is at most a ttl past the first row it meets, so a function has no more
steps than there are distinct milliseconds in one ttl, nor than its rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberkey.session import materialize

STEPS = "struct<starts: array<bigint>, outs: array<bigint>>"
POS = "__pos"


def null_safe_join(left: DataFrame, right: DataFrame, cols: list[str], how: str) -> DataFrame:
    """Join on null-safe equality of `cols`, keeping them once (from the left)."""
    other = right.select(
        *[F.col(c).alias(f"__o_{i}") for i, c in enumerate(cols)],
        *[c for c in right.columns if c not in cols],
    )
    match = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__o_{i}")) for i, c in enumerate(cols)]
    )
    return left.join(other, match, how).drop(*[f"__o_{i}" for i in range(len(cols))])


def step_function(clocks: np.ndarray, owns: np.ndarray, ttl_ms: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, outs) of a chunk's rows in order: a deadline up to starts[i] goes out as outs[i].

    A deadline past the last start goes out as the one more entry of `outs`, or, where there is none,
    as it came in.
    """
    size = len(clocks)
    if size == 0:
        return clocks, clocks
    hop = np.maximum(np.arange(1, size + 1), np.searchsorted(clocks, owns + ttl_ms))
    last = np.arange(size)
    while (inside := hop < size).any():  # double the hops until all have left the chunk
        last = np.where(inside, np.append(last, 0)[hop], last)
        hop = np.append(hop, size)[hop]
    window = int(np.searchsorted(clocks, clocks[0] + ttl_ms))
    return merged(clocks[:window], owns[last[: window + 1]] + ttl_ms)


def merged(starts: np.ndarray, outs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same function without steps that the next one covers."""
    n = len(starts)
    keep = np.append(outs[1:n] != outs[: n - 1], True)[:n]
    return starts[keep], np.concatenate((outs[:n][keep], outs[n:]))


def through(starts: np.ndarray, outs: np.ndarray, deadlines: np.ndarray) -> np.ndarray:
    """The deadlines that go out for those that come in."""
    if len(outs) == 0:
        return deadlines
    at = np.searchsorted(starts, deadlines)
    return np.where(at < len(outs), outs[np.minimum(at, len(outs) - 1)], deadlines)


def composed(first: tuple, then: tuple) -> tuple[np.ndarray, np.ndarray]:
    """`then` after `first`."""
    starts, outs = first[0], through(*then, first[1])
    if len(outs) == len(starts):  # a deadline past the rows of `first` comes to `then` as it is
        starts, outs = np.concatenate((starts, then[0])), np.concatenate((outs, then[1]))
    return merged(starts, outs)


def _array(cell) -> np.ndarray:
    return np.zeros(0, np.int64) if cell is None else np.asarray(cell, dtype=np.int64)


def _frame(functions: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"starts": [f[0] for f in functions], "outs": [f[1] for f in functions]})


def _chunk_function(ttl_ms: int):
    @F.pandas_udf(STEPS)
    def one(clocks: pd.Series, owns: pd.Series) -> pd.DataFrame:
        return _frame([step_function(_array(c), _array(o), ttl_ms) for c, o in zip(clocks, owns, strict=True)])

    return one


def _compose() -> Column:
    @F.pandas_udf(STEPS)
    def both(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = zip(a, b, c, d, strict=True)
        return _frame([composed((_array(i), _array(j)), (_array(k), _array(m))) for i, j, k, m in rows])

    return both("left.starts", "left.outs", "right.starts", "right.outs")


def _through_left() -> Column:
    @F.pandas_udf("bigint")
    def after(starts: pd.Series, outs: pd.Series, deadline: pd.Series) -> pd.Series:
        rows = zip(starts, outs, deadline.to_numpy(), strict=True)
        return pd.Series([int(through(_array(s), _array(o), np.array([d]))[0]) for s, o, d in rows], dtype="int64")

    return after("left.starts", "left.outs", "__known")


def carried_deadlines(rows: DataFrame, lane, ts: str, ttl_ms: int, value: str) -> DataFrame | None:
    """(scope, segment, `__known`): the deadline at the start of each chunk a segment runs into."""
    from emberkey.operators.ordered import CHUNK

    segment = [*lane.keys, "__seg"]
    item = F.struct(
        F.struct(*lane.order).alias("at"), F.col("__clock").alias("c"), F.col(ts).alias("own")
    )
    crossing = materialize(
        rows.filter(F.col(CHUNK) > F.col("__seg.chunk")).select(*segment).distinct(), "crossing"
    )
    # Chunks are numbered along the order, so those of a segment follow each other; one without rows is left out.
    chunks = (
        null_safe_join(rows, crossing, segment, "left_semi")
        .groupBy(*segment, (F.col(CHUNK) - F.col("__seg.chunk")).cast("bigint").alias(POS))
        .agg(F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), item))).alias("__a"))
    )
    level = materialize(
        chunks.select(*segment, POS, _chunk_function(ttl_ms)("__a.c", "__a.own").alias("f")), "steps"
    )
    most = level.agg(F.max(POS)).first()[0]
    if most is None:
        return None
    odd = F.col(POS) % 2 == 1
    pairs = []
    for _ in range(most.bit_length()):
        pair = level.groupBy(*segment, F.shiftright(POS, 1).alias("__up")).agg(
            F.first(F.when(~odd, F.col("f")), ignorenulls=True).alias("left"),
            F.first(F.when(odd, F.col("f")), ignorenulls=True).alias("right"),
        )
        pairs.append(materialize(pair.withColumnRenamed("__up", POS), "pairs"))
        level = materialize(pairs[-1].select(*segment, POS, _compose().alias("f")), "steps")
    known = crossing.select(
        *segment, F.lit(0).cast("bigint").alias(POS), (F.col("__seg.own") + ttl_ms).alias("__known")
    )
    for pair in reversed(pairs):
        down = null_safe_join(pair, known, [*segment, POS], "inner").withColumn("__next", _through_left())
        halves = F.array(
            F.struct((F.col(POS) * 2).alias("p"), F.col("__known").alias("d"), F.col("left").isNotNull().alias("is")),
            F.struct((F.col(POS) * 2 + 1).alias("p"), F.col("__next").alias("d"), F.col("right").isNotNull().alias("is")),
        )
        down = down.select(*segment, F.explode(halves).alias("h")).filter("h.is")
        known = materialize(
            down.select(*segment, F.col("h.p").alias(POS), F.col("h.d").alias("__known")), "known"
        )
    return known.select(*segment, (F.col(POS) + F.col("__seg.chunk")).cast("int").alias(CHUNK), "__known")
