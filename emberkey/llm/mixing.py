"""Mix sources to target weights by exact budget fitting.

Documents are counted by source and exact size. A source whose target is r whole passes and a rest
takes every document r times and fits the rest as a subset sum: most of it in proportion to the
length counts, then one more of the longest lengths, and the last words by a bounded-knapsack dynamic
programme over length counts. Which documents of a length go once more is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberkey.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
EXACT_WORDS = 16_384  # the part of a budget that the dynamic programme fits
ROWS_PER_SLICE = 512  # documents of one source and size are ranked in slices of about so many


def target_words(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Adds `target` to (source, source_size): shares of all words by weight, none above `most` times its size.

    Sources are ordered by code point, null last, and get the weights in turn. What a source may not
    take is shared again by weight, until none is above; in one step: with level l, the target is
    the lesser of the cap and l times the weight, where l is the highest of the levels reached by filling the sources
    in the order of cap over weight. One row per source passes a single window.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = totals.withColumn("place", place).withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(most))
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level)
    target = F.least("cap", F.max("level").over(everything) * F.col("weight"))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, exact: int = EXACT_WORDS) -> np.ndarray:
    """How many of each size to take, at most `counts`, so that the sum is at most `budget` and as near as found.

    `sizes` are distinct and positive. The last `exact` words are fitted by bounded-knapsack dynamic programming,
    which is exact for them.
    """
    total = int((sizes * counts).sum())
    budget = min(int(budget), total)
    if not total or budget <= 0:
        return np.zeros(len(sizes), dtype=np.int64)
    take = np.array([int(c) * budget // total for c in counts.tolist()], dtype=np.int64)
    left = budget - int((take * sizes).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if left <= exact:
            break
        if take[i] < counts[i] and sizes[i] <= left:
            take[i] += 1
            left -= int(sizes[i])
    if left > exact:  # few lengths with many documents each: more of the longest
        for i in np.argsort(-sizes, kind="stable"):
            more = min(int(counts[i] - take[i]), max(0, left - exact // 2) // int(sizes[i]))
            take[i] += more
            left -= more * int(sizes[i])
    # 0/1 items: spare documents of a size, split into powers of two.
    items: list[tuple[int, int, int]] = []
    for i in np.argsort(sizes, kind="stable"):
        size, spare, part = int(sizes[i]), int(counts[i] - take[i]), 1
        if size > left:
            break
        spare = min(spare, left // size)
        while spare > 0:
            part = min(part, spare)
            items.append((int(i), part, size * part))
            spare -= part
            part *= 2
    reached = np.zeros(left + 1, dtype=bool)
    reached[0] = True
    by = np.full(left + 1, -1, dtype=np.int64)  # the item that reached a sum first; items before it reach the rest
    for k, (_, _, words) in enumerate(items):
        if reached[left] or words > left:
            continue
        fresh = np.zeros_like(reached)
        fresh[words:] = reached[:-words]
        fresh &= ~reached
        by[fresh] = k
        reached |= fresh
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, part, words = items[by[at]]
        take[i] += part
        at -= words
    return take


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole passes and one-more counts for one source; a row for each size."""
    rows = rows.sort_values("size").reset_index(drop=True)
    whole, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    passes = int(target // whole) if whole else 0
    sizes, counts = rows["size"].to_numpy(), rows["n"].to_numpy()
    some = sizes > 0
    extra = np.zeros(len(rows), dtype=np.int64)
    extra[some] = fit_budget(sizes[some], counts[some], round(target - passes * whole))
    return pd.DataFrame({"key": rows["key"], "size": sizes, "n": counts, "source_size": whole, "target": target, "passes": passes, "extra": extra})


def mix_documents(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document; taken = copies * size.

    Null texts have size 0 and are taken 0 words; a null source is a source of its own, the last. Rows that repeat
    a doc_id are ordered by their text, so reruns agree. An empty table gives no rows. Other columns are ignored.

    Texts are read once, for sizes; all else works on narrow rows. Only length counts of one source
    meet in a task: at most the square root of twice its words, far fewer in practice. Ranking is by slices
    of about `ROWS_PER_SLICE` documents, so a source with a third of all rows is spread.
    """
    size = F.regexp_count(F.col("text"), F.lit(WORD))
    narrow = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"),
            F.coalesce(size, F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"),
        ),
        "sizes",
    )
    lengths = materialize(narrow.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "lengths")
    totals = lengths.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = target_words(totals.select("source", "source_size"), weights, most)
    targets = targets.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    plan = materialize(
        lengths.join(targets, "key")
        .groupBy("key")
        .applyInPandas(_plan, "key string, size long, n long, source_size long, target double, passes long, extra long"),
        "plan",
    )
    slices = F.ceil(F.col("n") / ROWS_PER_SLICE)
    share = F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))
    planned = materialize(narrow.join(plan, ["key", "size"]).withColumn("slice", F.floor(share * slices)), "planned")
    upto = Window.partitionBy("key", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = planned.groupBy("key", "size", "slice").agg(F.count("*").alias("here"))
    before = before.withColumn("before", F.coalesce(F.sum("here").over(upto), F.lit(0))).drop("here")
    place = F.row_number().over(Window.partitionBy("key", "size", "slice").orderBy("draw", "doc_id"))
    ranked = planned.join(before, ["key", "size", "slice"]).withColumn("place", place + F.col("before"))
    copies = F.col("passes") + F.when(F.col("place") <= F.col("extra"), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long")
    return ranked.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
