"""Approximate nearest neighbours by largest inner product: balanced posting lists.

Vectors are lifted by one component so that the largest inner product is the least distance. A bounded
sample is halved again and again, each half of equal size, until the parts are as small as a list shall
be; their means are the centroids. A centroid graph in memory finds a vector's nearest centroids: a
vector goes to the nearest list and, near a boundary, to further ones almost as near. A query
reads the lists whose centroid isn't farther than a ratio of the nearest one's distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberkey.llm.common import arrow_rows, materialize

LIST_VECTORS = 256  # wanted length of a list, before copies at boundaries
MOST_LISTS = 4096  # bounds what is broadcast: lists * dimensions * 8 bytes
SAMPLE_VECTORS = 32_768  # to place centroids by; every vector is indexed
COPIES = 4  # lists that a vector may be in
COPY_RATIO = 1.10  # ... if their centroids are nearer than so many times the nearest one
SEARCH_RATIO = 1.17  # lists that a query reads: distance to their centroid, against the nearest one
SEARCH_LISTS = 1024  # centroids that a query looks at first; further ones if all of these are near enough
SLICE_VECTORS = 2048  # a longer list is dealt to several tasks
NEIGHBOURS = 24  # edges of a centroid in the graph


def centroids_of(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of equal parts of `x`, about `lists` of them, by halving along the line between two means."""
    parts = [np.arange(len(x))]
    while len(parts) < lists and max(map(len, parts)) > 1:
        halves = []
        for part in parts:
            if len(part) < 2:
                halves.append(part)
                continue
            y, a, b, half = x[part], x[part[0]], x[part[len(part) // 2]], len(part) // 2
            for _ in range(6):
                order = np.argsort(y @ (a - b), kind="stable")
                b, a = y[order[:half]].mean(0), y[order[half:]].mean(0)
            halves += [part[order[:half]], part[order[half:]]]
        parts = halves
    return np.array([x[p].mean(0) for p in parts])


class CentroidGraph:
    """Centroids, each linked to its nearest ones and to a few far ones; best-first search for many vectors at once."""

    def __init__(self, centroids: np.ndarray, far: int = 4, seed: int = 5):
        self.c = centroids
        self.sq = (centroids**2).sum(1)
        n, near = len(centroids), min(NEIGHBOURS, len(centroids) - 1)
        rng = np.random.default_rng(seed)
        links = np.zeros((n, near + (far if n > 1 else 0)), dtype=np.int64)
        for lo in range(0, n, 512):
            d = self.sq - 2 * centroids[lo : lo + 512] @ centroids.T
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            links[lo : lo + 512, :near] = np.argsort(d, axis=1, kind="stable")[:, :near]
        if n > 1:
            links[:, near:] = (np.arange(n)[:, None] + rng.integers(1, n, (n, far))) % n
        self.links = links
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def nearest(self, x: np.ndarray, k: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of about the k nearest centroids to each row, nearest first; -1 where fewer were met."""
        n, k = len(x), min(k, len(self.c))
        rows = np.arange(n)[:, None]
        xs = (x**2).sum(1)[:, None]

        def distance(ids: np.ndarray) -> np.ndarray:
            return np.maximum(0, xs + self.sq[ids] - 2 * np.einsum("nd,nkd->nk", x, self.c[ids]))

        width = max(k, len(self.entries))
        ids = np.full((n, width), -1, dtype=np.int64)
        d = np.full((n, width), np.inf)
        ids[:, : len(self.entries)] = self.entries
        d[:, : len(self.entries)] = distance(ids[:, : len(self.entries)])
        seen = np.zeros((n, len(self.c)), dtype=bool)
        seen[:, self.entries] = True
        opened = np.zeros((n, len(self.c)), dtype=bool)
        while True:
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
            closed = ~np.isfinite(d) | opened[rows, np.maximum(ids, 0)]
            if closed.all():
                break
            pick = np.argsort(closed, axis=1, kind="stable")[:, :at_once]  # the nearest ones that aren't opened yet
            some = np.take_along_axis(ids, pick, 1)
            usable = ~np.take_along_axis(closed, pick, 1)
            opened[np.broadcast_to(rows, some.shape)[usable], some[usable]] = True
            new = self.links[np.maximum(some, 0)]
            fresh = np.broadcast_to(usable[:, :, None], new.shape).reshape(n, -1).copy()
            new = new.reshape(n, -1)
            fresh &= ~seen[rows, new]
            seen[np.broadcast_to(rows, new.shape)[fresh], new[fresh]] = True
            nd = np.where(fresh, distance(new), np.inf)
            # The same centroid may come from two links of one step.
            by = np.argsort(np.where(fresh, new, -1), axis=1, kind="stable")
            new, nd = np.take_along_axis(new, by, 1), np.take_along_axis(nd, by, 1)
            twice = np.zeros_like(fresh)
            twice[:, 1:] = (new[:, 1:] == new[:, :-1]) & np.isfinite(nd[:, 1:]) & np.isfinite(nd[:, :-1])
            nd[twice] = np.inf
            ids, d = np.hstack((ids, new)), np.hstack((d, nd))
        ids[~np.isfinite(d)] = -1
        return ids[:, :k], np.sqrt(d[:, :k])


def near_lists(graph: CentroidGraph, x: np.ndarray, ratio: float, first: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) for the lists whose centroid is at most `ratio` times as far as the row's nearest one.

    The search starts with the `first` nearest centroids and is widened for rows that all of these fit, up to all centroids; at
    most `most` lists are given, if that is set.
    """
    ids, d = graph.nearest(x, first)
    keep = (ids >= 0) & (d <= d[:, :1] * ratio + 1e-12)
    wider = np.flatnonzero(keep[:, -1]) if most is None and first < len(graph.c) else np.zeros(0, np.int64)
    keep[wider] = False
    row, col = np.nonzero(keep[:, :most])
    lists = ids[row, col]
    if len(wider):
        more, further = near_lists(graph, x[wider], ratio, 4 * first)
        row, lists = np.concatenate((row, wider[more])), np.concatenate((lists, further))
    return row, lists


def _lift(x: np.ndarray, top: float, query: bool) -> np.ndarray:
    """One more component: the rest up to the largest norm for vectors, 0 for queries."""
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, top * top - (x**2).sum(1)))
    return np.hstack((x, rest[:, None]))


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1)


def _take(rows: Iterator[tuple], n: int) -> Iterator[list[tuple]]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held


def search(vectors: DataFrame, every: int = 20, k: int = 20, search_ratio: float = SEARCH_RATIO, list_vectors: int = LIST_VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of (vec_id, embedding) whose id is divisible by `every`.

    Nearest means the largest inner product, ties go to the smaller id; a query's own id is left
    out. Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without
    an id. A product needs vectors of one length, so each length that occurs among queries (commonly one) is searched by
    itself. Rows that repeat both id and vector count once. An empty table gives no rows; a query without other vectors none.

    Equal vectors are one entry with its k + 1 smallest ids, which is all that ties can need, so many copies make
    no long list and no repeated work. Longer lists are cut into slices. Queries meet lists
    in one shuffle on (list, slice); a task holds one slice and a few hundred queries.
    """
    spark = vectors.sparkSession
    emb = F.col("embedding").cast("array<double>")
    sound = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), emb.alias("e")).where("vec_id is not null and e is not null").where(sound)
    lengths = rows.where(F.col("vec_id") % every == 0).select(F.size("e").alias("n")).distinct().orderBy("n").collect()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_search(rows.where(F.size("e") == n), n, every, k, search_ratio, list_vectors) for (n,) in lengths]
    return reduce(DataFrame.unionByName, found) if found else none


def _search(rows: DataFrame, dims: int, every: int, k: int, search_ratio: float, list_vectors: int) -> DataFrame:
    """The same for sound vectors (vec_id, e) of `dims` components."""
    spark = rows.sparkSession
    rows = rows.withColumns({"k1": F.xxhash64("e"), "k2": F.xxhash64(F.lit(1), "e")})
    smallest = F.dense_rank().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    few = rows.withColumn("r", smallest).where(F.col("r") <= k + 1)
    grouped = few.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("e").alias("e"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims)
            norm = np.sqrt((flat**2).sum(1))
            point = pa.array([v.tobytes() for v in np.ascontiguousarray(flat)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), point, pa.array(norm)], names=["k1", "k2", "ids", "point", "norm"])

    points = grouped.select("k1", "k2", "ids", "e").mapInArrow(packed, "k1 long, k2 long, ids array<long>, point binary, norm double")
    points = materialize(points, "points")
    n, top = points.agg(F.count("*"), F.max("norm")).first()
    lists = int(min(MOST_LISTS, max(1, n // list_vectors)))
    sample = points.orderBy(F.xxhash64("k1", "k2"), "k1").limit(SAMPLE_VECTORS).select("point").toPandas()["point"]  # bounded
    graph = CentroidGraph(centroids_of(_lift(_matrix([bytes(p) for p in sample]), top, False), lists))
    shipped = spark.sparkContext.broadcast((graph, float(top)))

    def place(query: bool) -> DataFrame:
        ratio, first, most = (search_ratio, SEARCH_LISTS, None) if query else (COPY_RATIO, 16, COPIES)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph, top = shipped.value
            for held in _take(arrow_rows(batches), 512):
                at, lists = near_lists(graph, _lift(_matrix([p for _, p in held]), top, query), ratio, first, most)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.astype(np.int32)), pa.array([held[i][0] for i in at], pa.int64()), pa.array([held[i][1] for i in at], pa.binary())],
                    names=["list", "entry", "point"],
                )

        chosen = points.where("asks") if query else points
        return chosen.select("rep_key", "point").mapInArrow(work, "list int, entry long, point binary")

    # A query's vector may have all its small ids elsewhere, so queries mark their entry by key.
    asking = rows.where(F.col("vec_id") % every == 0).select("k1", "k2", "vec_id").distinct()
    asking = materialize(asking, "asking")
    marked = points.withColumn("rep_key", F.monotonically_increasing_id())
    marked = marked.join(asking.select("k1", "k2").distinct().withColumn("asks", F.lit(True)), ["k1", "k2"], "left")
    points = materialize(marked.withColumn("asks", F.coalesce("asks", F.lit(False))), "entries")
    postings = materialize(place(False), "postings")
    # As many numbers as there are lists, at most MOST_LISTS.
    slices = {r[0]: -(-r[1] // SLICE_VECTORS) for r in postings.groupBy("list").count().collect()}
    cut = np.array([slices.get(i, 0) for i in range(len(graph.c))])

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, query = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            entry = b.column(2).to_numpy()
            times = np.where(query, cut[of], 1)
            at = np.repeat(np.arange(len(of)), times)
            each = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            number = np.where(query[at], each, entry[at] % np.maximum(1, cut[of[at]]))
            yield pa.RecordBatch.from_arrays([pa.array(of[at]), pa.array(number.astype(np.int32)), pa.array(query[at]), pa.array(entry[at]), b.column(3).take(pa.array(at))], names=["list", "slice", "query", "entry", "point"])

    both = postings.withColumn("query", F.lit(False)).unionByName(place(True).withColumn("query", F.lit(True)))
    both = both.select("list", "query", "entry", "point").mapInArrow(sliced, "list int, slice int, query boolean, entry long, point binary")
    both = both.repartition("list", "slice").sortWithinPartitions("list", "slice", "query")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            q = np.repeat(np.fromiter(best, np.int64, len(best)), [len(v[0]) for v in best.values()])
            e = np.concatenate([v[0] for v in best.values()]) if best else np.zeros(0, np.int64)
            s = np.concatenate([v[1] for v in best.values()]) if best else np.zeros(0)
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(e), pa.array(s)], names=["q", "entry", "score"])

        def runs() -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple]]]:
            key, members, asked, ids, matrix = None, [], [], None, None
            for li, sl, query, entry, point in arrow_rows(batches):
                if (li, sl) != key:
                    if asked:
                        yield ids, matrix, asked
                    key, members, asked, ids = (li, sl), [], [], None
                if not query:
                    members.append((entry, point))
                elif members:
                    if ids is None:
                        ids, matrix = np.array([m[0] for m in members]), _matrix([m[1] for m in members])
                        members = members[:1]
                    asked.append((entry, point))
                    if len(asked) == 256:
                        yield ids, matrix, asked
                        asked = []
            if asked:
                yield ids, matrix, asked

        for ids, matrix, asked in runs():
            scores = _matrix([p for _, p in asked]) @ matrix.T
            for (q, _), row in zip(asked, scores, strict=True):
                e, s = (ids, row) if q not in best else (np.concatenate((best[q][0], ids)), np.concatenate((best[q][1], row)))
                e, first_at = np.unique(e, return_index=True)
                s = s[first_at]
                if len(e) > k + 1:
                    line = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                    e, s = e[s >= line], s[s >= line]  # all that tie with the last
                best[q] = (e, s)
            if len(best) > 20_000:
                yield flush()
        yield flush()

    found = both.mapInArrow(scan, "q long, entry long, score double").groupBy("q", "entry").agg(F.max("score").alias("score"))
    found = found.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.col("score").desc()))).where(F.col("r") <= k + 1)
    ids = points.select(F.col("rep_key").alias("entry"), "ids")
    hits = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("i")))
    near = found.join(ids, "entry").select("q", F.explode(hits).alias("h"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("h"))).where(F.col("r") <= k + 1)
    near = near.groupBy("q").agg(F.array_sort(F.collect_list("h")).alias("hits"))
    who = asking.join(points.where("asks").select("k1", "k2", F.col("rep_key").alias("q")), ["k1", "k2"])
    own = F.slice(F.filter("hits", lambda h: h["i"] != F.col("vec_id")), 1, k)
    each = who.join(near, "q").select(F.col("vec_id").alias("query_id"), F.posexplode(own).alias("p", "h"))
    return each.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.i").alias("vec_id"), (-F.col("h.s")).alias("score"))
