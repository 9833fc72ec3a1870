"""Centroid clustering in whole numbers, nearest centroids found by a tournament of bisectors.

x is nearer to centroid j than to i < j exactly if x lies beyond their bisector: 2 x.(cj - ci) > |cj|^2 - |ci|^2.
Normals 2 (cj - ci) and thresholds are integers and made once a round, so each of the k - 1 tests of a vector is one
scalar product and a sign, exact, and zero leaves the smaller number in. Only the winner's distance is worked out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberkey.llm.common import materialize

BLOCK_ROWS = 4096
LARGEST = (1 << 63) - 1


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """normals[i, j] and thresholds[i, j]: j > i beats i at x if normals[i, j].x > thresholds[i, j]."""
    norms = (centroids * centroids).sum(axis=1)
    return 2 * (centroids[None, :, :] - centroids[:, None, :]), norms[None, :] - norms[:, None]


def tournament(x: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each row of x; the smallest of several."""
    winner = np.zeros(len(x), dtype=np.int64)
    for j in range(1, len(normals)):
        beaten = np.einsum("nd,nd->n", x, normals[winner, j]) > thresholds[winner, j]
        winner[beaten] = j
    return winner


def _vectors(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            yield part, part.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def whole(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v) of the rows with `dims` components, none null or non-finite, as v = floor(scale * x).

    Rows with a component beyond +-sqrt(2**60 / dims) after scaling (2**27 for 64 components, 2 million before) are left out as well: no long holds squared
    distances between such.
    """
    most = math.isqrt((1 << 60) // dims)
    x = F.col("embedding").cast("array<double>")
    fit = F.forall(x, lambda c: F.coalesce(F.abs(c * scale) < most, F.lit(False)))  # false for NaN and infinities too
    kept = vectors.where((F.size(x) == dims) & fit)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that `whole` keeps.

    The first centroids are those with the least sha256 of `seed:vec_id`, null ids last, and of equal ids the lesser vector; fewer
    vectors than k make fewer centroids. Repeated rows count each, extra columns are ignored, an empty table gives no rows.
    An inertia that no long holds is null. A round is one pass that sums up each task's vectors by cluster, so that a
    task sends at most k rows however uneven the clusters are; no vector is shuffled, and k centroids reach the driver.
    """
    spark = vectors.sparkSession
    rows = materialize(whole(vectors, dims, scale), "vectors")
    lot = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.orderBy(lot.asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in chosen], dtype=np.int64).reshape(-1, dims)

    def nearest(make, schema: str) -> DataFrame:
        """`make(batch, vectors, winners, centroids)` over all blocks, with the centroids as they are now."""
        now = centroids.copy()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            normals, thresholds = bisectors(now)
            yield from make(((part, x, tournament(x, normals, thresholds)) for part, x in _vectors(batches, dims)), now)

        return rows.mapInArrow(work, schema)

    def sums(blocks, now: np.ndarray) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(now), np.zeros(len(now), dtype=np.int64)
        for _, x, winner in blocks:
            count += np.bincount(winner, minlength=len(now))
            for c in np.unique(winner):
                total[c] += x[winner == c].sum(axis=0)
        met = np.flatnonzero(count)
        columns = [pa.array(met), pa.array(count[met]), pa.array(total[met].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "total"])

    def distances(blocks, now: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part, x, winner in blocks:
            apart = x - now[winner]
            columns = [part.column("vec_id"), pa.array(winner.astype(np.int32)), pa.array((apart * apart).sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    for _ in range(rounds if len(centroids) else 0):
        added = [F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"d{d}") for d in range(dims)]
        found = nearest(sums, "cluster long, n long, total array<long>").groupBy("cluster").agg(F.sum("n").alias("n"), *added)
        for r in found.collect():  # at most k
            centroids[r["cluster"]] = [int(r[f"d{d}"]) // r["n"] for d in range(dims)]

    out = nearest(distances, "vec_id long, cluster int, distance long") if len(centroids) else rows.selectExpr("vec_id", "0 AS cluster", "0L AS distance")
    out = materialize(out, "assigned")
    spread = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    held = lambda n: n if n <= LARGEST else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, held(d), held(sum(spread.values())), digest[c]) for c, d in spread.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row for each of the k centroids.
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """DuckDB SQL for the same rows; every vector meets every centroid."""
    most = math.isqrt((1 << 60) // dims)
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims}
  AND len(list_filter(embedding, lambda x: coalesce(isfinite(x) AND abs({scale} * CAST(x AS DOUBLE)) < {most}, false))) = {dims})""",
        f"""c0 AS MATERIALIZED (SELECT c, v FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS c FROM kept) WHERE c < {k})""",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (SELECT r, m % {k} AS c, m // {k} AS d FROM (SELECT r, min({k} * list_sum(
  list_transform(list_zip(kept.v, c{n}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT + c) AS m FROM kept, c{n} GROUP BY r))"""
        )
        if n < rounds:
            steps.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT c, coalesce(w, v) AS v FROM c{n} LEFT JOIN (SELECT c, list(m ORDER BY i) AS w FROM (
  SELECT c, i, (s - ((s % n) + n) % n) // n AS m FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
  SELECT c, unnest(v) AS x, unnest(range({dims})) AS i FROM kept JOIN a{n} USING (r)) GROUP BY c, i)) GROUP BY c) USING (c))"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (c)"""
