"""Centroid clustering in whole numbers, with a LAESA table of pivot distances.

Each vector's distances from a few fixed pivots are measured once and written with it. In a round every centroid's
distances from the same pivots are known too, and |d(v, p) - d(c, p)| is at most d(v, c) for each pivot p. So a
vector first meets the centroid with the smallest such bound exactly, and then those whose bound isn't beyond that distance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import materialize, ship

DIMS, SCALE, CENTROIDS, ROUNDS, SALT = 64, 256, 40, 5, "2"
#: Pivots, and the rows of smallest hash that they are picked from.
PIVOTS, PIVOT_SAMPLE = 16, 2_048
#: Components beyond this are refused: their squared distances would leave 64 bits.
LARGEST = 1 << 27
#: Rows that are compared at once.
BLOCK = 8_192


def kept(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component of the vectors with exactly dims components, none null or non-finite.

    Ids may be null or repeat: each row is a vector. Components beyond LARGEST raise an error when they are read.
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    fine = x.isNotNull() & (F.size(x) == dims) & ~F.coalesce(bad, F.lit(False))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    fits = F.forall(x, lambda e: F.abs(e.cast("double") * scale) <= LARGEST)
    return embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fits, whole).otherwise(F.raise_error("a component is too large").cast("array<bigint>")).alias("v"))


def start_order(salt: str = SALT) -> list[Column]:
    """Ascending sha256 of salt:vec_id, a null id as nothing; rows of one id by their components."""
    return [F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), F.col("v")]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of a from the same rows of b."""
    away = a - b
    return (away * away).sum(-1)


def _from_each(v: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of all rows from all points, each within a millionth."""
    return np.sqrt(np.stack([squared(v, p[None, :]) for p in points], 1).astype(np.float64)) if len(points) else np.zeros((len(v), 0))


def pick_pivots(vectors: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """Farthest-first pivots out of PIVOT_SAMPLE rows. Any rows give the same clusters; these leave fewer comparisons."""
    sample = np.array([r["v"] for r in vectors.select("v").orderBy(F.xxhash64("vec_id", "v"), "v").limit(PIVOT_SAMPLE).collect()], np.int64)
    chosen = [0]
    away = squared(sample, sample[:1])
    while len(chosen) < min(count, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, squared(sample, sample[chosen[-1]][None, :]))
    return sample[chosen]


def with_pivot_distances(vectors: DataFrame, points: np.ndarray) -> DataFrame:
    """The table that all rounds read: (vec_id, v, far), far the distances from the pivots."""

    def measure(batches):
        for batch in batches:
            if len(batch):
                far = _from_each(_matrix(batch.column(1)), points)
                yield pa.record_batch([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), far.shape[1]).cast(pa.list_(pa.float64()))], ["vec_id", "v", "far"])

    return materialize(vectors.select("vec_id", "v").mapInArrow(measure, "vec_id long, v array<long>, far array<double>"), "pivot-distances")


def nearest(v: np.ndarray, far: np.ndarray, centroids: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (ties: the smaller number), its exact squared distance, and how many exact distances that took.

    far, reach: distances of vectors and of centroids from the pivots.
    """
    bound = np.zeros((len(v), len(centroids)))
    for p in range(far.shape[1]):
        np.maximum(bound, np.abs(far[:, p, None] - reach[None, :, p]), out=bound)
    first = bound.argmin(1)
    best, own = first.copy(), squared(v, centroids[first])
    # Roots and differences are off by far less than the slack; no centroid at the same distance is lost.
    limit = np.sqrt(own.astype(np.float64)) * (1 + 1e-9) + 1e-6
    rows, numbers = np.nonzero(bound <= limit[:, None])
    new = numbers != first[rows]
    rows, numbers = rows[new], numbers[new]
    for at in range(0, len(rows), 1 << 18):
        i, c = rows[at : at + (1 << 18)], numbers[at : at + (1 << 18)]
        d = squared(v[i], centroids[c])
        order = np.lexsort((c, d, i))
        i, c, d = i[order], c[order], d[order]
        top = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        i, c, d = i[top], c[top], d[top]
        better = (d < own[i]) | (d == own[i]) & (c < best[i])
        best[i[better]], own[i[better]] = c[better], d[better]
    return best, own, len(v) + len(rows)


def _assigned(batches, centroids: np.ndarray, reach: np.ndarray):
    """(ids, v, nearest centroids, squared distances) of runs of table rows."""
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            part = batch.slice(at, BLOCK)
            v = _matrix(part.column(1))
            far = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            best, own, _ = nearest(v, far, centroids, reach)
            yield part.column(0), v, best, own


def assign(table: DataFrame, centroids: np.ndarray, points: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance). The centroids, a few numbers for each cluster, go with the task."""
    reach = _from_each(centroids, points)

    def work(batches):
        for ids, _, best, own in _assigned(batches, centroids, reach):
            yield pa.record_batch([ids, pa.array(best.astype(np.int32)), pa.array(own)], ["vec_id", "cluster", "distance"])

    return table.mapInArrow(work, "vec_id long, cluster int, distance long")


def cluster_sums(table: DataFrame, centroids: np.ndarray, points: np.ndarray) -> DataFrame:
    """(cluster, n, s): how many vectors are nearest to each centroid, and their componentwise sum. A task adds up its own first."""
    reach, dims = _from_each(centroids, points), centroids.shape[1]

    def work(batches):
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        for _, v, best, _ in _assigned(batches, centroids, reach):
            counts += np.bincount(best, minlength=len(centroids))
            np.add.at(sums, best, v)
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    own = table.mapInArrow(work, "cluster int, n long, s array<long>")
    return own.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dims)]).alias("s"))


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each row of vectors (vec_id, v), v of one length.

    The first `count` rows by start_order are the centroids (all rows, if there are fewer; rows of equal components make equal
    centroids, of which the smaller number gets the vectors). Each round assigns every vector and replaces a centroid by the floor of
    its vectors' mean; one without vectors stays. Only centroids, counts and sums of a cluster reach the driver. No rows, no result.
    """
    spark = vectors.sparkSession
    ship(spark)
    vectors = materialize(vectors, "vectors")
    start = vectors.orderBy(*start_order(salt)).limit(count).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in start], np.int64)
    points = pick_pivots(vectors, pivots)
    table = with_pivot_distances(vectors, points)
    for _ in range(rounds):
        centroids = centroids.copy()
        for r in cluster_sums(table, centroids, points).collect():
            centroids[r["cluster"]] = [s // r["n"] for s in r["s"]]
    found = materialize(assign(table, centroids, points), "assigned")
    held = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in held}
    told = F.broadcast(spark.createDataFrame([(c, d, sum(held.values()), digest[c]) for c, d in held.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.join(told, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(dims: int = DIMS, scale: int = SCALE, count: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT) -> str:
    """DuckDB SQL for the same rows where ids don't repeat: one pair of CTEs for each round."""
    away = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(k.v, c.v)])"
    parts = [
        f"k AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings"
        f" WHERE len(embedding) = {dims} AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{salt}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM k) ORDER BY h, v LIMIT {count})",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT r, vec_id, v, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS n"
            f" FROM (SELECT k.r, k.vec_id, k.v, c.c, CAST({away} AS BIGINT) AS d FROM k CROSS JOIN c{i} c)) WHERE n = 1)"
        )
        if i < rounds:
            mean = "[" + ", ".join(f"CAST((sum(v[{j}]) - (((sum(v[{j}]) % count(*)) + count(*)) % count(*))) // count(*) AS BIGINT)" for j in range(1, dims + 1)) + "]"
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, {mean} AS v FROM a{i} GROUP BY c) m ON o.c = m.c)")
    last = rounds
    return (
        f"WITH {', '.join(parts)} SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{last} a JOIN c{last} c ON a.c = c.c"
    )
