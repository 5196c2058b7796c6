"""Exact top-k inner products over a pivot-distance index.

One more component turns the largest inner product into the smallest distance: with M2 the largest
squared norm, |q' - v'|^2 = |q|^2 + M2 - 2 q.v for v' = (v, sqrt(M2 - |v|^2)) and q' = (q, 0). Each vector is
keyed by its nearest pivot and its distance from it. A query at distance d from a pivot needs only
the vectors at distances from d - r to d + r, r its k-th best distance so far. Search goes outward: each step takes the
annuli nearest to a block of queries, which shrinks r, until no annulus is left within the bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import materialize, ship

#: Rows that the pivots are drawn from, and the fewest and most pivots; between them a quarter of the root of the rows.
PIVOT_SAMPLE, PIVOTS = 4_096, (32, 1_024)
#: Fewest and most rows of an index chunk and of a block of queries, and how many of them a table makes in between.
CHUNK, CHUNKS = (2_048, 65_536), 2_000
QUERY_BLOCK, QUERY_BLOCKS = (1_024, 16_384), 64
#: Chunks that each step of the search takes for a block of queries; the last step takes all that are left.
STEPS = (2, 8, None)
#: Chunks whose rings are held in one list; scores computed at once; bytes of queries that are sent to all tasks at most.
RING_LIST, SCORES, SENT_BYTES = 4_096, 4_000_000, 64_000_000
K = 20


def quantized(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as a long array. Null ids, null and empty vectors and those with null or non-finite components take no part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    fine = x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(False)) & F.col("vec_id").isNotNull()
    return embeddings.where(fine).select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lifted(v: np.ndarray, m2: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(m2 - (v * v).sum(1), 0.0))[:, None]])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= cut)
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))][:k]


def packed(v: np.ndarray) -> bytes:
    """A matrix of whole numbers, in 2 bytes each where they fit, and a byte that tells which."""
    small = not len(v) or np.abs(v).max() < 1 << 15
    return (b"2" if small else b"8") + v.astype("<i2" if small else "<f8").tobytes()


def unpacked(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if data[:1] == b"2" else "<f8", offset=1).astype(np.float64).reshape(-1, dims)


def pivots(vectors: DataFrame, m2: float, count: int) -> np.ndarray:
    """Farthest-first pivots from PIVOT_SAMPLE rows of smallest hash. Any pivots give exact results; these part the data."""
    rows = vectors.select("v").orderBy(F.xxhash64("vec_id"), "row").limit(PIVOT_SAMPLE).collect()
    sample = _lifted(np.array([r["v"] for r in rows], np.float64), m2)
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def build_index(vectors: DataFrame, m2: float, points: np.ndarray, chunk: int) -> DataFrame:
    """Chunks of the index: (chunk, pivot, near, far, rows, ids, vectors, distances). A chunk holds vectors of one pivot, sorted by distance from it, from near to far.

    A pivot's vectors are dealt by distance ring into chunks, so a pivot that most rows are nearest to is many tasks' work.
    """
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(points)

    def key(batches):
        points = shared.value
        for batch in batches:
            if not len(batch):
                continue
            v = _lifted(_matrix(batch.column(2)), m2)
            d2 = np.maximum((v * v).sum(1)[:, None] + (points * points).sum(1) - 2 * v @ points.T, 0.0)
            pivot = d2.argmin(1)
            exact = np.sqrt(((v - points[pivot]) ** 2).sum(1))
            yield pa.record_batch([*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(exact)], ["row", "vec_id", "v", "pivot", "distance"])

    keyed = materialize(vectors.mapInArrow(key, "row long, vec_id long, v array<long>, pivot int, distance double"), "pivoted")
    # Ring limits: quantiles of the distances for each pivot, as many as its rows fill chunks.
    sizes = keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("distance", F.array(*[F.lit(i / 256) for i in range(1, 256)]), F.lit(10_000)).alias("q"))
    rings = sizes.select("pivot", F.least(F.lit(256), F.ceil(F.col("n") / chunk).cast("int")).alias("rings"), "q", "n")
    ring = F.size(F.filter("q", lambda x: x < F.col("distance")))
    # Beyond 256 rings of a pivot, or with many equal distances, a hash parts the ring further.
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / (F.col("rings") * chunk)).cast("int"))
    placed = keyed.join(rings, "pivot").select("row", "vec_id", "v", "pivot", "distance", F.floor(ring * F.col("rings") / 256).cast("int").alias("ring"), F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"))

    def pack(frame):
        frame = frame.sort_values(["distance", "row"])
        out = []
        for at in range(0, len(frame), 4 * chunk):
            some = frame.iloc[at : at + 4 * chunk]
            out.append((some["pivot"].iloc[0], some.distance.iloc[0], some.distance.iloc[-1], some["row"].to_numpy("<i8").tobytes(), some.vec_id.to_numpy("<i8").tobytes(), packed(np.stack(some.v.to_list())), some.distance.to_numpy("<f8").tobytes()))
        import pandas as pd

        return pd.DataFrame(out, columns=["pivot", "near", "far", "rows", "ids", "vectors", "distances"])

    chunks = placed.groupBy("pivot", "ring", "part").applyInPandas(pack, "pivot int, near double, far double, rows binary, ids binary, vectors binary, distances binary")
    return materialize(chunks.withColumn("chunk", F.monotonically_increasing_id()), "index")


def _away(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of queries, lifted by a zero, from all pivots."""
    d2 = (q * q).sum(1)[:, None] + (points * points).sum(1) - 2 * q @ points[:, :-1].T
    return np.sqrt(np.maximum(d2, 0))


def _blocks(vectors: DataFrame, wanted: Column, points: np.ndarray, size: int, dims: int) -> DataFrame:
    """Queries in blocks (q_block, q_rows, q_ids, q_vectors): a block's queries have one nearest pivot and like distances from it.

    Ranges of pivot and distance are dealt over tasks, so a pivot that most queries are nearest to is many tasks' work.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(points)

    def key(batches):
        for batch in batches:
            if len(batch):
                away = _away(_matrix(batch.column(2)), shared.value)
                home = away.argmin(1)
                yield pa.record_batch([*batch.columns, pa.array(home.astype(np.int32)), pa.array(away[np.arange(len(home)), home])], ["row", "vec_id", "v", "home", "d"])

    def pack(batches):
        number, home, held = 0, None, []

        def done():
            rows, ids, v = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.record_batch([pa.array([number]), *(pa.array([x], pa.binary()) for x in (rows.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), packed(v)))], ["number", "q_rows", "q_ids", "q_vectors"])

        for batch in batches:
            homes = batch.column(3).to_numpy(zero_copy_only=False)
            rows, ids, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2))
            for at in range(len(batch)):
                if held and (homes[at] != home or len(held) >= size):
                    yield done()
                    number, held = number + 1, []
                home = homes[at]
                held.append((rows[at : at + 1], ids[at : at + 1], v[at : at + 1]))
        if held:
            yield done()

    keyed = materialize(vectors.where(wanted).mapInArrow(key, "row long, vec_id long, v array<long>, home int, d double"), "queries")
    ordered = keyed.repartitionByRange(max(1, -(-keyed.count() // size)), "home", "d", "row").sortWithinPartitions("home", "d", "row")
    made = ordered.mapInArrow(pack, "number long, q_rows binary, q_ids binary, q_vectors binary")
    return materialize(made.select((F.spark_partition_id().cast("long") * F.lit(1 << 32) + F.col("number")).alias("q_block"), "q_rows", "q_ids", "q_vectors"), "query-blocks")


def top_k(vectors: DataFrame, wanted: Column, k: int = K, pivot_count: int | None = None, chunk: int | None = None, query_block: int | None = None, steps: tuple = STEPS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row of vectors that is wanted with all rows but itself, ties to smaller vec_id.

    vectors: (vec_id, v) with long components; vectors of unequal lengths are refused. Rows are told apart by a number of their
    own: a vec_id in several rows is a query, and a candidate, once for each. Scores are exact below 2**53. Blocks of queries,
    not single rows, meet chunks. If all queries together are small, by their measured bytes, they are sent to all tasks and
    the index is read in place; otherwise pairs of block and chunk are shuffled, whose number the blocks' size bounds. No rows, no result.
    """
    spark = vectors.sparkSession
    ship(spark)
    vectors = materialize(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "v"), "vectors")
    stat = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("m2"), F.max(F.size("v")).alias("dims"), F.min(F.size("v")).alias("least"), F.count("*").alias("n"), F.count(F.when(wanted, 1)).alias("q")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not stat["n"] or not stat["q"]:
        return spark.createDataFrame([], schema)
    if stat["least"] != stat["dims"]:
        raise ValueError("vectors of unequal lengths")

    def between(bounds: tuple[int, int], x: float) -> int:
        return min(bounds[1], max(bounds[0], int(x)))

    m2, dims, n = float(stat["m2"]), stat["dims"], stat["n"]
    points = pivots(vectors, m2, pivot_count or between(PIVOTS, n**0.5 / 4))
    chunk = chunk or between(CHUNK, n / CHUNKS)
    index = build_index(vectors, m2, points, chunk)
    blocks = _blocks(vectors, wanted, points, query_block or between(QUERY_BLOCK, stat["q"] / QUERY_BLOCKS), dims)
    small = stat["q"] * (dims * 8 + 32) <= SENT_BYTES
    shared = spark.sparkContext.broadcast(points)
    lists = -(-n // (chunk * RING_LIST))
    rings = index.select("chunk", "pivot", "near", "far").groupBy(F.pmod(F.xxhash64("chunk"), F.lit(lists)).alias("g")).agg(F.collect_list(F.struct("chunk", "pivot", "near", "far")).alias("rings"))
    rings = materialize(rings, "rings")

    def radius_of(q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        return np.where(np.isinf(floor), np.inf, np.sqrt(np.maximum((q * q).sum(1) + m2 - 2 * np.where(np.isinf(floor), 0, floor), 0)) + 1e-6)

    def floors(r: dict) -> np.ndarray:
        """The k-th best score of each query of a block so far."""
        known = {x["q_row"]: x["floor"] for x in r["floors"] or []}
        return np.array([known.get(i, -np.inf) for i in np.frombuffer(r["q_rows"], "<i8").tolist()], np.float64)

    def gaps(batches):
        """(q_block, chunk, gap): chunks that some query's bounds leave, and how far the nearest of them is."""
        for batch in batches:
            for r in batch.to_pylist():
                q = unpacked(r["q_vectors"], dims)
                away, radius = _away(q, shared.value), radius_of(q, floors(r))
                got = [(x["chunk"], np.maximum(np.maximum(away[:, x["pivot"]] - x["far"], x["near"] - away[:, x["pivot"]]), 0)) for x in r["rings"]]
                got = [(c, float(gap.min())) for c, gap in got if (gap <= radius).any()]
                yield pa.record_batch([pa.array([r["q_block"]] * len(got), pa.int64()), pa.array([c for c, _ in got], pa.int64()), pa.array([g for _, g in got], pa.float64())], ["q_block", "chunk", "gap"])

    def search(batches):
        for batch in batches:
            for i in range(len(batch)):
                r = batch.slice(i, 1).to_pylist()[0]
                q, v = unpacked(r["q_vectors"], dims), unpacked(r["vectors"], dims)
                q_rows, q_ids, rows, ids = (np.frombuffer(r[c], "<i8") for c in ("q_rows", "q_ids", "rows", "ids"))
                ring, floor = np.frombuffer(r["distances"], "<f8"), floors(r)
                away, radius = _away(q, shared.value)[:, r["pivot"]], radius_of(q, floor)
                low, high = np.searchsorted(ring, away - radius - 1e-6), np.searchsorted(ring, away + radius + 1e-6)
                some = np.flatnonzero(high > low)
                found = []
                for at in range(0, len(some), max(1, SCORES // len(v))):
                    part = some[at : at + max(1, SCORES // len(v))]
                    a, b = low[part].min(), high[part].max()
                    for s, j in zip(q[part] @ v[a:b].T, part.tolist(), strict=True):
                        inside = np.flatnonzero((s[low[j] - a : high[j] - a] >= floor[j]) & (rows[low[j] : high[j]] != q_rows[j])) + low[j]
                        best = inside[_best(s[inside - a], ids[inside], k)]
                        found.append((np.full(len(best), q_rows[j]), np.full(len(best), q_ids[j]), ids[best], s[best - a]))
                if found:
                    made = [np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)]
                    yield pa.record_batch([pa.array(np.full(len(made[0]), r["q_block"])), *map(pa.array, made)], ["q_block", "q_row", "query_id", "vec_id", "score"])

    best = searched = None
    for step in steps:
        ready = blocks.withColumn("floors", F.lit(None).cast("array<struct<q_row: long, floor: long>>"))
        if best is not None:
            known = best.groupBy("q_block", "q_row").agg(F.when(F.count("*") == k, F.min("score")).alias("floor")).where("floor is not null")
            ready = materialize(blocks.join(known.groupBy("q_block").agg(F.collect_list(F.struct("q_row", "floor")).alias("floors")), "q_block", "left"), "floors")
        spread = ready.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lists - 1).cast("long"))))
        near = spread.join(rings, "g").select("q_block", "q_rows", "q_vectors", "floors", "rings").mapInArrow(gaps, "q_block long, chunk long, gap double")
        if searched is not None:
            near = near.join(searched, ["q_block", "chunk"], "left_anti")
        if step:
            near = near.withColumn("nth", F.row_number().over(Window.partitionBy("q_block").orderBy("gap", "chunk"))).where(F.col("nth") <= step)
        pairs = materialize(near.select("q_block", "chunk"), "pairs")
        if not pairs.count():
            break
        searched = pairs if searched is None else searched.unionByName(pairs)
        meeting = pairs.join(index, "chunk").join(F.broadcast(ready), "q_block") if small else pairs.join(ready, "q_block").join(index, "chunk")
        found = meeting.select("q_block", "q_rows", "q_ids", "q_vectors", "floors", "pivot", "rows", "ids", "vectors", "distances").mapInArrow(search, "q_block long, q_row long, query_id long, vec_id long, score long")
        found = found if best is None else best.drop("rank").unionByName(found)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")))
        best = materialize(ranked.where(F.col("rank") <= k), "best")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score") if best is not None else spark.createDataFrame([], schema)


def search_table(embeddings: DataFrame, k: int = K, every: int = 20) -> DataFrame:
    """Queries: rows whose vec_id divides by `every`; candidates: all other rows."""
    return top_k(quantized(embeddings), F.col("vec_id") % every == 0, k)
