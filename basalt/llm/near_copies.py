"""SimHash near duplicates out to a similarity that three differing bits don't reach.

At a Jaccard similarity of 0.8 of five-word shingles, two 64-bit fingerprints differ in 7 to 14 bits, where a grid of segment
popcounts no longer parts the data. So candidates come from prefixes: in any one order of all shingles, sets that much
alike share one of the first n - ceil(SIMILARITY * n) + 1, without loss. Fingerprints of BITS bits, of the sets, decide: they link
where at least AGREE of the bits are the same. Common shingles are last in the order, which only saves work.
What does lie within three bits is found as in operator 2, by popcounts of segments on a grid, over all sets: those links
need no shared prefix, and sets of one 64-bit fingerprint are linked too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.llm.common import join_hot, materialize, ship, sorted_keys
from basalt.llm.components import components, merge
from basalt.llm import simhash
from basalt.llm.simhash import LISTED, dealt, first_of_each, majority, pair_runs, shingle_hashes
from basalt.llm.words import mix

SHINGLE = 5
#: The similarity as a fraction, so that all bounds are computed in whole numbers.
ALIKE, OF = 4, 5
SIMILARITY = ALIKE / OF
#: Bits of a fingerprint and the share of them that linked ones have in common at least.
BITS, AGREE = 512, 0.82
REACH = int(BITS * (1 - AGREE))
#: Texts that common shingles are counted in, how many of these texts have one, and the most common ones kept.
SAMPLE_ROWS, COMMON, MOST = 10_000, 8, 50_000
#: Sets of one shingle that one task compares with each other, and pairs at once.
CELL_ROWS, PAIRS = 20_000, 200_000


def shingle_set(text: str | bytes | None, words: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the word shingles, ascending."""
    return np.unique(shingle_hashes(text, words))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingle hashes in BITS // 64 numbers: each bit is set in over half of the spread hashes."""
    steps = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return majority(mix(shingles[:, None] + steps))


def prefix(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(SIMILARITY * n) + 1 of the set; those in common (ascending) come last."""
    n = len(shingles)
    if not n:
        return shingles
    late = np.isin(shingles, common, assume_unique=True)
    return np.concatenate([shingles[~late], shingles[late]])[: n - -(-ALIKE * n // OF) + 1]


def common_shingles(docs: DataFrame, words: int = SHINGLE) -> np.ndarray:
    """Shingles of at least COMMON of about SAMPLE_ROWS texts, at most MOST, ascending. They order the prefixes and decide nothing."""
    rows = docs.count()

    def compute(batches):
        for batch in batches:
            for x in batch.column(0).cast(pa.large_binary()):
                yield pa.record_batch([pa.array(shingle_set(x.as_py(), words).view(np.int64))], ["s"])

    texts = docs.select("text").where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) < (1 << 30) * min(1.0, SAMPLE_ROWS / max(rows, 1)))
    counted = texts.distinct().mapInArrow(compute, "s long").groupBy("s").agg(F.count("*").alias("n")).where(f"n >= {COMMON}")
    found = counted.orderBy(F.desc("n"), "s").limit(MOST).select("s").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _shared(batches):
    """Of (key, node, n), sorted by key: rows that some other row of their shingle can be alike by size."""
    for columns in sorted_keys(batches):
        s, node, n = (c.to_numpy(zero_copy_only=False) for c in columns)
        order = np.lexsort((n, s))
        s, node, n = s[order], node[order], n[order]
        near = (s[1:] == s[:-1]) & (OF * n[:-1] >= ALIKE * n[1:])
        keep = np.append(near, False) | np.append(False, near)
        yield pa.record_batch([pa.array(x[keep]) for x in (s, node, n)], ["key", "node", "n"])


def _compare(batches):
    """Of (key, own, node, n, print), sorted by key: links of rows with one key, at least one of them own, as stars (a, b)."""
    for columns in sorted_keys(batches):
        key, own, node, n = (c.to_numpy(zero_copy_only=False) for c in columns[:4])
        names, one, local = np.unique(node, return_index=True, return_inverse=True)
        prints = np.frombuffer(b"".join(columns[4].take(pa.array(one)).to_pylist()), "<u8").reshape(len(one), -1)
        order = np.lexsort((n, ~own, key))
        key, own, n, local = key[order], own[order], n[order], local[order]
        # A run is one key's own rows or its guests, by size; code orders all rows by run and size.
        run = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (own[1:] != own[:-1])))
        wide = int(n.max()) * 2 + 2
        code = run * wide + n
        guests = np.append(np.flatnonzero(np.diff(run)) + 1, len(key))
        after = guests[np.searchsorted(guests, np.arange(len(key)), side="right").clip(max=len(guests) - 1)]
        visited = own & (after < len(key)) & (key[np.minimum(after, len(key) - 1)] == key) & ~own[np.minimum(after, len(key) - 1)]
        most, least = OF * n // ALIKE, -(-ALIKE * n // OF)
        first = np.arange(len(key)) + 1
        mine = np.where(own, np.searchsorted(code, run * wide + most, side="right") - first, 0)
        guest_first = np.searchsorted(code, (run + 1) * wide + least, side="left")
        theirs = np.where(visited, np.searchsorted(code, (run + 1) * wide + most, side="right") - guest_first, 0)
        label = np.arange(len(names))
        for start, count in ((first, mine), (guest_first, theirs)):
            for left, right in pair_runs(start, np.maximum(count, 0), PAIRS):
                a, b = local[left], local[right]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                near = np.bitwise_count(prints[a] ^ prints[b]).sum(1) <= REACH
                if near.any():
                    label = merge(label, a[near], b[near])
        linked = np.flatnonzero(label != np.arange(len(names)))
        yield pa.record_batch([pa.array(names[linked]), pa.array(names[label[linked]])], ["a", "b"])


def grid_links(prints: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) of the sets of prints (node, fp) whose 64-bit fingerprints differ in simhash.RADIUS bits or fewer, or are linked by such ones. Give it a written table."""
    first = materialize(prints.groupBy("fp").agg(F.min("node").alias("first")), "first-of-prints")
    same = join_hot(prints, first, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = materialize(simhash.links(first.select("fp"), cell_rows), "grid-links")
    for end in ("a", "b"):
        near = materialize(join_hot(near, first.withColumnRenamed("fp", end), end).drop(end).withColumnRenamed("first", end), "grid-links")
    return same.where("a != b").unionByName(near)


def groups(docs: DataFrame, words: int = SHINGLE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, h, node, root): root is the smallest set reachable over links; node is a set's hash, h the text's.

    Linked are sets that share a shingle of their prefixes, differ in size by no more than SIMILARITY and have fingerprints within
    REACH bits, and those of grid_links. Equal sets are one node; null and empty texts, and those of blanks, have the empty set and are one group. Repeated
    rows are in one group; a null doc_id is kept. A shingle with more than cell_rows sets is dealt into parts, and every set
    visits all of them. No rows, no result.
    """
    ship(docs.sparkSession)
    import xxhash

    digest, common = xxhash.xxh64_intdigest, common_shingles(docs, words)

    def compute(batches):
        for batch in batches:
            sets = [shingle_set(x.as_py(), words) for x in batch.column(2).cast(pa.large_binary())]
            node = np.fromiter((digest(x.tobytes()) for x in sets), np.uint64, len(sets)).view(np.int64)
            heads = pa.array([prefix(x, common).view(np.int64) for x in sets], pa.list_(pa.int64()))
            wide = pa.array([wide_fingerprint(x).tobytes() for x in sets], pa.binary())
            fp = np.fromiter((majority(x[:, None])[0] for x in sets), np.uint64, len(sets)).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(node), pa.array([len(x) for x in sets], pa.int64()), heads, wide, pa.array(fp)], ["doc_id", "h", "node", "n", "prefix", "print", "fp"])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("h long, node long, n long, prefix array<long>, print binary, fp long")])
    made = materialize(docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(compute, schema), "shingle-sets")
    heads = made.select("node", "n", "prefix").dropDuplicates(["node"]).select(F.explode("prefix").alias("key"), "node", "n")
    # Keys of many sets are known from a share of the sets. They need no look for a second one, so none of them meets in one task.
    share = max(1, min(64, cell_rows // 64))
    often = heads.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).groupBy("key").agg(F.count("*").alias("sets")).where(F.col("sets") * share > cell_rows)
    often = materialize(often.select("key", F.lit(True).alias("often")), "often")
    marked = heads.join(F.broadcast(often) if often.count() <= LISTED else often, "key", "left")
    few = marked.where("often IS NULL").select("key", "node", "n").repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, node long, n long")
    shared = materialize(few.unionByName(marked.where("often").select("key", "node", "n")), "shared")
    prints = shared.select("node").distinct().join(made.groupBy("node").agg(F.min("print").alias("print")), "node")
    rows = dealt(shared.withColumn("own", F.lit(True)), "own", "node", cell_rows)
    # The place is a hash of shingle and part; should two meet, their sets are compared too, which links no more than they should.
    spread = rows.select(F.xxhash64("key", "part").alias("key"), F.col("home").alias("own"), "node", "n").join(prints, "node")
    links = spread.select("key", "own", "node", "n", "print").repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "a long, b long")
    grid = grid_links(materialize(made.select("node", "fp").distinct(), "prints"), cell_rows)
    found = components(links.unionByName(grid))
    nodes = materialize(made.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
    return join_hot(made.select("doc_id", "h", "node"), nodes, "node").select("doc_id", "h", "node", "root")


def keep_one(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """One row of docs, all columns, of each group of near copies."""
    return first_of_each(docs, groups(docs, words))
