"""SimHash near duplicates: popcounts of segments as points, joined on a grid, verified bit by bit.

A fingerprint's 32 two-bit segments have 0, 1 or 2 bits each. The Manhattan distance of two such
points is at most the Hamming distance. Within 3 bits one half of the segments is within
distance 1, so for each half a fingerprint joins its own grid cell and the cells one step up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.llm.common import join_hot, materialize, numbered, ship, sorted_keys
from basalt.llm.components import components, stars

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Bytes of a text that are taken apart at once.
STRETCH = 4_000_000
#: Fingerprints of one grid cell that one task compares with each other; a larger cell is dealt out.
CELL_ROWS = 20_000
#: Pairs verified at once, in numpy; cells whose list is sent to all tasks.
PAIRS, LISTED = 2_000_000, 500_000
_SIDE = 16
_STEP = 3 ** np.arange(_SIDE, dtype=np.int64)


def shingle_hashes(text: str | bytes | None, words: int) -> np.ndarray:
    """Hashes of the word shingles in their order, repeats too; a shorter text is one shingle. Null is empty."""
    data = text.encode() if isinstance(text, str) else text or b""
    if len(data) > STRETCH:
        return _in_stretches(data, words)
    tokens = data.lower().split()
    return _hashed(tokens, words)


def _hashed(tokens: list[bytes], words: int) -> np.ndarray:
    import xxhash

    if not tokens:
        return np.zeros(0, np.uint64)
    size = list(map(len, tokens))
    joined = b" ".join(tokens)
    ends = np.cumsum(np.array(size) + 1) - 1
    starts = ends - size
    if len(tokens) >= words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def _in_stretches(data: bytes, words: int) -> np.ndarray:
    """shingle_hashes of a long text, a stretch at a time: each goes on with the last words of the one before."""
    out, carried, at, seen = [], [], 0, 0
    while at < len(data):
        end = min(at + STRETCH // 2, len(data))
        while end < len(data) and data[end : end + 1] not in b" \t\n\v\f\r":
            end += 1
        tokens = data[at:end].lower().split()
        seen += len(tokens)
        held = carried + tokens
        # Fewer words than a shingle make one only if they are the whole text.
        if len(held) >= words or end == len(data) and seen == len(held):
            out.append(_hashed(held, words))
        carried = held[max(0, len(held) - words + 1) :]
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits set in over half of the rows (n, words) of unsigned 64-bit numbers; none set without rows."""
    counts = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 16_320):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + 16_320]).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        # Up to 255 bits fit in a byte.
        counts += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str | bytes | None, words: int = SHINGLE) -> int:
    """Bits set in over half of the hashes of the word shingles; 0 without words. Null is empty."""
    return int(majority(shingle_hashes(text, words)[:, None])[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, h, fp): h tells texts of one doc_id apart, fp is the fingerprint as a signed 64-bit integer."""
    ship(docs.sparkSession)

    def compute(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            fp = np.fromiter((fingerprint(x.as_py(), words) for x in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fp)], ["doc_id", "h", "fp"])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("h long, fp long")])
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(compute, schema)


def _grid(batches):
    """(key, own, fp): the own cell of each half, and the cells one step up."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        keys, own, which = [], [], []
        index = np.arange(len(fp))
        for half in (0, 1):
            bits = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
            counts = np.stack([np.bitwise_count((bits >> np.uint64(2 * k)) & np.uint64(3)) for k in range(_SIDE)]).astype(np.int64)
            base = _STEP @ counts + half * 3**_SIDE
            keys.append(base)
            own.append(np.ones(len(fp), bool))
            which.append(index)
            for k in range(_SIDE):
                up = counts[k] < 2
                keys.append(base[up] + _STEP[k])
                own.append(np.zeros(up.sum(), bool))
                which.append(index[up])
        yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(own)), pa.array(fp[np.concatenate(which)].view(np.int64))], ["key", "own", "fp"])


def _verify(batches):
    """Links of the cells in one partition, sorted by cell, as stars. Holds a run of cells at a time and compares PAIRS at once."""
    for columns in sorted_keys(batches):
        key, own, fp = (c.to_numpy(zero_copy_only=False) for c in columns)
        order = np.lexsort((~own, key))
        key, own, fp = key[order], own[order], fp[order].view(np.uint64)
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(begin, len(key)))
        owns = np.add.reduceat(own.astype(np.int64), begin)
        group = np.repeat(np.arange(len(begin)), size)
        place = np.arange(len(key)) - begin[group]
        first = np.where(own, place + 1, 0)
        count = np.maximum(owns[group] - first, 0)
        first += begin[group]
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for left, right in pair_runs(first, count):
            near = np.bitwise_count(fp[left] ^ fp[right]) <= RADIUS
            if near.any():
                a, b = stars(np.concatenate([a, fp[left[near]].view(np.int64)]), np.concatenate([b, fp[right[near]].view(np.int64)]))
        yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])


def pair_runs(first: np.ndarray, count: np.ndarray, pairs: int = PAIRS):
    """(left, right) for rows i and first[i], first[i] + 1, ... of count[i] each, about `pairs` at a time."""
    rows = np.flatnonzero(count)
    total = np.cumsum(count[rows])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + pairs, side="right")))
        r, n = rows[at:to], count[rows[at:to]]
        left = np.repeat(r, n)
        yield left, np.repeat(first[r] - (np.cumsum(n) - n), n) + np.arange(len(left))
        at = to


def dealt(rows: DataFrame, own: str, deal: str, cell_rows: int) -> DataFrame:
    """rows of column `key` with part and home: a key with more than cell_rows own rows is dealt into parts; every row visits all, one of them its home."""
    large = materialize(rows.where(own).groupBy("key").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("parts")).where("parts > 1"), "large-cells")
    few = large.count() <= LISTED
    joined = rows.join(F.broadcast(large) if few else large, "key", "left")
    home = F.col("parts").isNull() | (F.col("part") == F.pmod(F.xxhash64(deal), F.col("parts")).cast("int"))
    parts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    return joined.withColumn("part", F.explode(parts)).withColumn("home", home).drop("parts")


def links(prints: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Stars (a, b) that join just those distinct fingerprints (column fp) that are linked within one cell.

    A cell with more than cell_rows fingerprints is dealt into parts; every row of it visits all the parts.
    """
    rows = dealt(prints.mapInArrow(_grid, "key long, own boolean, fp long"), "own", "fp", cell_rows)
    # The part goes into the key's upper bits, so cells are told apart by one number.
    spread = rows.select((F.col("key") + F.col("part") * F.lit(1 << 28)).alias("key"), (F.col("own") & F.col("home")).alias("own"), "fp")
    return spread.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, h, fp, root, component_id): component_id is the smallest doc_id reachable over links of 3 or fewer differing bits.

    root is the component's smallest fingerprint and alone tells components apart: all components of null ids have the
    component_id null, and one doc_id with different texts can be the smallest of several.

    Equal fingerprints are compared once. Null and empty texts have fingerprint 0 and are linked like
    any other; repeated rows are in one component; a null doc_id is never the smallest (a component of
    null ids only has a null id). An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, words), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "prints")
    found = components(links(nodes.select("fp"), cell_rows))
    rooted = materialize(nodes.join(found, nodes.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low"), "rooted")
    named = join_hot(rooted, rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "root", "component_id")
    return join_hot(prints, materialize(named, "components"), "fp").select("doc_id", "h", "fp", "root", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which each root in found (doc_id, h, root) keeps one: that of the smallest doc_id (nulls last), then the smallest text hash.

    Rows equal in doc_id and text count as one document; of them the first by all columns' hash stays. Any column names will do.
    """
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")).alias("k"))
    best = best.select(F.col("k.doc_id").alias("id"), F.col("k.h").alias("h"))
    columns = [f"c{i}" for i in range(len(docs.columns))]
    id_, text = (columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    hashable = [c for c, f in zip(columns, docs.schema, strict=True) if "map<" not in f.dataType.simpleString()]
    # Repeated rows become one before the shuffle.
    rows = numbered(docs).groupBy(F.col(id_).alias("id"), F.xxhash64(text).alias("h")).agg(F.min_by(F.struct(*columns), F.xxhash64(*hashable)).alias("row"))
    kept = rows.join(best, rows.id.eqNullSafe(best.id) & (rows.h == best.h), "left_semi")
    return kept.select("row.*").toDF(*docs.columns)


def keep_one(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """One row of docs, all columns, of each component of near_duplicates."""
    return first_of_each(docs, near_duplicates(docs, words))
