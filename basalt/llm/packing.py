"""Best-fit packing of token sequences after Martello-Toth reduction, planned on counts of lengths."""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.llm.common import materialize, ship, slices

CAPACITY = 4096
#: Pieces of one length whose ranks one task counts, and such parts of all lengths together: beyond them parts grow.
PART_ROWS, PARTS = 1_000, 50_000


class _Lengths:
    """How many pieces of each length are left, and the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.left = dict(counts)
        self.order = sorted(counts)
        self.ranks = dict.fromkeys(counts, 0)

    def take(self, length: int, n: int) -> int:
        """Takes n pieces; gives the rank of the first."""
        rank = self.ranks[length]
        self.ranks[length] += n
        self.left[length] -= n
        if not self.left[length]:
            self.order.pop(bisect.bisect_left(self.order, length))
        return rank

    def largest_up_to(self, limit: int) -> int | None:
        i = bisect.bisect_right(self.order, limit)
        return self.order[i - 1] if i else None

    def smallest_sum(self, n: int, longer: int = 0) -> int:
        """The sum of the n shortest pieces longer than `longer`; past any capacity if there are fewer."""
        total = 0
        for length in self.order[bisect.bisect_right(self.order, longer) :]:
            k = min(n, self.left[length])
            total, n = total + k * length, n - k
            if not n:
                return total
        return 1 << 60

    def best_pair(self, limit: int) -> int:
        """The largest sum of two pieces that is at most limit; 0 if there is none."""
        best, i, j = 0, 0, bisect.bisect_right(self.order, limit) - 1
        while i <= j:
            a, b = self.order[i], self.order[j]
            if a + b > limit:
                j -= 1
            elif i == j and self.left[a] < 2:
                break
            else:
                best = max(best, a + b)
                i += 1
        return best

    def without(self, length: int) -> _Lengths:
        """The same but for one piece of that length."""
        rest = dict(self.left)
        rest[length] -= 1
        return _Lengths({k: v for k, v in rest.items() if v})

    def dominating(self, top: int, capacity: int) -> list[int] | None:
        """The pieces beside one of length top that dominate every other set beside it, or None where no rule holds.

        A set dominates another if the other's pieces fit in the places of its own. Beside top, with room r:
        nothing, if no piece fits; one piece of just r; the longest piece a that fits, if no two fit, or if no three
        fit and no two make more than a; a and the longest b that fits beside it, if no three fit and no two
        longer than b fit (each pair's longer piece then has a's place and the shorter one b's).
        """
        room, rest = capacity - top, self if self.left[top] > 1 else self.without(top)
        a = rest.largest_up_to(room)
        if a is None:
            return []
        if self.left[top] > 1 and a >= top:
            rest = self.without(top)
            a = rest.largest_up_to(room)
        if a == room or rest.smallest_sum(2) > room:
            return [a]
        if rest.smallest_sum(3) <= room:
            return None
        if a >= rest.best_pair(room):
            return [a]
        less = rest.without(a)
        b = less.largest_up_to(room - a)
        return [a, b] if b is not None and rest.smallest_sum(2, b) > room else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int, int]], int, int]:
    """Where the pieces of each length go: (length, first rank, last rank + 1, first sequence, pieces a sequence, offset, reduced).

    The counts are at most `capacity` numbers, however many documents there are, and the
    plan has a few rows for each. Reduction (Martello and Toth): from the longest piece down, where some set of at most
    three pieces with it dominates every other, it is fixed, which loses no sequence; passes repeat until one fixes nothing.
    The remainder goes by best fit, longest first, into the fullest sequence that has room.
    Returns the rows, the number of sequences, and how many the reduction fixed.
    """
    pieces = _Lengths({k: v for k, v in counts.items() if k > 0 and v > 0})
    rows: list[tuple[int, int, int, int, int, int, int]] = []
    sequences = 0

    def fix(lengths: list[int], n: int) -> None:
        nonlocal sequences
        offset = 0
        for length in lengths:
            rank = pieces.take(length, n)
            rows.append((length, rank, rank + n, sequences, 1, offset, 1))
            offset += length
        sequences += n

    before = -1
    while before != sequences:
        before = sequences
        for top in sorted(pieces.order, reverse=True):
            while pieces.left[top]:
                beside = pieces.dominating(top, capacity)
                if beside is None:
                    break
                together = Counter([top, *beside])
                # As often as the same pieces are there: with fewer pieces left the rule holds all the more.
                fix([top, *beside], min(pieces.left[k] // v for k, v in together.items()))
    fixed = sequences
    rest = sorted(pieces.order, reverse=True)
    # Open sequences by the room they have: room -> runs of (first sequence, how many).
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, first: int, n: int) -> None:
        if room not in runs:
            bisect.insort(rooms, room)
            runs[room] = []
        runs[room].append((first, n))

    for length in rest:
        left, rank = pieces.left[length], pieces.ranks[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(i)
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = min(room // length, left)
            full = min(n, left // each)
            rows.append((length, rank, rank + full * each, first, each, capacity - room, 0))
            put(room - each * length, first, full)
            if full < n:
                put(room, first + full, n - full)
            rank, left = rank + full * each, left - full * each
    return rows, sequences, fixed


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids: each text's ids and end_id, cut only where longer than capacity. Null text: empty."""
    ship(docs.sparkSession)

    def encode(batches):
        import zlib

        from basalt.llm.encoding import Encoder

        encoder = Encoder.of(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [np.append(x, end_id).astype("<u4") for x in encoder.encode(part.column(1))]
                cuts = [(i, k, x[k * capacity : (k + 1) * capacity]) for i, x in enumerate(ids) for k in range(-(-len(x) // capacity))]
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array([i for i, _, _ in cuts], pa.int32())),
                        pa.array([k for _, k, _ in cuts], pa.int32()),
                        pa.array([k * capacity for _, k, _ in cuts], pa.int64()),
                        pa.array([len(x) for _, _, x in cuts], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for _, _, x in cuts], pa.int64()),
                        pa.array([x.tobytes() for _, _, x in cuts], pa.binary()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")


def place(pieces: DataFrame, capacity: int = CAPACITY, salt: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds sequence_id, offset and reduced to rows with a length from 1 to capacity.

    Ranks within a length come from counts by (length, part). A length has a part for each part_rows pieces, so one that a
    third of all pieces share is spread over tasks. salt names a column that deals the pieces to parts (a stored number that
    differs in equal rows too); it is left out of the result. Without it a hash of the row does, and equal rows share a part.
    The plan and the parts are a few rows for each of at most `capacity` lengths and PARTS rows: they go to all tasks.
    """
    spark = pieces.sparkSession
    ship(spark)
    names = [c for c in pieces.columns if c != salt]
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    dealt = F.col(f"`{salt}`") if salt else F.xxhash64("doc_id", "piece", "ids_crc32")
    keyed = pieces.select(*columns, F.col("length").alias("l"), dealt.cast("long").alias("s"))
    by_length = {r["l"]: r["n"] for r in keyed.groupBy("l").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    part_rows = max(part_rows, sum(by_length.values()) // PARTS)
    many = {k: -(-n // part_rows) for k, n in by_length.items() if n > part_rows}
    parts = F.coalesce(F.create_map(*[F.lit(int(x)) for pair in many.items() for x in pair])[F.col("l").cast("int")], F.lit(1)) if many else F.lit(1)
    parted = keyed.withColumn("p", F.pmod(F.xxhash64("s"), parts).cast("int"))
    got = parted.groupBy("l", "p").agg(F.count("*").alias("n")).collect()  # capacity and PARTS rows at most
    bases: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r["l"], r["p"])):
        bases[r["l"], r["p"]] = seen.get(r["l"], 0)
        seen[r["l"]] = seen.get(r["l"], 0) + r["n"]
    rows, _, _ = plan(by_length, capacity)
    table = np.array(sorted(rows), np.int64).reshape(-1, 7)
    first = np.array(sorted((k * (1 << 32) + p, v) for (k, p), v in bases.items()), np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((first, table))

    def locate(batches):
        first, table = shared.value
        keys = table[:, 0] * (1 << 44) + table[:, 1]
        for batch in batches:
            length, part, rank = (batch.column(len(names) + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            rank = first[np.searchsorted(first[:, 0], length * (1 << 32) + part), 1] + rank - 1
            row = table[np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1]
            i = rank - row[:, 1]
            out = [pa.array(row[:, 3] + i // row[:, 4]), pa.array(row[:, 5] + i % row[:, 4] * length), pa.array(row[:, 6] == 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *out], [*[f"c{i}" for i in range(len(names))], "sequence_id", "offset", "reduced"])

    within = Window.partitionBy("l", "p").orderBy("s", *[f"c{names.index(c)}" for c in ("doc_id", "piece", "ids_crc32")])
    ranked = parted.withColumn("r", F.row_number().over(within)).select(*[f"c{i}" for i in range(len(names))], "l", "p", "r")
    kept = T.StructType([T.StructField(f"c{i}", pieces.schema[c].dataType) for i, c in enumerate(names)] + T.StructType.fromDDL("sequence_id long, offset long, reduced boolean").fields)
    return ranked.mapInArrow(locate, kept).toDF(*names, "sequence_id", "offset", "reduced")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with their sequence and place in it; see plan(). An empty table gives no rows.

    The ids are encoded once and written, without their texts, to the shared folder; placing reads
    the narrow columns only. A null doc_id is kept; repeated rows are packed each.
    """
    pieces = encode_pieces(docs, tokenizer, end_id, capacity).drop("ids")
    # Stored, so a task that runs again reads the same number.
    return place(materialize(pieces.withColumn("salt", F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())), "pieces"), capacity, "salt")
