"""Document probability under a subword lattice: every segmentation of a word counts, by forward recursion in log space."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.llm.common import crc_mod, materialize, ship, slices
from basalt.llm.words import Spans, Words, flat, mix, runs, same_bytes

#: Passes of expectation maximization, and the smoothing count of a piece.
ROUNDS, SMOOTH = 3, 0.01
#: Words, and their bytes, taken through the lattice at once; a word of more than LONG bytes goes alone, in stretches of STRETCH.
WORDS_AT_ONCE, BYTES_AT_ONCE, LONG, STRETCH = 60_000, 1_000_000, 256, 1 << 16
#: A word with at least this share of all tokens is a head word: by definition there are at most 1 / HEAD_SHARE.
HEAD_SHARE = 1e-6
_LN10 = math.log(10)


def vocabulary(model_file: str) -> list[bytes]:
    """Pieces of a sentencepiece vocabulary as bytes, a word's start as a blank; the 256 bytes come first."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    own = (m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)))
    single = [bytes([i]) for i in range(256)]
    # A blank only begins a word, and A-Z are lower-cased.
    return single + sorted({p for p in own if len(p) > 1 and b" " not in p[1:] and p == p.lower()})


#: The low bytes of a window that a span of 0 to 8 bytes has.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Windows:
    """The eight bytes from each place of data, and keys of spans of one length: equal bytes, equal key."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.at = np.ndarray((len(data) + 1,), "<u8", self.data, strides=(1,)).astype(np.uint64)

    def keys(self, start: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            seed = np.uint64(length * 0x9E3779B97F4A7C15 % (1 << 64))
            if length <= 8:
                return mix((self.at[start] & _MASKS[length]) + seed)
            key = mix(self.at[start] + seed)
            for offset in [*range(8, length - 8, 8), length - 8]:
                key = mix(key ^ self.at[start + offset])
            return key


class Lattice:
    """Pieces with natural log probabilities; words are bytes with a blank before them."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.logp = np.append(logp, -np.inf)
        self.longest = max(map(len, pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        end = np.cumsum([len(p) for p in pieces])
        self.none = len(pieces)
        self.size = np.array([len(p) for p in pieces])
        self.bytes = np.zeros((len(pieces), self.longest), np.uint8)
        self.bytes[np.repeat(np.arange(len(pieces)), self.size), runs(np.zeros(len(pieces), np.int64), self.size)] = data
        windows, keys = Windows(data), np.zeros(len(pieces), np.uint64)
        for n in np.unique(self.size).tolist():
            some = np.flatnonzero(self.size == n)
            keys[some] = windows.keys(end[some] - n, n)
        #: The first eight bytes of each piece, zeros behind a shorter one.
        self.head = windows.at[end - self.size] & _MASKS[np.minimum(self.size, 8)]
        # Two direct tables on other bits of the hash; the few pieces that meet in both are searched.
        self.keys = np.append(keys, np.uint64(0))
        self.first, self.second = np.full(1 << 18, self.none, np.int32), np.full(1 << 18, self.none, np.int32)
        self.first[(keys >> np.uint64(46)).astype(np.int64)] = np.arange(len(pieces))
        lost = np.flatnonzero(self.first[(keys >> np.uint64(46)).astype(np.int64)] != np.arange(len(pieces)))
        self.second[(keys[lost] & np.uint64((1 << 18) - 1)).astype(np.int64)] = lost
        again = lost[self.second[(keys[lost] & np.uint64((1 << 18) - 1)).astype(np.int64)] != lost]
        order = np.argsort(keys[again])
        self.rest_keys, self.rest = keys[again][order], again[order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        got = self.first[(keys >> np.uint64(46)).astype(np.int64)]
        out = np.where(self.keys[got] == keys, got, self.none)
        # A piece that isn't in the first table met another there.
        missing = np.flatnonzero((got != self.none) & (out == self.none))
        if len(missing):
            k = keys[missing]
            got = self.second[(k & np.uint64((1 << 18) - 1)).astype(np.int64)]
            found = np.where(self.keys[got] == k, got, self.none)
            if len(self.rest):
                place = np.minimum(np.searchsorted(self.rest_keys, k), len(self.rest) - 1)
                found = np.where(self.rest_keys[place] == k, self.rest[place], found)
            out[missing] = found
        return out

    def pieces_at(self, windows: Windows, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(which, piece): the starts at which a piece of that length stands. A key finds it, its bytes decide."""
        piece = self.find(windows.keys(start, length))
        some = np.flatnonzero(piece != self.none)
        piece = piece[some]
        same = (self.size[piece] == length) & (self.head[piece] == (windows.at[start[some]] & _MASKS[min(length, 8)]))
        if length > 8:
            same &= (self.bytes[piece, :length] == windows.data[start[some][:, None] + np.arange(length)]).all(1)
        return some[same], piece[same]

    def run(self, words: list[bytes], weights: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """The natural log of each word's marginal. With weights, adds their expected piece counts to `expected`."""
        out = np.zeros(len(words))
        size = np.array([len(w) + 1 for w in words], np.int64)
        for k in np.flatnonzero(size > LONG).tolist():
            out[k] = self._long(words[k], None if weights is None else weights[k], expected)
        data = np.frombuffer(b"".join(b" " + w for w in words if len(w) < LONG), np.uint8)
        windows = Windows(data)
        held = np.where(size > LONG, 0, size)
        begin = np.cumsum(held) - held
        with np.errstate(divide="ignore", invalid="ignore"):
            for n in np.unique(held[held > 0]).tolist():
                rows = np.flatnonzero(size == n)
                start = begin[rows]
                alpha = np.full((n + 1, len(rows)), -np.inf)
                alpha[0] = 0.0
                used: list[tuple[int, int, np.ndarray, np.ndarray]] = []
                for j in range(1, n + 1):
                    for i in range(max(0, j - self.longest), j):
                        some, p = self.pieces_at(windows, start + i, j - i)
                        if not len(some):
                            continue
                        alpha[j, some] = np.logaddexp(alpha[j, some], alpha[i, some] + self.logp[p])
                        if weights is not None:
                            used.append((i, j, some, p))
                out[rows] = alpha[n]
                if weights is None:
                    continue
                beta = np.full((n + 1, len(rows)), -np.inf)
                beta[n] = 0.0
                for i, j, some, p in sorted(used, key=lambda x: -x[1]):
                    beta[i, some] = np.logaddexp(beta[i, some], self.logp[p] + beta[j, some])
                for i, j, some, p in used:
                    share = np.exp(alpha[i, some] + self.logp[p] + beta[j, some] - alpha[n, some]) * weights[rows[some]]
                    expected += np.bincount(p, share, len(expected))
        return out

    def _long(self, word: bytes, weight: float | None, expected: np.ndarray | None) -> float:
        """The same for one long word. Pieces are found for a stretch of ends at a time, so memory doesn't grow with their number."""
        data = np.frombuffer(b" " + word, np.uint8)
        n = len(data)

        def edges(low: int):
            """(begin, end, piece) of the pieces that end in (low, low + STRETCH], by end."""
            high, first = min(n, low + STRETCH), max(0, low - self.longest)
            part = data[first:high]
            windows = Windows(part)
            found = []
            for length in range(1, min(self.longest, len(part)) + 1):
                start = np.arange(max(0, low + 1 - length - first), len(part) - length + 1)
                some, p = self.pieces_at(windows, start, length)
                found.append((start[some] + first, start[some] + first + length, p))
            begin, end, p = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(end, kind="stable")
            return begin[order], end[order], p[order]

        def add(a: float, b: float) -> float:
            return max(a, b) + math.log1p(math.exp(-abs(a - b))) if a > -math.inf else b

        alpha = [0.0] + [-math.inf] * n
        for low in range(0, n, STRETCH):
            begin, end, p = edges(low)
            for i, j, x in zip(begin.tolist(), end.tolist(), self.logp[p].tolist(), strict=True):
                alpha[j] = add(alpha[j], alpha[i] + x)
        if weight is None:
            return alpha[n]
        beta = [-math.inf] * n + [0.0]
        forward = np.array(alpha)
        for low in reversed(range(0, n, STRETCH)):
            begin, end, p = edges(low)
            for i, j, x in zip(begin[::-1].tolist(), end[::-1].tolist(), self.logp[p][::-1].tolist(), strict=True):
                beta[i] = add(beta[i], beta[j] + x)
            # All ends of this stretch are final by now.
            share = np.exp(forward[begin] + self.logp[p] + np.array([beta[j] for j in end.tolist()]) - forward[n]) * weight
            expected += np.bincount(p, share, len(expected))
        return alpha[n]


def _binary(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    held = data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(held.tobytes())])


def _train(doc_id):
    return crc_mod(doc_id, 5) != 1


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, c): every distinct word with its count in all texts and in training texts."""
    ship(docs.sparkSession)

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(0))
                one, place = words.distinct()
                train = part.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.record_batch([_binary(words.data, words.start[one], words.end[one]), pa.array(np.bincount(place, minlength=len(one)).astype(np.int64)), pa.array(np.bincount(place, train[words.doc], len(one)).astype(np.int64))], ["word", "n", "c"])

    pairs = docs.select("text", _train(F.col("doc_id")).alias("train")).mapInArrow(count, "word binary, n long, c long")
    return pairs.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def _gathered(batches):
    """Record batches whose first column is words, put together and cut to about WORDS_AT_ONCE rows and BYTES_AT_ONCE bytes (one row at least)."""
    held, rows, size = [], 0, 0
    for batch in batches:
        for part in slices(batch, "word", BYTES_AT_ONCE):
            held.append(part)
            rows += len(part)
            size += int(np.diff(flat(part.column(0))[1][[0, -1]])[0])
            if rows >= WORDS_AT_ONCE or size >= BYTES_AT_ONCE:
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def fit(counts: DataFrame, pieces: list[bytes], train_docs: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces and of the document's end, by expectation maximization over all training words.

    Each round sends back one number for each piece: the vocabulary bounds what the driver holds.
    """
    spark = counts.sparkSession
    logp = np.full(len(pieces), -math.log(len(pieces)))
    end = -math.log(len(pieces))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, logp))

        def expect(batches, shared=shared):
            lattice = Lattice(*shared.value)
            expected = np.zeros(lattice.none)
            for table in _gathered(batches):
                lattice.run(table.column(0).to_pylist(), table.column(1).to_numpy().astype(np.float64), expected)
            some = np.flatnonzero(expected)
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(expected[some])], ["piece", "e"])

        got = counts.where("c > 0").select("word", "c").mapInArrow(expect, "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).collect()
        total = np.full(len(pieces), SMOOTH)
        for r in got:
            total[r["piece"]] += r["e"]
        whole = total.sum() + train_docs + SMOOTH
        logp, end = np.log(total / whole), math.log((train_docs + SMOOTH) / whole)
        shared.unpersist()
    return logp, end


def score_documents(docs: DataFrame, model_file: str, rounds: int = ROUNDS, head_share: float = HEAD_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    The piece vocabulary exists; its probabilities are fitted on all training documents. Words are
    counted over the whole corpus. Head words, few by definition, are looked up where the text is read; only a
    text's other distinct words meet the table of counts in a join. Null texts are empty: one end token.
    Repeated rows are scored each. Without training documents N is 0 and every count is 0.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    pieces = vocabulary(model_file)
    counts = materialize(word_counts(docs), "words")
    ends = docs.agg(F.count(F.when(_train(F.col("doc_id")), 1)).alias("train"), F.count("*").alias("docs")).first()
    sums = counts.agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    train_docs = ends["train"]
    tokens = (sums["c"] or 0) + train_docs
    distinct = (sums["v"] or 0) + (train_docs > 0)
    logp, end = fit(counts, pieces, train_docs, rounds)
    shared = spark.sparkContext.broadcast((pieces, logp))

    def marginal(batches):
        lattice = Lattice(*shared.value)
        for table in _gathered(batches):
            got = lattice.run(table.column(0).to_pylist()) / _LN10
            yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in table.columns], pa.array(got)], ["word", "n", "c", "lp"])

    known = materialize(counts.mapInArrow(marginal, "word binary, n long, c long, lp double"), "scored-words")
    least = max(1.0, (sums["n"] or 0) * head_share)
    head = known.where(F.col("n") >= least).select("word", "c", "lp").collect()  # 1 / head_share words at most
    below = tokens + 0.5 * (distinct + 1)

    def base(c):
        return np.log10((np.asarray(c, np.float64) + 0.5) / below) if below else np.zeros(np.shape(c))

    data = np.frombuffer(b"".join(r["word"] for r in head), np.uint8)
    stop = np.cumsum([len(r["word"]) for r in head]).astype(np.int64)
    start = stop - np.array([len(r["word"]) for r in head], np.int64)
    # Of head words that share a hash one stays; the others are looked up with the rest.
    keys, order = np.unique(Spans(data).spans(start, stop), return_index=True)
    c = np.array([r["c"] for r in head], np.int64)[order]
    look = spark.sparkContext.broadcast((keys, data, start[order], stop[order] - start[order], base(c), np.array([r["lp"] for r in head])[order], c > 0))
    end_base, end_score = float(base(train_docs)), end / _LN10

    def read(batches):
        keys, data, start, size, bases, lps, seen = look.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(1))
                n = words.rows
                kinds, kind = words.distinct()
                h = words.spans(words.start[kinds], words.end[kinds])
                place = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                known_kind = keys[place] == h if len(keys) else np.zeros(len(h), bool)
                known_kind[known_kind] = size[place[known_kind]] == (words.end - words.start)[kinds[known_kind]]
                some = np.flatnonzero(known_kind)
                known_kind[some] = same_bytes(words.data, words.start[kinds[some]], data, start[place[some]], size[place[some]])
                hit = known_kind[kind]
                doc, at = words.doc[hit], place[kind[hit]]
                # Distinct other words of each text.
                wide = max(1, len(kinds))
                pair, k = np.unique(words.doc[~hit] * wide + kind[~hit], return_counts=True)
                one_doc, one = pair // wide, kinds[pair % wide]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(one_doc, minlength=n))]).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([_binary(words.data, words.start[one], words.end[one]), pa.array(k.astype(np.int64))], ["word", "k"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words.counts + 1), pa.array(np.bincount(doc, seen[at], n).astype(np.int64) + (train_docs > 0)), pa.array(np.bincount(doc, bases[at], n) + end_base), pa.array(np.bincount(doc, lps[at], n) + end_score), tail],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score", "tail"],
                )

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_tokens long, n_known long, base_score double, score double, tail array<struct<word: binary, k: long>>")])
    rows = materialize(docs.mapInArrow(read, schema).withColumn("row", F.monotonically_increasing_id()), "texts")
    pairs = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.k")
    counted = pairs.join(known, "word")
    per_word = F.log10((F.col("c") + 0.5) / F.lit(below or 1.0))
    more = counted.groupBy("row").agg(F.sum(F.col("k") * per_word).alias("b"), F.sum(F.col("k") * F.col("lp")).alias("s"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known"))
    nil = F.lit(0.0)
    return rows.drop("tail").join(more, "row", "left").select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", nil)).alias("base_score"),
        (F.col("score") + F.coalesce("s", nil)).alias("score"),
    )
