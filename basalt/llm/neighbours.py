"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Every word of every sampled example, toxic or not, is a term. A term weighs (1 + log count) * idf * relevance: idf from all
documents, relevance (Lan, Tan and Lu's tf.rf, raised to a power) from the labels of the sample, 1 at least.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.llm.common import crc_mod, kept_where, materialize, ship, slices, with_read_texts
from basalt.llm.labelled import labelled_sample
from basalt.llm.words import NOT_ALNUM, Spans, Words, flat, runs, same_bytes

#: Labelled rows that examples come from, and of these the examples whose votes the calibration is fitted on.
SAMPLE_ROWS, CALIBRATED = 4_000, 2_000
#: Bytes of the examples' texts together.
SAMPLE_BYTES = 32_000_000
#: Neighbours, examples of a block, blocks searched before the others' bounds are looked at.
NEIGHBOURS, BLOCK, FIRST = 15, 64, 8
#: The power of the relevance.
POWER = 3.0


class Vocabulary:
    """Terms as bytes with their numbers; looked up by hash, then compared byte by byte."""

    def __init__(self, words: pa.Array):
        self.data, first = flat(words)
        self.start, self.size = first[:-1], np.diff(first)
        keys = Spans(self.data).spans(first[:-1], first[1:]) if len(words) else np.zeros(0, np.uint64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, words: Words, one: np.ndarray) -> np.ndarray:
        """The number of each of the words, -1 for those that aren't terms."""
        out = np.full(len(one), -1, np.int64)
        if not len(self) or not len(one):
            return out
        keys = words.spans(words.start[one], words.end[one])
        size = words.end[one] - words.start[one]
        at = np.searchsorted(self.keys, keys)
        todo = np.arange(len(one))
        # Terms that share a hash stand side by side.
        while len(todo):
            place = np.minimum(at[todo], len(self) - 1)
            todo = todo[self.keys[place] == keys[todo]]
            number = self.order[np.minimum(at[todo], len(self) - 1)]
            same = self.size[number] == size[todo]
            some = np.flatnonzero(same)
            same[some] = same_bytes(self.data, self.start[number[some]], words.data, words.start[one[todo[some]]], size[todo[some]])
            out[todo[same]] = number[same]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < len(self)]
        return out


def counted(column: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, count) of the vocabulary's terms in whole texts."""
    words = Words(column, NOT_ALNUM)
    one, place = words.distinct()
    term = vocabulary.find(words, one)[place]
    hit = term >= 0
    wide = max(1, len(vocabulary))
    pair, count = np.unique(words.doc[hit] * wide + term[hit], return_counts=True)
    return pair // wide, pair % wide, count


@dataclass
class Index:
    """Examples as unit vectors. Postings by term and block of BLOCK examples, each with the block's largest weight."""

    vocabulary: Vocabulary
    weight_of: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    slope: float = 4.0
    shift: float = -2.0
    without: float = 0.5
    #: Postings: example and weight. Entries: block, largest weight, first and last posting. Terms: first and last entry.
    postings: tuple = field(default_factory=tuple)
    entries: tuple = field(default_factory=tuple)
    terms: np.ndarray | None = None

    def build(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> Index:
        order = np.lexsort((row, term))
        row, term, weight = row[order], term[order], weight[order]
        block = row // BLOCK
        start = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if len(row) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(row)))
        largest = np.maximum.reduceat(weight, start) if len(start) else np.zeros(0)
        self.postings = (row.astype(np.int32), weight)
        self.entries = (block[start].astype(np.int32), largest, start.astype(np.int32), size.astype(np.int32))
        self.terms = np.searchsorted(term[start], np.arange(len(self.weight_of) + 1))
        return self

    def unit(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
        weight = (1 + np.log(np.maximum(count, 1))) * self.weight_of[term]
        return weight / np.sqrt(np.maximum(np.bincount(row, weight * weight, rows), 1e-30))[row]

    def nearest(self, term: np.ndarray, weight: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the NEIGHBOURS nearest that share a term, ties to the smaller number.

        The blocks of the highest bounds go first; of the others those whose bound reaches the last neighbour's cosine.
        """
        blocks = -(-len(self.ids) // BLOCK)
        held = self.terms[term + 1] - self.terms[term]
        entry = runs(self.terms[term], held)
        mine = np.repeat(weight, held)
        block, largest, start, size = (x[entry] for x in self.entries)
        bound = np.bincount(block, mine * largest, blocks)
        cosine = np.zeros(blocks * BLOCK)

        def search(wanted: np.ndarray) -> np.ndarray:
            some = wanted[block]
            posting = runs(start[some].astype(np.int64), size[some].astype(np.int64))
            cosine[:] += np.bincount(self.postings[0][posting], np.repeat(mine[some], size[some]) * self.postings[1][posting], len(cosine))
            if leave >= 0:
                cosine[leave] = 0
            found = np.flatnonzero(cosine > 0)
            if len(found) > NEIGHBOURS:
                cut = np.partition(cosine[found], len(found) - NEIGHBOURS)[len(found) - NEIGHBOURS]
                found = found[cosine[found] >= cut]
            return found[np.lexsort((found, -cosine[found]))][:NEIGHBOURS]

        if blocks <= FIRST:
            found = search(bound > 0)
        else:
            first = np.zeros(blocks, bool)
            first[np.argpartition(-bound, FIRST)[:FIRST]] = True
            first &= bound > 0
            found = search(first)
            least = cosine[found[-1]] if len(found) == NEIGHBOURS else 0.0
            rest = (bound > 0) & ~first & (bound >= least - 1e-9)
            if rest.any():
                found = search(rest)
        return found, cosine[found]

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        weight = 1 / (0.05 + np.maximum(1 - cosine, 0))
        return float((weight * self.labels[found]).sum() / weight.sum())

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * vote + self.shift, -30, 30))))

    def calibrate(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, chosen: np.ndarray) -> None:
        """Platt scaling of the chosen examples' leave-one-out votes, targets smoothed."""
        limits = np.searchsorted(row, np.arange(len(self.ids) + 1))
        votes, truth = [], []
        for i in chosen.tolist():
            found, cosine = self.nearest(term[limits[i] : limits[i + 1]], weight[limits[i] : limits[i + 1]], i)
            if len(found):
                votes.append(self.vote(found, cosine))
                truth.append(self.labels[i])
        x, y = np.array(votes), np.array(truth, np.float64)
        ones = y.sum()
        if not ones or ones == len(y):
            return
        target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
        a = np.array([self.slope, self.shift])
        design = np.stack([x, np.ones(len(x))], 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
            grad = design.T @ (p - target) + 1e-3 * a
            hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            a = a - np.linalg.solve(hess, grad)
        if a[0] > 0:
            self.slope, self.shift = float(a[0]), float(a[1])


def relevance(term: np.ndarray, label: np.ndarray, size: int) -> np.ndarray:
    """log2(2 + toxic / other) of the examples that hold each term, to the POWER. A term seen once counts as common to both."""
    toxic = np.bincount(term, label, size)
    other = np.bincount(term, 1 - label, size)
    return np.log2(2 + np.maximum(toxic - 1, 0) / np.maximum(other, 1)) ** POWER


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Index:
    """fit() without the counts: texts are read for the examples and for the document frequencies."""
    return fit(docs, labels, sample_rows)[0]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, keep_counts: bool = False) -> tuple[Index, DataFrame | None]:
    """Examples and terms from at most sample_rows labelled documents whose crc32(doc_id) mod 3 isn't 1; document frequencies from all of docs.

    The sample, bounded by rows and by SAMPLE_BYTES, bounds all that reaches the driver and is sent to the tasks: the examples' words. Each text is one example, however many copies the sample has.
    With keep_counts the second result is (doc_id, terms, counts) of every row of docs, written: what scoring needs of a text.
    """
    spark = docs.sparkSession
    ship(spark)
    sample = labelled_sample(docs, labels, "toxic", 3, 1, sample_rows, SAMPLE_BYTES).groupBy("text").agg(F.min(F.col("doc_id").cast("string")).alias("id"), F.max("label").cast("int").alias("label"))

    def examples(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(2), NOT_ALNUM)
                one, place = words.distinct()
                wide = max(1, len(one))
                pair, count = np.unique(words.doc * wide + place, return_counts=True)
                row, kind = pair // wide, pair % wide
                offsets = pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32))
                text = pa.array([words.text(i) for i in one.tolist()], pa.binary()).take(pa.array(kind))
                yield pa.record_batch([part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, text), pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32)))], ["id", "label", "words", "counts"])

    got = sample.select("id", "label", "text").mapInArrow(examples, "id string, label int, words array<binary>, counts array<int>").toArrow().combine_chunks()
    ids = np.array(got["id"].to_pylist(), object)
    label = got["label"].to_numpy().astype(np.float64)
    words = got["words"].combine_chunks()
    size = np.diff(words.offsets.to_numpy()) if len(ids) else np.zeros(0, np.int64)
    coded = words.flatten().dictionary_encode() if len(ids) else pa.array([], pa.binary()).dictionary_encode()
    term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    count = got["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0, np.int32)
    vocabulary = Vocabulary(coded.dictionary)
    del got, words, coded
    pa.default_memory_pool().release_unused()
    shared = spark.sparkContext.broadcast(vocabulary)

    def frequency(batches):
        vocabulary = shared.value
        held = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                _, found, _ = counted(part.column(0), vocabulary)
                held[: len(vocabulary)] += np.bincount(found, minlength=len(vocabulary))[: len(vocabulary)]
                held[-1] += len(part)
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(held[some])], ["term", "n"])

    def count_texts(batches):
        vocabulary = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                row, found, times = counted(part.column(1), vocabulary)
                offsets = pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32))
                yield pa.record_batch([part.column(0), *[pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (found, times)]], ["doc_id", "terms", "counts"])

    def frequency_of_counts(batches):
        held = np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            held[:-1] += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=len(held) - 1)
            held[-1] += len(batch)
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(held[some])], ["term", "n"])

    counts = None
    if keep_counts:
        schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("terms array<int>, counts array<int>")])
        counts = materialize(docs.select("doc_id", "text").mapInArrow(count_texts, schema), "term-counts")
    source, summed = (docs.select("text"), frequency) if counts is None else (counts.select("terms"), frequency_of_counts)
    seen = np.zeros(len(vocabulary) + 1)
    rows = source.mapInArrow(summed, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # the sample's terms and one row
    seen[rows["term"].to_numpy()] = rows["n"].to_numpy()
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    row = np.repeat(np.arange(len(ids)), size)
    weight_of = idf * relevance(term, label[row], len(vocabulary))
    # Blocks of like examples have closer bounds: by label, then by the heaviest term.
    heaviest = np.full(len(ids), -1, np.int64)
    by = np.lexsort((term, weight_of[term], row))
    last = np.flatnonzero(np.append(row[by][1:] != row[by][:-1], len(row) > 0)) if len(row) else np.zeros(0, np.int64)
    heaviest[row[by][last]] = term[by][last]
    order = np.lexsort((ids.astype(str), heaviest, label))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    index = Index(vocabulary, weight_of, ids[order], label[order])
    row = place[row]
    by = np.lexsort((term, row))
    row, term, count = row[by], term[by], count[by]
    weight = index.unit(row, term, count, len(ids))
    index.without = (label.sum() + 0.5) / (len(label) + 1) if len(label) else 0.5
    index.build(row, term, weight)
    if len(ids):
        index.calibrate(row, term, weight, np.unique(np.linspace(0, len(ids) - 1, min(len(ids), CALIBRATED)).astype(int)))
    return index, counts


def _evidence(index: Index, row: np.ndarray, term: np.ndarray, count: np.ndarray, rows: int) -> list[pa.Array]:
    """Score, nearest example and its cosine of texts given by their terms and counts."""
    weight = index.unit(row, term, count, rows) if len(row) else np.zeros(0)
    limits = np.searchsorted(row, np.arange(rows + 1)).tolist()
    out = []
    for a, b in zip(limits, limits[1:], strict=False):
        found, cosine = index.nearest(term[a:b], weight[a:b]) if b > a else ((), ())
        out.append((index.score(index.vote(found, cosine)), str(index.ids[found[0]]), float(cosine[0])) if len(found) else (index.without, None, None))
    columns = zip(*out, strict=True) if out else ((), (), ())
    return [pa.array(x, t) for x, t in zip(columns, (pa.float64(), pa.string(), pa.float64()), strict=True)]


def score_counts(counts: DataFrame, index: Index) -> DataFrame:
    """(doc_id, score, nearest_example, nearest_cosine) of fit()'s counts."""
    shared = counts.sparkSession.sparkContext.broadcast(index)  # SAMPLE_ROWS examples at most
    schema = T.StructType([counts.schema["doc_id"], *T.StructType.fromDDL("score double, nearest_example string, nearest_cosine double")])

    def work(batches):
        for batch in batches:
            size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            term, count = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_evidence(shared.value, np.repeat(np.arange(len(batch)), size), term, count, len(batch))], schema.names)

    return counts.mapInArrow(work, schema)


def score(docs: DataFrame, index: Index) -> DataFrame:
    """docs with score, nearest_example and nearest_cosine as last columns (evidence is null where no example shares a term). Columns of those names, and repeated rows, do no harm."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(index)  # SAMPLE_ROWS examples at most

    def read(texts):
        index = shared.value
        return _evidence(index, *counted(texts, index.vocabulary), len(texts))

    return with_read_texts(docs, "score double, nearest_example string, nearest_cosine double", read)


def keep_below(docs: DataFrame, index: Index, threshold: float) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold. Repeated rows are scored each; no rows, no result."""
    return kept_where(score(docs, index), len(docs.columns), lambda x, *_: x < threshold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, and the nearest example as evidence, for every row of docs. Null texts are empty; repeated rows are scored each."""
    index, counts = fit(docs, labels, keep_counts=True)
    scored = score_counts(counts, index)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "nearest_example", "nearest_cosine")
