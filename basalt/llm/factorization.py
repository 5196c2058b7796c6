"""Quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import crc_mod, kept_where, ship, slices, with_read_texts
from basalt.llm.labelled import labelled_sample
from basalt.llm.words import Words, per_row

#: Word buckets, factors, labelled rows that the machine is fitted on, passes, rows of a step, learning rate, L2.
BUCKETS, FACTORS, SAMPLE_ROWS, PASSES, STEP_ROWS, RATE, L2 = 1 << 15, 6, 6_000, 8, 128, 0.1, 1e-4
_RATIOS = np.array([1e-9, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9, 0.97])
_BINS = len(_RATIOS) + 1
_STATS = 12
_LINES = np.zeros(256, bool)
_LINES[10] = True
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_ALPHA = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_SIGN = (_BYTES > 32) & (_BYTES < 127) & ~_ALPHA & ~_DIGIT & ~np.isin(_BYTES, [44, 46, 39, 45])


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows' first place, feature ids, values) of whole texts; an empty or null text has its statistics only."""
    words = Words(column)
    n = words.rows
    keys = words.hashes()
    order = np.lexsort((keys, words.doc))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])
    doc = words.doc[order][new]
    bucket = (keys[order][new] % np.uint64(BUCKETS)).astype(np.int64)
    distinct = np.bincount(doc, minlength=n)
    lines = Words(column, _LINES)
    line_order = np.lexsort((lines.hashes(), lines.doc))
    h = lines.hashes()[line_order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (lines.doc[line_order][1:] != lines.doc[line_order][:-1])
    own_lines = np.bincount(lines.doc[line_order][first], minlength=n)
    raw = words.raw
    size = np.diff(words.first)
    alpha, upper = per_row(_ALPHA[raw], words.first), per_row(_UPPER[raw], words.first)
    safe = lambda a, b: a / np.maximum(b, 1)
    some = np.maximum(words.counts, 1)
    stats = [
        safe(upper, alpha),
        safe(per_row(_SIGN[raw], words.first), size),
        safe(per_row(_DIGIT[raw], words.first), size),
        safe(per_row(raw == 124, words.first), some),
        safe(per_row(raw == 33, words.first), some),
        safe(per_row(raw == 10, words.first), some),
        safe(per_row(raw >= 128, words.first), size),
        safe(distinct, some),
        safe(own_lines, np.maximum(lines.counts, 1)),
        np.minimum(safe(words.end.size and np.bincount(words.doc, words.end - words.start, n), some) / 20, 1),
        np.minimum(np.log2(1 + per_row((raw & 0xC0) != 0x80, words.first)) / 20, 1),
        np.minimum(np.log2(1 + lines.counts) / 12, 1),
    ]
    stat_ids = np.stack([BUCKETS + i * _BINS + np.searchsorted(_RATIOS, x, side="right") for i, x in enumerate(stats)], axis=1)
    ids = np.concatenate([bucket, stat_ids.ravel()])
    rows = np.concatenate([doc, np.repeat(np.arange(n), _STATS)])
    values = np.concatenate([(1 / np.sqrt(np.maximum(distinct, 1)))[doc], np.full(n * _STATS, 1 / np.sqrt(_STATS))])
    back = np.argsort(rows, kind="stable")
    starts = np.concatenate([[0], np.cumsum(distinct + _STATS)])
    return starts, ids[back].astype(np.int32), values[back].astype(np.float32)


@dataclass
class Machine:
    """bias + w.x + the pairwise interactions of x through factors v, in time linear in the features that a row has."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, starts: np.ndarray, ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(starts) < 2:
            return np.zeros(0), np.zeros((0, self.v.shape[1]))
        at = starts[:-1]
        scaled = self.v[ids] * values[:, None]
        sums = np.add.reduceat(scaled, at)
        squares = np.add.reduceat(scaled * scaled, at)
        linear = np.add.reduceat(self.w[ids] * values, at)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(1), sums

    def score(self, starts: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(starts, ids, values)[0].astype(np.float64), -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss. rows: (label, feature ids, values). Without both labels: a constant."""
    size = BUCKETS + _STATS * _BINS
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(size, np.float32), (rng.standard_normal((size, FACTORS)) * 0.05).astype(np.float32))
    y = np.array([r[0] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        m.v[:] = 0
        p = (y.sum() + 0.5) / (len(y) + 1)
        m.bias = float(np.log(p / (1 - p)))
        return m
    m.bias = float(np.log(y.mean() / (1 - y.mean())))
    gb, gw, gv = 1e-8, np.full(size, 1e-8), np.full((size, FACTORS), 1e-8)
    for _ in range(PASSES):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), STEP_ROWS):
            some = [rows[i] for i in order[at : at + STEP_ROWS]]
            starts = np.concatenate([[0], np.cumsum([len(r[1]) for r in some])])
            ids, x = np.concatenate([r[1] for r in some]), np.concatenate([r[2] for r in some])
            raw, sums = m.raw(starts, ids, x)
            off = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[order[at : at + STEP_ROWS]]
            each = np.repeat(np.arange(len(some)), np.diff(starts))
            slope = off[each] * x / len(some)
            used, place = np.unique(ids, return_inverse=True)
            dw = np.bincount(place, slope) + L2 * m.w[used]
            dv = np.stack([np.bincount(place, slope * (sums[each, f] - m.v[ids, f] * x)) for f in range(FACTORS)], 1) + L2 * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += off.mean() ** 2
            m.w[used] -= RATE * dw / np.sqrt(gw[used])
            m.v[used] -= RATE * dv / np.sqrt(gv[used])
            m.bias -= RATE * off.mean() / np.sqrt(gb)
    return m


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fitted on labels.quality of at most sample_rows documents whose crc32(doc_id) mod 5 isn't 0; only their feature arrays reach the driver."""
    ship(docs.sparkSession)

    def collect(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                starts, ids, values = features(part.column(1))
                cut = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
                yield pa.record_batch([part.column(2), pa.array([ids[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([values[a:b].tobytes() for a, b in cut], pa.binary())], ["label", "ids", "x"])

    sample = labelled_sample(docs, labels, "quality", 5, 0, sample_rows).selectExpr("doc_id", "text", "cast(label as int) label")
    got = sample.mapInArrow(collect, "label int, ids binary, x binary").collect()
    rows = [(r["label"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["x"], np.float32)) for r in got]
    return fit(sorted(rows, key=lambda r: (r[0], r[1].tobytes())))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with a last column `score` (0 to 1) from the whole text alone; other columns pass through unread, one named score too. Null and empty texts have a score too."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(machine)  # BUCKETS * (FACTORS + 1) numbers
    return with_read_texts(docs, "score double", lambda texts: [pa.array(shared.value.score(*features(texts)), pa.float64())])


def keep_from(docs: DataFrame, machine: Machine, threshold: float) -> DataFrame:
    """The rows of docs, all columns, that score at least the threshold. Repeated rows are scored each; no rows, no result."""
    return kept_where(score(docs, machine), len(docs.columns), lambda x: x >= threshold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; repeated rows are scored each."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
