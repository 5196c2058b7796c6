"""The quality machine against plain Python: features of a text, the sum over all pairs, the fit step by step, and the whole query."""

import bisect
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
pytest.importorskip("basalt.llm")

from basalt.llm import factorization as fm  # noqa: E402
from basalt.llm.words import Words  # noqa: E402

TEXTS = [None, "", " \n\t", "One two two THREE!", "a|b|c 12 12 $$ %%", "ünïcode Über\nline one\nline one\n\nlast", "x" * 300 + " y", "The river\r\nran, it's 42-fold.", "!!! ???", "é"]


def by_hand(text):
    """Counter of (feature id, value rounded) of one text."""
    data = (text or "").encode()
    low = data.lower()
    words = low.split()
    kinds = sorted(set(words))
    lines = [x for x in low.split(b"\n") if x]
    alpha = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in data)
    sign = sum(32 < b < 127 and not chr(b).isalnum() and chr(b) not in ",.'-" for b in data)
    some, size = max(1, len(words)), max(1, len(data))
    stats = [
        sum(65 <= b <= 90 for b in data) / max(1, alpha), sign / size, sum(48 <= b <= 57 for b in data) / size, data.count(b"|") / some, data.count(b"!") / some, data.count(b"\n") / some, sum(b >= 128 for b in data) / size,
        len(kinds) / some, len(set(lines)) / max(1, len(lines)), min(sum(map(len, words)) / some / 20, 1), min(math.log2(1 + len(text or "")) / 20, 1), min(math.log2(1 + len(lines)) / 12, 1),
    ]
    held = Counter()
    for w in kinds:
        bucket = int(Words(pa.array([w], pa.binary())).hashes()[0] % np.uint64(fm.BUCKETS))
        held[bucket, round(1 / math.sqrt(len(kinds)), 5)] += 1
    for i, x in enumerate(stats):
        held[fm.BUCKETS + i * len([*fm._RATIOS, 0]) + bisect.bisect_right(fm._RATIOS.tolist(), x), round(1 / math.sqrt(12), 5)] += 1
    return held


def test_features():
    starts, ids, values = fm.features(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        a, b = starts[i], starts[i + 1]
        assert Counter((int(k), round(float(v), 5)) for k, v in zip(ids[a:b], values[a:b], strict=True)) == by_hand(text), text


def pairs(machine, ids, x):
    """bias + w.x + every pair's v_i . v_j x_i x_j."""
    ids = [int(i) for i in ids]
    total = machine.bias + sum(float(machine.w[i]) * v for i, v in zip(ids, x, strict=True))
    for a in range(len(ids)):
        for b in range(a):
            total += float(machine.v[ids[a]].astype(float) @ machine.v[ids[b]].astype(float)) * x[a] * x[b]
    return total


def test_fit_step_by_step(monkeypatch):
    """AdaGrad with gradients taken pair by pair."""
    monkeypatch.setattr(fm, "PASSES", 3)
    monkeypatch.setattr(fm, "STEP_ROWS", 4)
    rng = random.Random(3)
    rows = [(i % 2, np.array(sorted(rng.sample(range(12), 4)), np.int32), np.array([rng.random() for _ in range(4)], np.float32)) for i in range(11)]
    got = fm.fit(rows, 5)
    size = len(got.w)
    draw = np.random.default_rng(5)
    m = fm.Machine(0.0, np.zeros(size), (draw.standard_normal((size, fm.FACTORS)) * 0.05).astype(np.float32).astype(float))
    y = [r[0] for r in rows]
    m.bias = math.log(np.mean(y) / (1 - np.mean(y)))
    gb, gw, gv = 1e-8, np.full(size, 1e-8), np.full((size, fm.FACTORS), 1e-8)
    for _ in range(3):
        order = draw.permutation(len(rows))
        for at in range(0, len(order), 4):
            some = [rows[i] for i in order[at : at + 4]]
            dw, dv, off = Counter(), {}, []
            for label, ids, x in some:
                o = 1 / (1 + math.exp(-pairs(m, ids, x))) - label
                off.append(o)
                for a, i in enumerate(ids.tolist()):
                    dw[i] += o * x[a] / len(some)
                    others = sum((m.v[int(j)] * x[b] for b, j in enumerate(ids) if b != a), np.zeros(fm.FACTORS))
                    dv[i] = dv.get(i, 0) + o * x[a] * others / len(some)
            for i in dv:
                w, v = dw[i] + fm.L2 * m.w[i], dv[i] + fm.L2 * m.v[i]
                gw[i] += w * w
                gv[i] += v * v
                m.w[i] -= fm.RATE * w / math.sqrt(gw[i])
                m.v[i] -= fm.RATE * v / np.sqrt(gv[i])
            gb += np.mean(off) ** 2
            m.bias -= fm.RATE * np.mean(off) / math.sqrt(gb)
    assert got.bias == pytest.approx(m.bias, abs=1e-3)
    assert np.allclose(got.w[:12], m.w[:12], atol=2e-3) and np.allclose(got.v[:12], m.v[:12], atol=2e-3)


def test_the_querys_scores(spark):
    rng = random.Random(1)
    good, bad = "river stone cloud lantern copper harbour meadow".split(), "CASH!! $$$ free### WIN now".split()
    rows = [(i, " ".join(rng.choice(bad if i % 3 == 0 else good) for _ in range(rng.randint(1, 12)))) for i in range(90)] + [(200 + i, t) for i, t in enumerate(TEXTS)] + [(5, "again"), (None, "river")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    machine = fm.train(docs, labels)
    got = Counter((r.doc_id, round(r.score, 3)) for r in fm.classify(docs, labels).collect())
    want = Counter()
    for i, t in rows:
        starts, ids, x = fm.features(pa.array([t]))
        want[i, round(1 / (1 + math.exp(-pairs(machine, ids, x.tolist()))), 3)] += 1
    # A score on the edge of two roundings may fall on either side.
    assert sum((got - want).values()) <= 2 and len(list(got.elements())) == len(rows)
