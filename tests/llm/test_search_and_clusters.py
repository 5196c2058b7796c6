"""Ranked lexical search and centroid clustering against brute force, on tables with nulls, ties, repeats and long texts."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
pytest.importorskip("basalt.llm")

from basalt.llm import clustering, term_scan  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def ranked(docs, items, k):
    """The contract, term by term."""
    held = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    size = [sum(c.values()) for _, c in held]
    n_docs, n_terms = sum(n > 0 for n in size), sum(size)
    out = []
    for item, text in items:
        own = Counter(TERM.findall(lower(text)))
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c in held) + 1))) for t in own}
        scores = []
        for (doc, c), n in zip(held, size, strict=True):
            m = 75 + (25 * n * n_docs) // max(n_terms, 1)
            s = sum(times * w[t] * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in own.items())
            if s > 0:
                scores.append((-s, doc is not None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    pool = "the of and Café niño Stone river x1 Ünder über cloud-9 it's naïve 42 ALPHA alpha".split()
    docs = [(i, " ".join(rng.choice(pool) + rng.choice(["", ".", "\n", "!!"]) for _ in range(rng.randint(1, 60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \t..."), (203, "stone " * 400_000), (204, "stone" + "q" * 2_500_000), (205, docs[3][1]), (3, docs[3][1]), (None, "river river"), (-7, "river river"), (206, "ALPHA\u0000alpha"), (207, "the" * 3)]
    items = [(1, "the Stone of RIVER"), (2, None), (3, ""), (4, "unheard words only"), (5, "café CAFÉ river river river"), (5, "alpha"), (6, "!!"), (None, "über 42 cloud 9"), (7, "stone" + "q" * 2_500_000)]
    return docs, items


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("stretch", [7, 1_000_000])
def test_term_scan(spark, texts, monkeypatch, stretch):
    docs, items = texts
    if stretch == 7:
        docs = [(i, t[:3_000] if t else t) for i, t in docs]
    monkeypatch.setattr(term_scan, "STRETCH", stretch)
    frame = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, row long, term string").repartition(3)
    got = term_scan.search(frame, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, shard int"), 5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert as_rows(got) == Counter(ranked(docs, items, 5))


def test_term_scan_in_several_scans(spark, texts, monkeypatch):
    docs, items = ([(i, t and t[:500]) for i, t in rows] for rows in texts)
    monkeypatch.setattr(term_scan, "TERM_BYTES", 12)
    monkeypatch.setattr(term_scan, "SCORES", 50)
    got = term_scan.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3)
    assert as_rows(got) == Counter(ranked(docs, items, 3))


def test_whole_number_scores_agree_with_doubles(spark, texts, monkeypatch):
    docs, items = ([(i, t and t[:500]) for i, t in rows] for rows in texts)
    monkeypatch.setattr(term_scan, "EXACT", 0)
    got = term_scan.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert as_rows(got) == Counter(ranked(docs, items, 20))


def test_term_scan_of_empty_tables(spark, texts):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(texts[1], "item_id long, text string")
    assert term_scan.search(none, items).count() == 0
    assert term_scan.search(spark.createDataFrame(texts[0][:3], "doc_id long, text string"), items.limit(0)).count() == 0


def plain_clusters(rows, count, rounds, dims):
    """The contract in Python's whole numbers."""
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:count]
    centroids = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        held = {}
        for _, v in kept:
            held.setdefault(nearest(v)[1], []).append(v)
        for c, vs in held.items():
            centroids[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    got = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in got:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in got)


def vectors(dims):
    rng = random.Random(9)
    heart = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in heart[i % 6]]) for i in range(150)]
    same = [(500 + i, rows[0][1]) for i in range(60)]
    odd = [(700, None), (701, [0.1] * (dims - 1)), (702, [None] + [0.1] * (dims - 1)), (703, [math.nan] * dims), (704, [math.inf] * dims), (705, []), (None, [0.25] * dims), (3, [0.5] * dims), (3, [0.25] * dims), (706, [-0.0] * dims), (707, [1000.0] * dims)]
    return [*rows, *same, *odd]


@pytest.mark.parametrize("pivots", [0, 1, 16])
def test_clusters(spark, pivots):
    rows = vectors(8)
    frame = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id long, embedding array<double>, cluster int, distance int").repartition(3)
    got = clustering.cluster(clustering.kept(frame, 8), 12, 3, pivots=pivots)
    assert as_rows(got) == plain_clusters(rows, 12, 3, 8)


def test_few_equal_and_no_vectors(spark):
    for rows in ([(1, [0.5] * 8), (2, [0.5] * 8)], [(1, None)], []):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert as_rows(clustering.cluster(clustering.kept(frame, 8), 5, 2)) == plain_clusters(rows, 5, 2, 8)


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        clustering.kept(spark.createDataFrame([(1, [1e9] * 8)], "vec_id long, embedding array<double>"), 8).collect()


def test_pivots_spare_distances():
    rng = np.random.default_rng(4)
    heart = rng.integers(-2_000, 2_000, (40, 16))
    v = heart[rng.integers(0, 40, 3_000)] + rng.integers(-60, 60, (3_000, 16))
    points = heart[:8]
    far, reach = clustering._from_each(v, points), clustering._from_each(heart, points)
    best, own, compared = clustering.nearest(v, far, heart, reach)
    every = ((v[:, None, :] - heart[None]) ** 2).sum(-1)
    assert (best == every.argmin(1)).all() and (own == every.min(1)).all()
    assert compared < 0.2 * every.size
