"""Soft-membership mixing: the query's targets are reached, and posteriors and rates agree with plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

regex = pytest.importorskip("regex")
pytest.importorskip("public_tokenizers")
pytest.importorskip("basalt.llm")

from basalt.llm import mixing, queries  # noqa: E402


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_the_querys_targets_are_reached(spark, size):
    folder = f"/root/testdata/{size}"
    labelled = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", mixing.label_domain().alias("domain"))
    mixed, reached = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet"), labelled, queries.MIX_TARGETS, ["doc_id"])
    rows = mixed.select("n_tokens", "rate", *[mixed.posterior[k].alias(k) for k in queries.MIX_TARGETS]).collect()
    whole = sum(r.n_tokens for r in rows)
    assert all(r.rate >= 0 for r in rows)
    for domain, share in queries.MIX_TARGETS.items():
        total = sum(r.n_tokens * r.rate * r[domain] for r in rows)
        assert abs(total / (share * whole) - 1) < 0.005 and total == pytest.approx(reached[domain][1])


def features(text):
    """(distinct words, tokens, the five bins) of a text."""
    text = text or ""
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    size = max(1, len(text))
    raw = [sum("A" <= c <= "Z" for c in text) / size, sum(c in "#$%&*+=<>^~|\\" for c in text) / size, text.count("!") / size, len(set(words)) / max(1, len(words)), math.log10(len(words) + 1)]
    return set(words), len(words) + 1, [sum(limit <= x for limit in limits) for limits, x in zip(mixing._LIMITS, raw, strict=True)]


def posteriors(docs, labelled):
    """Naive Bayes with the features of the operator, counted in plain Python."""
    domain = {}
    for i, d in labelled:
        if i is not None and d is not None:
            domain[i] = min(d, domain.get(i, d))
    texts = defaultdict(list)
    for i, t in docs:
        if i in domain:
            texts[i].append(t)
    sample = [(domain[i], features(min((t for t in ts if t is not None), default=None))) for i, ts in texts.items()]
    totals = Counter(d for d, _ in sample)
    by_word = defaultdict(Counter)
    for d, (own, *_) in sample:
        for w in own:
            by_word[w][d] += 1
    marks = defaultdict(list)
    for w, c in by_word.items():
        n, d = max((n, d) for d, n in c.items())
        every = sum(c.values())
        lift = (n / totals[d]) / ((every - n + 0.5) / (len(sample) - totals[d] + 1))
        if every >= 5 and lift >= mixing.WEAK_LIFT and len(totals) > 1:
            marks[d].append((lift < mixing.LIFT, -n, w))
    kept = {d: {w for i, (weak, _, w) in enumerate(sorted(ws)[: mixing.WORDS]) if not weak or i < mixing.WEAK} for d, ws in marks.items()}
    kept = {d: ws for d, ws in kept.items() if ws}
    bins = lambda own, five: five + [min(len(own & kept[d]), mixing._BINS - 1) for d in sorted(kept)]
    counts = Counter((d, f, b) for d, (own, _, five) in sample for f, b in enumerate(bins(own, five)))
    out = []
    for _, t in docs:
        own, n, five = features(t)
        logs = {d: math.log((m + 1) / (len(sample) + len(totals))) + sum(math.log((counts[d, f, b] + 0.5) / (m + 0.5 * mixing._BINS)) for f, b in enumerate(bins(own, five))) for d, m in totals.items()}
        top = max(logs.values())
        e = {d: math.exp(x - top) for d, x in logs.items()}
        out.append((n, {d: x / sum(e.values()) for d, x in e.items()}))
    return out


def test_posteriors_against_plain_python(spark):
    rng = random.Random(12)
    pool = {"high": "river stone cloud lantern copper harbour".split(), "low": "WIN CASH!! $$$ free### now".split(), "toxic": "idiot scum moron river stone".split()}
    docs = [(i, " ".join(rng.choice(pool[d]) for _ in range(rng.randint(3, 60)))) for i, d in enumerate(rng.choices(list(pool), [6, 2, 1], k=300))]
    docs += [(900, None), (901, ""), (902, "Über naïve 42"), (3, docs[3][1]), (None, "river idiot")]
    kinds = [next(d for d, ws in pool.items() if t.split()[0] in ws) for _, t in docs[:300]]
    labelled = [(i, d) for (i, _), d in zip(docs[:300], kinds, strict=True) if i % 2] + [(3, "low"), (None, "low"), (5_000, "high"), (4, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = mixing.train(frame, spark.createDataFrame(labelled, "doc_id long, domain string"))
    got = Counter((r.n_tokens, *sorted((k, round(v, 9)) for k, v in r.posterior.items())) for r in mixing.posteriors(frame, model).collect())
    assert got == Counter((n, *sorted((k, round(v, 9)) for k, v in p.items())) for n, p in posteriors(docs, labelled))


def test_rates_are_the_nearest_to_one_that_reach_the_targets(spark):
    """Against a quadratic program solved by a long run of projected steps on its dual, in numpy."""
    rng = np.random.default_rng(3)
    n = rng.integers(5, 500, 200).astype(float)
    p = rng.dirichlet([4, 0.3, 0.1], 200)
    goal = np.array([0.7, 0.2, 0.1]) * n.sum()
    members = spark.createDataFrame([(int(k), dict(zip("abc", map(float, x), strict=True))) for k, x in zip(n, p, strict=True)], "n_tokens long, posterior map<string, double>")
    rate, reached = mixing.fit_rates(members, dict(zip("abc", (0.7, 0.2, 0.1), strict=True)))
    y = np.zeros(3)
    for _ in range(200_000):
        y += (goal - (n * np.maximum(0, 1 + p @ y)) @ p) / n.sum()
    want = np.maximum(0, 1 + p @ y)
    got = np.array([r.r for r in members.select(rate.alias("r")).collect()])
    assert np.abs((n * want) @ p / goal - 1).max() < 1e-6
    assert np.abs(got - want).max() < 0.01 * want.max()
    assert all(abs(a / g - 1) < 1e-3 for g, a in reached.values())


def test_targets_out_of_reach_and_left_out(spark):
    members = spark.createDataFrame([(10, {"a": 0.9, "b": 0.1}), (30, {"a": 0.8, "b": 0.2}), (5, None)], "n_tokens long, posterior map<string, double>")
    rate, reached = mixing.fit_rates(members, {"a": 0.1, "b": 0.9, "c": 0.0})
    assert set(reached) == {"a", "b"}
    rows = members.select("n_tokens", rate.alias("r")).collect()
    assert all(math.isfinite(r.r) and r.r >= 0 for r in rows)
    assert mixing.fit_rates(members.limit(0), {"a": 1.0})[1] == {}
    assert members.select(mixing.fit_rates(members.limit(0), {"a": 1.0})[0].alias("r")).agg(F.max("r")).first()[0] == 1.0
