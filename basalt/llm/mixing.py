"""Soft-membership mixing: documents belong to domains by degrees, and rates bring the expected token totals to targets."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import materialize, numbered

#: Labelled rows of the classifier; for each domain its marking words at most, and how many also where they mark it less.
SAMPLE_ROWS, WORDS, WEAK = 8_000, 200, 20
#: Times that a word is likelier in a domain than in the others to mark it, and to mark it less.
LIFT, WEAK_LIFT = 20, 4
#: Weight of the rates' closeness to 1 against the totals' errors: a total is off by about this share of the rates that it takes.
DAMPING = 1e-8
#: Share of error to stop at, steps at most, and step lengths that one pass tries.
CLOSE, STEPS, LENGTHS = 1e-3, 40, (1.0, 0.5, 0.2, 0.05, 0.01)
SEED = 11
_BINS = 8


def label_domain() -> Column:
    """The domain that a row of `labels` names."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high")


#: Limits between the bins of each statistic: shares of capitals, of signs and of exclamation marks among the characters, distinct among all words, and the words' decimal logarithm.
_LIMITS = ((0.005, 0.02, 0.05, 0.1, 0.3, 0.6), (0.002, 0.01, 0.03, 0.06, 0.12), (0.001, 0.01, 0.04, 0.1), (0.2, 0.35, 0.5, 0.65, 0.8, 0.95), (1.0, 1.5, 2.0, 2.5, 3.0, 3.5))
#: What is taken out of a text to leave the signs that are counted.
_SIGNS = ("[^A-Z]+", r"[^#$%&*+=<>^~|\\]+", "[^!]+")


def _at_most(x: Column):
    return lambda v: v <= x


def _with_statistics(docs: DataFrame) -> DataFrame:
    """Adds the distinct words, n_tokens and five binned statistics of whole texts; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("_words", F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))
    size = F.greatest(F.length(text), F.lit(1))
    raw = [F.length(F.regexp_replace(text, keep, "")) / size for keep in _SIGNS]
    out = out.select("*", F.array_distinct("_words").alias("_own"), F.size("_words").alias("_n"), *[x.alias(f"_x{i}") for i, x in enumerate(raw)])
    out = out.select("*", (F.size("_own") / F.greatest(F.col("_n"), F.lit(1))).alias("_x3"), F.log10(F.col("_n") + F.lit(1.0)).alias("_x4"), (F.col("_n") + 1).cast("long").alias("n_tokens"))
    bins = [F.size(F.filter(F.array(*map(F.lit, limits)), _at_most(F.col(f"_x{i}")))).alias(f"_f{i}") for i, limits in enumerate(_LIMITS)]
    return out.select(*docs.columns, "_own", "n_tokens", *bins)


def train(docs: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """A naive Bayes classifier of (doc_id, domain) rows, at most sample_rows of smallest id hash.

    Its tables, a few counts for each domain, statistic and bin, and the words that mark a domain, are all that reaches the driver.
    """
    chosen = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("domain").alias("domain"))
    stats = materialize(_with_statistics(texts).select("domain", "_own", *[f"_f{i}" for i in range(5)]), "mix-sample")
    totals = {r["domain"]: r["n"] for r in stats.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    all_rows = sum(totals.values())
    marks: dict[str, list[str]] = {}
    if len(totals) > 1:
        by_word = stats.select("domain", F.explode("_own").alias("w")).groupBy("w", "domain").agg(F.count("*").alias("n"))
        every = by_word.groupBy("w").agg(F.max(F.struct("n", "domain")).alias("m"), F.sum("n").alias("all")).where("all >= 5")
        size = F.create_map(*[F.lit(x) for d, n in totals.items() for x in (d, n)])[F.col("m.domain")]
        lift = (F.col("m.n") / size) / ((F.col("all") - F.col("m.n") + 0.5) / (F.lit(all_rows) - size + 1))
        # Each domain has its own bound, so a large one doesn't crowd out the words of a small one. A sort with a limit for each holds no domain in one task.
        ranked = materialize(every.select("w", "m", lift.alias("lift")).where(F.col("lift") >= WEAK_LIFT), "mix-words")
        found = []
        for d in sorted(totals):
            best = ranked.where(F.col("m.domain") == d).orderBy(F.col("lift") < LIFT, F.desc("m.n"), "w").limit(WORDS).collect()
            found += [r for i, r in enumerate(best) if r["lift"] >= LIFT or i < WEAK]
        for r in found:
            marks.setdefault(r["m"]["domain"], []).append(r["w"])
    marked = _marked(stats, marks)
    names = [f"_f{i}" for i in range(5 + len(marks))]
    long = marked.select("domain", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("int").alias("b")) for i, c in enumerate(names)])).alias("x"))
    counts = {(r["domain"], r["f"], r["b"]): r["n"] for r in long.groupBy("domain", "x.f", "x.b").agg(F.count("*").alias("n")).collect()}
    return {"totals": totals, "marks": marks, "counts": counts, "features": len(names)}


def _marked(df: DataFrame, marks: dict[str, list[str]]) -> DataFrame:
    for i, domain in enumerate(sorted(marks)):
        hits = F.size(F.array_intersect("_own", F.array(*map(F.lit, marks[domain]))))
        df = df.withColumn(f"_f{5 + i}", F.least(hits, F.lit(_BINS - 1)))
    return df


def posteriors(docs: DataFrame, model: dict) -> DataFrame:
    """Adds n_tokens and `posterior`, a map from domain to probability, from the text alone. Without labelled rows the one domain is `all`."""
    domains = sorted(model["totals"]) or ["all"]
    rows = sum(model["totals"].values())
    marked = _marked(_with_statistics(docs), model["marks"])
    logs = []
    for d in domains:
        n = model["totals"].get(d, 0)
        total = F.lit(math.log((n + 1) / (rows + len(domains))))
        for f in range(model["features"]):
            table = F.array(*[F.lit(math.log((model["counts"].get((d, f, b), 0) + 0.5) / (n + 0.5 * _BINS))) for b in range(_BINS)])
            total = total + F.get(table, F.col(f"_f{f}"))
        logs.append(total)
    marked = marked.withColumn("_logs", F.array(*logs))
    top = F.array_max("_logs")
    marked = marked.withColumn("_e", F.transform("_logs", lambda x: F.exp(x - top)))
    whole = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    made = marked.withColumn("posterior", F.map_from_arrays(F.array(*map(F.lit, domains)), F.transform("_e", lambda x: x / whole)))
    return made.drop("_own", "_logs", "_e", *[f"_f{i}" for i in range(model["features"])])


def _rate(shares: list[Column], pull: list[float]) -> Column:
    """A document's rate: 1 and what the domains pull it by, projected to 0 and more."""
    return F.greatest(F.lit(0.0), sum((F.lit(float(y)) * p for y, p in zip(pull, shares, strict=True)), F.lit(1.0)))


def fit_rates(members: DataFrame, targets: dict[str, float]) -> tuple[Column, dict]:
    """members: n_tokens and posterior. Rates r >= 0 by least squares: the totals' errors from their targets, and by DAMPING the rates' distance from 1.

    Where those two balance, r is max(0, 1 + p'y) for one number y of each domain: the rates that a projected gradient step from 1 along
    y gives. So y is what has to be found, by projected gradient steps in the metric of the documents that the projection leaves above 0
    (G = sum n p p' over them). A step is one aggregation to the totals, G and the objective at each of LENGTHS, of which the best is
    taken; rates follow from a document's own posteriors and y, so no state is kept for documents.
    Domains without mass are left out and the other targets made to sum to one. It steps until every total is within CLOSE of its
    target, or nothing gets better: then the target is beyond what rates of 0 and more can reach, and these come as near as least
    squares do. Returns the rate's expression and, for each domain, the target and the total reached.
    """
    names = sorted(targets)
    mass = members.agg(*[F.sum(F.col("n_tokens") * F.coalesce(F.col("posterior")[k], F.lit(0.0))).alias(f"m{i}") for i, k in enumerate(names)]).first()
    held = [(k, mass[i]) for i, k in enumerate(names) if (mass[i] or 0) > 0 and targets[k] > 0]
    if not held:
        return F.lit(1.0), {}
    whole, share, count = sum(m for _, m in held), sum(targets[k] for k, _ in held), len(held)
    goal = np.array([targets[k] / share * whole for k, _ in held])
    shares = [F.coalesce(F.col("posterior")[k], F.lit(0.0)) for k, _ in held]
    state = materialize(members.select(F.col("n_tokens").cast("double").alias("n"), *[p.alias(f"p{i}") for i, p in enumerate(shares)]), "rates")
    columns = [F.col(f"p{i}") for i in range(count)]

    def measure(pulls: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(objective, totals, G) of each pull, in one pass."""
        rated = state.select("n", *columns, *[_rate(columns, y.tolist()).alias(f"r{j}") for j, y in enumerate(pulls)])
        sums = []
        for j in range(len(pulls)):
            tokens = F.col("n") * F.col(f"r{j}")
            left = F.when(F.col(f"r{j}") > 0, F.col("n")).otherwise(0.0)
            sums += [F.sum(tokens * F.col(f"r{j}")), *[F.sum(tokens * p) for p in columns], *[F.sum(left * columns[a] * columns[b]) for a in range(count) for b in range(a + 1)]]
        got = np.array(rated.agg(*sums).first(), np.float64).reshape(len(pulls), -1)
        out = []
        for y, row in zip(pulls, got, strict=True):
            gram = np.zeros((count, count))
            gram[np.tril_indices(count)] = row[1 + count :]
            out.append((float(y @ goal - row[0] / 2 - DAMPING / 2 * (goal * y) @ y), row[1 : 1 + count], np.maximum(gram, gram.T)))
        return out

    y = np.zeros(count)
    (value, now, gram), *_ = measure([y])
    for _ in range(STEPS):
        if np.abs(now / goal - 1).max() < CLOSE:
            break
        slope = goal - now - DAMPING * goal * y
        step = np.linalg.lstsq(gram + np.diag(DAMPING * goal), slope, rcond=None)[0]
        tried = [y + t * step for t in LENGTHS]
        best, found = max(enumerate(measure(tried)), key=lambda x: x[1][0])
        if found[0] <= value + 1e-13 * abs(value):
            break
        y, (value, now, gram) = tried[best], found
    return _rate(shares, y.tolist()), {k: (g, a) for (k, _), g, a in zip(held, goal.tolist(), now.tolist(), strict=True)}


def copies(rate: Column, u: Column) -> Column:
    """How often a document is taken: the rate rounded up or down by u, uniform in [0, 1), so the expectation is the rate."""
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: list[str] | None = None, seed: int = SEED) -> tuple[DataFrame, dict]:
    """docs (all columns, or those in keep) with n_tokens, posterior, rate and copies; and each domain's target and total reached.

    Texts are read once: what the classifier says is written with the columns kept, and rates are fitted on it. A seeded
    hash of doc_id and text rounds the rate. Tokens are words and one end for each document. A total more than 0.5 % off its
    target is warned of. Repeated rows are rated each; null texts are empty; columns of any names do no harm. No rows, no result.
    """
    model = train(docs, labelled)
    kept = docs.columns if keep is None else keep
    places = [docs.columns.index(c) for c in kept]
    inner = numbered(docs).select("*", *[F.col(f"c{docs.columns.index(c)}").alias(c) for c in ("doc_id", "text")])
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    members = materialize(posteriors(inner, model).select(*[f"c{i}" for i in places], "n_tokens", "posterior", u.alias("u")), "members")
    rate, reached = fit_rates(members.select("n_tokens", "posterior"), targets)
    for domain, (goal, total) in reached.items():
        if abs(total - goal) > 0.005 * goal:
            warnings.warn(f"{domain}: {total:.0f} tokens expected, target {goal:.0f}", stacklevel=2)
    mixed = members.withColumn("rate", rate).withColumn("copies", copies(F.col("rate"), F.col("u"))).drop("u")
    return mixed.toDF(*kept, "n_tokens", "posterior", "rate", "copies"), reached


def sample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """The columns of docs, each row as often as its copies say."""
    mixed = numbered(mix(docs, labelled, targets)[0])
    n = len(docs.columns)
    # The rows as often as they are taken, none for none: no filter, which would be pushed below the rate and repeat it.
    taken = mixed.withColumn("n", F.explode(F.array_repeat(F.lit(1), F.col(f"c{n + 3}"))))
    return taken.select(*[f"c{i}" for i in range(n)]).toDF(*docs.columns)
