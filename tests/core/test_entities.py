import random
import re
from collections import Counter

from basalt.operators import entities


def by_hand(text, terms):
    """The rules, with regular expressions, term by term."""
    found = {}
    for t in sorted({t.lower() for t in terms}):
        n = len(re.findall(rf"\b{re.escape(t)}\b", (text or "").lower()))
        if n:
            name = t.upper() if len(t) <= 4 else t.title()
            found[name.lower()] = [name, "TECHNOLOGY", n]
    for cap in re.findall(entities.PHRASE, text or ""):
        if cap.lower() in {t.lower() for t in terms} or cap.lower() in entities.NO_NAMES:
            continue
        kind = next((k for k, parts in entities.KINDS.items() if any(p in cap for p in parts)), "CONCEPT")
        if cap.lower() in found:
            found[cap.lower()][2] += 1
        else:
            found[cap.lower()] = [cap, kind, 1]
    return sorted(map(tuple, found.values()), key=lambda x: (-x[2], x[0].lower()))


TERMS = ["spark", "Delta Lake", "io", "x.y", "spark sql", "a b a", "c++"]
POOL = ["Spark", "sparks", "SPARK SQL", "delta lake", "Delta  Lake", "IO", "rio", "x.y", "x.yz", "a b a b a", "River Team", "RIVER TEAM", "Stone Project", "The", "Moss Inc Engine", "c++", "io_x", "Über Io", "spark-sql", "Lake One Two Three Four"]


def test_entities(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(POOL) + rng.choice([" ", ", ", "\n", "."]) for _ in range(rng.randint(0, 25)))) for i in range(80)] + [(100, None), (101, "")]
    frame = spark.createDataFrame(rows, "i long, t string").repartition(3)
    terms = spark.createDataFrame([(t,) for t in [*TERMS, "SPARK", ""]], "term string")
    got = {}
    for r in entities.extract(frame, "i", "t", terms).collect():
        got.setdefault(r.i, []).append((r.name, r.kind, r.mentions))
    for i, t in rows:
        assert Counter(got.get(i, [])) == Counter(by_hand(t, TERMS)), t
    few = entities.extract(frame, "i", "t", terms, 2).collect()
    for i, t in rows:
        assert {(r.name, r.kind, r.mentions) for r in few if r.i == i} == set(by_hand(t, TERMS)[:2])


def test_a_large_dictionary_takes_several_passes(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "red blue green red")], "i long, t string")
    terms = spark.createDataFrame([(t,) for t in "red blue green grey".split()], "term string")
    monkeypatch.setattr(entities, "TERM_BYTES", 8)
    assert {(r.term, r.mentions) for r in entities.dictionary_hits(frame, "i", "t", terms).collect()} == {("red", 2), ("blue", 1), ("green", 1)}
    assert entities.dictionary_hits(frame, "i", "t", terms.limit(0)).count() == 0
