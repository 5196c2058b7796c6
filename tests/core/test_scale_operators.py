"""Percentiles, stems, the text index, digests, containment and graph steps against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.functions.stemming import stem
from basalt.operators import fulltext, generations, graph, lifecycle, text_index
from basalt.operators.percentiles import exact_percentiles
from basalt.sources import datasets
from basalt.tables import dealt


@pytest.mark.parametrize(("bins", "few"), [(4_096, 10_000), (8, 5), (2, 0)])
def test_percentiles(spark, bins, few):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1e6), rng.random(), 7.0, -1e300, 1e300])) for _ in range(600)]
    rows += [("one", 5.0), ("same", 2.0), ("same", 2.0), ("none", None), ("a", float("nan")), ("a", None), ("a", float("inf")), ("two", 1.0), ("two", 2.0)]
    points = {"p0": 0.0, "q1": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in exact_percentiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", points, bins, few).collect()}
    assert set(got) == {k for k, _ in rows}
    for k in got:
        own = [v for x, v in rows if x == k and v is not None and abs(v) < float("inf")]
        for name, p in points.items():
            want = np.percentile(own, 100 * p) if own else None
            assert got[k][name] == (pytest.approx(want, rel=1e-9) if own else None)
    assert exact_percentiles(spark.createDataFrame([], "v int"), [], "v", {"m": 0.5}).first().m is None


STEMS = {
    "run runs running": "run", "consist consisted consistency consistently": "consist", "license licenses licensed licensing": "licens", "hope hoped hoping": "hope", "hop hopped hopping": "hop",
    "general generally": "general", "generate generated generating": "generat", "happy happiness": "happi", "relate relational": "relat", "sky skies": "sky", "cry cries cried": "cri",
    "dog dog's dogs": "dog", "electricity electrical": "electr", "adoption adopts": "adopt", "succeed succeeds": "succeed", "by": "by", "say": "say", "naïve": "naïve", "x1": "x1", "": "",
}


def test_stems():
    for words, want in STEMS.items():
        assert {stem(w) for w in words.split() or [""]} == {want}, words


def texts(n=160):
    rng = random.Random(8)
    pool = "run runs running river rivers the of licensed license hoped naïve x1".split()
    rows = [(i * 3, " ".join(rng.choice(pool) + rng.choice(["", ",", " -"]) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    return [*rows, (1_000, None), (1_001, "run " * 500 + "license"), (1_002, "Running the LICENSES")]


@pytest.mark.parametrize("query", ["run license", "runs", "river of the", "hoping running licenses", "absent run", "the of", ""])
def test_index_gives_the_ranking_of_all_texts(spark, tmp_path, query):
    rows = spark.createDataFrame(texts(), "id long, t string").repartition(3)
    for stemmed in (False, True):
        index = text_index.build(rows, "id", "t", str(tmp_path / f"i{stemmed}"), stemmed, block_rows=10, buckets=4)
        for k, first in ((3, 1), (500, 2)):
            want = fulltext.ranked(rows, "id", "t", query, k, fulltext.vocabulary(rows, "t") if stemmed else None)
            assert sorted(text_index.search(index, query, k, "id", first).collect()) == sorted(want.select("id", "relevance", "rank").collect())


def test_stems_find_inflected_forms_and_change_nothing_else(spark):
    rows = spark.createDataFrame(texts(), "id long, t string")
    known = fulltext.vocabulary(rows, "t")
    plain = {r.id for r in fulltext.ranked(rows, "id", "t", "run", 500).collect()}
    wide = {r.id for r in fulltext.ranked(rows, "id", "t", "run", 500, known).collect()}
    assert wide == {i for i, t in texts() if re.search(r"\b(run|runs|running)\b", (t or "").lower())} and plain < wide
    # No other word has the stem of `naïve` or `x1`.
    assert sorted(fulltext.ranked(rows, "id", "t", "naïve x1", 50).collect()) == sorted(fulltext.ranked(rows, "id", "t", "naïve x1", 50, known).collect())


def test_a_query_reads_its_terms_postings(spark, tmp_path):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 3_000)}" for _ in range(60))) for i in range(2_000)], "id long, t string")
    index = text_index.build(rows, "id", "t", str(tmp_path / "i"), False, block_rows=500, buckets=16)
    found = index.of_terms(["w17"]).select("block", "n")
    assert found.count() and found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    files = plan.collectLeaves().apply(0).metrics().apply("numFiles").value()
    assert files <= 2 and len(index.postings().inputFiles()) == 16
    assert "EqualTo(term,w17)" in plan.toString() and "hits" not in plan.toString()


def test_fingerprints_count_equal_rows(spark):
    def of(*members):
        return spark.createDataFrame([(f"{m:064x}",) for m in members], "d string").agg(generations.fingerprint(F.col("d")).alias("f")).first().f

    assert len({of(5, 5), of(9, 9), of(5, 9), of(5), of(5, 5, 9, 9)}) == 5
    assert of(5, 9, 9) == of(9, 5, 9)
    big = (1 << 256) - 1
    assert of(*[big] * 40) != of(*[big] * 41)


def test_equal_rows_count_in_a_tables_digest(spark, tmp_path):
    one, other = (spark.createDataFrame(rows, "i int") for rows in ([(5,), (5,)], [(9,), (9,)]))
    path = str(tmp_path / "t")
    datasets.create_once(one, path)
    with pytest.raises(ValueError, match="another table"):
        datasets.create_once(other, path)


def test_contained(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "QUOTES", 4)
    rng = random.Random(4)
    pool = ["red", "blue", "green", "the", "of", "a"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(100, None), (101, ""), (102, "it's red.")]
    quotes = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 5)))) for i in range(20)] + [(50, None), (51, "'s re"), (52, "ed blu"), (53, "e the o"), (54, "d."), (3, "red")]
    got = fulltext.contained(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(quotes, "q long, quote string"), "id")
    want = sorted((i, q) for i, t in rows for q, x in quotes if t is not None and x is not None and x in t)
    assert sorted((r.id, r.q) for r in got.collect()) == want


def test_reach_grows_by_a_step_at_a_time(spark):
    edges = spark.createDataFrame([(f"d{i}", f"e{i + j}") for i in range(30) for j in (0, 1)], "a string, b string")
    got = graph.reach(edges, spark.createDataFrame([("e0",), ("e0",)], "node string"), 9)
    want, front = {"e0": 0}, ["e0"]
    both = {}
    for a, b in [(f"d{i}", f"e{i + j}") for i in range(30) for j in (0, 1)]:
        both.setdefault(a, []).append(b)
        both.setdefault(b, []).append(a)
    for depth in range(1, 10):
        front = sorted({y for x in front for y in both[x]} - set(want))
        want |= dict.fromkeys(front, depth)
    assert {r.node: r.depth for r in got.collect()} == want and got.count() == len(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_clusters_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 5)
    monkeypatch.setattr(graph, "HUBS", 10**9)
    pairs = [(0, i) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 103), (7, 200), (5, 5), (300, 300)]
    got = {r.node: r.cluster for r in graph.clusters(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == dict.fromkeys([*range(40), 200], 0) | dict.fromkeys([100, 101, 102, 103], 100)


@pytest.mark.parametrize("sent", [32_000_000, 0])
def test_snapshots_of_recipients_make_no_pairs(spark, monkeypatch, sent):
    monkeypatch.setattr(lifecycle, "SENT_BYTES", sent)
    rng = random.Random(4)
    members = [(rng.randint(1, 400), rng.choice([0, 1, 2, None]), rng.choice([1, 3, 5, None])) for _ in range(300)]
    events = [(i, rng.choice([0, 1, 2, 3, None]), rng.choice([0, 1, 2, 3, 4, 5, 9, None])) for i in range(200)]
    events += [(7, 1, 9), (7, 1, 9), (None, 0, 9), (None, 2, 3)]
    made = lifecycle.recipient_snapshots(spark.createDataFrame(events, "e int, g int, t int"), spark.createDataFrame(members, "m int, g int, s int"), "e", "g", "t", "m", "s")
    want = {}
    for e, g, t in events:
        want.setdefault(e, []).extend(m for m, h, s in members if None not in (g, t, h, s) and g == h and t >= s)
    assert {r.e: r.recipients for r in made.collect()} == {e: ",".join(map(str, sorted(x))) for e, x in want.items() if x}
    assert made.count() == len({e for e, x in want.items() if x})
    rows = spark.range(20_000).selectExpr("id as e", "cast(id % 2 as int) as g", "10 as t")
    many = lifecycle.recipient_snapshots(rows, spark.range(2_000).selectExpr("id as m", "cast(id % 2 as int) as g", "1 as s"), "e", "g", "t", "m", "s")
    assert many.agg(F.count("*"), F.min(F.length("recipients"))).first()[0] == 20_000
    assert "_m" not in many._jdf.queryExecution().optimizedPlan().toString()


def test_a_written_snapshot_has_a_list_once(spark, monkeypatch, tmp_path):
    """Lists of 1.4 MB in all, each of 200 events: written as Parquet the result is of the lists' size, not of the events' times theirs (some 290 MB)."""
    monkeypatch.setattr(lifecycle, "PARTS", 2, raising=False)
    events = spark.range(12_000).selectExpr("id as e", "cast(id % 60 as int) as g", "10 as t")
    members = spark.range(240_000).selectExpr("id as m", "cast(id % 60 as int) as g", "1 as s")
    made = lifecycle.recipient_snapshots(events, members, "e", "g", "t", "m", "s")
    made.write.parquet(str(tmp_path / "r"))
    assert sum(f.stat().st_size for f in (tmp_path / "r").glob("*.parquet")) < 6_000_000
    got = spark.read.parquet(str(tmp_path / "r"))
    assert got.agg(F.count("*"), F.count_distinct("e"), F.count_distinct("recipients")).first()[:] == (12_000, 12_000, 60)
    assert got.where("size(split(recipients, ',')) != 4000 OR cast(split(recipients, ',')[3999] as long) != 239940 + e % 60").isEmpty()


def test_partitions_grow_with_the_rows(spark):
    rows = spark.range(0, 90_000, 1, 2).selectExpr("id as d", "id % 7 as e")
    made = dealt(rows, "d", "e", most=10_000)
    assert made.rdd.getNumPartitions() == 9 and max(made.rdd.glom().map(len).collect()) < 12_000 and made.count() == 90_000
    assert dealt(rows.limit(0), "d").count() == 0 and dealt(rows.limit(0), "d").rdd.getNumPartitions() == 1
    grouped = made.groupBy("d", "e").agg(F.count("*").alias("n"))
    assert grouped._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_reach_over_edges_that_come_twice(spark):
    edges = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("x", "b"), ("c", "y"), (None, "x"), ("d", "z")], "a string, b string")
    found = graph.reach(edges, spark.createDataFrame([("a",)], "node string"), 3)
    assert sorted((r.node, r.depth) for r in found.where("node IS NOT NULL").collect()) == [("a", 0), ("b", 2), ("x", 1), ("y", 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


@pytest.mark.parametrize("stemmed", [False, True])
def test_index_shuffles_texts_and_postings_once(spark, tmp_path, monkeypatch, stemmed):
    """Hits aren't shuffled one by one: a text goes to its block's task, a posting to its bucket's; with stems, words' postings go to their stem's in between."""
    monkeypatch.setattr(text_index, "TASK_ROWS", 20)
    rows = spark.createDataFrame(texts(), "id long, t string").repartition(3)
    plans, sort = [], type(rows).sortWithinPartitions
    monkeypatch.setattr(type(rows), "sortWithinPartitions", lambda self, *c: plans.append(self._jdf.queryExecution().executedPlan().toString()) or sort(self, *c))
    text_index.build(rows, "id", "t", str(tmp_path / "i"), stemmed, block_rows=10, buckets=4)
    assert plans[-1].count("Exchange hashpartitioning(") == (3 if stemmed else 2)


@pytest.mark.parametrize("stemmed", [False, True])
def test_words_of_a_block_are_grouped_as_arrays(spark, tmp_path, monkeypatch, stemmed):
    """Every posting's figures and hits, with keys of another type; no word becomes a row of its own, and no hit a struct before it is written."""
    plans, sort = [], type(spark.range(1)).sortWithinPartitions
    monkeypatch.setattr(type(spark.range(1)), "sortWithinPartitions", lambda self, *c: plans.append(self._jdf.queryExecution().executedPlan().toString()) or sort(self, *c))
    held = [(f"k{i:04d}" if i % 9 else None, t) for i, t in texts()]
    index = text_index.build(spark.createDataFrame(held, "id string, t string"), "id", "t", str(tmp_path / "i"), stemmed, block_rows=10, buckets=4)
    want = {}
    for key, text in held:
        for place, word in enumerate(w for w in re.split(r"[\W_]+", (text or "").lower()) if w and key):
            want.setdefault(stem(word) if stemmed else word, {}).setdefault(key, []).append(place)
    got, made = {}, index.postings().collect()
    for r in made:
        assert [tuple(h) for h in r.hits] == sorted(map(tuple, r.hits)) and not {h.key for h in r.hits} & set(got.get(r.term, ()))
        for h in r.hits:
            got.setdefault(r.term, {}).setdefault(h.key, []).append(h.place)
        assert (r.n, r.most) == (len({h.key for h in r.hits}), max(len(got[r.term][h.key]) for h in r.hits))
    assert got == want and len({(r.term, r.block) for r in made}) == len(made)
    assert "Generate" not in plans[-1] and "array<struct<key:" not in plans[-1]


def test_long_texts_make_smaller_blocks(spark, tmp_path, monkeypatch):
    """A block's texts are held as a whole, so their bytes bound it as well as their number."""
    monkeypatch.setattr(text_index, "BLOCK_BYTES", 1_000, raising=False)
    rows = spark.createDataFrame([(i, "word other " * 30) for i in range(30)], "id long, t string")
    index = text_index.build(rows, "id", "t", str(tmp_path / "i"), False, buckets=2)
    assert index.postings().select("block").distinct().count() > 3
    assert [(r.id, r["rank"]) for r in text_index.search(index, "other word", 3, "id").orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3)]
    empty = text_index.build(rows.where("id < 0"), "id", "t", str(tmp_path / "e"), True, buckets=2)
    assert text_index.search(empty, "word", 3, "id").isEmpty()


def test_reuse_shuffles_digests_as_bytes(spark):
    """Different digests of any form stay different, null meets nothing, and hex ones take half their bytes."""
    a, b = "ab" * 32, "AB" * 32
    hashes = [a, b, "ab", None, "", a + "0", chr(1) + "x", bytes.fromhex("61" * 32).decode()]
    rows = spark.createDataFrame([(i, i % 2, h) for i, h in enumerate(hashes * 2)], "member int, chunk int, content_hash string")
    short = [r[0] for r in rows.limit(8).select(generations.short_digest(F.col("content_hash"))).collect()]
    assert len(short[0]) == 33 and len(set(map(bytes, filter(None, short)))) == 7 and short[3] is None
    approved = spark.createDataFrame([(0, a), (0, a), (1, a), (1, None), (0, "")], "chunk int, content_hash string")
    out = generations.reuse(rows, approved)
    assert out.columns == ["member", "chunk", "content_hash", "state"]
    assert {(r.member, r.state) for r in out.collect()} == {(i, "reused" if i % 8 in (0, 4) else "pending") for i in range(16)}
