"""Hot keys, long texts and long words: results stay right and no task takes a hot key whole."""

import random
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

xxhash = pytest.importorskip("xxhash")
pytest.importorskip("public_tokenizers")
pytest.importorskip("basalt.llm")

from basalt.llm import labelled, near_copies, sharding, simhash, spotsigs, words  # noqa: E402


def test_a_long_text_is_hashed_as_a_short_one(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "Bc", "ünï", "x" * 40]) + rng.choice(["", "\n", "  "]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 50, 400)] + ["   ", " " * 90 + "a", "a" + " " * 90, "q" * 200 + " b"]
    want = [simhash.shingle_hashes(t, n) for t in texts for n in (1, 3, 5)]
    monkeypatch.setattr(simhash, "STRETCH", 40)
    got = [simhash.shingle_hashes(t, n) for t in texts for n in (1, 3, 5)]
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_long_words_are_told_apart(monkeypatch):
    monkeypatch.setattr(words, "STRETCH", 3)
    rng = random.Random(2)
    own = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    column = words.Words(pa.array([" ".join(own[:200]), " ".join(own[200:])]))
    hashes = column.hashes().tolist()
    assert all((x == y) == (a == b) for a, x in zip(own, hashes, strict=True) for b, y in zip(own, hashes, strict=True))


def rendezvous(doc_id, shards):
    """The law `key`, recomputed: the shard with the largest signed hash of id, seed and number."""
    best = []
    for s in range(shards):
        h = 42
        for kind, v in (("<q", doc_id), ("<i", sharding.SEED), ("<i", s)):
            if v is not None:
                h = xxhash.xxh64_intdigest(struct.pack(kind, v), seed=h)
        best.append((h - (1 << 64) if h >= 1 << 63 else h, s))
    return max(best)[1]


def test_shards_of_a_hot_id(spark, tmp_path):
    rows = [(7 if i % 3 else i, "t" * (1 + i % 90)) for i in range(3_000)] + [(None, "x" * 30)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.shard_documents(docs, str(tmp_path / "s"), 16, bucket_bytes=4_000)
    assert got.groupBy("bucket").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] < 3 * 4_000
    held = got.select("doc_id", "text", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text) for r in held) == Counter(rows)
    assert all(r.shard == rendezvous(r.doc_id, 16) for r in held)
    for s in {r.shard for r in held}:
        assert sorted(r.slot for r in held if r.shard == s) == list(range(sum(r.shard == s for r in held)))


def test_equal_rows_part_over_blocks(spark):
    rows = [(None, "the river of stone and cloud")] * 2_000 + [(i, f"the river {i} of stone") for i in range(2_000)] + [(5_000, "over the cloud")] * 2_000
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text")).withColumn("dealt", F.xxhash64("h", F.monotonically_increasing_id()))
    place, _ = spotsigs._ordered_blocks(docs, 30)
    sizes = [r["n"] for r in docs.groupBy(place.alias("b")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 6_000 and max(sizes) < 600
    ids = docs.select("doc_id", place.alias("b")).groupBy("b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).orderBy("b").collect()
    known = [(r.lo, r.hi) for r in ids if r.lo is not None]
    assert known == sorted(known) and all(a[1] <= b[0] for a, b in zip(known, known[1:], strict=False))
    got = spotsigs.fingerprint_and_edit(docs.select("doc_id", "text"), block_bytes=4_000)
    assert got.count() == 6_000 and got.where("n_chars = 28").count() == 2_000


def test_near_copies_of_a_hot_shingle(spark):
    """A passage that all texts begin with is in every prefix of short texts: links are as with whole cells."""
    rng = random.Random(4)
    base = "one passage that all texts have"
    texts = [base + " " + " ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts += [t + " end" for t in texts[:100]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    roots = lambda rows: Counter(map(frozenset, rows.groupBy("root").agg(F.collect_list("doc_id").alias("d")).toPandas()["d"]))
    assert roots(near_copies.groups(docs, cell_rows=20)) == roots(near_copies.groups(docs, cell_rows=100_000))


def test_labelled_texts_within_a_bound(spark):
    docs = spark.createDataFrame([(i, "x" * (10 if i % 7 else 1_000)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    every = labelled.labelled_sample(docs, labels, "toxic", 3, 1, 150).collect()
    some = labelled.labelled_sample(docs, labels, "toxic", 3, 1, 150, 500).collect()
    assert len(some) == 50 and all(len(r.text) == 10 for r in some)
    assert {tuple(r) for r in some} < {tuple(r) for r in every}
    assert {tuple(r) for r in labelled.labelled_sample(docs, labels, "toxic", 3, 1, 150, 10_000_000).collect()} == {tuple(r) for r in every}


def test_near_copies_within_three_bits_are_linked(spark):
    """Sets too far apart in size for the prefixes, whose 64-bit fingerprints lie within three bits, are in one group."""
    rng = random.Random(6)
    fp = lambda text: int(simhash.majority(near_copies.shingle_set(text)[:, None])[0])
    texts = []
    while len(texts) < 8:
        words_ = [f"w{rng.randint(0, 10**6)}" for _ in range(13)]
        whole, part = " ".join(words_), " ".join(words_[:11])  # 9 and 7 shingles
        if (fp(whole) ^ fp(part)).bit_count() <= 3:
            texts += [whole, part]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for cell_rows in (2, 100_000):
        root = {r.doc_id: r.root for r in near_copies.groups(docs, cell_rows=cell_rows).collect()}
        assert all(root[i] == root[i + 1] for i in range(0, 8, 2)) and len(set(root.values())) == 4
