"""Each stage of the pipeline on its own input, at a small size."""

import random
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        rows = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert rows.columns == names, name
            before = {r.doc_id for r in docs.select("doc_id").collect()}
            assert {r.doc_id for r in rows.select("doc_id").collect()} <= before
        kept.append((docs.count(), rows.count()))
        last, docs = docs, rows
    assert all(b <= a for a, b in kept[:3]) and all(b > 0 for _, b in kept)
    pieces = Counter(r.doc_id for r in docs.where("piece = 0").collect())
    assert pieces == Counter(r.doc_id for r in last.collect())


def brute_wide(shingles):
    """SimHash of 512 bits of a set of shingle strings, in whole numbers."""
    import xxhash

    def spread(x):
        x &= (1 << 64) - 1
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
        return x ^ x >> 31

    hashes = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in shingles]
    bits = 0
    for w in range(8):
        own = [spread(h + (w + 1) * 0x9E3779B97F4A7C15) for h in hashes]
        for b in range(64):
            bits |= (2 * sum(h >> b & 1 for h in own) > len(own)) << (64 * w + b)
    return bits


def test_near_copies_of_five_word_shingles(spark):
    """One row of each group stays. Brute force: near copies by Jaccard and fingerprint are in one group, groups hold together by fingerprints, and 0.9 of the pairs of Jaccard 0.8 or more are found."""
    from basalt.llm import near_copies

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "one two", "One  two", "one two three"]
    for size in (12, 60, 120, 250):
        for _ in range(5):
            base = [rng.choice(vocabulary) for _ in range(size)]
            texts.append(" ".join(base))
            for more in (0, 0, 1, 1, 2):
                copy = list(base)
                for _ in range(size // 60 + more):
                    copy[rng.randrange(size)] = rng.choice(vocabulary)
                texts.append(" ".join(copy))
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    sets = [{tuple((t or "").lower().split()[i : i + 5]) for i in range(max(len((t or "").split()) - 4, min(1, len((t or "").split()))))} for t in texts]
    prints = [brute_wide(s) for s in sets]

    def components(linked):
        root = list(range(len(rows)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(rows)):
            for j in range(i):
                if sets[i] == sets[j] or linked(i, j):
                    root[find(i)] = find(j)
        return [find(i) for i in range(len(rows))]

    def near(i, j):
        return 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])

    def alike(i, j):
        return (prints[i] ^ prints[j]).bit_count() <= 92 and 5 * min(map(len, (sets[i], sets[j]))) >= 4 * max(map(len, (sets[i], sets[j])))

    fine, coarse = components(lambda i, j: near(i, j) and alike(i, j)), components(lambda i, j: alike(i, j) and bool(sets[i] & sets[j]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    place = {(i, t): k for k, (i, t) in enumerate(rows)}
    for cell_rows in (20_000, 2):
        got = near_copies.groups(docs, 5, cell_rows).collect()
        assert len(got) == len(rows)
        of = {(r.doc_id, r.h): r.root for r in got}
        keyed = docs.selectExpr("doc_id", "text", "xxhash64(text) h").collect()
        group = {place[r.doc_id, r.text]: of[r.doc_id, r.h] for r in keyed}
        pairs = [(i, j) for i in range(len(rows)) for j in range(i)]
        assert all(group[i] == group[j] for i, j in pairs if fine[i] == fine[j])
        assert all(coarse[i] == coarse[j] for i, j in pairs if group[i] == group[j])
        true = [(i, j) for i, j in pairs if near(i, j)]
        assert len(true) > 60 and sum(group[i] == group[j] for i, j in true) >= 0.9 * len(true)
    kept = pipeline.near_duplicates(spark, docs, SF).collect()
    best = {}
    for k, (i, _) in enumerate(rows):
        best[group[k]] = min(best.get(group[k], (True, 0)), (i is None, i or 0))
    assert sorted(group[place[r.doc_id, r.text]] for r in kept) == sorted(best)
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept) == Counter(best.values())


NAMES = "doc_id long, text string, lang string, source string, n_chars long, score double, c0 string, nearest_cosine double, _score double, row long, h long, _row long"


def test_stages_take_any_rows(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, clashing names and an empty table."""
    texts = ["alpha beta gamma delta epsilon " * 20, "", None, "one"]
    rows = [(i if i % 3 else None, texts[i % 4], *(("en", "s", 1, 0.5, "x", 0.1, 0.2, 1, 2, 3) if i % 2 else (None,) * 10)) for i in range(12)]
    rows += [rows[1], rows[1]]
    (tmp_path / "labels.parquet").mkdir()
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    for some in (rows, []):
        docs = spark.createDataFrame(some, NAMES)
        for name, stage in pipeline.STAGES[:4]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            n = out.count()
            assert n <= len(some) or name.startswith("mixing"), name
            if name == "SimHash near-dedup" and some:
                assert n == 3  # the long text, blank ones, "one"
        assert pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == len(some)
