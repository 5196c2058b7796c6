"""Each operator against brute force on a small table with nulls, empty, long and repeated texts, and clashing columns."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("basalt.llm")

from basalt.llm import factorization, lattice, mixing, neighbours, packing, sharding, simhash, spotsigs, token_files, topk  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, block int, fp long, part int, row long, word string, copies int"
WORDS = "the of and to in idiot scum moron alpha beta gamma delta epsilon zeta eta theta iota kappa stone river cloud über café niño".split()


def corpus() -> list[tuple]:
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS[:5] + WORDS[8:]) for _ in range(rng.randint(3, 80))) for _ in range(60)]
    toxic = [" ".join(rng.choice(WORDS) for _ in range(30)) + " idiot scum moron" for _ in range(30)]
    junk = [" ".join(rng.choice(WORDS[8:]).upper() + "!!" for _ in range(30)) for _ in range(30)]
    long = " ".join(rng.choice(WORDS) for _ in range(30_000))
    all_texts = [*texts, *toxic, *junk, long, None, "", "  ", "a  b", "it's\nfine\n\nnow\tgo", "<|endoftext|> x", texts[0], texts[0], texts[1] + " end"]
    rows = [(i * 3, t) for i, t in enumerate(all_texts)]
    rows += [rows[5], rows[5], (None, "null id"), (None, None)]
    return [(i, t, "en", "s", 1, 0.5, 1, 2, 3, 4, "w", 9) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(not (t or "").isupper()), int("idiot" in (t or ""))) for i, t, *_ in corpus()[:120]]
    return spark.createDataFrame([*rows, rows[0], (None, 1, 0), (1_000_000, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def test_quality(docs, labels, empty):
    got = factorization.classify(docs, labels).collect()
    assert len(got) == len(corpus())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in got)
    right = [by[i].predicted == (not t.isupper()) for i, t, *_ in corpus()[:120]]
    assert sum(right) >= 114
    assert factorization.classify(empty, labels).count() == 0
    assert {r.score for r in factorization.classify(docs, labels.where("false")).collect()} == {0.5}


def test_machine_identity():
    rng = np.random.default_rng(0)
    m = factorization.Machine(0.3, rng.normal(size=50).astype("f4"), rng.normal(size=(50, 4)).astype("f4"))
    ids, x = np.array([3, 7, 9, 20], np.int32), np.array([0.5, 1, 2, 0.1], np.float32)
    slow = 0.3 + sum(m.w[i] * v for i, v in zip(ids, x)) + sum(m.v[ids[a]] @ m.v[ids[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert abs(m.raw(np.array([0, 4]), ids, x)[0][0] - slow) < 1e-4


def test_toxicity(docs, labels, empty):
    got = neighbours.classify(docs, labels).collect()
    assert len(got) == len(corpus())
    by = {r.doc_id: r for r in got}
    assert sum(by[i].predicted == int("idiot" in t) for i, t, *_ in corpus()[:120]) >= 114
    assert neighbours.classify(empty, labels).count() == 0
    assert neighbours.classify(docs, labels.where("false")).count() == len(corpus())


def test_nearest_example_against_dense_cosine(docs, labels):
    """Evidence and votes of the query are those of dense TF-IDF vectors of whole texts."""
    import re

    index = neighbours.train(docs, labels)
    first = np.append(index.vocabulary.start, 0)
    term = {index.vocabulary.data[a : a + n].tobytes().decode(): i for i, (a, n) in enumerate(zip(first, index.vocabulary.size))}

    def vector(text):
        v = np.zeros(len(term))
        for w, n in Counter(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))).items():
            if w in term:
                v[term[w]] = (1 + math.log(n)) * index.weight_of[term[w]]
        return v / (np.linalg.norm(v) or 1)

    text_of = {str(i): t for i, t, *_ in corpus() if i is not None}
    examples = np.stack([vector(text_of[i]) for i in index.ids])
    for r in neighbours.classify(docs, labels).collect():
        if r.doc_id is None:
            continue
        cosine = examples @ vector(text_of[str(r.doc_id)])
        if cosine.max() <= 1e-12:
            assert r.nearest_cosine is None and abs(r.score - index.without) < 1e-9
            continue
        assert abs(r.nearest_cosine - cosine.max()) < 1e-9
        top = np.lexsort((np.arange(len(cosine)), -np.round(cosine, 12)))[:15]
        top = top[cosine[top] > 1e-12]
        if len(cosine) <= 15 or np.partition(cosine, -16)[-16] < cosine[top].min() - 1e-9:
            weight = 1 / (0.05 + 1 - cosine[top])
            assert abs(r.score - index.score((weight * index.labels[top]).sum() / weight.sum())) < 1e-6


def test_block_max_is_exact():
    rng = np.random.default_rng(1)
    n, v = 300, 40
    count = rng.poisson(0.1, (n, v))
    count[count.sum(1) == 0, 0] = 1
    row, term = np.nonzero(count)
    index = neighbours.Index(np.arange(v, dtype=np.uint64), rng.uniform(1, 4, v), np.arange(n), rng.integers(0, 2, n).astype(float))
    weight = index.unit(row, term, count[row, term], n)
    index.build(row, term, weight)
    dense = np.zeros((n, v))
    dense[row, term] = weight
    for i in range(0, n, 17):
        t = np.flatnonzero(dense[i])
        found, cosine = index.nearest(t, dense[i, t])
        assert np.allclose(cosine, np.sort(dense @ dense[i])[::-1][: len(cosine)])


def brute_print(text):
    import xxhash

    w = words(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty):
    rows = corpus()
    prints = [brute_print(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), 1 << 60), r[0])
    want = Counter((r[0], prints[i], low.get(find(i))) for i, r in enumerate(rows))
    for cell_rows in (20_000, 2):
        got = simhash.near_duplicates(docs, cell_rows=cell_rows).collect()
        assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len({find(i) for i in range(len(rows))})
    assert set(kept[0].asDict()) == set(docs.columns)


def test_keep_one_tells_components_apart(spark):
    """Components of null ids, and one doc_id with unrelated texts, are components of their own."""
    rng = random.Random(8)
    a, b, c, d = (" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(4))
    rows = [(None, a), (None, a), (None, b), (7, c), (7, d), (9, d)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(None, a), (None, b), (7, c), (7, d)])


def test_dense_grid_cells():
    rng = np.random.default_rng(2)
    import pyarrow as pa

    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base[:20] ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64))
    fp = np.unique(np.concatenate([base, near]))
    rows = list(simhash._grid([pa.record_batch([pa.array(fp.view(np.int64))], ["fp"])]))
    links = {tuple(sorted(x)) for b in simhash._verify(rows) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    label = {int(x): int(x) for x in fp.view(np.int64)}
    for a, b in links:
        label[a] = label[b] = min(label[a], label[b])
    for i in range(len(fp)):
        for j in range(i):
            if (int(fp[i]) ^ int(fp[j])).bit_count() <= 3:
                a, b = int(fp.view(np.int64)[i]), int(fp.view(np.int64)[j])
                assert label[a] == label[b]


def test_sharding(docs, empty):
    got = sharding.shard_digest(docs).collect()
    assert len(got) == len(corpus())
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus())
    assert sharding.shard_digest(empty).count() == 0


def in_order(df):
    """(doc_id, text) by id, nulls first, then by the text's hash."""
    rows = df.selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").collect()
    return [(r.doc_id, r.text) for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))]


def test_spotsigs_next_over_hot_ids(spark):
    """One id and null in a third of the rows each, over many blocks: every row's next is the one behind it."""
    import hashlib

    rng = random.Random(4)
    rows = [(rng.choice([None, 7, i]), " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))) for i in range(600)]
    df = spark.createDataFrame([*rows, *rows[:40], *[(None, "same text here")] * 30], "doc_id long, text string")
    got = Counter((r.doc_id, r.edited_sha256) for r in spotsigs.fingerprint_and_edit(df, block_bytes=500).collect())
    held = in_order(df)
    # Rows of one id are in one order for each block; any neighbour among equal ids is a next one, so ids alone are compared there.
    assert Counter(i for i, _ in got.elements()) == Counter(i for i, _ in held)
    single = {i for i, n in Counter(i for i, _ in held).items() if n == 1}
    for k, (i, t) in enumerate(held):
        following, of = held[(k + 1) % len(held)][1], held[(k + 1) % len(held)][0]
        if i in single and of in single:
            n = len(t) // 4
            assert got[i, hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()] == 1
    texts = {}
    for i, t in held:
        texts.setdefault(i, []).append(t)
    for i in (None, 7):
        follow = {*texts[i], *(t for k, (j, t) in enumerate(held) if j != i and held[k - 1][0] == i)}
        allowed = {hashlib.sha256((t[: len(t) - len(t) // 4] + f[: len(t) // 4]).encode()).hexdigest() for t in texts[i] for f in follow}
        assert all(h in allowed for j, h in got if j == i)


def test_spotsigs(docs, empty):
    import hashlib

    got = spotsigs.fingerprint_and_edit(docs).collect()
    rows = in_order(docs)
    want = Counter()
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        want[i, len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    text_of = {i: t for i, t in rows if i is not None}
    prints = {}
    for r in got:
        if r.doc_id is not None:
            assert prints.setdefault(text_of[r.doc_id], r.fingerprint) == r.fingerprint
    cut = lambda s: {s[i : i + 16] for i in range(0, len(s), 16)}
    for r in got:
        a, b = cut(r.fingerprint), cut(r.edited_fingerprint)
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-9
    assert spotsigs.fingerprint_and_edit(empty).count() == 0


def brute_signatures(text):
    """(anchor, chain) pairs: each anchor with the next two content words, no anchor words between them counted."""
    import re

    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    found = set()
    for i, t in enumerate(w):
        if t in spotsigs.ANCHORS:
            chain = [x for x in w[i + 1 :] if x not in spotsigs.ANCHORS][:2]
            if len(chain) == 2:
                found.add((t, *chain))
    return found or set(w)


def test_spotsigs_against_brute_force(docs):
    """The number of signatures, and both likenesses, are those of sets of chains made by a loop."""
    got = {}
    for r in spotsigs.fingerprint_and_edit(docs).collect():
        got[r.doc_id, r.edited_sha256] = r
    import hashlib

    rows = in_order(docs)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        r = got[i, hashlib.sha256(edited.encode()).hexdigest()]
        own, new, other = map(brute_signatures, (t, edited, following))
        assert len(r.fingerprint) == 16 * len(own) and len(r.edited_fingerprint) == 16 * len(new)

        def like(a, b):
            return len(a & b) / len(a | b) if a | b else 1.0

        assert abs(r.near_edited - like(own, new)) < 1e-9
        if rows.count(rows[k]) == 1:
            assert abs(r.near_next - like(own, other)) < 1e-9


def test_spotsigs_chain(spark):
    df = spark.createDataFrame([("the quick of brown fox",)], "text string")
    size = spotsigs.with_signatures(df, {"text": "sig"}).selectExpr("size(sig) n").first().n
    assert size == 2  # the: quick brown; of: brown fox


def test_similar_sets(docs):
    sets = [r.sig for r in spotsigs.with_signatures(docs.select("text"), {"text": "sig"}).collect()]
    distinct = {tuple(s) for s in sets if s}
    want = sum(1 for a in distinct for b in distinct if a < b and len({*a} & {*b}) / len({*a} | {*b}) >= 0.8)
    assert spotsigs.similar_sets(docs).count() == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(name):
    import pyarrow as pa
    from basalt.llm.encoding import Encoder

    e = Encoder(public_tokenizers.path(name))
    texts = [t for _, t, *_ in corpus()] + ["a…. b", "x².", "\n  b", "5.5%a!!\nfoo", "≠ a≠", "ñ.×.÷a é!Ω?", " lead", "trail ", "ΑΣ. ΑΣ b", "   b", "\n  b", "é ́x"]
    for t, ids in zip(texts, e.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == e.library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    token_files.write_token_files(docs, str(tmp_path / "t"), path, part_bytes=50_000, block_bytes=2_000)
    got = sorted(token_files.read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    at = 0
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for i, x, *_ in corpus())
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_files.read_index(spark, str(tmp_path / "t")).count() == len(got)
    assert token_files.token_file_round_trip(empty, path).count() == 0


def test_mixing(docs, labels, empty):
    labelled = labels.select("doc_id", mixing.label_domain().alias("domain"))
    targets = {"high": 0.5, "low": 0.3, "toxic": 0.2}
    mixed, reached = mixing.mix(docs, labelled, targets)
    got = mixed.collect()
    assert len(got) == len(corpus())
    assert all(r.rate >= 0 and r[-1] in (math.floor(r.rate), math.floor(r.rate) + 1) for r in got)
    total = sum(r.n_tokens for r in got)
    for k, share in targets.items():
        mass = sum(r.n_tokens * r.rate * r.posterior[k] for r in got)
        assert abs(mass / total - share) < 0.01
        assert abs(reached[k][0] - share * total) < 1e-6 * total and abs(reached[k][1] - mass) < 1e-6 * total
    taken = mixing.sample(docs, labelled, targets)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r[-1] for r in got)
    assert mixing.mix(empty, labelled, targets)[0].count() == 0
    members = docs.sparkSession.createDataFrame([(10, {"high": 0.9, "low": 0.1})] * 5, "n_tokens long, posterior map<string, double>")
    unreachable = mixing.fit_rates(members, {"high": 0.5, "low": 0.5})[1]
    assert abs(unreachable["low"][1] - 25) > 1  # every document is mostly high, no rates change that


def test_rates_against_projected_least_squares(spark):
    """The fitted rates reach the objective that a long run of plain projected gradient reaches."""
    rng = np.random.default_rng(6)
    n = rng.integers(5, 50, 80).astype(float)
    p = rng.dirichlet([0.3, 0.3, 0.3], 80)
    goal = np.array([0.6, 0.3, 0.1]) * n.sum()
    members = spark.createDataFrame([(int(k), dict(zip("abc", map(float, x)))) for k, x in zip(n, p)], "n_tokens long, posterior map<string, double>")
    rate, reached = mixing.fit_rates(members, dict(zip("abc", (0.6, 0.3, 0.1))))
    r = np.array([x.r for x in members.select(rate.alias("r")).collect()])
    totals = (n * r) @ p
    assert (r >= 0).all() and np.allclose(totals, [reached[k][1] for k in "abc"], rtol=1e-6)
    assert np.abs(totals / goal - 1).max() < 0.005
    slow = np.ones(80)
    step = 1 / np.linalg.norm(n[:, None] * p, 2) ** 2
    for _ in range(20_000):
        slow = np.maximum(0, slow - step * (n[:, None] * p) @ ((n * slow) @ p - goal))
    assert np.abs((n * slow) @ p / goal - 1).max() < 0.005


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path).collect()
    want = Counter()
    for i, x, *_ in corpus():
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for k in range(-(-len(ids) // 4096)):
            part = ids[k * 4096 : (k + 1) * 4096]
            want[i, k, k * 4096, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    ends = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096
    assert packing.pack_documents(empty, path).count() == 0


def test_plan_against_exact():
    import itertools

    rng = random.Random(5)

    def fewest(items, room):
        best = len(items)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= room and bins[k] not in bins[:k]:
                    go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best

    more = triples = 0
    for _ in range(400):
        room = rng.choice([20, 50, 100])
        low = rng.choice([1, room // 5, room // 4])
        items = [rng.randint(low, room) for _ in range(rng.randint(1, 9))]
        rows, n, _ = packing.plan(dict(Counter(items)), room)
        assert sum(r[2] - r[1] for r in rows) == len(items)
        fill, fixed, left = Counter(), Counter(), Counter(items)
        for length, a, b, first, each, _, reduced in rows:
            for i in range(b - a):
                fill[first + i // each] += length
                fixed[first + i // each] += reduced
            left[length] -= (b - a) * reduced
        assert max(fill.values()) <= room and len(fill) == n
        best = fewest(sorted(items, reverse=True), room)
        # What the reduction fixes loses no sequence.
        assert len(+fixed) + fewest(sorted(left.elements(), reverse=True), room) == best
        triples += sum(v == 3 for v in fixed.values())
        more += n - best
    assert triples > 5 and more <= 4
    rows, _, fixed = packing.plan({61: 1, 60: 1, 37: 1, 13: 3, 3: 1}, 100)
    assert not any(r[6] and r[0] == 61 for r in rows)
    assert list(itertools.chain(packing.plan({}, 20)[0])) == []


def test_top_k(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(8, 16))
    m = (base[rng.integers(0, 8, 400)] + 0.2 * rng.normal(size=(400, 16))).astype(np.float32) / 4
    m[10] = m[20] = m[30]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(m)]
    # One id in several rows: each is a query, and a candidate, of its own.
    rows += [rows[0], rows[0], rows[40], rows[7], (None, [0.0] * 16, 0), (480, [], 0)]
    rows += [(400, None, 0), (420, [float("nan")] * 16, 0), (440, [None] + [0.0] * 15, 0), (460, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, distance int")
    vectors = topk.quantized(df)
    got = topk.top_k(vectors, F.col("vec_id") % 20 == 0, 20, 6, 16, 4).collect()
    q = np.floor(64 * m.astype(np.float64)).astype(np.int64)
    ids = [r[0] for r in rows if r[0] is not None and r[0] < 400]
    want = Counter()
    for a, i in enumerate(ids):
        if i % 20 == 0:
            s = q @ q[i]
            order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[ids[b]], ids[b]))[:20]
            want.update((i, r + 1, ids[b], int(s[ids[b]])) for r, b in enumerate(order))
    assert Counter(tuple(r) for r in got) == want
    assert Counter(tuple(r) for r in topk.search_table(df).collect()) == want
    with pytest.raises(ValueError, match="unequal"):
        topk.search_table(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>"))
    assert topk.search_table(df.where("false")).count() == 0
    few = topk.search_table(df.where("vec_id < 3").dropDuplicates(["vec_id"])).collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(0, 1), (0, 2)]


def test_lattice_marginal_is_the_sum_over_segmentations():
    pieces = [bytes([i]) for i in range(256)] + [b" a", b"ab", b"b", b" ab", b"ba"][0:2] + [b" ab", b"ba"]
    rng = np.random.default_rng(0)
    logp = np.log(rng.dirichlet(np.ones(len(pieces))))
    known = {p: logp[i] for i, p in enumerate(pieces)}

    def total(w):
        if not w:
            return 1.0
        return sum(math.exp(known[w[:k]]) * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in known)

    some = [b"ab", b"abab", b"", b"zab", "é".encode()]
    model = lattice.Lattice(pieces, logp)
    assert np.allclose(model.run(some), [math.log(total(b" " + w)) for w in some])
    expected = np.zeros(len(pieces))
    model.run([b"ab"], np.array([2.0]), expected)
    assert abs(sum(expected[i] * len(p) for i, p in enumerate(pieces)) - 6) < 1e-9


def test_lattice_long_words(monkeypatch):
    """A long word, in stretches, gets what the short way gives it."""
    rng = np.random.default_rng(1)
    pieces = [bytes([i]) for i in range(256)] + [b" a", b"ab", b"aba", b"bb"]
    model = lattice.Lattice(pieces, np.log(rng.dirichlet(np.ones(len(pieces)))))
    words = [bytes(rng.choice([97, 98], 60).astype(np.uint8)) for _ in range(5)]
    want, short = np.zeros(len(pieces)), None
    short = model.run(words, np.ones(5), want)
    monkeypatch.setattr(lattice, "LONG", 8)
    monkeypatch.setattr(lattice, "STRETCH", 7)
    got = np.zeros(len(pieces))
    assert np.allclose(model.run(words, np.ones(5), got), short) and np.allclose(got, want)
    assert np.allclose(model.run(words), short)


def test_words_that_share_polynomial_hashes(spark):
    """Two words that collide modulo any power of two are two words."""
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(0, thue), (2, thue.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert sorted(r.n for r in lattice.word_counts(df).collect()) == [1, 1]


def test_lattice_scores(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = lattice.score_documents(docs, path, head_share=0.01).collect()
    counts = Counter()
    for i, t, *_ in corpus():
        if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1:
            counts.update(words(t))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, *_ in corpus():
        w = [*words(t), None]
        want[i, len(w), sum(x in counts for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    by = {}
    for r in got:
        if r.doc_id is not None:
            assert abs(by.setdefault(r.doc_id, r.score) - r.score) < 1e-6
    assert lattice.score_documents(empty, path).count() == 0


def test_document_score_is_the_sum_of_marginals(docs):
    """Scores from a plain recursion over the fitted pieces, word by word."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    some = docs.where("doc_id < 60 OR doc_id > 360")
    pieces = lattice.vocabulary(path)
    train = sum(zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 != 1 for r in some.select("doc_id").collect())
    logp, end = lattice.fit(lattice.word_counts(some), pieces, train)
    known = {p: logp[i] for i, p in enumerate(pieces)}
    held = {}

    def marginal(word):
        if word not in held:
            data = b" " + word
            alpha = [0.0] + [0.0] * len(data)
            alpha[0] = 1.0
            for j in range(1, len(data) + 1):
                alpha[j] = sum(alpha[i] * math.exp(known[data[i:j]]) for i in range(j) if data[i:j] in known)
            held[word] = math.log10(alpha[-1])
        return held[word]

    for r in lattice.score_documents(some, path, head_share=0.01).join(some.select("doc_id", "text").distinct(), "doc_id").collect():
        assert abs(r.score - (sum(map(marginal, words(r.text))) + end / math.log(10))) < 1e-6 * max(1, abs(r.score))


def test_sharding_draws_evenly(spark):
    """Places within shards say nothing of the order of ids, and a second run gives the same ones."""
    df = spark.range(4000).selectExpr("id doc_id", "concat('t', id) text").repartition(4)
    one, two = (sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_digest(df).collect()) for _ in range(2))
    assert one == two
    for s in range(16):
        ids, slots = zip(*[(i, k) for i, t, k in one if t == s])
        assert 180 < len(ids) < 320 and abs(np.corrcoef(ids, slots)[0, 1]) < 0.25
