import hashlib
import hmac
import io
import math
import re
import uuid
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basalt.functions import chunking, text, vectors
from basalt.operators import fulltext, graph, grounding, records, retrieval, temporal
from basalt.sources import datasets, parsers

TEXTS = st.text(alphabet="ab é.!?\n\t ", max_size=400)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_chunks_cover_all_text(t):
    for cut in (lambda x: chunking.token_chunks(x, 12, 4), lambda x: chunking.recursive_chunks(x, 12, 4)):
        spans = cut(t)
        held = set()
        for a, b in spans:
            assert t[a:b] == t[a:b].strip() and a < b
            held |= set(range(a, b))
        assert all(i in held for i, c in enumerate(t) if not c.isspace())


def test_overlap_is_whole_sentences():
    t = "One two three. Four five six. Seven eight nine. Ten eleven twelve."
    spans = chunking.token_chunks(t, 7, 3)
    assert [t[a:b] for a, b in spans][:2] == ["One two three. Four five six.", "Four five six. Seven eight nine."]


def test_chunk_frame(spark):
    df = spark.createDataFrame([(1, "Grüße. " * 700), (2, None), (3, "  "), (4, "one")], "id int, body string")
    got = chunking.chunk(df, "id", "body", "semantic")
    assert got.where("id IN (2, 3)").count() == 0 and got.where("id = 1").count() > 1
    assert chunking.span_violations(got, df, "id", "body").count() == 0
    with pytest.raises(ValueError):
        chunking.chunk(df, "id", "body", "other")


def test_embedding(spark):
    """Features by a loop in Python, and vectors by hand from them."""
    from collections import Counter

    texts = ["budget approved by finance", "Finance approved the budget, budget", "zebra crossing", "the of the", "", None, "Straße ça", "?!", "it's well-known, it's"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = {r.id: r for r in vectors.with_lexical_embedding(vectors.with_lexical_features(df, "t"), "t", "v").collect()}
    for i, t in enumerate(texts):
        every = re.findall(r"[\w'-]+", (t or "").lower()) or [(t or "").strip().lower() or "<empty>"]
        words = [w for w in every if w not in vectors.STOP] or every
        want = Counter({f"word:{w}": 1 + math.log(n) for w, n in Counter(words).items()})
        for w in set(words):
            for k in range(len(w)) if len(w) >= 4 else ():
                want["char:" + f"^{w}$"[k : k + 3]] += 0.15
        for a, b in zip(words, words[1:]):
            want[f"bigram:{a}:{b}"] += 0.5
        got = Counter()
        for f in rows[i].features:
            got[f.name] += f.weight
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        v = np.zeros(1536)
        for name, weight in want.items():
            h = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, person=vectors.PERSON).digest(), "big")
            v[h % 1536] += weight if h >> 63 else -weight
        assert np.allclose(rows[i].v, v / (np.linalg.norm(v) or 1), atol=1e-6)
    a, b, c = (np.array(rows[i].v) for i in (0, 1, 2))
    assert a @ b > 0.5 > abs(a @ c)


def test_digests(spark):
    df = spark.createDataFrame([('{"b": 1, "a": {"password": "x", "n": [1]}}', 7), (None, 8)], "j string, t long")
    r = df.select(vectors.canonical_hash(F.col("j")).alias("h"), vectors.redact(F.col("j")).alias("r"), vectors.signature(F.col("j"), F.col("t"), "k").alias("s"), vectors.name_uuid(F.col("j")).alias("u")).collect()
    body = '{"b": 1, "a": {"password": "x", "n": [1]}}'
    assert r[0].h == hashlib.sha256(b'{"a":{"n":[1],"password":"x"},"b":1}').hexdigest()
    assert r[0].r == '{"b":1,"a":{"password":"[REDACTED]","n":[1]}}'
    assert r[0].s == "v1=" + hmac.new(b"k", f"7.{body}".encode(), hashlib.sha256).hexdigest()
    assert r[0].u == str(uuid.uuid5(uuid.NAMESPACE_URL, body)) and r[1].h is None


def test_parsers(spark):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p("before")}{p("Plan", "Heading1")}{p("one")}{p("two")}</w:body></w:document>')
    rows = [("text", b"hello"), ("text", b"a\0b"), ("text", b"\xff"), ("text", b" "), ("markdown", "intro\n# A\n\nbody é\n## B\n".encode()), ("docx", box.getvalue()), ("docx", b"x"), ("pages", b"one\ftwo\f"), ("zip", b""), ("pdf", b"one"), ("pdf", b"%PDF-1.7")]
    got = parsers.parse(spark.createDataFrame([(i, k, bytearray(b)) for i, (k, b) in enumerate(rows)], "i int, parser string, content binary")).orderBy("i").collect()
    cut = [[(s.title, r.parsed.text[s.start_char : s.end_char]) for s in r.parsed.sections] for r in got]
    assert [r.parsed.error for r in got] == [None, "binary content", "not UTF-8", "no text", None, None, "not a word-processor file", None, "unsupported type", "not a PDF", "page text needed"]
    assert cut[4] == [("Preamble", "intro"), ("A", "body é")]
    assert cut[5] == [("Introduction", "before"), ("Plan", "one\n\ntwo")]
    assert cut[7] == [("Page 1", "one"), ("Page 2", "two")]


def test_text_columns(spark):
    df = spark.createDataFrame([("  Alpha beta\n needle in 1999, 2024-01 and 1999 ",)], "t string")
    r = df.select(text.compact(F.col("t")).alias("c"), text.years(F.col("t")).alias("y"), text.snippet(F.col("t"), "needle", 12).alias("s"), text.estimate_tokens(F.col("t")).alias("n")).first()
    assert r.c == "Alpha beta needle in 1999, 2024-01 and 1999" and r.y == ["1999"] and r.n == 10
    assert "needle" in r.s and r.s.startswith("…") and r.s.endswith("…")
    assert df.select(text.parser_kind(F.lit("a.zip"), F.lit("text/plain")).alias("k")).first().k is None


def test_fusion_keeps_raw_ranks(spark):
    rows = [(1, 0, i + 1, x) for i, x in enumerate(["alpha", "beta", "beta"])] + [(1, 1, i + 1, x) for i, x in enumerate(["beta", " ", "gamma"])]
    got = retrieval.reciprocal_rank_fusion(spark.createDataFrame(rows, "q int, ranking_no int, rank int, item string"), "q", "item").orderBy("position").collect()
    assert [r.item for r in got] == ["beta", "alpha", "gamma"]
    assert got[0].score == round(1 / 62 + 1 / 61, 9) and got[2].score == round(1 / 63, 9)


def test_temporal_modes():
    with pytest.raises(ValueError):
        temporal.temporal_filter(F.lit(1), years=[2000], year_range=(1999, 2000))
    with pytest.raises(ValueError):
        temporal.authority("other")


def test_claims(spark):
    df = spark.createDataFrame([("Budget is 40 in May", "the budget of 40 was set"), ("Budget is 41", "the budget of 40")], "claim string, content string")
    assert [r.supported for r in grounding.claim_support(df).orderBy("claim").collect()] == [True, False]


def test_claim_validation(spark):
    rows = [
        ("The river is 40 km long", "Surveys say the river has 40 km", ["D1"], "passed"),
        ("The river is 41 km long", "Surveys say the river has 40 km", ["D1"], "missing anchor"),
        ('They wrote "deep  water" there', "they wrote deep water there", ["D1"], "passed"),
        ("The river never floods", "the river floods", ["D1"], "polarity"),
        ("Mountains rise slowly eastward", "the river floods", ["D1"], "low coverage"),
        ("Cost rose 5%", "cost rose 5% in May", ["D1", "D1"], "sources"),
        ("Cost rose", "cost rose", ["D%d" % i for i in range(1, 7)], "sources"),
        (" ", "x", ["D1"], "claim size"),
        ("y" * 1001, "x", ["D1"], "claim size"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, claim string, content string, sources array<string>, want string")
    assert [(r.i, r.verdict) for r in grounding.validate_claims(df).orderBy("i").collect()] == [(i, r[3]) for i, r in enumerate(rows)]


def test_aligned_quote(spark):
    """Against all runs of sentences tried one by one."""
    import random

    rng = random.Random(2)
    names = "river cloud stone harbour signal meadow lantern copper".split()
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choice(names) for _ in range(rng.randint(1, 4))) + rng.choice([". ", "! ", '." ', "\n\n", "? "]) for _ in range(rng.randint(1, 7))]
        rows.append((i, " ".join(rng.sample(names, rng.randint(1, 4))), "".join(parts).rstrip() if i % 2 else "".join(parts)))
    rows += [(100, "river", ""), (101, "river", "no match here. none")]
    got = {r.i: r for r in grounding.aligned_quote(spark.createDataFrame(rows, "i int, claim string, content string"), "claim", "content").collect()}
    cut = re.compile(r"[.!?]+[\"”’')\]]*(?=\s|$)|\n{2,}")
    for i, claim, content in rows:
        spans, at = [], 0
        for end in [*(m.end() for m in cut.finditer(content)), len(content)]:
            piece = content[at:end]
            if piece.strip():
                spans.append((at + len(piece) - len(piece.lstrip()), at + len(piece.rstrip())))
            at = end
        words = lambda x: {w for w in re.split(r"[\W_]+", x.lower()) if len(w) > 2 and w not in grounding.STOP}
        need = words(claim) & words(content)
        runs = [(b - a, a, b) for j, (a, _) in enumerate(spans) for _, b in spans[j:] if need and need <= words(content[a:b])]
        want = min(runs)[1:] if runs else (0, len(content))
        assert (got[i].start, got[i].end) == want, content


def test_pack_and_manifest(spark):
    rows = [(1, 0, "document", "a", False), (1, 1, "document", "", False), (1, 2, "document", "c", False), (1, 3, "tool", "t", True), (1, 4, "tool", "u", False), (1, 5, "memory", "m", False)]
    pack = grounding.evidence_pack(spark.createDataFrame(rows, "g int, place int, kind string, content string, failed boolean"), "g", "place", "kind", "content", F.col("failed"))
    assert [(r.ordinal, r.source_id) for r in pack.orderBy("ordinal").collect()] == [(1, "D1"), (2, "D3"), (3, "M1"), (4, "T1")]
    assert grounding.manifest(pack, "g").first().fault is None
    assert grounding.manifest(pack.withColumn("content", F.lit("z")), "g").first().fault == "digest"
    assert grounding.manifest(pack.withColumn("source_id", F.lit("Q1")), "g").first().fault == "malformed id"


def test_full_text(spark):
    """Cover density against all stretches tried one by one."""
    import random

    rng = random.Random(1)
    texts = [" ".join(rng.choice("red blue green the of".split()) for _ in range(rng.randint(0, 14))) for _ in range(80)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    terms = ["red", "blue"]
    got = {r.i: r.x for r in df.select("i", fulltext.cover_rank(fulltext.words(F.col("t")), terms).alias("x")).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        covers = {}
        for e in range(len(w)):
            starts = [s for s in range(e + 1) if {*terms} <= {*w[s : e + 1]}]
            if starts and w[e] in terms:
                covers.setdefault(max(starts), e)
        assert abs(got[i] - sum(1 / (e - s + 1) for s, e in covers.items())) < 1e-9, t
    ranked = fulltext.keyword_ranking(df, "i", "t", "red of", 5)
    assert ranked.count() <= 10
    alone = fulltext.hybrid(None, ranked, "i", 5).collect()
    assert alone and all(r.degraded for r in alone)


def test_contained(spark):
    rows = spark.createDataFrame([(1, "aa bb cc dd"), (2, "xaa bb ccx"), (3, "zz"), (4, None)], "i int, text string")
    quotes = spark.createDataFrame([(1, "aa bb cc"), (2, "bb"), (3, "zz"), (4, "q w e")], "j int, quote string")
    assert {(r.i, r.j) for r in fulltext.contained(rows, quotes, "i").collect()} == {(1, 1), (2, 1), (1, 2), (2, 2), (3, 3)}


def test_long_chains_are_one_cluster(spark):
    import random

    ids = list(range(300))
    random.Random(3).shuffle(ids)
    pairs = spark.createDataFrame(list(zip(ids, ids[1:])) + [(1000, 1001), (7, 7)], "a int, b int")
    got = {r.node: r.cluster for r in graph.clusters(pairs).collect()}
    assert got == {**dict.fromkeys(ids, 0), 1000: 1000, 1001: 1000}


def test_quota_refusals_take_nothing(spark):
    df = spark.createDataFrame([("a", 1, 8), ("a", 2, 5), ("a", 3, 2), ("b", 1, 11), ("b", 2, None), (None, 1, 3)], "t string, o int, n int")
    got = {(r.t, r.o): (r.accepted, r.running) for r in records.reserve_quota(df, "t", ["o"], "n", 10).collect()}
    assert got == {("a", 1): (True, 8), ("a", 2): (False, 8), ("a", 3): (True, 10), ("b", 1): (False, 0), ("b", 2): (True, 0), (None, 1): (True, 3)}


def test_bulk_ids(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert [r.id for r in records.bulk_change(df, "id", [1, 3, 9], F.col("id") < 3).collect()] == [1]
    for ids in ([], [1, 1], range(101)):
        with pytest.raises(ValueError):
            records.bulk_change(df, "id", ids, F.lit(True))


def test_bounded_functions(spark):
    df = spark.createDataFrame([("né€😀x",), (None,)], "t string")
    for n in range(1, 12):
        assert df.select(text.cut_utf8(F.col("t"), n).alias("c")).first().c == "né€😀x".encode()[:n].decode(errors="ignore")
    many = spark.createDataFrame([(" ".join(str(1990 + i) for i in range(11)),)], "t string")
    with pytest.raises(Exception, match="years"):
        many.select(text.filter_years(F.col("t"))).collect()
    assert [r.s for r in df.select(text.extractive_summary(F.lit("One. " + "y" * 700 + "."), "bullet_points").alias("s")).collect()][0] == "• One.\n• " + "y" * 500


def test_tables_written_once(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string"), spark.createDataFrame([(1, "y")], "i int, s string")
    path = str(tmp_path / "t")
    assert datasets.create_once(a, path).count() == 2
    assert datasets.create_once(a.orderBy("i"), path).count() == 2
    with pytest.raises(ValueError):
        datasets.create_once(b, path)
    chunks = str(tmp_path / "c")
    datasets.append_chunks(a, chunks, "p1")
    datasets.append_chunks(b, chunks, "p1")
    with pytest.raises(ValueError):
        datasets.append_chunks(b, chunks, "p2")
    assert spark.read.parquet(chunks).count() == 3


def test_manifest(spark, tmp_path):
    import json

    (tmp_path / "a.txt").write_text("The river is long.")
    (tmp_path / "b.txt").write_text("changed")
    sha = hashlib.sha256(b"The river is long.").hexdigest()
    docs = [{"id": "a", "path": "a.txt", "sha256": sha}, {"id": "b", "path": "b.txt", "sha256": sha}, {"id": "c", "path": "../c.txt", "sha256": sha}, {"id": "d", "path": "d.txt", "sha256": sha}]
    good, bad, none = ({"document": "a", "quote": "river", "start": 4}, {"document": "a", "quote": "river", "start": 5}, {"document": "zz", "quote": "x", "start": 0})
    queries = [{"id": "q1", "text": "how long", "evidence": [good]}, {"id": "q2", "text": "?", "evidence": [bad]}, {"id": "q3", "text": "?", "evidence": [none]}]
    (tmp_path / "manifest.json").write_text(json.dumps({"version": 1, "documents": docs, "queries": queries}))
    got = datasets.load_manifest(spark, str(tmp_path))
    assert {(r.item, r.violation) for r in got["violations"].collect()} == {("b", "sha256"), ("c", "path"), ("d", "missing"), ("q2", "quote"), ("q3", "unknown document")}
    assert got["documents"].count() == 4 and got["queries"].count() == 3 and got["evidence"].count() == 3


def test_section_chunks_are_cut_once(spark):
    """Texts whose sections are blank, missing or none are one chunk; the chunker runs once, over sections' own stretches."""
    kind = "k int, text string, name string, s array<struct<title: string, page: int, start_char: int, end_char: int>>"
    rows = [(1, "One two. \x1c\u2003 x", "N", [("A", 1, 0, 8), ("B", 1, 8, 12)]), (2, " \x1c\u2003 ab", "N", [("A", 1, 0, 3)]), (3, "whole", "N", None), (4, "whole", "N", []), (5, "  ", "N", None), (6, None, "N", None)]
    got = chunking.section_chunks(spark.createDataFrame(rows, kind), "k", "text", "s", "name")
    assert sorted((r.k, r.chunk_index, r.content, r.section) for r in got.collect()) == [(1, 0, "One two.", "A"), (2, 0, "\x1c\u2003 ab", "Full Content"), (3, 0, "whole", "Full Content"), (4, 0, "whole", "Full Content")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "LeftAnti" not in plan


def test_embedding_hashes_each_feature_once(spark, monkeypatch):
    """Repeats of a batch cost no further hashes, and texts of one batch don't touch each other."""
    import numpy as np
    import pyarrow as pa

    from basalt.functions import vectors

    texts = [["alpha", "beta", "alpha"], ["be"], ["gamma", "alpha"]] * 40
    hashed = []
    places = vectors._places
    monkeypatch.setattr(vectors, "_places", lambda names, size: places((hashed.append(x) or x for x in names), size))
    together = vectors._embedded(pa.array(texts), 256)
    assert len(hashed) == len(set(hashed)) and len(hashed) < 30
    monkeypatch.setattr(vectors, "HELD_TEXTS", 7)
    assert np.array_equal(together, vectors._embedded(pa.array(texts), 256))
    assert np.array_equal(together[:3], np.concatenate([vectors._embedded(pa.array([t]), 256) for t in texts[:3]]))


def test_texts_without_a_term_are_not_taken_apart(spark):
    """What may_hold lets through is all that has the terms as words, among it no text that lacks one as a run of characters."""
    from pyspark.sql import functions as F

    from basalt.operators import fulltext

    rows = spark.createDataFrame([(0, "Apache LICENSE"), (1, "apaches licensed"), (2, "apache"), (3, None), (4, "İ license apache"), (5, "no")], "k int, t string")
    terms = [["apache"], ["license"]]
    may = {r.k for r in rows.where(fulltext.may_hold(F.col("t"), terms)).collect()}
    has = {r.k for r in rows.where(fulltext.holds_all_forms(fulltext.words(F.col("t")), terms)).collect()}
    assert has == {0, 4} and has <= may == {0, 1, 4}
