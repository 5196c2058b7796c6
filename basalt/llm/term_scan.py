"""Ranked lexical search by scanning texts: one automaton of all items' terms counts them in every document, without an index of documents.

A text's bytes that part terms become single blanks, and each term is a pattern with a blank on either side, so that only whole
terms match; neighbouring matches share their blank. The first pass writes what the automaton counted; the second turns the counts into scores.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.llm.common import materialize, ship

K = 20
#: UTF-8 bytes of the distinct terms of one automaton, and their mentions in items; more items take several scans.
TERM_BYTES, MENTIONS = 8_000_000, 2_000_000
#: Terms of more bytes are looked up whole, since an automaton is as deep as its longest pattern.
LONG = 512
#: Bytes of a text that are scanned at once, and scores that are held at once.
STRETCH, SCORES = 1_000_000, 2_000_000
#: Shards that each item's rows are ranked in before they meet.
SHARDS = 32
#: Sums below this are exact in doubles.
EXACT = 1 << 53

#: A-Z to a-z; ASCII bytes other than letters and digits to a blank. Bytes of other characters stay: they are of a term.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def stretches(text: str | bytes | None):
    """A text, made plain, in pieces that end where a term does. Null is empty."""
    data = text.encode() if isinstance(text, str) else text or b""
    at, rest = 0, b""
    while at < len(data):
        plain = rest + data[at : at + STRETCH].translate(_PLAIN)
        at += STRETCH
        # The last term may go on in the next piece.
        cut = plain.rfind(b" ") + 1 if at < len(data) else len(plain)
        rest = plain[cut:]
        if cut:
            yield plain[:cut]


def term_count(plain: bytes) -> int:
    inside = np.frombuffer(plain, np.uint8) != 32
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]) + inside[0]) if len(inside) else 0


def terms(text: str | bytes | None) -> list[bytes]:
    """The terms of a text, repeats too, as UTF-8."""
    return [t for plain in stretches(text) for t in plain.split(b" ") if t]


class Scanner:
    """Counts terms, numbered in their order, in texts."""

    def __init__(self, vocabulary: list[bytes]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.long = {term: i for i, term in enumerate(vocabulary) if len(term) > LONG}
        for i, term in enumerate(vocabulary):
            if len(term) <= LONG:
                self.automaton.add_word(f" {term.decode('latin-1')} ", i)
        self.automaton.make_automaton()

    def counts(self, text: str | bytes | None) -> tuple[int, Counter]:
        """(terms in the text, how often each numbered one)."""
        size, found = 0, Counter()
        for plain in stretches(text):
            size += term_count(plain)
            if len(self.automaton):
                found.update(i for _, i in self.automaton.iter(f" {plain.decode('latin-1')} "))
            if self.long:
                found.update(self.long[t] for t in plain.split(b" ") if t in self.long)
        return size, found


def item_groups(items: DataFrame):
    """Items in groups that fit in TERM_BYTES and MENTIONS each: lists of (row, item_id, terms). One group is held at a time.

    An item whose own terms are more is a group by itself. A null text has no terms.
    """
    held, size, mentions = [], 0, 0
    for r in items.select("row", "item_id", "text").toLocalIterator():
        own = terms(r["text"])
        bytes_of = sum(map(len, set(own)))
        if held and (size + bytes_of > TERM_BYTES or mentions + len(own) > MENTIONS):
            yield held
            held, size, mentions = [], 0, 0
        if own:
            held.append((r["row"], r["item_id"], own))
            size, mentions = size + bytes_of, mentions + len(own)
    if held:
        yield held


def count_terms(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, term, tf) of whole texts: how many terms each has, and the arrays of the numbered terms that are in it, with how often."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)

    def scan(batches):
        scanner = Scanner(sent.value)
        for batch in batches:
            sizes, numbers, times = [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                size, found = scanner.counts(text.as_py())
                sizes.append(size)
                numbers.append(list(found))
                times.append(list(found.values()))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(numbers, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "term", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, n long, term array<int>, tf array<long>")


def frequencies(counted: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents with terms, terms of all documents, documents that hold each of the `size` numbered terms).

    A task adds up what it reads, so a term that all documents hold is one row of a task.
    """
    whole = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.sum("n").alias("L")).first()

    def add(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(df[some])], ["term", "df"])

    df = np.zeros(size, np.int64)
    for r in counted.select("term").mapInArrow(add, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r["term"]] = r["df"]
    return whole["N"] or 0, whole["L"] or 0, df


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def tops(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, ties to smaller ids."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        cut = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= cut]
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _ranked(counted: DataFrame, group: list, vocabulary: list[bytes], k: int) -> DataFrame:
    """(row, item_id, doc_id, score, shard): the k best documents of each item of the group in each task."""
    spark = counted.sparkSession
    number = {t: i for i, t in enumerate(vocabulary)}
    documents, all_terms, df = frequencies(counted, len(vocabulary))
    weight = weights(df, documents)
    first = np.cumsum([0] + [len(own) for *_, own in group])
    mentions = np.array([number[t] for *_, own in group for t in own], np.int64)
    sent = spark.sparkContext.broadcast((first, mentions, weight, [(r, i) for r, i, _ in group]))

    def score(batches):
        first, mentions, weight, names = sent.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        item_of = np.repeat(np.arange(len(names)), np.diff(first))
        # What each (item, term) pair is worth: the term's weight as often as the item mentions it.
        pair, times = np.unique(item_of * len(weight) + mentions, return_counts=True)
        p_item, p_term = pair // len(weight), pair % len(weight)
        worth = weight[p_term] * times
        exact = float(np.bincount(p_item, worth.astype(np.float64)).max(initial=0)) * 1e6 < EXACT
        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            n = batch.column(1).to_numpy(zero_copy_only=False)
            size = np.diff(batch.column(2).offsets.to_numpy())
            term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            doc = np.repeat(np.arange(len(ids)), size)
            m = 75 + (25 * n * documents) // max(1, all_terms)
            value = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
            # Documents and items a few at a time, so that the table of scores stays small; only terms that occur take part.
            here, place = np.unique(term, return_inverse=True)
            at = np.full(len(weight), -1)
            at[here] = np.arange(len(here))
            some = np.flatnonzero(at[p_term] >= 0)
            kind = np.float64 if exact else np.int64
            wide = max(1, min(len(names), SCORES // max(1, len(here))))
            tall = max(1, SCORES // max(1, len(here), wide))
            for i in range(0, len(names), wide):
                mine = some[(p_item[some] >= i) & (p_item[some] < i + wide)]
                table = np.zeros((len(here), min(wide, len(names) - i)), kind)
                table[at[p_term[mine]], p_item[mine] - i] = worth[mine]
                for d in range(0, len(ids), tall):
                    inside = (doc >= d) & (doc < d + tall)
                    values = np.zeros((min(tall, len(ids) - d), len(here)), kind)
                    values[doc[inside] - d, place[inside]] = value[inside]
                    scores = (values @ table).astype(np.int64)
                    own = ids[d : d + tall]
                    for j in np.flatnonzero(scores.any(0)).tolist():
                        found = tops(scores[:, j], own, k)
                        known = best.get(i + j)
                        s, x = scores[found, j], own[found]
                        if known is not None:
                            s, x = np.concatenate([known[0], s]), np.concatenate([known[1], x])
                            found = tops(s, x, k)
                            s, x = s[found], x[found]
                        best[i + j] = s, x
        for j, (s, x) in best.items():
            row, item = names[j]
            made = pa.array(x)
            yield pa.record_batch([pa.array([row] * len(x), pa.int64()), pa.array([item] * len(x), pa.int64()), pc.if_else(pc.equal(made, -(1 << 63)), pa.scalar(None, pa.int64()), made), pa.array(s)], ["row", "item_id", "doc_id", "score"])

    return counted.mapInArrow(score, "row long, item_id long, doc_id long, score long").withColumn("shard", F.spark_partition_id() % SHARDS)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 of each row of items (item_id, text).

    Each row of docs (doc_id, text) is a document and each row of items an item: repeated ones have ranks of their own. Equal
    scores go by ascending doc_id, a null id first. Null and empty texts have no terms; an item without terms, and empty tables, give no rows.
    Whole texts are scanned once for each group of items that fits in an automaton.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    rows = materialize(items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), "text"), "items")
    parts = None
    for group in item_groups(rows):
        vocabulary = sorted({t for *_, own in group for t in own})
        counted = materialize(count_terms(docs, vocabulary), "term-counts")
        part = _ranked(counted, group, vocabulary, k)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = (F.desc("score"), F.asc_nulls_first("doc_id"))
    near = materialize(parts, "ranked").withColumn("rank", F.row_number().over(Window.partitionBy("row", "shard").orderBy(*order))).where(F.col("rank") <= k)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


#: DuckDB SQL for the rows of search() over documents and benchmark, where ids don't repeat.
ORACLE_SQL = r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
    ), i AS (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
    ), pairs AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
    whole AS (SELECT count(*) FILTER (len(t) > 0) AS docs, CAST(sum(len(t)) AS BIGINT) AS all_terms FROM d),
    f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM pairs) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f CROSS JOIN whole GROUP BY term),
    s AS (
        SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // all_terms)))) AS BIGINT) AS score
        FROM pairs JOIN w USING (term) JOIN f USING (term) CROSS JOIN whole GROUP BY ALL
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
