"""Full-text match and ranking over whole texts, in DataFrame functions.

Lexemes are runs of letters and digits, lower-cased, without stop words. With a vocabulary (word, stem) a term stands for all words of
its stem: `run` finds `running`. Stems are made of distinct words only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.tables import sent_if_small, ship, written

#: Words that are never searched for.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
#: Words that may stand for a query's stems.
FORMS = 5_000
#: Words of a term that texts are searched for before they are taken apart.
LOOKED_FOR = 8
#: Short quotes that are sent to all tasks at once.
QUOTES = 10_000
_PARTS = r"[^\p{L}\p{N}]+"


def query_terms(query: str) -> list[str]:
    """The distinct lexemes of a query in their order."""
    return list(dict.fromkeys(w for w in re.split(r"[\W_]+", query.lower()) if w and w not in STOP))


def words(c: Column) -> Column:
    """All words of a text in their places, stop words too."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), _PARTS), "")


def holds_all(held: Column, terms: list[str]) -> Column:
    """Whether an array of words has every term; no terms, no match."""
    out = F.lit(bool(terms))
    for t in terms:
        out = out & F.array_contains(held, t)
    return out


def cover_rank(held: Column, terms: list[str] | list[list[str]]) -> Column:
    """Cover density: the sum of 1 / length of the shortest stretches that hold all the terms, each begun at another word. A term is a word, or a list of the words that stand for it.

    One pass over a text's hits; the state is the last place of each term. 0 where a term is missing.
    """
    if not terms or not all(terms):
        return F.lit(0.0)
    listed = [[t] if isinstance(t, str) else t for t in terms]
    numbers = F.create_map(*[x for i, ws in enumerate(listed) for w in ws for x in (F.lit(w), F.lit(i))])
    placed = F.filter(F.transform(held, lambda w, i: F.struct(F.element_at(numbers, w).alias("t"), i.alias("p"))), lambda x: x["t"].isNotNull())
    return cover_density(placed, len(listed))


def cover_density(placed: Column, terms: int) -> Column:
    """cover_rank of a text's hits (t: number of a term, p: place) in the order of their places."""

    def step(state: Column, hit: Column) -> Column:
        last = F.transform(state["last"], lambda p, i: F.when(i == hit["t"], hit["p"]).otherwise(p))
        start = F.array_min(last)
        new = (start >= 0) & (start != state["start"])
        return F.struct(last.alias("last"), F.when(start >= 0, start).otherwise(state["start"]).alias("start"), (state["rank"] + F.when(new, 1.0 / (hit["p"] - start + 1)).otherwise(0.0)).alias("rank"))

    zero = F.struct(F.array(*[F.lit(-1)] * terms).alias("last"), F.lit(-1).alias("start"), F.lit(0.0).alias("rank"))
    return F.aggregate(placed, zero, step, lambda s: s["rank"])


def vocabulary(rows: DataFrame, text: str) -> DataFrame:
    """(word, stem) of the distinct words of all texts."""
    import pandas as pd

    from basalt.functions.stemming import stem

    ship(rows.sparkSession)

    def stems(frames):
        for frame in frames:
            yield pd.DataFrame({"word": frame["word"], "stem": [stem(w) for w in frame["word"]]})

    return rows.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word")).distinct().mapInPandas(stems, "word string, stem string")


def forms(known: DataFrame, query: str) -> list[list[str]]:
    """For each distinct stem of the query's terms the words of a vocabulary that have it; itself where there are none. Only words of those few stems reach the driver, FORMS at most."""
    from basalt.functions.stemming import stem

    stems = list(dict.fromkeys(stem(w) for w in query_terms(query)))
    if not stems:
        return []
    found = known.where(F.col("stem").isin(stems)).limit(FORMS + 1).collect()
    if len(found) > FORMS:
        raise ValueError(f"more than {FORMS} words of the query's stems")
    return [sorted({r["word"] for r in found if r["stem"] == s}) or [s] for s in stems]


def holds_all_forms(held: Column, terms: list[list[str]]) -> Column:
    """Whether an array of words has a word of each term."""
    out = F.lit(bool(terms))
    for ws in terms:
        out = out & F.arrays_overlap(held, F.array(*map(F.lit, ws)))
    return out


def may_hold(text: Column, terms: list[list[str]]) -> Column:
    """False only for texts that lack a term as a run of characters, so they need not be taken apart into words. Terms of many words aren't looked for."""
    out = F.lit(True)
    for ws in terms:
        if len(ws) <= LOOKED_FOR:
            held = F.lit(False)
            for w in ws:
                held = held | F.contains(F.lower(text), F.lit(w))
            out = out & held
    return out


def ranked(rows: DataFrame, key: str, text: str, query: str, k: int, known: DataFrame | None = None) -> DataFrame:
    """(key, relevance, rank): the k rows that hold all the query's terms, by cover density, ties to the smaller key; with a vocabulary, words of the same stem count as a term."""
    terms = [[t] for t in query_terms(query)] if known is None else forms(known, query)
    found = rows.where(may_hold(F.col(text), terms)).select(key, words(F.col(text)).alias("w")).where(holds_all_forms(F.col("w"), terms)).select(key, F.round(cover_rank(F.col("w"), terms), 9).alias("relevance"))
    return first_ranks(found, key, k)


def first_ranks(found: DataFrame, key: str, k: int) -> DataFrame:
    first = found.orderBy(F.desc("relevance"), key).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("relevance"), key)))  # k rows


def keyword_ranking(rows: DataFrame, key: str, text: str, query: str, k: int) -> DataFrame:
    """(key, rank): full-text rows first, then those not seen yet that hold the whole query as a phrase (rank 0, by key), as one ranking."""
    best = ranked(rows, key, text, query, k).select(key, F.lit(0).alias("part"), F.col("rank").cast("long").alias("place"))
    literal = rows.where(F.instr(F.lower(text), query.lower()) > 0).select(key).orderBy(key).limit(k).select(key, F.lit(1).alias("part"), F.lit(0).cast("long").alias("place"))
    once = best.unionByName(literal).groupBy(key).agg(F.min(F.struct("part", "place")).alias("p"))
    return once.select(key, F.row_number().over(Window.orderBy("p.part", "p.place", key)).alias("rank"))  # 2k rows


def title_match(title: Column, tags: Column, query: str) -> Column:
    """Full text, or the lower-cased query anywhere in the title with % and _ as wild cards, or equal to a tag."""
    terms = query_terms(query)
    return holds_all(words(title), terms) | F.lower(title).like(f"%{query.lower()}%") | F.array_contains(tags, query)


def lexical_scores(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query, item, score) of queries (query, terms) and rows (item, terms), terms distinct: shared terms over the geometric mean of both counts, of pairs that share one."""
    q = queries.select("query", F.size("terms").alias("nq"), F.explode("terms").alias("term"))
    r = rows.select("item", F.size("terms").alias("nr"), F.explode("terms").alias("term"))
    shared = r.join(q, "term").groupBy("query", "item", "nq", "nr").agg(F.count("*").alias("n"))
    return shared.select("query", "item", F.round(F.col("n") / F.sqrt((F.col("nq") * F.col("nr")).cast("double")), 9).alias("score"))


def lexical_arm(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query, item, score, rank): k items a query by shared terms over the geometric mean of both counts, above 0, ties to the smaller item.

    queries: (query, terms), rows: (item, terms), terms distinct. They meet over an inverted index: no pair without a shared term is made.
    """
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    return lexical_scores(queries, rows).withColumn("rank", place).where(F.col("rank") <= k)


def hybrid(semantic: DataFrame | None, keyword: DataFrame, key: str, k: int) -> DataFrame:
    """(key, score, position, degraded): reciprocal rank fusion of two rankings (key, rank), the semantic one first. Without it the keyword ranking stands alone, marked as degraded."""
    from basalt.operators.retrieval import reciprocal_rank_fusion

    def one(ranking: DataFrame, no: int) -> DataFrame:
        return ranking.select(F.lit(0).alias("query"), F.lit(no).alias("ranking_no"), key, "rank")

    both = one(keyword, 1) if semantic is None else one(semantic, 0).unionByName(one(keyword, 1))
    return reciprocal_rank_fusion(both, "query", key).where(F.col("position") <= k).select(key, "score", "position", F.lit(semantic is None).alias("degraded"))


def contained(rows: DataFrame, quotes: DataFrame, key: str) -> DataFrame:
    """rows (key, text, ...) joined to those quotes (with quote) that they hold as they stand.

    A quote's inner words are whole words of every text that holds it. So keys of rows meet keys of quotes over the longest of them, and
    only then the texts are fetched. Quotes of less than three words have none: all texts are searched for them, QUOTES at a time.
    Each row has a key of its own. Null texts and quotes match nothing.
    """
    inner = F.slice(words(F.col("quote")), 2, F.greatest(F.size(words(F.col("quote"))) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = written(quotes.where("quote IS NOT NULL").withColumn("_w", longest).withColumn("_q", F.monotonically_increasing_id()), "quotes")
    asked = keyed.where("_w IS NOT NULL")
    spread = rows.select(F.col(key).alias("_key"), F.explode(F.array_distinct(words(F.col("text")))).alias("_w")).join(sent_if_small(asked.select("_w").distinct()), "_w", "left_semi")
    pairs = spread.join(asked.select("_w", "_q"), "_w").select("_key", "_q")
    met = rows.join(pairs, F.col(key) == F.col("_key")).join(asked.drop("_w"), "_q").where(F.contains(F.col("text"), F.col("quote"))).drop("_key", "_q")
    short = written(keyed.where("_w IS NULL").drop("_w", "_q"), "short-quotes")
    parts = -(-short.count() * 2 // QUOTES)
    for part in range(parts):
        few = F.broadcast(short.where(F.pmod(F.xxhash64("quote"), F.lit(parts)) == part))
        met = met.unionByName(rows.join(few, F.contains(F.col("text"), F.col("quote"))).select(*met.columns))
    return met
