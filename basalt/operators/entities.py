"""Entities of texts: terms of a dictionary by one automaton, and capitalised phrases with a kind."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.operators.paging import latest
from basalt.tables import ship

#: UTF-8 bytes of the terms of one automaton; a larger dictionary takes several passes over the texts.
TERM_BYTES = 16_000_000
#: Entities of a text at most, phrases that aren't entities, and parts of a phrase that tell its kind.
MOST = 250
NO_NAMES = (
    "accept", "add", "all", "and", "because", "build", "configure", "current", "each", "every", "exercise", "for", "how", "keep", "official", "pin", "recommended", "return", "search", "see", "that", "the", "then",
    "therefore", "they", "this", "tool", "translate", "true", "use", "what", "when", "where",
)
KINDS = {"ORGANIZATION": ("Inc", "Corp", "LLC", "Labs", "Foundation", "Team", "Organization"), "PROJECT": ("Project", "System", "Engine", "Service", "Protocol", "Framework", "OS")}
#: Fixed value: up to four words that begin with a capital.
PHRASE = r"\b[A-Z][a-zA-Z0-9_-]{2,}(?:[ \t]+[A-Z][a-zA-Z0-9_-]{2,}){0,3}\b"


class TermCounter:
    """Counts whole-word, non-overlapping hits of lower-case terms in texts."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for t in terms:
            self.automaton.add_word(t, t)
        self.automaton.make_automaton()

    def counts(self, text: str | None) -> dict[str, int]:
        text = (text or "").lower()
        found: dict[str, int] = {}
        until: dict[str, int] = {}
        if not len(self.automaton):
            return found

        def word(i: int) -> bool:
            return 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")

        for end, term in self.automaton.iter(text):
            start = end - len(term) + 1
            # A boundary lies between a sign of a word and another; hits of a term don't overlap.
            if word(start - 1) != word(start) and word(end) != word(end + 1) and start >= until.get(term, 0):
                found[term] = found.get(term, 0) + 1
                until[term] = end + 1
        return found


def _groups(terms: DataFrame):
    """Distinct lower-case terms in groups of at most TERM_BYTES; one group is held at a time."""
    held, size = [], 0
    for r in terms.select(F.lower("term").alias("term")).where("term <> ''").distinct().orderBy("term").toLocalIterator():
        n = len(r["term"].encode())
        if held and size + n > TERM_BYTES:
            yield held
            held, size = [], 0
        held.append(r["term"])
        size += n
    if held:
        yield held


def dictionary_hits(rows: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, term, mentions) of the terms (column term) that stand in each text as whole words, in any case. Null texts have none. Texts are read once for each TERM_BYTES of terms."""
    spark = rows.sparkSession
    ship(spark)
    kind = f"{key} {rows.schema[key].dataType.simpleString()}, term string, mentions long"
    out = spark.createDataFrame([], kind)
    for group in _groups(terms):
        sent = spark.sparkContext.broadcast(group)

        def count(frames, sent=sent):
            counter = TermCounter(sent.value)
            for frame in frames:
                got = [(k, t, n) for k, x in zip(frame[key], frame[text], strict=True) for t, n in counter.counts(x).items()]
                yield pd.DataFrame(got, columns=[key, "term", "mentions"]).astype({key: frame[key].dtype, "mentions": "int64"})

        out = out.unionByName(rows.select(key, text).mapInPandas(count, kind))
    return out


def canonical(term: Column) -> Column:
    """Terms of up to four signs in capitals, others with each word's first letter as one."""
    return F.when(F.length(term) <= 4, F.upper(term)).otherwise(F.initcap(term))


def phrases(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, kind, mentions) of capitalised phrases, those that differ in case alone as one, under the name seen first."""
    found = rows.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(PHRASE), F.lit(0))).alias("place", "name"))
    named = found.withColumn("folded", F.lower("name")).where(~F.col("folded").isin(*NO_NAMES))
    once = named.groupBy(key, "folded").agg(F.count("*").alias("mentions"), F.min(F.struct("place", "name"))["name"].alias("name"))
    kind = F.lit("CONCEPT")
    for k in ("PROJECT", "ORGANIZATION"):
        has = F.lit(False)
        for part in KINDS[k]:
            has = has | F.contains(F.col("name"), F.lit(part))
        kind = F.when(has, k).otherwise(kind)
    return once.select(key, "name", kind.alias("kind"), "mentions", "folded")


def extract(rows: DataFrame, key: str, text: str, terms: DataFrame, most: int = MOST) -> DataFrame:
    """(key, name, kind, mentions): the `most` entities of each text with most mentions, ties by name. Dictionary terms are of kind TECHNOLOGY; a phrase that is a term isn't counted again, and one with a term's canonical name adds to it."""
    hits = dictionary_hits(rows, key, text, terms).select(key, canonical(F.col("term")).alias("name"), F.lit("TECHNOLOGY").alias("kind"), "mentions").withColumn("folded", F.lower("name")).withColumn("first", F.lit(0))
    listed = terms.select(F.lower("term").alias("folded")).distinct()
    caps = phrases(rows, key, text).join(listed, "folded", "left_anti").select(key, "name", "kind", "mentions", "folded", F.lit(1).alias("first"))
    both = hits.unionByName(caps).groupBy(key, "folded").agg(F.sum("mentions").alias("mentions"), F.min(F.struct("first", "name", "kind")).alias("x"))
    named = both.select(key, F.col("x.name").alias("name"), F.col("x.kind").alias("kind"), "mentions", "folded")
    return latest(named, [key], [F.desc("mentions"), F.asc("folded")], most).select(key, "name", "kind", "mentions")
