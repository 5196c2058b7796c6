"""Chunks with exact code-point spans: small pure helpers, applied to whole columns in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Span = tuple[int, int]
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_PARAGRAPH = re.compile(r"\n[ \t]*\n+")
_WORD = re.compile(r"\S+")


def trimmed(text: str, start: int, end: int) -> Span | None:
    """The span without white space at its ends; None if nothing is left."""
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return (start, end) if start < end else None


def split_spans(text: str, gap: re.Pattern, start: int = 0, end: int | None = None) -> list[Span]:
    """Spans between the gaps of text[start:end], trimmed, none empty."""
    end = len(text) if end is None else end
    found, at = [], start
    for m in gap.finditer(text, start, end):
        found.append((at, m.start()))
        at = m.end()
    return [s for a, b in [*found, (at, end)] if (s := trimmed(text, a, b))]


def tokens(text: str) -> int:
    return max(1, int(len(text.split()) * 1.3))


def token_chunks(text: str, target: int = 400, overlap: int = 50, start: int = 0, end: int | None = None) -> list[Span]:
    """Whole sentences up to `target` tokens a chunk; the next begins with the last sentences of up to `overlap` tokens.

    A sentence over the target is cut into runs of words. Running sums of the units' tokens say how far each chunk goes and where the next begins.
    """
    units: list[Span] = []
    run = max(1, int((target - overlap) / 1.3))
    for sentence in split_spans(text, _SENTENCE, start, end):
        if tokens(text[slice(*sentence)]) > target:
            words = [m.span() for m in _WORD.finditer(text, *sentence)]
            units += [(words[i][0], words[min(i + run, len(words)) - 1][1]) for i in range(0, len(words), run)]
        else:
            units.append(sentence)
    sums = [0, *accumulate(tokens(text[a:b]) for a, b in units)]
    chunks: list[Span] = []
    first = last = 0
    while last < len(units):
        last = max(last + 1, bisect_right(sums, sums[first] + target) - 1)
        chunks.append((units[first][0], units[last - 1][1]))
        if last < len(units):
            first = min(last, max(first, bisect_left(sums, sums[last] - overlap), bisect_left(sums, sums[last + 1] - target)))
    return chunks


def recursive_chunks(text: str, target: int = 400, overlap: int = 50) -> list[Span]:
    """Paragraphs of up to `target` tokens whole, longer ones by sentences."""
    out: list[Span] = []
    for a, b in split_spans(text, _PARAGRAPH):
        out += [(a, b)] if tokens(text[a:b]) <= target else token_chunks(text, target, overlap, a, b)
    return out


def strategy(c: Column) -> Column:
    """The strategy that a request names, `semantic` as `sentence`; an unknown one is an error when it is read."""
    asked = F.lower(F.trim(c))
    known = F.when(asked == "semantic", "sentence").when(asked.isin(*STRATEGIES), asked)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown strategy: "), F.coalesce(c, F.lit("null")))).cast("string"))


def header(title: Column, section: Column) -> Column:
    """What stands before a chunk: title and section, or the title alone."""
    return F.when(section.isNotNull() & (section != ""), F.concat(title, F.lit(" > "), section, F.lit(": "))).otherwise(F.concat(title, F.lit(": ")))


def section_chunks(docs: DataFrame, key: str, text: str, sections: str, title: str, strategy: str = "token") -> DataFrame:
    """(key, chunk_index, start_char, end_char, content, contextualized, section, page) of the sections (title, page, start_char, end_char) of each text.

    Sections are chunked each by themselves; spans are rebased to the text and hold the content exactly; chunks are numbered through. A text whose
    sections give none is one chunk, `Full Content`, without the white space around it; a blank or null one has no chunk.
    """
    # Sections take their own stretch with them, not the whole text each.
    own = F.transform(sections, lambda s: F.struct(s["title"].alias("title"), s["page"].alias("page"), s["start_char"].alias("at"), F.substring(F.col(text), s["start_char"] + 1, s["end_char"] - s["start_char"]).alias("body")))
    parts = docs.select(F.col(key).alias("_k"), F.col(title).alias("_title"), F.posexplode(own).alias("_n", "_s"))
    body = parts.select("_k", "_n", "_title", F.col("_s.title").alias("section"), F.col("_s.page").alias("page"), F.col("_s.at").alias("_at"), F.col("_s.body").alias("_body"))
    keyed = body.withColumn("_id", F.struct("_k", "_n", "_title", "section", "page", "_at"))
    cut = chunk(keyed, "_id", "_body", strategy)
    rebased = cut.select("_id.*", F.col("chunk_index").alias("_c"), (F.col("start_char") + F.col("_id._at")).alias("start_char"), (F.col("end_char") + F.col("_id._at")).alias("end_char"), "content")
    # Every section that isn't blank gives a chunk; blank as Python has it.
    bare = docs.where((F.trim(F.col(text)) != "") & ~F.coalesce(F.exists(own, lambda s: s["body"].rlike(r"[^\p{Z}\t-\r\x1c-\x1f\x85]")), F.lit(False)))
    lead = F.length(text) - F.length(F.regexp_replace(text, r"(?U)^\s+", ""))
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    whole = bare.select(F.col(key).alias("_k"), F.lit(0).alias("_n"), F.col(title).alias("_title"), F.lit("Full Content").alias("section"), F.lit(1).alias("page"), F.lit(0).alias("_at"), F.lit(0).alias("_c"), lead.alias("start_char"), (lead + F.length(trimmed)).alias("end_char"), trimmed.alias("content"))
    both = rebased.unionByName(whole)
    # A document's chunks are numbered in one task: they were one document before.
    number = F.row_number().over(Window.partitionBy("_k").orderBy("_n", "_c")) - 1
    named = both.withColumn("chunk_index", number).withColumn("contextualized", F.concat(header(F.col("_title"), F.when(F.col("section") != "Full Content", F.col("section"))), F.col("content")))
    return named.select(F.col("_k").alias(key), "chunk_index", "start_char", "end_char", "content", "contextualized", "section", "page")


STRATEGIES = {"token": lambda t: token_chunks(t), "sentence": lambda t: token_chunks(t, 450, 40), "recursive": lambda t: recursive_chunks(t)}


def chunk(docs: DataFrame, key: str, text: str, strategy: str = "token") -> DataFrame:
    """(key, chunk_index, start_char, end_char, content, token_count). `semantic` means `sentence`; null and blank texts have no chunk."""
    strategy = {"semantic": "sentence"}.get(strategy, strategy)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")

    @F.pandas_udf("array<struct<start_char: int, end_char: int, token_count: int>>")
    def spans(texts: pd.Series) -> pd.Series:
        cut = STRATEGIES[strategy]
        return texts.map(lambda t: [(a, b, tokens(t[a:b])) for a, b in cut(t)] if t else [])

    # Chunks take their own stretch with them, not the whole text each.
    cut = docs.select(key, text, spans(text).alias("_spans"))
    own = F.transform("_spans", lambda s: F.struct(s["start_char"].alias("start_char"), s["end_char"].alias("end_char"), F.substring(F.col(text), s["start_char"] + 1, s["end_char"] - s["start_char"]).alias("content"), s["token_count"].alias("token_count")))
    found = cut.select(key, F.posexplode(own).alias("chunk_index", "s"))
    return found.select(key, "chunk_index", "s.*")


def span_violations(chunks: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Chunks whose span of the text is not their content."""
    return chunks.join(docs.select(key, F.col(text).alias("_whole")), key).where("NOT (substring(_whole, start_char + 1, end_char - start_char) <=> content)").drop("_whole")
