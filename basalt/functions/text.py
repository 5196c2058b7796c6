"""Text functions as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact(c: Column) -> Column:
    """White space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def escape_like(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))


def estimate_tokens(c: Column) -> Column:
    """1.3 tokens a word, cut to a whole number, one at least."""
    words = F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor(words * 1.3)).cast("int")


def snippet(c: Column, query: str, most: int = 240) -> Column:
    """A text of up to `most` signs whole; of a longer one `most` signs around the query's first place (else that of its first word found), a third of them before it, or its last ones. Cut ends are marked."""
    text = compact(c)
    low = F.lower(text)
    found = F.lit(0)
    for candidate in reversed([query.strip(), *re.findall(r"[\w-]+", query)]):
        if len(candidate.strip()) >= 2:
            at = F.instr(low, candidate.lower())
            found = F.when(at > 0, at - 1).otherwise(found)
    n = F.length(text)
    start = F.greatest(F.lit(0), F.least(found - most // 3, n - most))
    end = F.least(n, start + most)
    cut = F.trim(F.substring(text, start + 1, end - start))
    return F.when(n <= most, text).otherwise(F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(end < n, "…").otherwise("")))


def years(c: Column) -> Column:
    """Distinct four-digit years from 1000 to 2999 in order, not within longer numbers or dashes."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<![\d-])((?:1|2)\d{3})(?![\d-])"), F.lit(1)))


def filter_years(c: Column, most: int = 10) -> Column:
    """years() of a query, which fails where there are more than `most`."""
    return F.when(F.size(years(c)) > most, F.raise_error(F.lit(f"more than {most} years"))).otherwise(years(c))


def cut_utf8(c: Column, most: int) -> Column:
    """The longest beginning of at most `most` UTF-8 bytes that ends with a whole sign."""
    raw = c.cast("binary")
    cuts = [F.substring(raw, 1, most - back) for back in range(min(4, most))]
    out = cuts[-1].cast("string")
    for x in reversed(cuts[:-1]):
        out = F.when(F.is_valid_utf8(x.cast("string")), x.cast("string")).otherwise(out)
    return out


def escape_xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def quote_xml(c: Column) -> Column:
    """An attribute's value in quotes: double ones, or single ones where the value has double ones only."""
    safe = F.replace(F.replace(F.replace(escape_xml(c), F.lit("\n"), F.lit("&#10;")), F.lit("\r"), F.lit("&#13;")), F.lit("\t"), F.lit("&#9;"))
    double, single = F.contains(safe, F.lit('"')), F.contains(safe, F.lit("'"))
    whole = F.when(double & single, F.replace(safe, F.lit('"'), F.lit("&quot;"))).otherwise(safe)
    mark = F.when(double & ~single, F.lit("'")).otherwise(F.lit('"'))
    return F.concat(mark, whole, mark)


#: Sentences and characters in all of an extractive summary by style.
STYLES = {"brief": (3, 700), "bullet_points": (6, 1_400), "detailed": (10, 2_400)}


#: Signs of a slice and of a sentence, sentences looked at, and what stands for a text without words.
SLICE, SENTENCE, SENTENCES, NO_TEXT = 320, 500, 64, "This document does not contain extractable text."


def extractive_summary(c: Column, style: str) -> Column:
    """The first sentences within the style's bounds, each of 500 signs at most; a text of one sentence in slices of 320 signs."""
    count, signs = STYLES[style]
    text = compact(F.coalesce(c, F.lit("")))
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")
    starts = F.sequence(F.lit(1), F.greatest(F.least(F.length(text), F.lit(signs)), F.lit(1)), F.lit(SLICE))
    parts = F.when(F.size(parts) == 1, F.transform(starts, lambda i: F.trim(F.substring(text, i, F.lit(SLICE))))).otherwise(parts)
    bounded = F.filter(F.transform(F.slice(parts, 1, SENTENCES), lambda s: F.rtrim(F.substring(s, 1, SENTENCE))), lambda s: s != "")

    def step(state: Column, s: Column) -> Column:
        over = state["full"] | (F.size(state["kept"]) >= count) | ((F.size(state["kept"]) > 0) & (state["used"] + F.length(s) > signs))
        return F.struct(F.when(over, state["kept"]).otherwise(F.array_append(state["kept"], s)).alias("kept"), F.when(over, state["used"]).otherwise(state["used"] + F.length(s)).alias("used"), over.alias("full"))

    zero = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))
    kept = F.aggregate(bounded, zero, step, lambda s: s["kept"])
    shown = F.array_join(F.transform(kept, lambda s: F.concat(F.lit("• "), s)), "\n") if style == "bullet_points" else F.array_join(kept, " ")
    return F.when(text == "", F.lit(NO_TEXT)).otherwise(shown)


#: What stands between sentences, and between paragraphs.
SENTENCE_GAP, PARAGRAPH_GAP = r"(?<=[.!?])(?U:\s+)", r"\n[ \t]*\n+"


def spans_between(c: Column, gap: str) -> Column:
    """Array of (start, end): the code-point spans between a text's gaps, without white space at their ends, none empty."""
    pieces = F.zip_with(F.split(c, gap), F.regexp_extract_all(c, F.lit(f"({gap})"), F.lit(1)), lambda p, g: F.struct(p.alias("p"), F.coalesce(F.length(g), F.lit(0)).alias("g")))

    def step(state: Column, x: Column) -> Column:
        p, at = x["p"], state["at"]
        n = F.length(p)
        start = at + n - F.length(F.regexp_replace(p, r"(?U)^\s+", ""))
        end = at + F.length(F.regexp_replace(p, r"(?U)\s+$", ""))
        return F.struct((at + n + x["g"]).alias("at"), F.array_append(state["spans"], F.struct(start.alias("start"), end.alias("end"))).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))
    return F.filter(F.aggregate(pieces, zero, step, lambda s: s["spans"]), lambda s: s["start"] < s["end"])


def summary(c: Column, most: int = 900) -> Column:
    """A beginning of at most `most` signs that ends with a whole word, and a mark where it was cut."""
    text = compact(c)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most), r"\s\S*$", ""), F.lit("…")))


def tags(c: Column, most: int = 20) -> Column:
    """Tags without blanks around them, lower-cased, each once, in order."""
    return F.slice(F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: (x != "") & (F.length(x) <= 64))), 1, most)


def title_form(c: Column) -> Column:
    """Lower case, single blanks, none before a punctuation sign."""
    return F.regexp_replace(compact(F.lower(c)), r"\s+([,.;:!?])", "$1")


def reminder(said: Column, now: Column) -> Column:
    """A struct of due and error (one of them null) for `in N seconds|minutes|hours|days` or an ISO time with its zone: at most a second before now, and 366 days after it."""
    words = F.lower(F.trim(said))
    relative = r"^in\s+(\d{1,6})\s*(second|minute|hour|day)s?$"
    n, kind, zero = F.regexp_extract(words, relative, 1), F.regexp_extract(words, relative, 2), F.lit(0)
    count = F.when(n != "", n.cast("int")).otherwise(zero)
    step = F.make_dt_interval(F.when(kind == "day", count).otherwise(zero), F.when(kind == "hour", count).otherwise(zero), F.when(kind == "minute", count).otherwise(zero), F.when(kind == "second", count).otherwise(zero))
    zoned = F.when(F.trim(said).rlike(r"(Z|[+-]\d{2}:\d{2})$"), F.to_timestamp_ntz(F.to_utc_timestamp(F.try_to_timestamp(F.trim(said)), F.current_timezone())))
    due = F.when(n != "", now + step).otherwise(zoned)
    error = F.when(due.isNull(), "not a time").when(due < now - F.expr("INTERVAL 1 SECOND"), "past").when(due > now + F.expr("INTERVAL 366 DAY"), "too far")
    return F.struct(F.when(error.isNull(), due).alias("due"), error.alias("error"))


def parser_kind(name: Column, mime: Column) -> Column:
    """The parser for a file: its extension decides, then its type; null where there is none."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    by_ext = F.when(ext.isin("txt", "text", "log", "json", "yaml", "yml"), "text").when(ext.isin("md", "markdown"), "markdown").when(ext == "pdf", "pdf").when(ext == "docx", "docx")
    by_mime = F.when(mime == "text/markdown", "markdown").when(mime.startswith("text/"), "text").when(mime == "application/pdf", "pdf")
    return F.when(ext != "", by_ext).otherwise(by_mime)


def sensitive(c: Column) -> Column:
    """Kinds of sensitive numbers in a text."""
    return F.array_compact(F.array(F.when(c.rlike(r"\b\d{3}-\d{2}-\d{4}\b"), F.lit("ssn")), F.when(c.rlike(r"\b(?:\d[ -]?){12,18}\d\b"), F.lit("card"))))


def same_origin(c: Column) -> Column:
    """A path on the own host: one slash first, 500 signs at most."""
    return c.rlike(r"^/(?!/)") & (F.length(c) <= 500)
