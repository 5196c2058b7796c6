"""Files as sections with spans in one canonical text: plain text, Markdown, word-processor files and page text."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.MULTILINE)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SECTIONS = "struct<error: string, text: string, sections: array<struct<title: string, page: int, start_char: int, end_char: int>>>"


class Refused(ValueError):
    """A file that can't be parsed; its text says why."""


def decode(data: bytes) -> str:
    if b"\0" in data:
        raise Refused("binary content")
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        raise Refused("not UTF-8") from None
    if not text.strip():
        raise Refused("no text")
    return text


def plain(data: bytes) -> tuple[str, list]:
    text = decode(data)
    return text, [("Document Content", 1, 0, len(text))]


def markdown(data: bytes) -> tuple[str, list]:
    """A section for each heading with a body; text before the first is the preamble."""
    text = decode(data)
    marks = list(_HEADING.finditer(text))
    if not marks:
        return text, [("Main Content", 1, 0, len(text))]
    parts = [("Preamble", 0, marks[0].start())]
    parts += [(m[2].strip(), m.end(), n.start() if n else len(text)) for m, n in zip(marks, [*marks[1:], None], strict=True)]
    out = []
    for title, a, b in parts:
        body = text[a:b]
        if body.strip():
            out.append((title, 1, a + len(body) - len(body.lstrip()), a + len(body.rstrip())))
    return text, out


def pages(data: bytes) -> tuple[str, list]:
    """Page text, form feeds between pages."""
    text, at, out = decode(data), 0, []
    for i, page in enumerate(text.split("\f"), 1):
        if page.strip():
            out.append((f"Page {i}", i, at, at + len(page)))
        at += len(page) + 1
    return text, out


def pdf(data: bytes) -> tuple[str, list]:
    """No layout library is here: a PDF's text must be given page by page, as the kind `pages`."""
    raise Refused("page text needed" if data[:5] == b"%PDF-" else "not a PDF")


def docx(data: bytes) -> tuple[str, list]:
    """Paragraphs with blank lines between; heading styles begin sections."""
    if data[:2] != b"PK":
        raise Refused("not a word-processor file")
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        raise Refused("not a word-processor file") from None
    rows = []
    for p in root.iter(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        text = "".join(x.text or "" for x in p.iter(f"{_W}t")).strip()
        if text:
            rows.append((text, style is not None and style.get(f"{_W}val", "").startswith("Heading")))
    if not rows:
        raise Refused("no text")
    whole, at, title, open_at, last, out = "\n\n".join(t for t, _ in rows), 0, "Introduction", None, 0, []
    for text, heading in rows:
        if heading:
            if open_at is not None:
                out.append((title, 1, open_at, last))
            title, open_at = text, None
        elif open_at is None:
            open_at = at
        last = at + len(text)
        at = last + 2
    if open_at is not None:
        out.append((title, 1, open_at, last))
    return whole, out


def text_files(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, error, text) of plain files: binary content, content that isn't UTF-8 and blank content are refused. In DataFrame functions."""
    body = F.col(content).cast("binary")
    text = body.cast("string")
    error = (
        F.when(body.isNull(), "no text")
        .when(F.instr(text, "\0") > 0, "binary content")
        .when(~F.is_valid_utf8(text), "not UTF-8")
        .when(F.regexp_replace(text, r"(?U)\s+", "") == "", "no text")
    )
    return files.select(key, error.alias("error"), F.when(error.isNull(), text).alias("text"))


def text_sections(texts: DataFrame, key: str) -> DataFrame:
    """(key, section, title, page, start_char, end_char): one section for each text."""
    return texts.where("text IS NOT NULL").select(key, F.lit(0).alias("section"), F.lit("Document Content").alias("title"), F.lit(1).alias("page"), F.lit(0).alias("start_char"), F.length("text").alias("end_char"))


def markdown_sections(texts: DataFrame, key: str) -> DataFrame:
    """(key, section, title, page, start_char, end_char) of Markdown texts (key, text): a section for each heading with a body, its body without the white space around it.

    A heading is one to six # at the start of a line, white space and a title on the same line. Text before the first is the preamble; a text
    without headings is one section. In DataFrame functions: texts are split before their headings, and lengths added up by document.
    """
    head = r"(?md)\A#{1,6}[^\S\n]+(.+)$"
    pieces = texts.where("text IS NOT NULL").select(key, F.posexplode(F.split("text", r"(?md)(?=^#{1,6}[^\S\n]+.+$)")).alias("section", "piece"))
    before = F.sum(F.length("piece")).over(Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, -1))
    every = F.count("*").over(Window.partitionBy(key))
    marked = pieces.withColumn("at", F.coalesce(before, F.lit(0))).withColumn("headed", F.col("piece").rlike(head)).withColumn("only", (every == 1) & ~F.col("headed"))
    mark = F.regexp_extract("piece", head, 0)
    body = F.when(F.col("headed"), F.expr("substring(piece, length(mark) + 1)")).otherwise(F.col("piece"))
    cut = marked.withColumn("mark", mark).withColumn("body", body).withColumn("at", F.col("at") + F.when(F.col("headed"), F.length("mark")).otherwise(0))
    bare = F.regexp_replace("body", r"(?U)^\s+", "")
    start = F.col("at") + F.length("body") - F.length(bare)
    end = F.col("at") + F.length(F.regexp_replace("body", r"(?U)\s+$", ""))
    title = F.when(F.col("headed"), F.trim(F.regexp_extract("piece", head, 1))).when(F.col("only"), "Main Content").otherwise("Preamble")
    whole = F.col("only")
    kept = cut.where(whole | (bare != ""))
    return kept.select(
        key, "section", title.alias("title"), F.lit(1).alias("page"), F.when(whole, 0).otherwise(start).cast("int").alias("start_char"), F.when(whole, F.length("piece")).otherwise(end).cast("int").alias("end_char")
    )


PARSERS = {"text": plain, "markdown": markdown, "pdf": pdf, "pages": pages, "docx": docx}


def parse(files: DataFrame, content: str = "content", kind: str = "parser") -> DataFrame:
    """files with a column `parsed`: error (null if none), the canonical text, and its sections. An unknown kind is an error."""

    @F.pandas_udf(SECTIONS)
    def run(bodies: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        def one(body, name):
            if name not in PARSERS:
                return ("unsupported type", None, [])
            try:
                return (None, *PARSERS[name](bytes(body or b"")))
            except Refused as e:
                return (str(e), None, [])

        return pd.DataFrame([one(b, k) for b, k in zip(bodies, kinds, strict=True)], columns=["error", "text", "sections"])

    return files.withColumn("parsed", run(F.col(content).cast("binary"), F.col(kind)))
