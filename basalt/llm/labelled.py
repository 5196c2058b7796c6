"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import crc_mod, materialize


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int, most_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, label): at most `rows` labelled documents, those of smallest id hash, without the held-out ones.

    A doc_id that is labelled more than once takes its highest label; null ids and labels are left out.
    Of several rows with one doc_id the first text in order counts.
    The sample of ids is bounded by `rows`, so it is sent to all tasks and the texts are not shuffled. With most_bytes, whole texts
    are taken in the order of the id hash as long as they fit together; those of over a sixteenth of it are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_mod(F.col("doc_id"), modulus) != held_out))
    chosen = known.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    if most_bytes is None:
        return sample
    sample = materialize(sample.where(F.octet_length("text") <= most_bytes // 16), "labelled")
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # `rows` rows at most
    fitting = sample.select("doc_id", so_far.alias("bytes")).where(F.col("bytes") <= most_bytes).select("doc_id")
    return sample.join(F.broadcast(fitting), "doc_id", "left_semi")
