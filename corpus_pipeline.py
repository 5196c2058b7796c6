"""The training-data pipeline: five stages, each on all that the one before kept.

Every stage takes null and empty texts (null counts as empty), null ids, repeated rows, columns of any further names, and an empty table,
which gives no rows. The filters score a repeated row each time; the near-duplicate stage keeps one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from basalt.llm import factorization, mixing, near_copies, neighbours, packing
from basalt.llm.common import materialize

QUALITY, TOXIC = 0.3, 0.7
#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5
#: Shares of tokens for each language, the domain here: the filters before leave too little of the labels' classes. About 0.61, 0.15, 0.15
#: and 0.09 come in, so English is taken less than once on average and Spanish more.
TARGETS = {"en": 0.54, "de": 0.16, "fr": 0.16, "es": 0.14}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score is at least QUALITY."""
    return factorization.keep_from(docs, factorization.train(docs, _labels(spark, sf_dir)), QUALITY)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity score is below TOXIC."""
    return neighbours.keep_below(docs, neighbours.train(docs, _labels(spark, sf_dir)), TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts whose SimHash fingerprints of five-word shingles agree in near_copies.AGREE of the bits, directly or through others."""
    return near_copies.keep_one(docs, SHINGLE)


def mixing_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its rate says. The classifier learns languages from the labelled documents."""
    labelled = docs.select("doc_id", docs.lang.alias("domain")).join(_labels(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_semi")
    return mixing.sample(docs, labelled, TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("toxicity", toxicity), ("SimHash near-dedup", near_duplicates), ("mixing sources to target weights", mixing_rates), ("best-fit packing", pack)]
#: SQL can't express a trained classifier, tokens or packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return docs
