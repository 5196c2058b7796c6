"""Registered queries of this subpackage: name -> (callable, SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from basalt.llm import clustering, factorization, lattice, mixing, neighbours, packing, sharding, simhash, site_style, spotsigs, term_scan, token_files, topk

#: Shares of all tokens that op6 aims at.
MIX_TARGETS = {"high": 0.90, "low": 0.08, "toxic": 0.02}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_table(_table(spark, sf_dir, "embeddings"))


def op1_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorization.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_and_edit(_table(spark, sf_dir, "documents"))


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _table(spark, sf_dir, "labels").select("doc_id", mixing.label_domain().alias("domain"))
    mixed, _ = mixing.mix(_table(spark, sf_dir, "documents"), labelled, MIX_TARGETS, ["doc_id"])
    return mixed.select("doc_id", "n_tokens", *[mixed.posterior[k].alias(f"p_{k}") for k in sorted(MIX_TARGETS)], "rate", "copies")


def op11_term_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_scan.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(clustering.kept(_table(spark, sf_dir, "embeddings")))


def op13_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_machine": op1_quality_machine,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_sharding": op3_sharding,
    "op4_spotsigs": op4_spotsigs,
    "op5_token_files": op5_token_files,
    "op6_soft_mixing": op6_soft_mixing,
    "op7_toxicity_neighbours": op7_toxicity_neighbours,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_subword_lattice": op10_subword_lattice,
    "op11_term_scan": op11_term_scan,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_site_style_tree": op13_site_style_tree,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op11_term_scan": term_scan.ORACLE_SQL,
    "op12_centroid_clustering": clustering.oracle_sql(),
    "op9_exact_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
    """,
}
