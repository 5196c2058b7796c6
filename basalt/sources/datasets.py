"""Datasets on disk: tables written once, chunks appended under one profile, and manifests of an evaluation set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version int, documents array<struct<id: string, path: string, sha256: string>>, queries array<struct<id: string, text: string, evidence: array<struct<document: string, quote: string, start: int>>>>"


def table_digest(df: DataFrame) -> tuple[int, int, int]:
    """(rows, sums of two hashes of each row): the same for the same rows in any order, with partial results combined. Equal rows add up and don't cancel."""
    names = sorted(df.columns)
    sums = [F.sum(F.xxhash64(F.lit(seed), *names).cast("decimal(20,0)")).alias(f"s{seed}") for seed in (1, 2)]
    got = df.agg(F.count("*").alias("n"), *sums).first()
    return got["n"], int(got["s1"] or 0), int(got["s2"] or 0)


def create_once(df: DataFrame, path: str) -> DataFrame:
    """Writes df at the path if nothing is there; adopts what is there if it is the same rows, and fails otherwise. Returns the table, read back and checked."""
    spark = df.sparkSession
    wanted = table_digest(df)
    try:
        df.write.mode("errorifexists").parquet(path)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    stored = spark.read.schema(df.schema).parquet(path)
    if table_digest(stored) != wanted:
        raise ValueError(f"another table is at {path}")
    return stored


def append_chunks(chunks: DataFrame, path: str, profile: str) -> None:
    """Appends chunks to a table that is pinned to one embedding profile; a table of another profile is refused."""
    spark = chunks.sparkSession
    try:
        other = spark.read.parquet(path).where(F.col("profile") != profile).limit(1).count()
    except Exception as e:  # the table begins with its first chunks
        if "PATH_NOT_FOUND" not in str(e):
            raise
        other = 0
    if other:
        raise ValueError("the table has another profile")
    chunks.withColumn("profile", F.lit(profile)).write.mode("append").parquet(path)


def load_manifest(spark: SparkSession, folder: str, name: str = "manifest.json") -> dict[str, DataFrame]:
    """documents (id, path, text), queries (query, text), evidence (query, document, quote, start) of a manifest, and violations (item, violation).

    Violations: a version that isn't known, a path that leaves the folder, a text that is missing or whose SHA-256 differs, evidence of an
    unknown document, and a quote that isn't at its place.
    """
    raw = spark.read.schema(MANIFEST).option("multiLine", True).json(f"{folder}/{name}")
    listed = raw.select(F.explode("documents").alias("d")).select("d.*")
    escapes = F.col("path").startswith("/") | F.col("path").contains("..")
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_file"))
    keyed = files.withColumn("path", F.regexp_replace(F.substring_index("_file", folder.rstrip("/") + "/", -1), "^/", ""))
    documents = listed.join(keyed.drop("_file"), "path", "left")
    queries = raw.select(F.explode("queries").alias("q"))
    evidence = queries.select(F.col("q.id").alias("query"), F.explode("q.evidence").alias("e")).select("query", "e.*")
    placed = evidence.join(documents.select(F.col("id").alias("document"), "text"), "document", "left")
    at = F.expr("substring(text, start + 1, length(quote))")
    faults = [
        raw.where("version IS NULL OR version NOT IN (1, 2)").select(F.lit("manifest").alias("item"), F.lit("version").alias("violation")),
        documents.where(escapes).select(F.col("id").alias("item"), F.lit("path").alias("violation")),
        documents.where(~escapes & F.col("text").isNull()).select(F.col("id").alias("item"), F.lit("missing").alias("violation")),
        documents.where(F.sha2(F.col("text").cast("binary"), 256) != F.col("sha256")).select(F.col("id").alias("item"), F.lit("sha256").alias("violation")),
        placed.join(listed.select(F.col("id").alias("document")), "document", "left_anti").select(F.col("query").alias("item"), F.lit("unknown document").alias("violation")),
        placed.where(at != F.col("quote")).select(F.col("query").alias("item"), F.lit("quote").alias("violation")),
    ]
    violations = faults[0]
    for f in faults[1:]:
        violations = violations.unionByName(f)
    return {"documents": documents.select("id", "path", "text"), "queries": queries.select(F.col("q.id").alias("query"), F.col("q.text").alias("text")), "evidence": evidence, "violations": violations}
