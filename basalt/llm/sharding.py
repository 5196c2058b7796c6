"""Sharding by a two-pass external shuffle, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.llm.common import work_path

#: Text bytes in a bucket: what one task shuffles in memory. Tasks of a pass at most.
BUCKET_BYTES, TASKS = 8_000_000, 100_000
SEED = 20_260_101


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash of the id is highest. One more shard can only win rows for itself."""
    return F.array_max(F.array(*[F.struct(F.xxhash64(doc_id, F.lit(seed), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]))["s"]


def shard_documents(docs: DataFrame, path: str, shards: int = 16, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Writes docs to `path` as `shards` shards in random order and returns what was written, see read_shards().

    Law `key`: doc_id and the shard count decide the shard. Pass one scatters the records
    into seeded-hash buckets that fit in memory, some for each shard; pass two shuffles each
    bucket (shuffle() draws a Fisher-Yates permutation) and writes it. A bucket's hash takes a row's number too, so equal
    rows part as well. A task takes its buckets one after another and holds one. A null
    id or text counts as a value of its own; columns other than doc_id and text are left out.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"))
    placed = docs.withColumn("shard", shard_of(F.col("doc_id"), shards, seed))
    # A shard that a frequent id makes large has as many more buckets.
    held = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    each = [max(1, -(-held.get(s, 0) // bucket_bytes)) for s in range(shards)]
    bases = [sum(each[:s]) for s in range(shards)]
    own = lambda numbers: F.get(F.array(*map(F.lit, numbers)), F.col("shard"))
    scattered = F.xxhash64("doc_id", "text", F.monotonically_increasing_id(), F.lit(seed + 1))
    keyed = placed.withColumn("h", scattered)
    keyed = keyed.withColumn("bucket", (own(bases) + F.pmod("h", own(each))).cast("int"))
    n = max(sum(each), int(spark.conf.get("spark.sql.shuffle.partitions")))
    record = F.struct(F.xxhash64("h", F.lit(seed + 2)).alias("h"), "doc_id", "size", "text")
    # In a fixed order before the seeded draw, so a task that runs again writes the same rows.
    ordered = keyed.repartition(min(n, TASKS), "bucket").sortWithinPartitions("bucket", "shard")
    gathered = ordered.groupBy("bucket", "shard").agg(F.sort_array(F.collect_list(record)).alias("records"))
    drawn = gathered.select("shard", "bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("place", "r"))
    rows = drawn.select("r.doc_id", "r.text", "r.size", "bucket", "place", "shard")
    # Aggregation over sorted rows holds one bucket at a time; the default, by hash, would hold all of a task's.
    name = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        rows.write.partitionBy("shard").parquet(path)
    finally:
        spark.conf.set(name, before)
    return read_shards(spark, path, rows.schema)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The written records with their slot: the place in the bucket after the rows of the shard's earlier buckets, so without a gap."""
    written = spark.read.schema(schema).parquet(path)
    counts = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return written.join(bases, "bucket").withColumn("slot", (F.col("base") + F.col("place")).cast("long")).drop("base", "place")


def shard_digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The written records without their texts, and the shard each takes when there is one more."""
    written = shard_documents(docs, work_path(docs.sparkSession, "shards"), shards)
    return written.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"), "bucket")
