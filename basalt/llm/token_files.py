"""Token ids on disk: one Zstandard frame a document, a dictionary shared by all frames, and an offset index.

Layout under one path:
  dictionary  sha256, dictionary (one row)
  blocks      part, block, sha256, documents, tokens, payload (the frames of a block on end), index
              (an array of doc_id, place, offset, length, n_tokens, before: the tokens of the block's earlier documents)
Parts are ranges of (doc_id, text hash) in order, blocks follow each other within a part. A reader of one document
needs its index entry, its block's payload and the dictionary.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.llm.common import ship, slices, text_bytes, work_path

#: Text bytes of a part, frame bytes of a block.
PART_BYTES, BLOCK_BYTES = 16_000_000, 4_000_000
#: The dictionary's sample: documents, the UTF-8 bytes of their texts together, and the dictionary's size.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2_000, 8_000_000, 65_536
LEVEL = 3


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """A dictionary from the id arrays of whole documents: of the sample_docs texts of smallest hash those that fit in sample_bytes together, in that order.

    The sample only bears on how small the frames get. Empty where there are too few documents.
    """
    import zstandard

    from basalt.llm.encoding import Encoder

    keyed = docs.where("text is not null").select("text", F.xxhash64("text").alias("h"))
    sizes = keyed.groupBy("h").agg(F.max(F.octet_length("text").cast("long")).alias("n")).orderBy("h").limit(sample_docs).collect()
    wanted, held = [], 0
    for r in sizes:
        if held + r["n"] <= sample_bytes:
            wanted.append(r["h"])
            held += r["n"]
    some = docs.sparkSession.createDataFrame([(h,) for h in wanted], "h long")
    rows = keyed.join(F.broadcast(some), "h").groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect() if wanted else []
    texts = pa.record_batch([pa.array([r["text"] for r in rows], pa.string())], ["text"])
    ids = [np.append(x, end_id).astype("<u4").tobytes() for part in slices(texts, "text", 250_000) for x in Encoder.of(tokenizer).encode(part.column(0))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, ids).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True), zstandard.ZstdDecompressor(dict_data=shared)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, part_bytes: int = PART_BYTES, block_bytes: int = BLOCK_BYTES) -> str:
    """Encodes every whole text (null: empty), appends end_id, and writes the files in ascending doc_id order (nulls first; rows of one doc_id by their text's hash).

    One shuffle by ranges of (doc_id, text hash), so one id, or null, in many rows is many tasks' work. A task encodes its
    sorted part and lays out a block whenever block_bytes of frames are ready; it holds no more than that. Extra columns are
    left out. An empty table gives empty blocks.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dictionary = train_dictionary(docs, tokenizer, end_id)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most
    entry = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("place int, offset long, length long, n_tokens long, before long")])
    schema = T.StructType([*T.StructType.fromDDL("part int, block int, sha256 string, documents int, tokens long, payload binary"), T.StructField("index", T.ArrayType(entry))])

    def lay_out(batches):
        from basalt.llm.encoding import Encoder

        encoder, (compress, _) = Encoder.of(tokenizer), _codec(shared.value)
        part, block, frames, index, offset, tokens = None, 0, [], [], 0, 0

        def done():
            row = {"part": part, "block": block, "sha256": name, "documents": len(index), "tokens": tokens, "payload": b"".join(frames), "index": index}
            return pa.RecordBatch.from_pylist([row], arrow_schema)

        for batch in batches:
            arrow_schema = _layout(batch.schema.field(0).type)
            for some in slices(batch, "text"):
                part = some.column(2)[0].as_py()
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1)), strict=True):
                    frame = compress.compress(np.append(ids, end_id).astype("<u4").tobytes())
                    index.append({"doc_id": doc_id, "place": len(index), "offset": offset, "length": len(frame), "n_tokens": len(ids) + 1, "before": tokens})
                    frames.append(frame)
                    offset, tokens = offset + len(frame), tokens + len(ids) + 1
                    if offset >= block_bytes:
                        yield done()
                        block, frames, index, offset, tokens = block + 1, [], [], 0, 0
        if index:
            yield done()

    parts = max(1, -(-text_bytes(docs) // part_bytes))
    keyed = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    keyed.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(lay_out, schema).write.parquet(f"{path}/blocks")
    return path


def _layout(id_type: pa.DataType) -> pa.Schema:
    entry = pa.struct([("doc_id", id_type), ("place", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64())])
    return pa.schema([("part", pa.int32()), ("block", pa.int32()), ("sha256", pa.string()), ("documents", pa.int32()), ("tokens", pa.int64()), ("payload", pa.binary()), ("index", pa.list_(entry))])


def _bases(blocks: DataFrame) -> DataFrame:
    """(part, block, base): the tokens of all blocks before. The one window over everything has a row a part."""
    rows = blocks.select("part", "block", "tokens")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("p"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("w", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(parts, "part").select("part", "block", (F.col("p") + F.col("w")).alias("base"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """part, block, doc_id, place, offset, length, n_tokens, start (ids of all documents before it)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    rows = blocks.select("part", "block", F.explode("index").alias("e")).join(_bases(blocks), ["part", "block"])
    return rows.select("part", "block", "e.*", (F.col("base") + F.col("e.before")).alias("start")).drop("before")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit integers) of every document, from the files alone. Without with_ids, ids is left out."""
    ship(spark)
    stored = spark.read.parquet(f"{path}/dictionary").first()
    shared = spark.sparkContext.broadcast((stored["sha256"], bytes(stored["dictionary"])))
    blocks = spark.read.parquet(f"{path}/blocks")
    id_field = blocks.schema["index"].dataType.elementType["doc_id"]

    def decode(batches):
        name, dictionary = shared.value
        assert hashlib.sha256(dictionary).hexdigest() == name, "another dictionary than the files were written with"
        _, expand = _codec(dictionary)
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                assert row["sha256"] == name, "another dictionary than the block was written with"
                for at in range(0, len(row["index"]), 256):
                    some = row["index"][at : at + 256]
                    got = [expand.decompress(row["payload"][e["offset"] : e["offset"] + e["length"]]) for e in some]
                    ids = pa.array([e["doc_id"] for e in some], batch.schema.field("index").type.value_type.field("doc_id").type)
                    columns = [pa.array([row[k]] * len(some), pa.int32()) for k in ("part", "block")]
                    starts = pa.array([e["before"] for e in some], pa.int64())
                    yield pa.record_batch([*columns, ids, starts, pa.array([len(x) // 4 for x in got], pa.int64()), pa.array([zlib.crc32(x) for x in got], pa.int64()), pa.array(got if with_ids else [None] * len(got), pa.binary())], ["part", "block", "doc_id", "before", "n_tokens", "ids_crc32", "ids"])

    schema = T.StructType([*T.StructType.fromDDL("part int, block int"), id_field, *T.StructType.fromDDL("before long, n_tokens long, ids_crc32 long, ids binary")])
    rows = blocks.select("part", "block", "sha256", "payload", "index").mapInArrow(decode, schema)
    if not with_ids:
        rows = rows.drop("ids")
    return rows.join(_bases(blocks), ["part", "block"]).withColumn("start", F.col("base") + F.col("before")).drop("part", "block", "before", "base")


def token_file_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the files in the shared folder and returns what they hold."""
    path = write_token_files(docs, work_path(docs.sparkSession, "tokens"), tokenizer)
    return read_token_files(docs.sparkSession, path, with_ids=False)
