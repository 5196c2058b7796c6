"""Shared folders, package shipping, ordered blocks and bounded Arrow slices."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python step holds in numpy form at once.
SLICE_BYTES = 1_000_000
#: Rows of an Arrow batch.
ARROW_ROWS = 1_000
#: Rows of one key that a task takes before join_hot deals the key out, and keys dealt out at most.
HOT_ROWS, HOT_KEYS = 1_000, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where it is unset and Spark runs in one local process (tests), a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if base:
        return base
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="basalt-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/basalt-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: it cuts lineage and survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined on key with right, which has one row a key at most; a key with many rows in left is dealt over tasks.

    A key with more than HOT_ROWS rows has a part for each, its rows take turns, and right's row goes to all the parts. Those keys are HOT_KEYS at most (the limit grows with left), so their list is sent to all tasks.
    left is read twice and its rows are numbered: give it a written table.
    """
    limit = max(HOT_ROWS, left.count() // HOT_KEYS)
    hot = F.broadcast(left.groupBy(key).agg(F.ceil(F.count("*") / limit).cast("int").alias("_parts")).where("_parts > 1"))
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("_parts"))).cast("int")
    parts = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
    one = left.join(hot, key, "left").withColumn("_part", part).drop("_parts")
    other = right.join(hot, key, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    return one.join(other, [key, "_part"], how).drop("_part")


def numbered(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ... in place of its own, so that no name of a caller clashes with an operator's."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def with_read_texts(docs: DataFrame, added: str, read) -> DataFrame:
    """docs and, after its own columns, those of the DDL schema `added`; read(texts) gives their Arrow arrays for a slice of whole texts.

    Columns of any names and types pass through unread, those that share a name with an added one too.
    """
    at, more = docs.columns.index("text"), T.StructType.fromDDL(added)
    types = [f.dataType for f in (*docs.schema, *more)]
    names = [f"c{i}" for i in range(len(types))]

    def run(batches):
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                yield pa.RecordBatch.from_arrays([*part.columns, *read(part.column(at))], names)

    made = T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)])
    return numbered(docs).mapInArrow(run, made).toDF(*docs.columns, *more.names)


def kept_where(wide: DataFrame, columns: int, condition) -> DataFrame:
    """The first `columns` columns of those rows that condition(last columns) holds for; names may clash."""
    rows = numbered(wide)
    return rows.where(condition(*[F.col(c) for c in rows.columns[columns:]])).select(*rows.columns[:columns]).toDF(*wide.columns[:columns])


def sorted_keys(batches, rows: int = 200_000):
    """Columns of Arrow batches sorted by their first column, as numpy, in runs of whole keys of about `rows` rows."""
    held: list[pa.RecordBatch] = []
    count = 0

    def columns(table):
        return [c.combine_chunks() for c in table.columns]

    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count >= rows:
            table = pa.Table.from_batches(held)
            key = table.column(0).combine_chunks().to_numpy(zero_copy_only=False)
            cut = int(key.searchsorted(key[-1]))
            if cut:
                yield columns(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            count = table.num_rows - cut
            rows = max(rows, 2 * count)
    if count:
        yield columns(pa.Table.from_batches(held))


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per context, and keeps their batches small."""
    # Small Arrow batches: a worker holds one, and texts may be long.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    sc = spark.sparkContext
    if getattr(sc, "_basalt_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="basalt-ship-")) / "basalt.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(os.fspath(target))
    sc._basalt_shipped = True


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty string."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus).cast("int")


def block_of(key: Column, bounds: list) -> Column:
    """The number of bounds at or below the key: ranges in key order, nulls first. Two levels keep the search short."""

    def below(cut: list) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cut)), lambda b: b <= key))

    if not bounds:
        return F.lit(0)
    if len(bounds) <= 64:
        return F.when(key.isNull(), 0).otherwise(below(bounds))
    step = int(len(bounds) ** 0.5) + 1
    heads = bounds[::step]
    groups = F.array(*[F.array(*map(F.lit, bounds[i : i + step])) for i in range(0, len(bounds), step)])
    head = below(heads)
    inner = F.size(F.filter(F.get(groups, head - 1), lambda b: b <= key))
    return F.when(key.isNull() | (head == 0), 0).otherwise((head - 1) * step + inner)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """The batch in runs of rows with about `limit` bytes in one column, so numpy temporaries stay bounded."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)
