"""Tables written between steps: lineage is cut by files that outlive a lost executor."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side that is sent to all tasks at most.
SENT_BYTES = 32_000_000
#: Rows of a partition at most and, while there are fewer partitions than cores, at least.
DEALT_ROWS, LEAST_ROWS = 250_000, 20_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs in one local process, a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if base:
        return base.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="basalt-shared-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/basalt-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent_if_small(df: DataFrame, row_bytes: int = 64, most: int = SENT_BYTES) -> DataFrame:
    """df, marked to be sent to all tasks if its rows, counted, fit in `most` bytes; otherwise as it is, for Spark to shuffle. Give it a written table: it is counted."""
    return F.broadcast(df) if df.limit(most // row_bytes + 1).count() * row_bytes <= most else df


def dealt(rows: DataFrame, *keys: str, most: int = DEALT_ROWS) -> DataFrame:
    """rows by their keys over as many partitions as keep each at about `most` rows, so that a task's memory doesn't grow with the table. Give it a table or a written one: it is counted."""
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, -(-n // most), min(cores, -(-n // LEAST_ROWS))), *keys)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per context; functions that workers call by name need it there."""
    sc = spark.sparkContext
    if getattr(sc, "_basalt_sent", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="basalt-sent-")) / "basalt_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(os.fspath(target))
    sc._basalt_sent = True
