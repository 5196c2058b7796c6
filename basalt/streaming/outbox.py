"""Event streams: windows, idempotent outboxes, rate limits and circuit breakers in Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema: str | None = None, files: int = 1) -> DataFrame:
    """Parquet events that arrive in a folder, event time with its zone so a watermark can hold."""
    kind = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str = "10 minutes", *keys: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sliding(events: DataFrame, size: str, step: str, late: str = "10 minutes", *keys: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))


def once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each idempotency key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def rate_limited(events: DataFrame, key: str, most: int, late: str = "10 minutes") -> DataFrame:
    """Requests of each key in fixed minutes, and whether they were too many."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", "60 seconds"), key).agg(F.count("*").alias("requests"))
    return counts.withColumn("limited", F.col("requests") > most)


def publish(stream: DataFrame, path: str, checkpoint: str, key: str, apply: Callable[[DataFrame, int], None] | None = None, buckets: int = 256):
    """Appends each batch's rows whose key the table lacks, so a batch that runs again adds nothing.

    The table is cut into buckets of the key's hash, and a batch reads those that its keys fall into, not the table. One
    query writes to a table at a time: between the look and the append nothing else may add the same keys.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        rows = df.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # buckets at most
        try:
            known = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(*touched)).select(key)
            rows = rows.join(known, key, "left_anti")
        except Exception as e:  # the table begins with its first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").partitionBy("bucket").parquet(path)
        if apply:
            apply(df, n)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def circuit_breaker(calls: DataFrame, key: str, failures: int = 5, within: float = 60.0, hold: float = 30.0) -> DataFrame:
    """(key, at, state) after each call (columns key, ts, ok): closed, or open after so many failures in `within` seconds. The first call
    `hold` seconds later is a trial: it gives a row half-open, then the state that it leaves."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed, opened = state.get if state.exists else ([], 0.0)
        failed = list(failed)
        rows = []
        for row in pd.concat(list(frames)).sort_values("ts").itertuples(index=False):
            at = row.ts.timestamp()
            trying = bool(opened) and at - opened >= hold
            if opened and not trying:
                rows.append((k[0], row.ts, "open"))
                continue
            if trying:
                rows.append((k[0], row.ts, "half-open"))
            if row.ok:
                failed, opened = [], 0.0
            else:
                failed = [x for x in failed if at - x < within] + [at]
                if trying or len(failed) >= failures:
                    opened = at
            rows.append((k[0], row.ts, "open" if opened else "closed"))
        state.update((failed, opened))
        yield pd.DataFrame(rows, columns=[key, "at", "state"])

    kind = calls.schema[key].dataType.simpleString()
    return calls.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at timestamp, state string", "failed array<double>, opened double", "append", GroupStateTimeout.NoTimeout)
