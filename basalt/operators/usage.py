"""Usage analytics over a run log: counts, percentiles, daily series, budgets and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.operators.percentiles import exact_percentiles


def since(df: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last `days` UTC days up to and with the day as_of."""
    end = F.to_timestamp_ntz(F.lit(as_of)) + F.expr("INTERVAL 1 DAY")
    return df.where((F.col(column) >= end - F.expr(f"INTERVAL {days} DAY")) & (F.col(column) < end))


def overview(runs: DataFrame, done: Column) -> DataFrame:
    return runs.agg(
        F.count("*").alias("queries"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("tokens"),
        F.round(F.avg(F.when(done, F.col("latency"))), 6).alias("avg_latency"),
        F.count(F.when(~done, 1)).alias("failed"),
    )


def percentiles(runs: DataFrame, column: str, done: Column, points: dict[str, float]) -> DataFrame:
    """Interpolated percentiles of the column over the rows that `done` holds for, by refining histograms."""
    found = exact_percentiles(runs.where(done), [], column, points)
    return found.select(*[F.round(k, 6).alias(k) for k in points])


def daily_series(runs: DataFrame, as_of: str, days: int) -> DataFrame:
    """day, queries, tokens on each of the last `days` days; days without runs have zeros."""
    spark = runs.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.to_date(F.lit(as_of)), days - 1), F.to_date(F.lit(as_of)))).alias("day"))
    daily = since(runs, "created_at", as_of, days).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("queries"), F.sum("total_tokens").cast("long").alias("tokens"))
    return calendar.join(daily, "day", "left").select("day", F.coalesce("queries", F.lit(0)).alias("queries"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def change_percent(now: Column, before: Column) -> Column:
    """Null, not zero, where there was nothing before."""
    return F.when(before > 0, F.round((now - before) * 100.0 / before, 1))


def token_budget(runs: DataFrame, key: str, allocation: int) -> DataFrame:
    """used, reserved and remaining tokens by key: a running run counts with the larger of its total and its reservation."""
    running = F.col("status") == "running"
    held = F.when(running, F.greatest("total_tokens", "reserved_tokens")).otherwise(F.col("total_tokens"))
    used = F.sum(F.when(running, 0).otherwise(F.col("total_tokens"))).cast("long")
    spent = F.sum(held).cast("long")
    return runs.groupBy(key).agg(used.alias("used"), (spent - used).alias("reserved"), F.greatest(F.lit(0), F.lit(allocation) - spent).cast("long").alias("remaining"))


def reservation(allocation: Column, reserve: int = 10_000) -> Column:
    return F.least(allocation, F.lit(reserve), F.greatest(F.lit(1000), F.floor(allocation / 10)))


def queue_depths(queue: DataFrame, name: str, order: list[str], age: Column, cap: int = 10_000) -> DataFrame:
    """depth (at most cap), over_cap and the largest age for each queue, from its first cap + 1 rows."""
    from pyspark.sql import Window

    first = queue.withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy(*order))).where(F.col("_r") <= cap + 1)
    return first.groupBy(name).agg(F.least(F.count("*"), F.lit(cap)).alias("depth"), (F.count("*") > cap).alias("over_cap"), F.max(age).alias("max_age"))
