"""Bitemporal versions: authority, windows and as-of picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.operators.paging import latest


def authority(kind: str, source: str = "source_time", recorded: str = "recorded_at") -> Column:
    """The time that decides: `effective` takes the source's where it is known; `source` drops rows without one."""
    if kind not in ("effective", "source", "recorded"):
        raise ValueError(f"unknown temporal authority: {kind}")
    return {"effective": F.coalesce(source, recorded), "source": F.col(source), "recorded": F.col(recorded)}[kind]


def temporal_filter(time: Column, years: list[int] | None = None, year_range: tuple[int | None, int | None] | None = None, window: tuple[str | None, str | None] | None = None) -> Column:
    """Exact years, whole-year bounds or a half-open window; one of them at most."""
    given = [x for x in (years, year_range, window) if x]
    if len(given) > 1:
        raise ValueError("give years, a range of years or a window, not several")
    if years:
        if len(years) > 10 or any(not 1000 <= y <= 2999 for y in years):
            raise ValueError("at most ten years from 1000 to 2999")
        # Half-open ranges, which reach a Parquet scan; the year of a column doesn't.
        out = F.lit(False)
        for y in sorted(set(years)):
            out = out | (time >= F.to_timestamp_ntz(F.lit(f"{y}-01-01"))) & (time < F.to_timestamp_ntz(F.lit(f"{y + 1}-01-01")))
        return out
    low, high = (None, None)
    if year_range:
        a, b = year_range
        low, high = (f"{a}-01-01" if a else None), (f"{b + 1}-01-01" if b else None)
    elif window:
        low, high = window
        if low and high and low >= high:
            raise ValueError("a window must begin before it ends")
    out = F.lit(True)
    if low:
        out = out & (time >= F.to_timestamp_ntz(F.lit(low)))
    if high:
        out = out & (time < F.to_timestamp_ntz(F.lit(high)))
    return out


def as_of(versions: DataFrame, key: str, time: Column, cutoff: str, number: str, tie: str) -> DataFrame:
    """Each key's last version strictly before the cutoff; ties by version number, then id, both descending."""
    held = versions.withColumn("_t", time).where(F.col("_t") < F.to_timestamp_ntz(F.lit(cutoff)))
    return latest(held, [key], [F.desc("_t"), F.desc(number), F.desc(tie)]).drop("_t")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """left with the value of right's last row of the same key strictly before left_time: one sort of both sides together, no pairs."""
    from pyspark.sql import Window

    names = left.columns
    a = left.withColumn("_t", F.col(left_time)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(0))
    b = right.select(F.col(key), F.col(right_time).alias("_t"), F.col(value).alias("_v"), F.lit(1).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(f"asof_{value}", F.last("_v", ignorenulls=True).over(w)).where("_side = 0").select(*names, f"asof_{value}")


def scoped(df: DataFrame, column: str, identity: str | None) -> DataFrame:
    """The rows of one identity; a session without one sees none."""
    return df.where(F.col(column) == F.lit(identity) if identity else F.lit(False))
