"""Latest rows, keyset pages and top rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column], rank: int = 1) -> DataFrame:
    """The first `rank` rows of each key in the order given. The rank filter is pushed into the window, before its shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= rank).drop("_r")


def after(keys: list[tuple[str, bool]], anchor: list) -> Column:
    """Rows after the anchor in a mixed order; keys: (column, descending)."""
    out, same = F.lit(False), F.lit(True)
    for (name, down), value in zip(keys, anchor, strict=True):
        c = F.col(name)
        out = out | (same & ((c < F.lit(value)) if down else (c > F.lit(value))))
        same = same & (c == F.lit(value))
    return out


def keyset_page(df: DataFrame, keys: list[tuple[str, bool]], limit: int, anchor: list | None = None) -> DataFrame:
    """A page of `limit` rows after the anchor, with has_more from one row beyond it."""
    order = [F.desc(k) if down else F.asc(k) for k, down in keys]
    rows = (df.where(after(keys, anchor)) if anchor else df).orderBy(*order).limit(limit + 1)
    numbered = rows.withColumn("_r", F.row_number().over(Window.orderBy(*order)))  # limit + 1 rows
    return numbered.withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("_r") <= limit).drop("_r")


def top(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
