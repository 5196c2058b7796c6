"""Half-open ranges: what spans cover of a request, and whether they cover it whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(requests: DataFrame, spans: DataFrame, request: str, key: str) -> DataFrame:
    """(request, overlaps, covered, complete): how many spans (key, a, b) of its key overlap each request (request, key, a, b), how much of it they cover together, and whether that is all.

    A place that several spans cover counts once. A request without overlaps, and an empty one, is there too (an empty one is complete).
    """
    held = spans.select(F.col(key).alias("_k"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    met = requests.join(held, (F.col(key) == F.col("_k")) & (F.col("_a") < F.col("b")) & (F.col("_b") > F.col("a")))
    cut = met.select(request, F.greatest("_a", "a").alias("s"), F.least("_b", "b").alias("e"))
    until = F.max("e").over(Window.partitionBy(request).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(until, F.col("s"))))
    sums = cut.withColumn("new", new).groupBy(request).agg(F.count("*").alias("overlaps"), F.sum("new").alias("covered"))
    out = requests.join(sums, request, "left")
    covered = F.coalesce("covered", F.lit(0))
    return out.select(request, F.coalesce("overlaps", F.lit(0)).alias("overlaps"), covered.alias("covered"), (covered >= F.col("b") - F.col("a")).alias("complete"))
