"""Exact interpolated percentiles by refining histograms: no group's values are gathered, and none is sorted.

A percentile of n values lies between two ranks. A pass counts, for each interval that a rank is still known to lie in, its values in
BINS equal bins, with each bin's least and largest value; the bin that holds the rank is the next interval. Intervals of few values are
then sorted. With BINS = 4,096 and FEW = 10,000 two passes do for some 40 million values of a group, three for 10^11.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.tables import sent_if_small, written

BINS, FEW = 4_096, 10_000


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """keys and one column for each point p (0 to 1): the value at p * (n - 1), interpolated, of the group's values.

    Nulls, NaN and infinite values aren't counted; a group without values has nulls. Without keys it is one row. rows are read once for each pass, a
    key, value and nothing else. Keys may be null.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    narrow = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("x"))
    whole = narrow.withColumn("x", F.when(F.abs("x") < float("inf"), F.col("x")))
    groups = written(whole.groupBy(*names).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), "percentile-groups")
    # Groups are joined as rows with a digest of the keys, so that null keys meet.
    digest = F.to_json(F.struct(*names)) if names else F.lit("")
    values = whole.where("x IS NOT NULL").select(digest.alias("g"), "x")
    position = {p: F.lit(float(p)) * (F.col("n") - 1) for p in set(points.values())}
    wanted = F.array_distinct(F.array(*[f(position[p]).cast("long") for p in position for f in (F.floor, F.ceil)]))
    open_ranks = written(groups.where("n > 0").select(digest.alias("g"), F.explode(wanted).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("held")), "ranks")
    known = open_ranks.where("lo = hi").select("g", "rank", F.col("lo").alias("at"))
    open_ranks = open_ranks.where("lo < hi")
    while True:
        short = open_ranks.where(F.col("held") <= few)
        wide = open_ranks.where(F.col("held") > few)
        spans = written(wide.select("g", "lo", "hi").distinct(), "spans")
        if not spans.count():
            break
        # Halves, so that the width of any two finite values is finite.
        place = F.least(F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1)).cast("int")
        met = values.join(sent_if_small(spans, 128), "g").where("x BETWEEN lo AND hi")
        counted = written(met.groupBy("g", "lo", "hi", place.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most")), "bins")
        before = F.sum("n").over(Window.partitionBy("g", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))  # `bins` rows at most
        so_far = counted.withColumn("before", F.coalesce(before, F.lit(0)))
        inside = wide.join(so_far, ["g", "lo", "hi"]).where((F.col("rank") - F.col("below") >= F.col("before")) & (F.col("rank") - F.col("below") < F.col("before") + F.col("n")))
        next_ranks = inside.select("g", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("before")).alias("below"), F.col("n").alias("held"))
        again = written(short.unionByName(next_ranks), "ranks")
        known = known.unionByName(again.where("lo = hi").select("g", "rank", F.col("lo").alias("at")))
        open_ranks = again.where("lo < hi")
    last = open_ranks.select("g", "lo", "hi", "below").distinct()
    sorted_values = values.join(sent_if_small(written(last, "spans"), 128), "g").where("x BETWEEN lo AND hi").groupBy("g", "lo", "hi", "below").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # `few` values at most
    settled = open_ranks.join(sorted_values, ["g", "lo", "hi", "below"]).select("g", "rank", F.get("xs", (F.col("rank") - F.col("below")).cast("int")).alias("at"))
    found = known.unionByName(settled).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "at"))).alias("m"))
    out = groups.withColumn("g", digest).join(found, "g", "left")

    def point(p: float):
        at = position[p]
        low, high = F.col("m")[F.floor(at).cast("long")], F.col("m")[F.ceil(at).cast("long")]
        part = at - F.floor(at)
        return F.when(F.floor(at) == F.ceil(at), low).otherwise((1 - part) * low + part * high)

    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], *[point(p).alias(k) for k, p in points.items()])
