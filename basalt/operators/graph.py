"""Entity graphs as edge tables: mentions, co-mentions, traversal and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.tables import sent_if_small, written

#: Edges of a node from which it counts as a hub, and hubs at most (the limit grows with the edges).
HUB, HUBS = 10_000, 10_000


def degrees(edges: DataFrame, entity: str = "entity", document: str = "document") -> DataFrame:
    return edges.groupBy(entity).agg(F.sum("frequency").cast("long").alias("mention_count"), F.countDistinct(document).alias("document_count"))


def neighbours(edges: DataFrame, roots: DataFrame, limit: int = 40) -> DataFrame:
    """Entities that share a document with a root; most frequent in the shared document first, at most `limit`."""
    mine = edges.join(roots, "entity", "left_semi").select(F.col("entity").alias("root"), "document")
    return mine.join(edges, "document").where("entity != root").select("document", "root", F.col("entity").alias("target"), "frequency").orderBy(F.desc("frequency"), "document", "root", "target").limit(limit)


def authorised(projection: DataFrame, documents: DataFrame) -> DataFrame:
    """(document, status, allowed) of every projected document (document, version, revision): may its edges be shown?

    documents: (document, current_version, acknowledged, deleted, blocked, pending). Allowed are those whose projection is of the current
    version at the acknowledged revision, and which are neither deleted nor blocked. The status is degraded for all while any document is pending.
    """
    held = projection.join(documents, "document", "left")
    same = F.col("version").eqNullSafe(F.col("current_version")) & F.col("revision").eqNullSafe(F.col("acknowledged"))
    allowed = F.coalesce(same & ~F.col("deleted") & ~F.col("blocked"), F.lit(False))
    pending = documents.agg(F.coalesce(F.bool_or("pending"), F.lit(False)).alias("_pending"))  # one row
    status = F.when(F.col("_pending"), "degraded").otherwise("complete")
    return held.crossJoin(F.broadcast(pending)).select("document", status.alias("status"), allowed.alias("allowed"))


def traverse(edges: DataFrame, roots: DataFrame, limit: int = 40, allowed: DataFrame | None = None, allowed_now: DataFrame | None = None) -> DataFrame:
    """Both hops as undirected edges, once each; targets that are roots themselves are left out.

    With allowed (document), the second hop begins at targets of allowed documents only; both hops are held against allowed_now before they are returned.
    """
    if allowed is not None:
        edges = edges.join(allowed.select("document"), "document", "left_semi")
    one = neighbours(edges, roots, limit).withColumn("hop", F.lit(1))
    named = roots.select(F.col("entity").alias("target"))
    one = one.join(named, "target", "left_anti")
    two = neighbours(edges, one.select(F.col("target").alias("entity")).distinct(), limit).withColumn("hop", F.lit(2)).join(named, "target", "left_anti")
    found = one.unionByName(two)
    if allowed_now is not None:
        found = found.join(allowed_now.select("document"), "document", "left_semi")
    both = found.select("document", F.least("root", "target").alias("a"), F.greatest("root", "target").alias("b"), "hop")
    return both.groupBy("document", "a", "b").agg(F.min("hop").alias("hop"))


def reach(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(node, depth): breadth-first over bipartite edges (a, b), hops edges far; each step one join with the new nodes.

    The edges and each step's new nodes are written, so a step's plan has two joins however many came before it. Edges are read both ways
    and may come more than once: only the nodes that a step finds are made distinct.
    """
    one_way = written(edges.select("a", "b"), "edges")
    both = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b")))
    front = written(roots.select("node", F.lit(0).alias("depth")).dropDuplicates(["node"]), "front")
    found = front
    for depth in range(1, hops + 1):
        step = both.join(sent_if_small(front.select(F.col("node").alias("a"))), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        front = written(step.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def _lowest(edges: DataFrame) -> DataFrame:
    """edges (a, b) with the smallest b of each a as `low`. A hub's edges are dealt over tasks: its minimum is one row, and joined as such."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
    # The few nodes with more edges than HUB get their minimum sent to all tasks, so their edges stay where they are.
    most = max(HUB, edges.count() // HUBS)
    hubs = F.broadcast(low.where(F.col("n") > most).select("a", F.col("low").alias("_hub")))
    with_hubs = edges.join(hubs, "a", "left")
    rest = with_hubs.where("_hub IS NULL").drop("_hub").join(low.where(F.col("n") <= most).select("a", "low"), "a")
    return with_hubs.where("_hub IS NOT NULL").select("a", "b", F.col("_hub").alias("low")).unionByName(rest)


def clusters(pairs: DataFrame) -> DataFrame:
    """(node, cluster) of linked nodes, cluster the smallest of those reachable.

    Alternating stars: each round hangs every node's larger neighbours on the smallest node it knows, then its smaller ones. The rounds
    grow with the logarithm of the longest chain and go on until nothing changes. Each half of a round is written.
    """
    edges = written(pairs.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
        large = written(_lowest(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct(), "links")
        near = _lowest(large)
        hung = near.select("a", "low", F.when(F.col("b") != F.col("low"), F.col("b")).alias("b"))
        edges = written(hung.select("a", F.col("low").alias("b")).unionByName(hung.where("b IS NOT NULL").select(F.col("b").alias("a"), F.col("low").alias("b"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("cluster")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("cluster")).distinct())


def projection(edges: DataFrame, roots: DataFrame, depth: int, most_nodes: int = 250, most_links: int = 500) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of the part of a bipartite graph (a, b, frequency) that roots (node) reach in 2 * depth edges.

    nodes (node, depth, links, place): nearest first, then those with most links, then by name, at most most_nodes. links (a, b, frequency):
    between those nodes, most frequent first, at most most_links. Both say in `truncated` whether something was left out.
    """
    if not 1 <= depth <= 4:
        raise ValueError("depth from 1 to 4")
    found = reach(edges.select("a", "b"), roots, 2 * depth)
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    ranked = found.join(ends, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    first = ranked.orderBy("depth", F.desc("links"), "node").limit(most_nodes + 1)
    place = F.row_number().over(Window.orderBy("depth", F.desc("links"), "node"))  # most_nodes + 1 rows
    placed = first.withColumn("place", place).withColumn("truncated", F.count("*").over(Window.partitionBy()) > most_nodes).where(F.col("place") <= most_nodes)
    names = placed.select("node")  # most_nodes rows
    inside = edges.join(F.broadcast(names.withColumnRenamed("node", "a")), "a", "left_semi").join(F.broadcast(names.withColumnRenamed("node", "b")), "b", "left_semi")
    held = inside.select("a", "b", "frequency").orderBy(F.desc("frequency"), "a", "b").limit(most_links + 1)
    order = Window.orderBy(F.desc("frequency"), "a", "b")  # most_links + 1 rows
    links = held.withColumn("place", F.row_number().over(order)).withColumn("truncated", F.count("*").over(Window.partitionBy()) > most_links).where(F.col("place") <= most_links).drop("place")
    return placed, links


def document_entities(edges: DataFrame, asked: DataFrame, allowed: DataFrame, most: int = 250) -> DataFrame:
    """(document, degraded, entity, frequency) of the asked documents. One with more than most entities, or that isn't allowed, is degraded: a row without an entity. So is, not degraded, one without entities."""
    mine = edges.join(asked.select("document"), "document", "left_semi")
    counts = mine.groupBy("document").agg(F.count("*").alias("_n"))
    told = asked.join(allowed.select("document", F.lit(True).alias("_ok")), "document", "left").join(counts, "document", "left")
    told = told.select("document", (F.col("_ok").isNull() | (F.coalesce("_n", F.lit(0)) > most)).alias("degraded"))
    shown = mine.join(told.where("NOT degraded").select("document"), "document", "left_semi").select("document", "entity", "frequency")
    return told.join(shown, "document", "left").select("document", "degraded", "entity", "frequency")


def mention_scan(mentions: DataFrame, order: list, most: int = 2_000) -> DataFrame:
    """The first `most` mentions in an order, each with `truncated`: whether there are more. One row more than `most` is probed."""
    first = mentions.orderBy(*order).limit(most + 1)
    placed = first.withColumn("_r", F.row_number().over(Window.orderBy(*order))).withColumn("truncated", F.count("*").over(Window.partitionBy()) > most)  # most + 1 rows
    return placed.where(F.col("_r") <= most).drop("_r")
