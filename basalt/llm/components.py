"""Connected components by alternating stars: joins and minima only. A hub's neighbours are dealt over tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import join_hot, materialize


def merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """label, the smallest known number of each number's component, after the links (u, v)."""
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task as (node, smallest node of its component), without the smallest nodes."""
    if not len(a):
        return a, b
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = merge(np.arange(len(nodes)), place[: len(a)], place[len(a) :])
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) of one type. Returns (node, root), root the smallest node reachable; nodes without links are absent.

    Each round sends every node's larger neighbours, then its smaller ones, to the smallest it knows.
    The rounds grow with the logarithm of the longest path. Each is written to the shared folder. No round limit: it
    ends when nothing changes.
    """
    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = join_hot(both, both.groupBy("a").agg(F.min("b").alias("low")), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()
        large = materialize(large, "stars")
        near = join_hot(large, large.groupBy("a").agg(F.min("b").alias("low")), "a")
        small = near.select("a", F.col("low").alias("b")).unionByName(near.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))).distinct()
        edges = materialize(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
