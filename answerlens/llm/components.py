"""Connected components of an edge table by alternating large and small stars, without collecting anything."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlens.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(src, dst) of any integer ids -> (node, component), component being the smallest id reachable.

    Loops and repeated edges are allowed, ids without a proper edge aren't returned. Each half round is a minimum per
    node (combined before the shuffle) that is written, then joined back, so a hub with many neighbours is only the
    key of a join, which Spark can split. The rounds end when the edges stay the same; their number follows the
    logarithm of the longest path.
    """
    e = edges.select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("p")).filter("v <> p").distinct()
    e = scratch.save(e, "edges")
    before = _sum(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("p").alias("v"), F.col("v").alias("p")))
        low = scratch.save(both.groupBy("v").agg(F.min("p").alias("m")).withColumn("m", F.least("v", "m")), "low")
        large = both.join(low, "v").filter("p > v").select(F.col("p").alias("v"), F.col("m").alias("p"))
        large = scratch.save(large, "large")
        least = scratch.save(large.groupBy("v").agg(F.min("p").alias("m")), "least")
        small = large.join(least, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("p")), F.struct(F.col("p").alias("v"), F.col("m").alias("p")))).alias("x"))
        small = scratch.save(small.select("x.*").filter("v <> p").distinct(), "small")
        after = _sum(small)
        scratch.drop(e, low, large, least)
        e = small
        if after == before:
            break
        before = after
    roots = e.select(F.col("p").alias("node")).distinct().withColumn("component", F.col("node"))
    return scratch.save(e.select(F.col("v").alias("node"), F.col("p").alias("component")).unionByName(roots), "components")


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("v", "p").cast("decimal(20,0)"))).first())


def spanning(ids: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per position, the smallest id that the edges u - w (positions) reach; a task returns these, not its edges."""
    order = np.argsort(ids, kind="stable")
    label = np.empty(len(ids), dtype=np.int64)
    label[order] = np.arange(len(ids))
    while len(u):
        low = label.copy()
        np.minimum.at(low, u, label[w])
        np.minimum.at(low, w, label[u])
        if (low == label).all():
            break
        label = low
    return ids[order][label]
