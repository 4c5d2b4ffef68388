"""Connected components of an edge table by alternating large-star and small-star steps, each a grouped minimum and a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.runtime import checkpoint


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v): every neighbour of a node is linked to the least node around it.

    The least neighbour is a grouped minimum with partial aggregation and comes back by a join that adaptive execution can
    split, so that a node with a third of all edges costs no single task.
    """
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v of one integer type); component is the least node reachable.

    Nulls and loops are no edges. The number of rounds follows the logarithm of the longest path; each round's edges are
    checkpointed, so a lost executor costs no replay of earlier rounds.
    """
    now = checkpoint(edges.select("u", "v").filter("u <> v").distinct())
    seen = None
    while True:
        now = checkpoint(_stars(_stars(now, large=True), large=False))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    star = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())


def local_labels(n: int, pairs) -> np.ndarray:
    """Labels of n nodes, the least node number of each component; `pairs` yields (i, j) arrays of links."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                deeper = label[label]
                if (deeper == label).all():
                    break
                label = deeper
    return label
