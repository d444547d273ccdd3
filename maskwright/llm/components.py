"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is an aggregation that combines on the map side and a join; each
round is written to the shared folder. Links are never gathered anywhere.

Hubs: a node of more than 1/HUBS of all link ends is a hub. There are fewer
than HUBS of them however large the input, so hubs and their least neighbours
are broadcast, and no task of a join holds all links of a hub. Nodes are longs
or any other type that sorts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

HUBS = 1000


def joined(labels: np.ndarray, near: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Gives all positions that ``near`` connects the least label among them, in place."""
    for k in np.flatnonzero(near.any(1)).tolist():
        met = np.unique(np.append(labels[right[near[k]]], labels[left[k]]))
        if len(met) > 1:
            labels[np.isin(labels, met)] = met[0]


def _star(edges: DataFrame, large: bool, ends: int) -> DataFrame:
    """edges (u, v) with v < u, of ``ends`` ends in all or more. Large: larger neighbours go to the least one; small: smaller neighbours and the node itself do."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_k"))
    hubs = least.filter(F.col("_k") > F.lit(ends / HUBS)).select("u", "m")
    others = both.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.filter(F.col("_k") <= F.lit(ends / HUBS)).select("u", "m"), "u")
    met = both.join(F.broadcast(hubs), "u").unionByName(others)
    if large:
        moved = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("v < u").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) the rows (node, component) of every node that is not its component's least one.

    ``component`` is the least node that can be reached. Loops are ignored and
    the direction and number of edges do not matter.
    """
    turned = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    at = written(turned.filter("v < u").distinct(), "edges")
    before = _mark(at)
    while before[0]:
        half = written(_star(at, True, 2 * before[0]), "edges")
        new = written(_star(half, False, before[0]), "edges")
        after = _mark(new)
        discard(at)
        discard(half)
        at = new
        if after == before:
            break
        before = after
    return at.select(F.col("u").alias("node"), F.col("v").alias("component"))
