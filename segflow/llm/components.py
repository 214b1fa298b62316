"""Connected components of links, by joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.shared import cut


def fold(root: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``root`` (the least member known of each node's group) after adding links between nodes."""
    if not links:
        return root
    a, b = (np.concatenate(x) for x in zip(*links))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (root[a], root[b], a, b):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): the least node that links (a, b) reach, for every node of a link but the roots themselves.

    Alternates two steps until nothing changes: each node's larger neighbours
    are linked to its least neighbour, then its smaller ones. Minima are
    aggregated before the shuffle and joined back, so a node of very many links
    is never gathered, and Spark can split its rows. Each round is cut, so a
    lost executor repeats one round at most.
    """
    a, b = F.col("a"), F.col("b")
    now = cut(links.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state = _state(now)
    if state[0] == 0:
        return now.select(a.alias("node"), b.alias("root"))
    for _ in range(rounds):
        both = now.select(a.alias("u"), b.alias("v")).union(now.select(b.alias("u"), a.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(rest.union(lowest.select("a", F.col("m").alias("b"))).distinct())
        if (new := _state(now)) == state:
            return now.select(a.alias("node"), b.alias("root"))
        state = new
    raise RuntimeError("links did not settle")
