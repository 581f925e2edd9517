"""Connected components of a graph given by its edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecweave.llm.frames import split_join
from vecweave.sources.storage import materialize

MAX_ROUNDS = 60


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the edges between a and b, few that join the same."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept: tuple[list[int], list[int]] = ([], [])
    for x, y in np.unique(np.stack([a, b], axis=1), axis=0).tolist():
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            kept[0].append(x)
            kept[1].append(y)
    return kept


def _to_least(ways: DataFrame, least: DataFrame) -> DataFrame:
    """Rows (u, v) with the least neighbour m of u. A vertex with very many neighbours is split over tasks."""
    return split_join(ways, least, "u", "n", how="inner", spread_by=F.xxhash64("v"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, component) for every vertex with an edge; the component is the least vertex that can be reached.

    Rounds of two steps on the edges alone: every vertex hands its larger neighbours, then its smaller ones, to the least
    of them. The number of rounds follows the logarithm of the longest path. Each round is a written table, so a lost
    executor costs one round at most. The edges of a vertex are counted with partial aggregation and never gathered; those
    of a vertex with very many are joined in several tasks.
    """
    def both(df: DataFrame) -> DataFrame:
        return df.union(df.select(F.col("v"), F.col("u"))).toDF("u", "v")

    current = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    )
    rows = current.count()
    for _ in range(MAX_ROUNDS):
        # Each vertex hands its larger neighbours to its least one.
        ways = both(current)
        nearest = ways.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = _to_least(ways.filter("v > u"), nearest).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Each vertex hands its smaller neighbours, and itself, to the least of them.
        large = materialize(large.filter("u > v"), rows)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            _to_least(large, least)
            .select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
            .filter("u > v")
            .distinct()
        )
        after = materialize(small, rows)
        changed = after.exceptAll(current).limit(1).count() or current.exceptAll(after).limit(1).count()
        current = after
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = current.select(F.col("v").alias("vertex")).distinct().withColumn("component", F.col("vertex"))
    return current.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)
