"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsift.llm._common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the component is
    its smallest node.

    Alternates the large-star and small-star steps, so the number of rounds grows
    with the logarithm of the diameter; each round is two aggregations with
    map-side combine and two joins by node, and rows never exceed the edges.
    Edges with a null end and loops only contribute their non-null nodes.
    """
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).where("node is not null").distinct()
    links = edges.where("u is not null and v is not null and u <> v")
    links = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first, so that the join below shuffles both sides anew and adaptive
        # execution can split the edges of a hub
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # large star: the neighbours above u point at u's least neighbour
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and its lower neighbours point at the least of them
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        lower = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(lower.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
