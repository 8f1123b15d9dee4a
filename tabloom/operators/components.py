"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import release, settle
from .lookup import lookup

SMALL_EDGES = 100_000


def _merge(pairs: list[tuple]) -> dict:
    """Lowest member of each node's component for a short edge list."""
    parent: dict = {}

    def top(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for u, v in pairs:
        parent.setdefault(u, u)
        parent.setdefault(v, v)
        a, b = top(u), top(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in parent}


def connected_components(
    edges: DataFrame, src: str = "src", dst: str = "dst", small_edges: int = SMALL_EDGES
) -> DataFrame:
    """(node, root) for every node of an edge list; the root is the lowest node reached.

    Each round points nodes at the lowest node around them, first from larger
    neighbours, then from smaller ones. The number of rounds grows with the logarithm
    of the component size, not with its diameter.
    """
    a, b = F.col(src), F.col(dst)
    whole = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    if whole.count() <= small_edges:
        kind = whole.schema["u"].dataType.simpleString()
        found = _merge([tuple(r) for r in whole.collect()])
        return whole.sparkSession.createDataFrame(list(found.items()), f"node {kind}, root {kind}")
    nodes = whole.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    state = whole.where(F.col("u") != F.col("v"))
    owned = None
    mark = None
    while True:
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = (
            lookup(both, low, "u", "n").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = settle(large, "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = lookup(large, low, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        new = settle(small, "stars")
        release(large)
        release(owned)
        state = owned = new
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
