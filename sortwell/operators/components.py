"""Connected components by contraction: hook to the least neighbour, jump, relabel the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortwell.session import release, settle


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row ``(node, component)`` for each end of an edge; ``component`` is the least node.

    Each round sends a node to its least neighbour (a forest, since parents are
    smaller), follows parents three times, and rewrites the edges between what is left.
    A component of two or more nodes at least halves each round. Edges and parents are
    written tables, so a hub's rows can be split at run time. Edges with
    a null end and loops are ignored; repeated edges are harmless.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    live = settle(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(low.alias("u"), high.alias("v"))
        .distinct(),
        "edges",
    )
    labels = None
    while not live.isEmpty():
        both = live.union(live.select("v", "u"))
        parent = settle(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("up")), "parents")
        jumped = parent
        for _ in range(3):
            jumped = jumped.join(parent.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up").select("node", F.col("up2").alias("up"))
        jumped = settle(jumped, "parents")
        release(parent)
        parent = jumped
        if labels is None:
            labels = parent.select("node", F.col("up").alias("component"))
        else:
            above = parent.select(F.col("node").alias("component"), "up")
            labels = settle(labels.join(above, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        left = parent.select(F.col("node").alias("u"), F.col("up").alias("pu"))
        right = parent.select(F.col("node").alias("v"), F.col("up").alias("pv"))
        moved = settle(live.join(left, "u").select("pu", "v"), "edges")
        nxt = settle(
            moved.join(right, "v")
            .where(F.col("pu") != F.col("pv"))
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .distinct(),
            "edges",
        )
        release(live)
        release(moved)
        live = nxt
    if labels is None:
        return live.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
