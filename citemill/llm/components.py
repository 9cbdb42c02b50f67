"""Connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.session import discard, store


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges(a, b)``; nodes without an edge are left out.

    In each round a node hooks to the neighbour, or itself, of least hash, and edges are
    rewritten to the hooks. The hash changes with the round, so that chains shrink by a constant share
    too and the rounds grow with the logarithm of the longest one. Each round is a
    written table in the shared folder, deleted when the next one stands. It ends when no edge is left; there is no cap.
    """
    edges = store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, turn = None, 0
    while labels is None or not edges.isEmpty():
        turn += 1
        rank = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), F.col(c)).alias("rank"), F.col(c).alias("at"))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(rank("b")).alias("best")).select(
            F.col("a").alias("node"), F.least("best", rank("a"))["at"].alias("root"))
        hook = store(hook, "hooks")
        if labels is None:
            labels = hook
        else:
            later = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            old, labels = labels, store(labels.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
            discard(old)
        to = lambda c: hook.select(F.col("node").alias(c), F.col("root").alias(f"{c}_to"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to")
        old, edges = edges, store(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        discard(old, *([hook] if labels is not hook else []))
    discard(edges)
    return labels
