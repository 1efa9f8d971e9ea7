"""Connected components of an edge table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of any one type that orders and hashes -> node, root: the nodes of edges, one root for each component.

    Each round sends every node to the neighbour (or itself) of least hash and contracts the edges; hashed order makes
    the rounds few (about the logarithm of the longest path). The least neighbour combines before the shuffle, so a hub is
    no hot group, and the joins meet one row for each node, which Spark broadcasts or splits. Rounds end in tables in the
    shared folder. Loops and repeated edges do no harm; no edges give no rows; null ends are left out.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    first = edges.select("a", "b").where("a is not null and b is not null").distinct()
    left = common.staged(first, "edges")
    loops = common.staged(left.where("a = b").select(F.col("a").alias("node")).distinct(), "loops")
    left_now = left.where("a <> b")
    old = left
    rounds: list[DataFrame] = []
    while not left_now.isEmpty():
        both = left_now.select("a", "b").union(left_now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        to = common.staged(least.select(F.col("a").alias("node"), F.least(order("a"), F.col("m"))["v"].alias("root")), "roots")
        rounds.append(to)
        ends = lambda c: to.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731, B023
        contracted = left_now.join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b")
        contracted = contracted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left_now = common.staged(contracted, "edges")
        common.unstage(old)
        old = left_now
    common.unstage(old)
    if not rounds:
        return loops.select("node", F.col("node").alias("root"))
    out = rounds[0]
    for to in rounds[1:]:
        out = out.join(to.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out.unionByName(loops.join(rounds[0], "node", "left_anti").select("node", F.col("node").alias("root")))
