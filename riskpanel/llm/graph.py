"""Connected components by alternating large-star and small-star steps, all as joins and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.session import materialize


def _star(edges: DataFrame) -> DataFrame:
    """Both directions of every link, with the least neighbour of each node (itself included) beside it."""
    both = edges.union(edges.select("b", "a")).toDF("node", "near")
    least = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("m"))
    return both.join(least, "node")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the least node that it is connected with.

    A large-star step links a node's greater neighbours to its least one, a small-star step its smaller neighbours and
    itself; the number of rounds grows with the logarithm of the longest chain. Each round's links are a table in the
    shared checkpoint folder. Raises if ``max_rounds`` do not settle it.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        s = _star(cur)
        large = materialize(s.where("near > node and near <> m").select(F.col("near").alias("a"), F.col("m").alias("b"))
                            .distinct())
        # small star: only downward links, to the least of a node's smaller neighbours
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        nxt = large.join(low, "a")
        nxt = (nxt.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
               .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        cur = materialize(nxt)
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = tuple(state)
    raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
