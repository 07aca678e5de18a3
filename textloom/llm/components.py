"""Connected components of a graph in DataFrames: smallest node of each component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._columns import discard, materialize

#: Times that pointers are doubled in a round: chains shrink by 2^JUMPS at least.
JUMPS = 2


def smallest_reachable(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node it reaches.

    Contraction: each node points to its smallest neighbour, or itself; pointers are
    doubled JUMPS times; then every edge is renamed to where its ends point, and loops and
    repeats go. A node and where it points are in one component, and the edge between them
    lives on under the new names, so components stay what they are while the graph shrinks
    fast: a star in one round, a chain of n by 2^JUMPS in each. The pointers of all rounds
    in a row lead to the smallest node.

    All steps are joins and grouped minima with partial aggregation, so a node of very many
    edges is no hot group; rounds are written to the shared folder, and nothing but a count
    goes to the driver; a round's tables are deleted when the next are written. Two rounds halve
    the nodes that still have edges at least, so ``max_rounds`` is no limit on real graphs.
    Null ends and loops are left out.
    """
    live = materialize(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    for _ in range(max_rounds):
        ends = live.select(F.col("a").alias("node"), F.col("a").alias("to")).unionAll(live.select(F.col("b").alias("node"), F.col("a").alias("to")))
        points = ends.groupBy("node").agg(F.min("to").alias("to"))
        done = [points]
        for _ in range(JUMPS):
            points = materialize(points, "pointers")
            done.append(points)
            further = points.select(F.col("node").alias("to"), F.col("to").alias("next"))
            points = points.join(further, "to").select("node", F.col("next").alias("to"))
        points = materialize(points, "pointers")
        discard(*done)
        old_labels, old_live = labels, live
        if labels is None:
            labels = points.select("node", F.col("to").alias("component"))
        else:
            step = points.select(F.col("node").alias("component"), F.col("to").alias("next"))
            labels = labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        labels = materialize(labels, "labels")
        at = points.select(F.col("node").alias("a"), F.col("to").alias("x"))
        bt = points.select(F.col("node").alias("b"), F.col("to").alias("y"))
        renamed = live.join(at, "a").join(bt, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        live = materialize(renamed.where("a < b").distinct(), "edges")
        discard(old_labels, old_live, points)
        if not live.limit(1).count():
            discard(live)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
