"""Connected components of a graph by hooking to smaller labels and halving paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import checkpointed, counted

#: Rounds after which a graph counts as broken; a path of n vertices takes about log2(n).
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex of ``edges`` (a, b); component is the smallest vertex reachable.

    Vertices are longs. In each round a vertex takes the smallest label that its
    neighbours' labels have, and its label's label; only sizes are counted on
    the driver. Each round is checkpointed. Joins are on vertices; where many
    vertices share a label, the label side of the join has one row, so that
    Spark can split the other side.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(
        F.col("a").alias("vertex"), "label"))
    for _ in range(MAX_ROUNDS):
        label_of = labels.select(F.col("vertex").alias("_v"), F.col("label").alias("_l"))
        # the smallest label next to each vertex
        near = both.join(label_of, F.col("b") == F.col("_v")).groupBy("a").agg(F.min("_l").alias("_near"))
        # offered to the vertex and to the root that it has had
        own = labels.join(near, F.col("vertex") == F.col("a"))
        offers = own.select("vertex", F.least("label", "_near").alias("_new")).union(
            own.select(F.col("label").alias("vertex"), F.least("label", "_near").alias("_new")))
        hooked = offers.groupBy("vertex").agg(F.min("_new").alias("label"))
        jump = hooked.select(F.col("vertex").alias("_v"), F.col("label").alias("_l"))
        after = hooked.join(jump, F.col("label") == F.col("_v"), "left").select(
            "vertex", F.least("label", F.coalesce("_l", "label")).alias("label"))
        after = checkpointed(after)
        changed = counted(after.join(label_of, F.col("vertex") == F.col("_v")).where("label != _l").limit(1))
        labels = after
        if not changed:
            return labels.select("vertex", F.col("label").alias("component"))
    raise RuntimeError(f"labels still change after {MAX_ROUNDS} rounds")
