"""Rows that share a point, dealt to pairs of blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(met: DataFrame, known: DataFrame, weight: int) -> DataFrame:
    """(node, component, point, i, j, side) of the rows of ``met`` (point, node, n) at points that still have several components.

    ``known`` has the component (node, component) of nodes that have one already,
    others are their own. A point's nodes are dealt to blocks of ``weight`` of n on
    average, and a block meets itself and each other one once, under the key
    (point, i, j), on side 0 or 1. So what a task holds of a point doesn't grow
    with it. Points with the same members count as one.
    """
    labelled = met.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = labelled.groupBy("point").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"), F.sum("n").alias("_weight"), F.count(F.lit(1)).alias("_size"),
        F.bit_xor("node").alias("_x"), F.bit_xor(F.xxhash64("node")).alias("_y")).where("_low < _high")
    several = several.groupBy("_size", "_x", "_y").agg(F.min("point").alias("point"), F.min("_weight").alias("_weight")).select(
        "point", F.ceil(F.col("_weight") / weight).cast("int").alias("blocks"))
    dealt = labelled.join(several, "point").withColumn("own", F.pmod(F.xxhash64("node", "point"), F.col("blocks")).cast("int"))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return sent.select("node", "component", "point", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                       F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
