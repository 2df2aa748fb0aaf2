"""Connected components of a table of links, by rounds of joins; nothing but a count comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import maybe_broadcast, release, scratch


def _ends(up: DataFrame) -> DataFrame:
    """up(node, label), where labels are smaller than their nodes -> the same nodes with the ends of their chains; up is released."""
    while True:
        known = maybe_broadcast(up.select(F.col("node").alias("label"), F.col("label").alias("far")))
        step = up.join(known, "label", "left").select("node", F.coalesce("far", "label").alias("label"), F.col("far").isNotNull().alias("moved"))
        step = scratch(step, "labels")
        release(up)
        if step.where("moved").isEmpty():
            return step
        up = step


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs -> (node, label): the smallest node that can be reached. Nodes without links aren't listed.

    In each round a node that has smaller neighbours goes to the smallest of them, from there to that one's, and so on, in
    chains that are followed twice as far at each step. Links move with their ends; those within one node are dropped, and of
    equal ones but one is kept, so that the next round joins only what still parts two nodes. A node that is left either took
    in all its neighbours or has a smaller one in the next round, so every two rounds halve the nodes that have links.
    """
    pair = lambda a, b: (F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    left = scratch(links.select(*pair("a", "b")).where("low <> high").distinct(), "links")
    found = None
    while True:
        up = _ends(scratch(left.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("label")), "labels"))
        known = maybe_broadcast(up.select(F.col("node").alias("high"), "label"))
        moved = left.join(known, "high").where("low <> label").select("low", "label").distinct()
        known = maybe_broadcast(up.select(F.col("node").alias("low"), F.col("label").alias("end")))
        moved = moved.join(known, "low", "left").select(*pair(F.coalesce("end", "low"), F.col("label"))).where("low <> high").distinct()
        moved = scratch(moved, "links")
        release(left)
        left = moved
        if found is None:
            found = up
        else:
            far = maybe_broadcast(up.select(F.col("node").alias("label"), F.col("label").alias("far")))
            step = found.join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label"))
            step = scratch(step.unionByName(up.select("node", "label")), "labels")
            release(found, up)
            found = step
        if left.isEmpty():
            break
    out = found.select("node", "label")
    out = scratch(out.unionByName(out.select(F.col("label").alias("node"), "label").distinct()), "labels")
    release(left, found)
    return out
