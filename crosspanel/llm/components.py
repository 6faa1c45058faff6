"""Connected components of a link table by contraction, with staged intermediates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crosspanel.llm.frames import drop_staged, staged


def components(links: DataFrame, left: str = "x", right: str = "y") -> DataFrame:
    """(node, component) for every node of a link, component being its smallest node.

    Each round every node adopts the smallest label next to it, labels follow their own label,
    and links are rewritten to the new labels; links inside a label vanish.  Labels only fall, so
    the last label of a node is the smallest of its component.  Every round works on distinct
    links and at least halves the labels that still have some, so a few rounds suffice.
    """
    edges = staged(links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").distinct(), "links")
    mapping: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
        up = step.select(F.col("a").alias("label"), F.col("label").alias("next"))
        jumped = step.join(up, "label").select("a", F.col("next").alias("label"))
        jumped = staged(jumped, "labels")
        drop_staged(step)
        new = edges.join(jumped, "a").select("b", F.col("label").alias("la"))
        new = new.join(jumped.select(F.col("a").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb")
        new = staged(new.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "links")
        if mapping is None:
            mapping = jumped.select(F.col("a").alias("node"), F.col("label").alias("component"))
        else:
            moved = jumped.select(F.col("a").alias("component"), F.col("label").alias("to"))
            mapping = staged(mapping.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "mapping")
        drop_staged(edges)
        edges = new
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return mapping
