"""Distributed union-find: connected components of a table of links.

Every round each component hooks onto its smallest neighbour, the resulting
forest is flattened by pointer jumping, and the links are rewritten between the
roots.  A component that is left with links has been hooked onto or has hooked,
so the number of components with links at least halves each round.  Links and
labels stay tables; only counts reach the driver.  Every round is written with
``checkpoint()``, so a lost executor never reaches back past it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import cut_lineage


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): every node that has a link, with the smallest node it can reach.

    Repeated links, links in both directions and a node linked with itself are
    allowed; a link with a null end is ignored.  No links give no rows.
    """
    a, b = F.col(left), F.col(right)
    edges = links.where(a.isNotNull() & b.isNotNull()).select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct()
    edges = cut_lineage(edges)
    labels = cut_lineage(edges.select(F.explode(F.array("low", "high")).alias("node")).distinct().select("node", F.col("node").alias("root")))
    edges = edges.where("low < high")
    while True:
        parent = cut_lineage(edges.groupBy(F.col("high").alias("child")).agg(F.min("low").alias("parent")))
        if parent.isEmpty():
            return labels
        parent = _flatten(parent)
        labels = cut_lineage(
            labels.join(parent, labels["root"] == parent["child"], "left").select("node", F.coalesce("parent", "root").alias("root"))
        )
        low, high = parent.toDF("l", "lp"), parent.toDF("h", "hp")
        moved = edges.join(low, F.col("low") == F.col("l"), "left").join(high, F.col("high") == F.col("h"), "left")
        x, y = F.coalesce("lp", "low"), F.coalesce("hp", "high")
        edges = cut_lineage(moved.select(F.least(x, y).alias("low"), F.greatest(x, y).alias("high")).where("low < high").distinct())


def _flatten(parent: DataFrame) -> DataFrame:
    """Point every child at the root of its tree, doubling the reach each round."""
    while True:
        above = parent.toDF("up", "upper")
        jumped = cut_lineage(
            parent.join(above, parent["parent"] == above["up"], "left").select("child", F.coalesce("upper", "parent").alias("parent"), F.col("upper").isNotNull().alias("moved"))
        )
        if jumped.where("moved").isEmpty():
            return jumped.drop("moved")
        parent = jumped.drop("moved")
