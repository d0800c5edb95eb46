"""Connected components of an edge table, by contraction and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an undirected edge table.

    The component is the smallest node reachable. Each round points every node at its
    smallest neighbour, jumps pointers until trees are flat and contracts the edges;
    a round merges every tree that has an edge, so rounds are logarithmic in number.
    A hub's edges meet in partial sums and in joins that adaptive execution splits,
    never in one group. Null ends are ignored; no edges give an empty table.
    """
    links = materialize(
        edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").distinct(), "links"
    )
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        parent = materialize(
            both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("component")),
            "parents",
        )
        parent = _flatten(parent)
        if labels is None:
            labels = parent
        else:
            to = parent.select(F.col("node").alias("component"), F.col("component").alias("upper"))
            labels = materialize(
                labels.join(to, "component", "left").select("node", F.coalesce("upper", "component").alias("component")), "labels"
            )
        of = parent.select("node", "component")
        links = materialize(
            links.join(of.select(F.col("node").alias("src"), F.col("component").alias("a")), "src")
            .join(of.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
            .where("a <> b")
            .select(F.col("a").alias("src"), F.col("b").alias("dst"))
            .distinct(),
            "links",
        )
    if labels is None:
        return links.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return labels


def _flatten(parent: DataFrame) -> DataFrame:
    """Point every node at its tree's root."""
    while True:
        up = parent.select(F.col("node").alias("component"), F.col("component").alias("upper"))
        parent = materialize(
            parent.join(up, "component").selectExpr("node", "upper AS component", "upper <> component AS moved"), "jumps"
        )
        moved = not parent.where("moved").isEmpty()
        parent = parent.drop("moved")
        if not moved:
            return parent
