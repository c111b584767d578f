"""Connected components of an edge table by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _roots(parents: DataFrame) -> DataFrame:
    """(node, label) with the end of each node's chain of parents, in a number of rounds
    that grows with the logarithm of the longest chain."""
    while True:
        up = parents.select(F.col("node").alias("label"), F.col("label").alias("top"))
        parents = materialise(parents.join(up, "label").select("node", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved")), "parents")
        moved, parents = parents.where("moved"), parents.select("node", "label")
        if moved.isEmpty():
            return parents


def relabel(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (a, b) between the different labels of the ends of ``edges``, each once. Both
    ends are nodes of ``labels`` (node, label)."""
    out = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
    out = out.join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").where("x <> y")
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b); label is the least node of its
    component. Equal ends, repeated edges and an empty table are allowed.

    In each round every node hooks on its least neighbour if that is less than itself,
    chains are followed to their ends, and only edges between different ends go on, so
    the edges of a component shrink from round to round. Hot nodes meet only joins
    that may be split and aggregates that combine before their shuffle."""
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label"))
        roots = _roots(materialise(near, "parents"))
        if labels is None:
            labels = roots
        else:
            top = roots.select(F.col("node").alias("label"), F.col("label").alias("top"))
            labels = materialise(labels.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
        edges = materialise(relabel(edges, roots), "edges")
        if edges.isEmpty():
            return labels
