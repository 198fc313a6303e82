"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def followed(label: DataFrame) -> DataFrame:
    """``label(node, to)`` with each pointer followed to its end, twice as far in each round; ends point at themselves, and others at smaller nodes."""
    while True:
        ahead = label.where("node <> to").select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = label.join(ahead, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
        step = staged(step, "labels")
        label = step.drop("moved")
        if step.where("moved").isEmpty():
            return label


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, root)``, root the smallest node that can be reached.

    Each round points every node at its smallest neighbour (or itself), follows the
    pointers to their ends, renames both ends of all edges, and drops edges that have
    become loops. A node that stays its own end in one round has a smaller neighbour
    in the next, so two rounds at least halve the nodes, and a path of any order takes
    as many rounds as the logarithm of its length. A group-by with a minimum
    pre-aggregates, so a node with very many edges sends one row per task. Every
    round is written to the shared folder. No edges give no rows.
    """
    both = edges.select("a", "b").where("a <> b")
    both = staged(both.union(both.select("b", "a")).distinct(), "edges")
    names = None
    while not both.isEmpty():
        label = followed(staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).select(F.col("a").alias("node"), "to"), "labels"))
        if names is None:
            names = label
        else:
            step = label.select(F.col("node").alias("to"), F.col("to").alias("next"))
            names = staged(names.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "names")
        left, right = label.select(F.col("node").alias("a"), F.col("to").alias("la")), label.select(F.col("node").alias("b"), F.col("to").alias("lb"))
        both = staged(both.join(left, "a").join(right, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "edges")
    if names is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return names.select("node", F.col("to").alias("root"))
