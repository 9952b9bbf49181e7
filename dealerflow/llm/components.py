"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerflow.llm.common import saved


def _chosen(edges: DataFrame, turn: int) -> DataFrame:
    """``id`` and ``to`` of every end: the first of itself and its neighbours, in an order of this turn's own."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select("b", "a"))
    if turn == 0:
        return both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to"))
    order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("to"))
    first = both.groupBy("id").agg(F.min(order("to")).alias("best"))
    return first.select("id", F.least(order("id"), "best")["to"].alias("to"))


def _contracted(edges: DataFrame, step: DataFrame) -> DataFrame:
    """The links between what their ends chose, each once."""
    a, b = (step.select(F.col("id").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
    ends = edges.join(a, "a").join(b, "b").where("to_a <> to_b")
    return ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id) of every end of ``links`` (a, b), a stored table.

    Each turn every node chooses one of itself and its neighbours, and the links
    between the chosen are the next turn's graph, until none is left. The first
    turn chooses the smallest id, which settles every star around its smallest
    node. Later turns choose by a random order of their own, which shrinks any
    graph, long chains of rising ids too, by a constant factor a turn in
    expectation. A hub's links are spread by partial minima and by the skew join.
    Turns are stored in the shared folder; their choices are then followed from
    the last and smallest turn back to the first.
    """
    edges, steps = links.where("a <> b").select("a", "b"), []
    while not edges.isEmpty():
        steps.append(saved(_chosen(edges, len(steps))))
        edges = saved(_contracted(edges, steps[-1]))
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    root = steps.pop()
    while steps:
        onward = root.select(F.col("id").alias("to"), F.col("to").alias("root"))
        root = steps.pop().join(onward, "to", "left").select("id", F.coalesce("root", "to").alias("to"))
    smallest = root.groupBy("to").agg(F.min("id").alias("component"))
    return saved(root.join(smallest, "to").select("id", "component"))
