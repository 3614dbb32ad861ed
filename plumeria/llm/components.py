"""Connected components by contraction, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Each round orders the nodes by a hash of its own, maps every node to the first node of its closed neighbourhood and
    contracts the edges by that map, until no edge is left. The last node of a component in a round's order is the first
    of no neighbourhood, so every round takes nodes away; a random order leaves at most three quarters of them on average
    whatever the graph is (half of a path), so rounds grow with the logarithm of the nodes. The maps are then followed
    back from the last one, which reads each of them once. Minima are partial aggregates; the joins read written tables,
    so that adaptive execution can split a hub's rows. Null ends are dropped, loops keep their node.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    e = written(edges.select(both.alias("e")).select("e.a", "e.b").distinct(), "edges")
    maps = []
    while not maps or not e.isEmpty():
        a, b = (F.xxhash64(F.lit(len(maps)), x) for x in "ab")
        first = e.groupBy("a").agg(F.min_by("b", b).alias("b"))
        least = written(first.select(F.col("a").alias("node"), F.when(b < a, F.col("b")).otherwise(F.col("a")).alias("to")), "least")
        maps.append(least)
        e = written(
            e.join(least.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(least.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(),
            "edges",
        )
    labels = maps.pop()
    while maps:
        last = labels.select(F.col("node").alias("to"), F.col("to").alias("root"))
        labels = written(maps.pop().join(last, "to", "left").select("node", F.coalesce("root", "to").alias("to")), "labels")
    names = labels.groupBy("to").agg(F.min("node").alias("component"))
    return written(labels.join(names, "to").select("node", "component"), "components")
