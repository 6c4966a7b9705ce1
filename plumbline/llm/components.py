"""Connected components of an edge table by randomised contraction, wholly in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node of ``edges(a, b)``: rows (node, component), component = its smallest node.

    ``edges`` should be a written table, as it is read more than once. Each round
    gives every node the neighbour (or itself) that comes first in the round's
    order, and replaces all nodes by theirs. Even rounds take the order of the ids,
    which folds stars around a small id at once; odd rounds take a pseudo-random
    order, which removes a constant share of the nodes whatever the ids are (long
    paths included), so that the rounds grow with the logarithm of the graph. A hot
    node's edges combine before the shuffle. Lineage is cut in each round.
    """
    spark = edges.sparkSession
    edges = edges.select("a", "b").filter("a <> b")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        order = (lambda c, k=len(maps): F.xxhash64(c, F.lit(k))) if len(maps) % 2 else (lambda c: c)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("n")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("n")))
        first = both.groupBy("u").agg(F.min(F.struct(order(F.col("n")).alias("r"), F.col("n"))).alias("best"))
        own = F.struct(order(F.col("u")).alias("r"), F.col("u").alias("n"))
        parent = cut(first.select("u", F.least(F.col("best"), own)["n"].alias("p")))
        maps.append(parent)
        edges = cut(
            edges.join(parent.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a")
            .join(parent.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
            .filter("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct()
        )
    if not maps:
        return spark.createDataFrame([], "node long, component long")
    labels = maps[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for parent in maps[1:]:
        labels = labels.join(parent.select(F.col("u").alias("root"), F.col("p").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    if len(maps) == 1:  # only the order of the ids was used: the roots are the smallest nodes
        return labels.withColumnRenamed("root", "component")
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return cut(labels.join(least, "root").select("node", "component"))
