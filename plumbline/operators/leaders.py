"""Folds that depend on an order, as rounds of joins: who leads is settled where nothing earlier is open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, drop_steps


def leaders(items: DataFrame, near: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, leader): what a fold gives that walks a group's items in order, makes an item a leader if no earlier
    leader is near it, and else puts it to the first such leader.

    ``items(keys, item)``, numbered in order within a group; ``near(keys, item, earlier)`` with earlier < item. An item leads once no
    earlier item near it is open or leads, and follows once one leads; each round settles at least the first open item of every
    neighbourhood, and where the order is unrelated to nearness most of what is left, so there are few rounds.
    """
    pairs = cut(near.select(*keys, "item", "earlier").distinct())
    behind = pairs.select(*keys, "item").distinct()
    leading = cut(items.select(*keys, "item").join(behind, [*keys, "item"], "left_anti"))
    open_pairs, known = pairs, [leading]
    while not open_pairs.isEmpty():
        newest = known[-1].select(*keys, F.col("item").alias("earlier"))
        following = cut(open_pairs.join(newest, [*keys, "earlier"], "left_semi").select(*keys, "item").distinct())
        # pairs that still matter: neither a follower's own, nor behind a follower, nor behind what leads already
        rest = open_pairs.join(following, [*keys, "item"], "left_anti")
        left = cut(rest.join(following.select(*keys, F.col("item").alias("earlier")), [*keys, "earlier"], "left_anti"))
        waiting = left.select(*keys, "item").distinct()
        known.append(cut(rest.select(*keys, "item").distinct().join(waiting, [*keys, "item"], "left_anti")))
        if open_pairs is not pairs:
            drop_steps(open_pairs)
        drop_steps(following)
        open_pairs = left
    every = known[0]
    for more in known[1:]:
        every = every.union(more)
    first = pairs.join(every.select(*keys, F.col("item").alias("earlier")), [*keys, "earlier"], "left_semi").groupBy(*keys, "item").agg(F.min("earlier").alias("leader"))
    led = first.join(every, [*keys, "item"], "left_anti")
    return cut(every.withColumn("leader", F.col("item")).unionByName(led), *known)


def numbered(led: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, number): leaders numbered from 0 in order, and their followers alike."""
    from pyspark.sql import Window as W

    own = led.filter("item = leader").select(*keys, "leader", (F.row_number().over(W.partitionBy(*keys).orderBy("leader")) - 1).alias("number"))
    return led.join(own, [*keys, "leader"]).select(*keys, "item", "number")
