"""Ordered analytics: turns along a path, plateaus, combs, grids, cumulative votes."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G


def _turn(before: str, here: str):
    """Absolute turn between two directions, in 0..pi."""
    d = F.abs(F.col(here) - F.col(before))
    return F.least(d, F.lit(2 * pi) - d)


def with_turns(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments that have a length, with ``heading`` and ``turn`` from the segment before (null on a path's first)."""
    solid = segments.withColumn("len", G.distance("ax", "ay", "bx", "by_")).filter("len > 0")
    headed = solid.withColumn("heading", F.atan2(F.col("by_") - F.col("ay"), F.col("bx") - F.col("ax")))
    order = W.partitionBy(*keys, "path_id").orderBy("seg_no")
    return headed.withColumn("before", F.lag("heading").over(order)).withColumn("turn", _turn("before", "heading")).drop("before")


def corner_split(segments: DataFrame, keys: list[str], factor: float = 3.0) -> DataFrame:
    """Split paths where they turn by more than ``factor`` times their median turn (1e-9 at least): adds ``chain_no``."""
    path = W.partitionBy(*keys, "path_id")
    turned = with_turns(segments, keys).withColumn("median_turn", F.percentile("turn", 0.5).over(path))  # a window: a join would deal and sort all rows again
    cut_ = F.coalesce(F.col("turn") > F.greatest(F.col("median_turn") * factor, F.lit(1e-9)), F.lit(False))
    return turned.withColumn("chain_no", F.sum(cut_.cast("int")).over(path.orderBy("seg_no").rowsBetween(W.unboundedPreceding, 0))).drop("median_turn")


def bend_counts(segments: DataFrame, keys: list[str], degrees: float = 15.0) -> DataFrame:
    """Bends (turns over 15 degrees) of every path: (keys, path_id, bends)."""
    return with_turns(segments, keys).groupBy(*keys, "path_id").agg(F.count_if(F.col("turn") > degrees * pi / 180).alias("bends"))


def plateau(curves: DataFrame, keys: list[str]) -> DataFrame:
    """The flat part of curves (x, y): the longest run of steps whose relative change is at most the median change.

    Returns (keys, threshold, width, median): the middle and width of the run in x, the first of equally
    long runs; a curve of fewer than 4 points has 0, 0, 0. A start at 0 counts as 1.
    """
    order = W.partitionBy(*keys).orderBy("x")
    steps = (
        curves.withColumns({"px": F.lag("x").over(order), "py": F.lag("y").over(order), "step": F.row_number().over(order) - 1, "points": F.count("*").over(W.partitionBy(*keys))})
        .filter("step > 0 AND points >= 4")
        .withColumn("base", F.when(F.col("py") == 0, 1.0).otherwise(F.col("py")))
        .withColumn("change", F.abs(F.col("y") - F.col("base")) / F.col("base"))
    )
    median = steps.groupBy(*keys).agg(F.percentile("change", 0.5).alias("m")).select(*keys, F.when(F.col("m") == 0, 1e-9).otherwise(F.col("m")).alias("median"))
    flat = steps.join(median, keys).filter(F.col("change") <= F.col("median"))
    island = flat.withColumn("island", F.col("step") - F.row_number().over(order))
    runs = island.groupBy(*keys, "island").agg(F.count("*").alias("n"), F.min("step").alias("first"), F.min("px").alias("lo"), F.max("x").alias("hi"))
    best = runs.groupBy(*keys).agg(F.max(F.struct(F.col("n"), (-F.col("first")).alias("first"), "lo", "hi")).alias("r"))
    found = median.join(best, keys).select(*keys, ((F.col("r.lo") + F.col("r.hi")) / 2).alias("threshold"), (F.col("r.hi") - F.col("r.lo")).alias("width"), "median")
    short = curves.groupBy(*keys).agg(F.count("*").alias("n")).filter("n < 4").select(*keys, F.lit(0.0).alias("threshold"), F.lit(0.0).alias("width"), F.lit(0.0).alias("median"))
    return found.unionByName(short)


def sweep(base: DataFrame, bridges: DataFrame, keys: list[str], steps: int = 40, most: float = 12.0) -> DataFrame:
    """Total length against the joining threshold, in units: (keys, x, y), steps + 1 points up to ``most``.

    ``base(keys, total, unit)`` has the length without bridges; ``bridges(keys, gap)`` those made at the
    greatest threshold. Joining is greedy by gap, so the bridges at a smaller threshold are the ones up to
    it: one join replaces one per step.
    """
    grid = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("x", F.col("k") * (most / steps))
    step = F.ceil(F.col("gap") / F.col("unit") / (most / steps) - 1e-12).cast("int")
    binned = bridges.join(base.select(*keys, "unit"), keys).withColumn("k", F.greatest(F.lit(0), step)).groupBy(*keys, "k").agg(F.sum("gap").alias("add"))
    order = W.partitionBy(*keys).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    return grid.join(binned, [*keys, "k"], "left").withColumn("y", F.col("total") + F.coalesce(F.sum("add").over(order), F.lit(0.0))).select(*keys, "x", "y")


def grid_pitch(words: DataFrame, keys: list[str], most_spread: float = 0.02) -> DataFrame:
    """Pitch of a drawing's module grid from labels (prefix, value, x, y, height).

    Labels of one prefix in one row or column (buckets of the median height) with at least three members, values
    that run one way and positions that grow give distances per unit; the most regular series wins, unless its
    spread exceeds ``most_spread``. Returns (keys, pitch, spread, n).
    """
    median = words.groupBy(*keys).agg(F.percentile("height", 0.5).alias("h"), F.count("*").alias("labels")).filter("labels >= 3")
    base = words.join(median, keys)
    tol = F.greatest(F.col("h"), F.lit(1e-6))
    axis = lambda name, along, across: base.select(*keys, "prefix", "value", F.lit(name).alias("axis"), F.col(along).alias("along"), F.floor(F.col(across) / tol).alias("bucket"))
    both = axis("row", "x", "y").union(axis("column", "y", "x"))
    series = [*keys, "axis", "prefix", "bucket"]
    order = W.partitionBy(*series).orderBy("along", "value")
    gaps = both.withColumns({"dv": F.lead("value").over(order) - F.col("value"), "dp": F.lead("along").over(order) - F.col("along")}).filter("dv IS NOT NULL")
    ratio = F.col("dp") / F.col("dv")
    rated = gaps.groupBy(*series).agg(
        F.count("*").alias("n"),
        F.min(F.when((F.col("dv") == 0) | (F.col("dp") <= 0), 0).otherwise(1)).alias("sound"),
        F.min(F.signum("dv")).alias("lo"),
        F.max(F.signum("dv")).alias("hi"),
        F.avg(F.abs(F.when(F.col("dv") != 0, ratio))).alias("pitch"),
        ((F.max(F.abs(F.when(F.col("dv") != 0, ratio))) - F.min(F.abs(F.when(F.col("dv") != 0, ratio)))) / F.avg(F.abs(F.when(F.col("dv") != 0, ratio)))).alias("spread"),
    )
    good = rated.filter("n >= 2 AND sound = 1 AND lo = hi")
    best = good.groupBy(*keys).agg(F.min(F.struct("spread", "axis", "prefix", "bucket", "pitch", "n")).alias("b"))
    return best.filter(F.col("b.spread") <= most_spread).select(*keys, "b.pitch", "b.spread", (F.col("b.n") + 1).alias("n"))


def comb_fit(marks: DataFrame, bars: DataFrame, keys: list[str], most: int = 40, near: float = 0.08, full: float = 0.95) -> DataFrame:
    """The finest even division of a bar whose ticks have marks: (keys, divisions, coverage).

    ``bars(keys, start, span)``, ``marks(keys, at)``. A division of n parts is covered by the share of its n + 1
    ticks with a mark within 8 % of a part. The finest with 95 % wins; where none has it, the coarsest with any.
    """
    ticks = bars.withColumn("n", F.explode(F.sequence(F.lit(2), F.lit(most)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    placed = ticks.withColumn("at", F.col("start") + F.col("k") * F.col("span") / F.col("n"))
    # a bar has a bounded number of ticks; its marks are gathered once, sorted and distinct
    gathered = marks.groupBy(*keys).agg(F.sort_array(F.collect_set("at")).alias("marks"))
    hit = F.exists("marks", lambda m: F.abs(m - F.col("at")) <= F.col("span") / F.col("n") * near)
    rated = placed.join(gathered, keys).withColumn("hit", hit).groupBy(*keys, "n").agg((F.count_if("hit") / (F.first("n") + 1)).alias("cover"))
    covered = rated.groupBy(*keys).agg(F.max(F.when(F.col("cover") >= full, F.struct("n", "cover"))).alias("fine"), F.min(F.when(F.col("cover") > 0, F.struct("n", "cover"))).alias("coarse"))
    pick = F.coalesce("fine", "coarse")
    return covered.select(*keys, F.coalesce(pick["n"], F.lit(0)).alias("divisions"), F.coalesce(pick["cover"], F.lit(0.0)).alias("coverage"))


def anchor_vote(votes: DataFrame, keys: list[str], share: float = 0.70) -> DataFrame:
    """Clusters (cluster, votes) taken in the order of votes until over ``share`` of all: adds ``cumulative`` and ``chosen``."""
    order = W.partitionBy(*keys).orderBy(F.desc("votes"), "cluster").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("votes").over(W.partitionBy(*keys))
    summed = votes.withColumns({"upto": F.sum("votes").over(order), "total": total})
    return summed.select(*keys, "cluster", "votes", (F.col("upto") / F.col("total")).alias("cumulative"), ((F.col("upto") - F.col("votes")) / F.col("total") <= share).alias("chosen"))
