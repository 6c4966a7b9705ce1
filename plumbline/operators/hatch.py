"""Hatched areas: which clusters are hatching, and the mask that they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import spatial as S


def hatch_clusters(segments: DataFrame, keys: list[str], plan_area: Column | float, most_pitch: Column | float, least_paths: int = 60, least_regular: float = 0.80, share: float = 0.5, counted: DataFrame | None = None) -> DataFrame:
    """Clusters of a drawing that hatch its plan: (keys, pitch, regularity, coverage).

    ``keys`` begins with the drawing; ``plan_area`` and ``most_pitch`` may be columns of the segments that are constant in a drawing. A cluster needs ``least_paths`` paths, a regular pitch of at most ``most_pitch``,
    and at least ``share`` of the coverage (cells of the pitch's size over the plan's area) of the drawing's widest candidate.
    ``counted(keys, n)``: the clusters' paths, where they are known. Clusters of a drawing are few: what is known of them goes to their segments.
    """
    many = segments.groupBy(*keys).agg(F.count_distinct("path_id").alias("n")) if counted is None else counted
    pool = segments.join(F.broadcast(many.filter(F.col("n") >= least_paths).select(*keys)), keys, "left_semi")
    pool = pool.withColumns({"most": most_pitch if isinstance(most_pitch, Column) else F.lit(float(most_pitch)), "area": plan_area if isinstance(plan_area, Column) else F.lit(float(plan_area))})
    rated = S.parallel_pitch(pool, [*keys, "most", "area"]).filter((F.col("pitch") > 0) & (F.col("pitch") <= F.col("most")) & (F.col("regularity") >= least_regular)).drop("most")
    pool = pool.drop("most", "area")
    n = F.greatest(F.lit(1), (G.distance("ax", "ay", "bx", "by_") / F.col("pitch")).cast("int"))
    sampled = pool.join(F.broadcast(rated), keys).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    t = F.col("k") / F.col("n")
    cell = lambda a, b: G.grid_cell(F.col(a) + (F.col(b) - F.col(a)) * t, F.col("pitch"))
    cells = sampled.select(*keys, "pitch", "regularity", "area", cell("ax", "bx").alias("cx"), cell("ay", "by_").alias("cy")).distinct()
    covered = cells.groupBy(*keys, "pitch", "regularity", "area").agg((F.count("*") * F.first("pitch") * F.first("pitch") / F.first("area")).alias("coverage")).drop("area")
    return covered.withColumn("top", F.max("coverage").over(W.partitionBy(keys[0]))).filter(F.col("coverage") >= F.col("top") * share).drop("top")


def hatch_mask(segments: DataFrame, hatching: DataFrame, keys: list[str], cell: float | str) -> DataFrame:
    """Cells (of a size, or of the size in a column of the segments) that hatching covers, widened by half of its own pitch so that the lines' gaps close: (drawing key, cx, cy)."""
    drawing = keys[0]
    lines = segments.join(F.broadcast(hatching.select(*keys, "pitch")), keys).withColumn("cell", F.col(cell) if isinstance(cell, str) else F.lit(float(cell)))
    seed = S.covered_cells(lines, [*keys, "pitch", "cell"], F.col("cell"))
    radius = F.greatest(F.lit(1), F.ceil(F.col("pitch") / F.col("cell") / 2)).cast("int")
    wide = seed.withColumn("dx", F.explode(F.sequence(-radius, radius))).withColumn("dy", F.explode(F.sequence(-radius, radius)))
    return wide.select(drawing, (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy")).distinct()
