"""Zones of a page: rectangles, frames, panels, and where paths lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.shared import cut
from . import network as N
from . import spatial as S


def path_boxes(segments: DataFrame, keys: list[str]) -> DataFrame:
    """The box of every path: (keys, path_id, x0, y0, x1, y1)."""
    lo, hi = lambda a, b: F.min(F.least(a, b)), lambda a, b: F.max(F.greatest(a, b))
    return segments.groupBy(*keys, "path_id").agg(lo("ax", "bx").alias("x0"), lo("ay", "by_").alias("y0"), hi("ax", "bx").alias("x1"), hi("ay", "by_").alias("y1"))


def measured_paths(paths: DataFrame) -> DataFrame:
    """Paths with an array ``segments`` of (seg_no, ax, ay, bx, by_): adds len, x0, y0, x1, y1 and ``rectangular`` (see the function of that name), null without a segment.

    All of it is read from the row itself, so nothing is dealt.
    """
    ends = lambda s: G.distance(s["ax"], s["ay"], s["bx"], s["by_"])
    some = F.size("segments") > 0
    side = lambda f, g, a, b: f(F.transform("segments", lambda s: g(s[a], s[b])))
    boxed = paths.withColumns({
        "len": F.when(some, F.aggregate("segments", F.lit(0.0), lambda sum_, s: sum_ + ends(s))),
        "x0": side(F.array_min, F.least, "ax", "bx"), "y0": side(F.array_min, F.least, "ay", "by_"), "x1": side(F.array_max, F.greatest, "ax", "bx"), "y1": side(F.array_max, F.greatest, "ay", "by_"),
    })
    tol = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * 0.02
    slanted = F.exists("segments", lambda s: (F.abs(s["ax"] - s["bx"]) > tol) & (F.abs(s["ay"] - s["by_"]) > tol))
    sides = F.size(F.filter("segments", lambda s: ends(s) > 0)).between(3, 8)
    return boxed.withColumn("rectangular", F.when(F.size("segments") >= 3, sides & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & ~slanted).otherwise(F.when(some, False)))


def zone_of(box: tuple, zones: list[tuple], share: float = 0.6) -> Column:
    """The kind of the first zone (kind, x0, y0, x1, y1) that holds ``share`` of a box, else ``frame``."""
    out = F.lit("frame")
    for kind, *outer in reversed(zones):
        out = F.when(G.overlap_fraction(box, tuple(outer)) >= share, kind).otherwise(out)
    return out


def classify_boxes(boxes: DataFrame, zones: DataFrame, keys: list[str], share: float = 0.6) -> DataFrame:
    """The same with zones in a table (keys, ordinal, kind, zx0, zy0, zx1, zy1), a bounded number for each drawing: a drawing's zones go to its boxes in one row, so no box is dealt."""
    sides = ("zx0", "zy0", "zx1", "zy1")
    listed = zones.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ordinal", "kind", *sides))).alias("_zones"))
    held = F.filter("_zones", lambda z: G.overlap_fraction(("x0", "y0", "x1", "y1"), tuple(z[c] for c in sides)) >= share)
    return boxes.join(F.broadcast(listed), keys, "left").withColumn("zone", F.coalesce(F.get(held, F.lit(0))["kind"], F.lit("frame"))).drop("_zones")


def rectangular(segments: DataFrame, keys: list[str], boxes: DataFrame | None = None) -> DataFrame:
    """(keys, path_id, rectangular): 3 to 8 segments with length, all axis-parallel within 2 % of the box's shorter side."""
    box = path_boxes(segments, keys) if boxes is None else boxes
    g = segments.join(box, [*keys, "path_id"]).groupBy(*keys, "path_id", "x0", "y0", "x1", "y1")
    tol = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * 0.02
    slanted = (F.abs(F.col("ax") - F.col("bx")) > tol) & (F.abs(F.col("ay") - F.col("by_")) > tol)
    stats = g.agg(F.count_if(G.distance("ax", "ay", "bx", "by_") > 0).alias("n"), F.count_if(slanted).alias("slanted"))
    return stats.select(*keys, "path_id", ((F.col("n") >= 3) & (F.col("n") <= 8) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.col("slanted") == 0)).alias("rectangular"))


def frames(rectangles: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """The largest rectangle (path_id, x0, y0, x1, y1) of 30 to 99.5 % of the page (keys, width, height), of equal ones the first path; the page itself without one."""
    area = G.box_area("x0", "y0", "x1", "y1")
    share = area / (F.col("width") * F.col("height"))
    box = F.struct("x0", "y0", "x1", "y1")
    best = rectangles.join(pages, keys).filter(share.between(0.30, 0.995)).groupBy(*keys).agg(F.max(F.struct(area.alias("area"), (-F.col("path_id")).alias("first"), box.alias("f"))).alias("m")).select(*keys, F.col("m.f").alias("f"))
    page = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))
    return pages.join(best, keys, "left").select(*keys, F.coalesce("f", page).alias("f")).select(*keys, "f.*")


def densities(boxes: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """Paths per 10,000 square points inside each box: (keys, box_id, n_inside, density).

    ``boxes(keys, box_id, x0, y0, x1, y1)``; a path (keys, path_id, x0, y0, x1, y1) is inside with more than 90 % of its own box, so
    its middle is, too: an equi-join of the middle's cell with the cells of a box. Cells go by levels of the boxes' longer side
    (powers of two), so a box is written to at most four of them and a middle is looked up once for each level its drawing has.
    """
    level = F.greatest(F.lit(-20), F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-6))))).cast("int")
    sized = boxes.select(*keys, "box_id", "x0", "y0", "x1", "y1").withColumn("level", level)
    size = F.pow(F.lit(2.0), F.col("level"))
    along = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    spread = sized.withColumn("cx", along("x0", "x1")).withColumn("cy", along("y0", "y1")).select(*keys, "level", "box_id", "cx", "cy", *[F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")])
    levels = sized.groupBy(*keys).agg(F.collect_set("level").alias("levels"))
    mx, my = G.box_middle("x0", "y0", "x1", "y1")
    middles = paths.select(*keys, "x0", "y0", "x1", "y1").join(levels, keys).withColumn("level", F.explode("levels")).drop("levels").withColumns({"cx": F.floor(mx / size), "cy": F.floor(my / size)})
    inside = middles.join(spread, [*keys, "level", "cx", "cy"]).filter(G.overlap_fraction(("x0", "y0", "x1", "y1"), ("ox0", "oy0", "ox1", "oy1")) > 0.9).groupBy(*keys, "box_id").agg(F.count("*").alias("n_inside"))
    area = G.box_area("x0", "y0", "x1", "y1")
    return boxes.join(inside, [*keys, "box_id"], "left").select(*keys, "box_id", F.coalesce("n_inside", F.lit(0)).alias("n_inside"), F.when(area > 0, F.coalesce("n_inside", F.lit(0)) / (area / 10000)).otherwise(0.0).alias("density"))


def detect(segments: DataFrame | None, pages: DataFrame, keys: list[str], paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Frames and zones of drawings: (keys, x0, y0, x1, y1) and (keys, ordinal, kind, zx0, zy0, zx1, zy1, density).

    ``pages(keys, width, height)``. Panels are boxes of 0.4 to 60 % of the frame, nine tenths inside it, that touch its edge or are
    more than twice as dense as the page; they are merged, and the plan is the largest rectangle free of them.
    The plan is zone 0; panels follow by descending area (ties: from the left, then from the top). ``paths(keys, path_id, x0, y0,
    x1, y1, rectangular)``: what the segments say, where it is known.
    """
    sides = ("x0", "y0", "x1", "y1")
    if paths is None:
        paths = cut(path_boxes(segments, keys))
        rects = rectangular(segments, keys, paths).filter("rectangular").join(paths, [*keys, "path_id"])
    else:
        rects, paths = paths.filter("rectangular"), paths.select(*keys, "path_id", *sides)
    rects = cut(rects.select(*keys, "path_id", *sides))
    frame = cut(frames(rects, pages, keys))
    of = frame.select(*keys, *[F.col(c).alias(f"f{c}") for c in ("x0", "y0", "x1", "y1")])
    area, whole = G.box_area("x0", "y0", "x1", "y1"), G.box_area("fx0", "fy0", "fx1", "fy1")
    likely = rects.join(of, keys).filter((area >= whole * 0.004) & (area <= whole * 0.6) & (G.overlap_fraction(("x0", "y0", "x1", "y1"), ("fx0", "fy0", "fx1", "fy1")) >= 0.9)).withColumnRenamed("path_id", "box_id")
    likely = cut(likely)
    dense = densities(likely.select(*keys, "box_id", "x0", "y0", "x1", "y1"), paths, keys)
    mean = paths.groupBy(*keys).agg(F.count("*").alias("n")).join(of, keys).select(*keys, (F.col("n") / F.greatest(whole / 10000, F.lit(1e-9))).alias("mean"))
    near = F.greatest(F.col("fx1") - F.col("fx0"), F.col("fy1") - F.col("fy0")) * 0.02
    touches = F.least(*(F.abs(F.col(c) - F.col(f"f{c}")) for c in ("x0", "y0", "x1", "y1"))) < near
    chosen = likely.join(dense, [*keys, "box_id"]).join(mean, keys).filter(touches | (F.col("density") > F.col("mean") * 2)).withColumn("ordinal", F.col("box_id"))
    panels = cut(N.merge_boxes(chosen.select(*keys, "ordinal", "x0", "y0", "x1", "y1"), keys))
    order = F.row_number().over(S.W.partitionBy(*keys).orderBy(area.desc(), "x0", "y0", "x1", "y1"))
    numbered = panels.withColumn("box_id", order)
    rated = numbered.join(densities(numbered, paths, keys), [*keys, "box_id"]).join(of, keys)
    kind = panel_kind(("x0", "y0", "x1", "y1"), ("fx0", "fy0", "fx1", "fy1"), F.col("density"))
    zone = lambda df, n, k, d: df.select(*keys, n.cast("int").alias("ordinal"), k.alias("kind"), *[F.col(c).alias(f"z{c}") for c in ("x0", "y0", "x1", "y1")], d.alias("density"))
    plan = N.largest_free_rectangle(frame, panels, keys)
    return frame, zone(plan, F.lit(0), F.lit("plan"), F.lit(None).cast("double")).unionByName(zone(rated, F.col("box_id"), kind, F.col("density")))


def panel_kind(box: tuple, frame: tuple, density: Column) -> Column:
    """titleblock, legend or detail by place, shape and density."""
    x0, y0, x1, y1 = map(G.c, box)
    fx0, fy0, fx1, fy1 = map(G.c, frame)
    right, low = (x0 - fx0) / (fx1 - fx0) > 0.66, (y0 - fy0) / (fy1 - fy0) > 0.66
    tall = (y1 - y0) / F.greatest(x1 - x0, F.lit(1e-9)) > 1.2
    return F.when(right & low, "titleblock").when(right & (tall | (density > 0.5)), "legend").otherwise("detail")
