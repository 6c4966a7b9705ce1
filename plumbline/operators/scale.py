"""Scale of a drawing from independent geometric sources that must agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import ordered as O
from . import spatial as S

#: What a grid label or a scale bar may stand for, in millimetres (fixed values).
GRID_UNITS_MM = (10.0, 100.0, 1000.0)
BAR_SPANS_MM = (1000.0, 2000.0, 5000.0, 10000.0, 20000.0, 50000.0, 100000.0)
#: Wall thickness that is plausible, in millimetres.
WALL_MM = (60.0, 500.0)


def candidates(sources: DataFrame, keys: list[str]) -> DataFrame:
    """Standard scales each source may mean: (keys, source, scale, raw).

    ``sources(keys, source, pitch, meanings array<double>)``: the pitch in points may stand for any of the
    meanings (mm). Of meanings with the same standard scale the last counts.
    """
    each = sources.select(*keys, "source", "pitch", F.posexplode("meanings").alias("ordinal", "mm"))
    raw = F.col("mm") / (F.col("pitch") * G.MM_PER_PT)
    rated = each.withColumn("raw", raw).withColumn("scale", G.snap_scale("raw")).filter("scale IS NOT NULL AND pitch > 0")
    return rated.groupBy(*keys, "source", "scale").agg(F.max_by("raw", "ordinal").alias("raw"))


def vote(rated: DataFrame, walls: DataFrame, keys: list[str], tolerance_pct: float = 0.5) -> DataFrame:
    """The scale of every drawing, or a refusal: (keys, scale, verified, support, surviving, error_pct, flags).

    Scales with the most sources survive; of them, those that make the modal wall spacing (``walls(keys, mode)``, points)
    plausible, if any does. The scale is delivered only if one survives, two sources support it, and they agree
    within ``tolerance_pct``; else it is null.
    """
    support = rated.groupBy(*keys, "scale").agg(F.count("*").alias("support"), F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.avg("raw").alias("mean"))
    most = support.groupBy(*keys).agg(F.max("support").alias("most"))
    best = support.join(most, keys).filter("support = most").join(walls, keys, "left")
    mm = F.col("mode") * G.MM_PER_PT * F.col("scale")
    gated = best.withColumn("plausible", F.coalesce(F.col("mode") > 0, F.lit(False)) & mm.between(*WALL_MM))
    flags_of = gated.groupBy(*keys).agg(F.count("*").alias("before"), F.count_if("plausible").alias("n_plausible"), F.first("mode").alias("mode"))
    left = gated.join(flags_of.select(*keys, "before", "n_plausible"), keys).filter("n_plausible = 0 OR plausible")
    one = left.groupBy(*keys).agg(F.count("*").alias("surviving"), F.min(F.struct("scale", "support", "lo", "hi", "mean")).alias("v"), F.first("before").alias("before"), F.first("n_plausible").alias("n_plausible"), F.first("mode").alias("mode"))
    error = F.when(F.col("v.support") > 1, (F.col("v.hi") - F.col("v.lo")) / F.col("v.mean") * 100)
    verified = (F.col("v.support") >= 2) & (F.col("surviving") == 1) & (F.coalesce(error, F.lit(0.0)) <= tolerance_pct)
    flags = F.array_compact(
        F.array(
            F.when(F.col("mode").isNull() | (F.col("mode") <= 0), "wall:not_found"),
            F.when((F.col("mode") > 0) & (F.col("n_plausible") == 0), "wall_gate_rejected_all"),
            F.when((F.col("n_plausible") > 0) & (F.col("n_plausible") < F.col("before")), "wall_gate_rejected"),
            F.when(F.col("v.support") < 2, "single_source_only"),
            F.when(F.col("surviving") > 1, "ambiguous"),
            F.when(error > tolerance_pct, "sources_disagree"),
        )
    )
    return one.select(*keys, F.when(verified, F.col("v.scale")).alias("scale"), verified.alias("verified"), F.col("v.support").alias("support"), "surviving", error.alias("error_pct"), F.concat_ws(",", flags).alias("flags"))


def scalebars(paths: DataFrame, plans: DataFrame, keys: list[str], diagonal: float | Column, most: int = 6, least_marks: int = 4, least_cover: float = 0.8) -> DataFrame:
    """The scale bar of every drawing that has one: (keys, path_id, pitch, divisions, coverage, marks); pitch is its length.

    ``paths(keys, path_id, kind, x0, y0, x1, y1)``, ``plans(keys, px0, py0, px1, py1)``. A bar is filled, at least 20 times
    as long as wide and 2 to 35 % of the diagonal; the first ``most``, those outside of the plan first and the longest of these
    first, are tried (ties: the first path). The middles of all other paths in the band around a bar are its
    marks; the first bar with enough marks whose comb is covered enough counts.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    long, short = F.greatest(w, h), F.least(w, h)
    filled = paths.filter(F.col("kind").isin("f", "fs") & (short > 0) & (long / short >= 20) & (long >= diagonal * 0.02) & (long <= diagonal * 0.35))
    outside = F.coalesce(~G.box_inside(("x0", "y0", "x1", "y1"), ("px0", "py0", "px1", "py1")), F.lit(True))
    ranked = filled.join(F.broadcast(plans), keys, "left").withColumns({"outside": outside, "long": long, "flat": w >= h}).withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("outside"), F.desc("long"), "path_id"))).filter(F.col("rank") <= most)
    bars = ranked.select(*keys, "rank", F.col("path_id").alias("bar"), "long", "flat", F.when(F.col("flat"), F.col("x0")).otherwise(F.col("y0")).alias("start"), *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    # at most a few bars in a drawing: they go to its paths, then the band
    band = [F.col("bx0") - F.col("long") * 0.05, F.col("by0") - F.col("long") * 0.25, F.col("bx1") + F.col("long") * 0.05, F.col("by1") + F.col("long") * 0.25]
    in_band = paths.join(F.broadcast(bars), keys).filter((F.col("path_id") != F.col("bar")) & G.box_inside(("x0", "y0", "x1", "y1"), tuple(band)))
    mx, my = G.box_middle("x0", "y0", "x1", "y1")
    marks = in_band.select(*keys, "rank", F.when(F.col("flat"), mx).otherwise(my).alias("at"))
    counted = marks.groupBy(*keys, "rank").agg(F.count("*").alias("n_marks")).filter(F.col("n_marks") >= least_marks)
    tried = bars.join(counted, [*keys, "rank"]).withColumn("span", F.col("long"))
    fits = O.comb_fit(marks, tried, [*keys, "rank"]).filter((F.col("divisions") > 0) & (F.col("coverage") >= least_cover))
    first = tried.join(fits, [*keys, "rank"]).groupBy(*keys).agg(F.min_by(F.struct(F.col("bar").alias("path_id"), F.col("long").alias("pitch"), "divisions", "coverage", F.col("n_marks").alias("marks")), "rank").alias("s"))
    return first.select(*keys, "s.*")


def wall_modes(segments: DataFrame, clusters: DataFrame, keys: list[str], cluster: str, diagonal: float | Column, most: int = 6, least_pairs: int = 10) -> DataFrame:
    """The usual distance of wall lines: (keys, mode, n_modes), the median of the modal spacings of the most orthogonal clusters.

    ``segments(keys, cluster, path_id, seg_no, ax, ay, bx, by_)``; ``clusters(keys, cluster, n_paths, orthogonal, spread, total)``: the
    ``most`` longest of those with 20 paths, over 70 % orthogonal and a spread over 5 %. Spacings up to 1.2 % of the diagonal
    of segments over 0.1 % of it; a cluster needs ``least_pairs``. ``diagonal``: a length, or a column of the segments that is constant in a drawing.
    """
    good = clusters.filter("n_paths >= 20 AND orthogonal > 0.7 AND spread > 0.05").withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.round("total", 6).desc(), cluster))).filter(F.col("rank") <= most).select(*keys, cluster)
    wide = diagonal if isinstance(diagonal, Column) else F.lit(float(diagonal))
    pool = segments.withColumn("reach", wide * 0.012).filter(G.distance("ax", "ay", "bx", "by_") > wide * 0.001).join(F.broadcast(good), [*keys, cluster], "left_semi")
    group = [*keys, cluster]
    lines = S.axis_lines(pool, [*group, "reach"])
    # of equally frequent spacings the one of the first pair: flat lines before upright ones, then by place
    counted = S.spacing_counts(lines, [*group, "reach"], F.col("reach"), 0.5, 0.02).withColumn("pairs", F.sum("n").over(W.partitionBy(*group))).filter(F.col("pairs") >= least_pairs)
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("n"), "first"))
    modes = counted.withColumn("place", place).filter("place = 1")
    return modes.groupBy(*keys).agg(F.percentile("spacing", 0.5).alias("mode"), F.count("*").alias("n_modes"))


def reference_matches(pitch: Column, divisions: Column, known_pitch: Column, known_divisions: Column) -> Column:
    """Whether a scale bar is the one that a project was calibrated with: within 0.5 % as long, with as many divisions."""
    near = F.abs(pitch - known_pitch) / known_pitch <= 0.005
    return F.coalesce((known_pitch > 0) & near & (divisions == known_divisions), F.lit(False))


def reference_from(scales: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """What a project can reuse of verified drawings: (keys, pitch, divisions, span_mm); no row without a verified scale or a bar."""
    good = scales.filter("verified AND scale > 0").join(bars, keys)
    return good.select(*keys, "pitch", "divisions", F.round(F.col("pitch") * G.MM_PER_PT * F.col("scale"), 1).alias("span_mm"))


def sources_of(grids: DataFrame, bars: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """All sources for ``candidates``: grids (keys, pitch), bars (keys, pitch, divisions), and bars that match their project's reference (keys, known_pitch, known_divisions, known_span_mm)."""
    array = lambda values: F.array(*(F.lit(float(v)) for v in values))
    row = lambda df, name, meanings: df.select(*keys, F.lit(name).alias("source"), "pitch", meanings.alias("meanings"))
    known = bars.join(references, keys).filter(reference_matches(F.col("pitch"), F.col("divisions"), F.col("known_pitch"), F.col("known_divisions")))
    return row(grids, "grid", array(GRID_UNITS_MM)).unionByName(row(bars, "scalebar", array(BAR_SPANS_MM))).unionByName(row(known, "project_scalebar", F.array("known_span_mm")))
