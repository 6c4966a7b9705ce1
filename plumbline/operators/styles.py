"""Style clusters and the statistics that pipe selection reads."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.shared import cut
from .leaders import leaders, numbered


def positional(values: Column, p: float) -> Column:
    """The value at index int(n * p) of a sorted array, the last at most; null for an empty one."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.least(F.size(ordered) - 1, F.floor(F.size(ordered) * p).cast("int")))


def angle_histogram(segments: DataFrame, keys: list[str], bins: int = 12) -> DataFrame:
    """Length-weighted shares of undirected directions in 15-degree bins named 000, 015 ...: (keys, bin, share)."""
    length = G.distance("ax", "ay", "bx", "by_")
    angle = G.undirected_angle(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"))
    number = F.least(F.lit(bins - 1), F.floor(angle / (pi / bins)).cast("int"))
    binned = segments.withColumn("len", length).filter("len > 0").groupBy(*keys, F.format_string("%03d", number * (180 // bins)).alias("bin")).agg(F.sum("len").alias("s"))
    return binned.select(*keys, "bin", (F.col("s") / F.sum("s").over(W.partitionBy(*keys))).alias("share"))


def width_buckets(widths: DataFrame, keys: list[str], tolerance: float = 0.05) -> DataFrame:
    """Representative line widths: in ascending order, a width over 5 % above the last representative is a new one.

    The fold runs over a group's distinct widths (to 4 decimals), few whatever the number of rows.
    Returns (keys, representatives array<double>).
    """
    distinct = widths.filter("width > 0").groupBy(*keys).agg(F.array_sort(F.collect_set(F.round("width", 4))).alias("w"))
    last = lambda acc: F.element_at(acc, -1)
    fold = F.aggregate("w", F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) == 0) | ((x - F.try_element_at(acc, F.lit(-1))) / F.try_element_at(acc, F.lit(-1)) > tolerance), F.concat(acc, F.array(x))).otherwise(acc))
    return distinct.select(*keys, fold.alias("representatives"))


def nearest_bucket(width: Column, representatives: Column) -> Column:
    """Index of the representative nearest by relative distance, the first on ties."""
    rated = F.transform(representatives, lambda r, i: F.struct((F.abs(width - r) / r).alias("d"), i.alias("i")))
    return F.array_min(rated)["i"]


def colour_representatives(colours: DataFrame, keys: list[str], tolerance: float = 5.0) -> DataFrame:
    """Greedy colour clusters in the order of first use: (keys, r, g, b, colour_no).

    ``colours(keys, r, g, b, ordinal)``. A colour joins the first representative nearer than ``tolerance`` in
    Lab, else it becomes one. Distinct colours meet in cells of Lab as wide as the tolerance; who represents is settled in
    rounds (``leaders``), so no group is folded in one call.
    """
    lab = ("l", "aa", "bb")
    first = colours.groupBy(*keys, "r", "g", "b").agg(F.min("ordinal").alias("item")).withColumns(dict(zip(lab, G.srgb_to_lab("r", "g", "b"), strict=True)))
    first = cut(first.filter("item IS NOT NULL"))
    wide = first
    for x in lab:
        wide = wide.withColumn(f"c{x}", F.explode(F.array(*(F.floor(F.col(x) / tolerance) + k for k in (-1, 0, 1)))))
    other = first.select(*keys, F.col("item").alias("earlier"), *(F.col(x).alias(f"{x}2") for x in lab), *(F.floor(F.col(x) / tolerance).alias(f"c{x}") for x in lab))
    near = wide.join(other, [*keys, *(f"c{x}" for x in lab)]).filter("earlier < item").filter(G.delta_e(lab, tuple(f"{x}2" for x in lab)) < tolerance)
    number = numbered(leaders(first, near, keys), keys)
    return first.join(number, [*keys, "item"]).select(*keys, "r", "g", "b", F.col("number").cast("int").alias("colour_no"))


def sheet_summary(paths: DataFrame, keys: list[str], diagonal: float) -> DataFrame:
    """(keys, n_paths, has_layers, layers, median_width, epsilon): distinct layer names joined by ``;`` (a drawing's vocabulary), the median of the positive widths (0 without), and the length that counts as nothing."""
    median = F.percentile(F.when(F.col("width") > 0, F.col("width")), 0.5)
    layers = F.array_join(F.array_sort(F.collect_set("layer")), ";")
    g = paths.groupBy(*keys).agg(F.count("*").alias("n_paths"), F.coalesce(F.bool_or(F.col("layer") != ""), F.lit(False)).alias("has_layers"), layers.alias("layers"), median.alias("m"))
    return g.select(*keys, "n_paths", "has_layers", "layers", F.coalesce("m", F.lit(0.0)).alias("median_width"), F.coalesce("m", F.lit(diagonal * 1e-4)).alias("epsilon"))


def orthogonal_share(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, concentration, orthogonal): the largest share of the angle histogram, and that of the bins 000 and 090."""
    h = angle_histogram(segments, keys)
    return h.groupBy(*keys).agg(F.max("share").alias("concentration"), F.sum(F.when(F.col("bin").isin("000", "090"), F.col("share")).otherwise(0.0)).alias("orthogonal"))


def positional_values(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each group the values at index int(n * p) in ascending order, the last at most: (keys, one column for each share).

    Equal values are counted first and summed up in order, so no group is gathered in an array. Nulls don't count.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    ranked = counted.withColumns({"upto": upto, "all": F.sum("n").over(W.partitionBy(*keys))})
    place = lambda p: F.least(F.col("all") - 1, F.floor(F.col("all") * p))
    return ranked.groupBy(*keys).agg(*(F.min(F.when(F.col("upto") > place(p), F.col(value))).alias(name) for name, p in shares.items()))


#: Shares at which a profile gives a drawing's line widths.
WIDTH_SHARES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def width_percentiles(paths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p10, p25, p50, p75, p90): positional percentiles of the positive line widths, to 3 decimals; 0 without one."""
    found = positional_values(paths.filter("width > 0"), keys, "width", WIDTH_SHARES)
    return paths.select(*keys).distinct().join(found, keys, "left").select(*keys, *(F.round(F.coalesce(c, F.lit(0.0)), 3).alias(c) for c in WIDTH_SHARES))


def path_lengths(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path_id, len, x0, y0, x1, y1, width) of every path."""
    return segments.groupBy(*keys, "path_id").agg(F.sum(G.distance("ax", "ay", "bx", "by_")).alias("len"), F.min(F.least("ax", "bx")).alias("x0"), F.min(F.least("ay", "by_")).alias("y0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.max(F.greatest("ay", "by_")).alias("y1"), F.first("width").alias("width"))


def cluster_stats(segments: DataFrame, keys: list[str], page_area: float | Column, per_path: DataFrame | None = None) -> DataFrame:
    """Size, lengths, spread and box of every cluster; path lengths' positional p50 and p90. ``per_path``: its ``path_lengths`` where they are known."""
    per_path = path_lengths(segments, keys) if per_path is None else per_path
    g = per_path.groupBy(*keys).agg(F.count("*").alias("n_paths"), F.sum("len").alias("total"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("width").alias("width"))
    p = positional_values(per_path.filter("len > 0"), keys, "len", {"p50": 0.5, "p90": 0.9})
    return g.join(p, keys, "left").select(*keys, "n_paths", "total", "p50", "p90", G.box_area("x0", "y0", "x1", "y1").alias("box"), (G.box_area("x0", "y0", "x1", "y1") / page_area).alias("spread"), "width", "x0", "y0", "x1", "y1")


def quantised(paths: DataFrame, keys: list[str], tolerance: float = 5.0) -> DataFrame:
    """Stroke and fill colour numbers of every path: (keys, path_id, stroke_no, fill_no); see ``with_colours``."""
    return with_colours(paths, keys, tolerance).select(*keys, "path_id", "stroke_no", "fill_no")


def with_colours(paths: DataFrame, keys: list[str], tolerance: float = 5.0) -> DataFrame:
    """Paths with the numbers of their stroke and fill colour, ``stroke_no`` and ``fill_no``; null without that colour.

    ``paths(keys, path_id, kind, stroke, fill)``, colours structs (r, g, b). One quantiser serves both: colours count in the
    order of paths, the stroke before the fill; strokes only for the kinds s and fs, fills only for f and fs.
    """
    used = lambda c, kinds: F.when(F.col("kind").isin(*kinds), F.col(c))
    own = paths.withColumns({"_stroke": used("stroke", ("s", "fs")), "_fill": used("fill", ("f", "fs"))})
    seen = own.select(*keys, F.explode(F.array(F.struct((F.col("path_id") * 2).alias("ordinal"), F.col("_stroke").alias("c")), F.struct((F.col("path_id") * 2 + 1).alias("ordinal"), F.col("_fill").alias("c")))).alias("s")).select(*keys, "s.ordinal", "s.c.r", "s.c.g", "s.c.b").filter("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL")
    numbers = cut(colour_representatives(seen, keys, tolerance))  # written, so that joins know whether they are few
    named = lambda c: numbers.select(*keys, F.struct("r", "g", "b").alias(f"_{c}"), F.col("colour_no").alias(f"{c}_no"))
    return own.join(named("stroke"), [*keys, "_stroke"], "left").join(named("fill"), [*keys, "_fill"], "left").drop("_stroke", "_fill")


STYLE = ["stroke_no", "fill_no", "width_no", "dash_signature", "layer", "closed"]


def style_index(paths: DataFrame, lengths: DataFrame | None, keys: list[str], carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Style clusters of every drawing: (path -> cluster, clusters).

    ``paths(keys, path_id, kind, stroke, fill, width, dash_signature, layer, closed)``, ``lengths(keys, path_id, len)``
    (None: the paths have ``len``, and no path is dealt). Paths of equal stroke and fill colour number, width bucket, dash, layer and closing make a cluster; clusters are named c000, c001
    ... by descending total length, ties by their first path. Returns (keys, path_id, cluster_id, the ``carry`` columns of the path) and
    (keys, cluster_id, the six columns of STYLE, width, n_paths, total, share); every path is in one cluster. Widths and clusters
    of a drawing are few and go to its paths.
    """
    styled = with_colours(paths, keys).join(F.broadcast(cut(width_buckets(paths, keys))), keys, "left")
    if lengths is not None:
        styled = styled.join(lengths, [*keys, "path_id"], "left")
    styled = styled.withColumn("width_no", F.coalesce(nearest_bucket(F.col("width"), F.col("representatives")), F.lit(0))).withColumn("rep", F.get("representatives", F.col("width_no")))
    styled = styled.select(*keys, "path_id", *(F.col(c).alias(f"_{c}") for c in carry), *STYLE, "rep", "len")
    styled = styled if lengths is None else cut(styled)
    g = styled.groupBy(*keys, *STYLE).agg(F.count("*").alias("n_paths"), F.sum(F.coalesce("len", F.lit(0.0))).alias("total"), F.min("path_id").alias("first"), F.coalesce(F.max("rep"), F.lit(0.0)).alias("width"))
    # clusters of one drawing are few; a drawing is one window
    by_length = W.partitionBy(*keys).orderBy(F.round("total", 6).desc(), "first")
    named = g.withColumn("cluster_id", F.format_string("c%03d", F.row_number().over(by_length) - 1)).withColumn("share", F.coalesce(F.col("total") / F.nullif(F.sum("total").over(W.partitionBy(*keys)), F.lit(0.0)), F.lit(0.0)))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*keys, *STYLE]]
    named = cut(named)
    both = styled.alias("p").join(F.broadcast(named.select(*keys, *STYLE, "cluster_id")).alias("c"), same)
    return both.select(*(F.col(f"p.{k}") for k in keys), F.col("p.path_id"), F.col("c.cluster_id"), *(F.col(f"p._{c}").alias(c) for c in carry)), named.drop("first")


def rejection(median_length: Column) -> Column:
    """Why a cluster can't be pipes, null where it may: (total, outside, n_paths, p90, p50, connectivity, concentration, wall_share)."""
    many = F.col("n_paths") >= 30
    return (
        F.when(F.col("total") <= 0, "degenerate")
        .when(F.col("outside") > 0.5, "frame")
        .when(many & (F.col("p90") < median_length) & (F.col("connectivity") < 0.25), "text_or_glyph")
        .when((F.col("concentration") > 0.8) & many & (F.col("p50") < median_length), "hatch")
        .when(F.col("wall_share") > 0.5, "wall")
    )


def structural_score(median_width: Column, diagonal: float | Column) -> Column:
    """0 to 1 from line width, connectivity, reach and spread of a cluster."""
    one = F.lit(1.0)
    tenth = F.greatest((diagonal if isinstance(diagonal, Column) else F.lit(diagonal)) * 0.01, F.lit(1e-9))
    return F.when(F.col("width") > median_width, 0.40).otherwise(0.0) + F.least(one, F.col("connectivity")) * 0.25 + F.least(one, F.col("p90") / tenth) * 0.20 + F.least(one, F.col("spread") / 0.2) * 0.15


def classify(clusters: DataFrame, rule_tokens: list[str] | Column | None, median_width: Column, least_connectivity: float = 0.10, anchored: Column | None = None) -> DataFrame:
    """``verdict`` and ``step`` of every cluster: ``pipe`` or why not; a cluster is never dropped.

    ``clusters`` has reason (see rejection), layer, width, connectivity. With a layer rule (a list of tokens, or an array column
    that is null where none applies), its matches that are drawn over 2 % wider than the median are pipes. Else, wide and
    connected clusters pass the gate; of them, those that labels voted for (``anchored``) are pipes, or all where there was no vote (null).
    """
    from ..functions.text import layer_matches, layer_matches_any

    wide = F.col("width") > median_width * 1.02
    chosen = F.lit(True) if anchored is None else F.coalesce(anchored, F.lit(True))
    gate = F.when(~wide, "thin_for_service_layer").when(F.col("connectivity") <= least_connectivity, "unconnected").when(~chosen, "not_pipe_style").otherwise("pipe")
    gated = F.when(~wide | (F.col("connectivity") <= least_connectivity), "structural_gate").otherwise("structural_gate" if anchored is None else F.when(anchored.isNull(), "structural_gate").otherwise("style_vote"))
    if rule_tokens is None:
        verdict, step = gate, gated
    else:
        given = F.lit(True) if isinstance(rule_tokens, list) else rule_tokens.isNotNull()
        hit = layer_matches(F.col("layer"), rule_tokens) if isinstance(rule_tokens, list) else layer_matches_any(F.col("layer"), rule_tokens)
        ruled = F.when(hit & wide, "pipe").when(~hit, "not_in_layer_rule").otherwise("thin_for_service_layer")
        verdict, step = F.when(given, ruled).otherwise(gate), F.when(given, F.lit("layer_rule")).otherwise(gated)
    return clusters.withColumns({"verdict": F.coalesce("reason", verdict), "step": F.when(F.col("reason").isNotNull(), "negative_filter").otherwise(step)})
