"""The whole measurement of many drawings: one DataFrame plan, keyed by drawing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import delivery as D
from ..operators import hatch as H
from ..operators import layers as L
from ..operators import network as N
from ..operators import ordered as O
from ..operators import scale as SC
from ..operators import spatial as S
from ..operators import styles as ST
from ..operators import zones as Z
from ..sources import adapter as A
from ..sources.shared import cut
from .registry import query

DRAWING = ["drawing_id"]
CLUSTER = ["drawing_id", "cluster_id"]
_ENDS = ("ax", "ay", "bx", "by_")


@dataclass
class Measurement:
    """Every path is in accepted or blocked; every metre of an accepted path's runs is in quantities, counted or masked."""

    triage: DataFrame
    zones: DataFrame
    bars: DataFrame
    scales: DataFrame
    clusters: DataFrame
    accepted: DataFrame
    blocked: DataFrame
    strands: DataFrame
    verticals: DataFrame
    quantities: DataFrame
    delivery: DataFrame
    facts: DataFrame
    widths: DataFrame


def profile(m: Measurement) -> DataFrame:
    """(drawing_id, json): what is kept of a measured drawing.

    Its facts, line widths by percentile and the field that tells its pipes' status; under ``clusters`` every style with its verdict and
    score, under ``zones`` the plan and the panels. Clusters and zones of one drawing are few.
    """
    pipes = m.clusters.filter("verdict = 'pipe'").select(*DRAWING, F.col("cluster_id").alias("cluster"), "layer")
    status = D.status_rule(pipes, DRAWING).select(*DRAWING, F.col("field").alias("status_field"), F.col("mapping").alias("status_mapping"))
    facts = m.facts.join(m.widths, DRAWING, "left").join(status, DRAWING, "left")
    clusters = m.clusters.select(*DRAWING, "cluster_id", "layer", "n_paths", "total", F.col("verdict").alias("class"), "step", F.round("score", 3).alias("confidence"))
    return D.as_json(facts, clusters=clusters, zones=m.zones)


def _selected(shape: DataFrame, stats: DataFrame, angles: DataFrame, boxes: DataFrame, clusters: DataFrame, paths: DataFrame, zones: DataFrame, scales: DataFrame, pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """Clusters with their statistics, verdict and step."""
    counted = stats.select(*CLUSTER, "n_paths")
    stats = stats.drop("total", "n_paths", "width", "spread")
    spread = (F.col("box") / (F.col("page_width") * F.col("page_height"))).alias("spread")
    width = F.when(F.col("width") > 0, F.col("width"))
    # one row a drawing or a cluster goes to all segments: none of them is dealt by its name
    eps = paths.groupBy(*DRAWING).agg(F.percentile(width, 0.5).alias("median_width")).join(pages, DRAWING, "right").select(*DRAWING, F.coalesce("median_width", F.col("diagonal") * 1e-4).alias("eps"))
    touching = S.connectivity(shape.join(F.broadcast(cut(eps)), DRAWING), CLUSTER, "eps", counted).select(*CLUSTER, "connectivity")
    weight = F.greatest("len", F.lit(1e-9))
    zoned = Z.classify_boxes(boxes, zones, DRAWING)
    outside = zoned.groupBy(*CLUSTER).agg((F.sum(F.when(F.col("zone") == "plan", 0.0).otherwise(weight)) / F.sum(weight)).alias("outside"))
    known = scales.filter("scale IS NOT NULL").select(*DRAWING, G.points_of_mm(SC.WALL_MM[0], "scale").alias("lo"), G.points_of_mm(SC.WALL_MM[1], "scale").alias("hi"))
    walls = S.paired_share(shape.join(F.broadcast(known), DRAWING), CLUSTER, F.col("lo"), F.col("hi")).select(*CLUSTER, F.col("share").alias("wall_share"))
    w_med = ST.positional_values(paths.filter("width > 0"), DRAWING, "width", {"w_med": 0.5})
    len_med = ST.positional_values(stats.filter("p50 > 0"), DRAWING, "p50", {"len_med": 0.5})
    c = clusters
    for more, keys in ((stats, CLUSTER), (angles, CLUSTER), (touching, CLUSTER), (outside, CLUSTER), (walls, CLUSTER), (w_med, DRAWING), (len_med, DRAWING), (pages, DRAWING), (scales.select(*DRAWING, "scale"), DRAWING), (tokens, DRAWING)):
        c = c.join(more, keys, "left")
    c = c.select("*", spread).fillna(0.0, ["concentration", "orthogonal", "connectivity", "outside", "wall_share", "p50", "p90", "w_med", "len_med"])
    refused = F.when(F.col("scale").isNull(), "no_scale")
    judged = ST.classify(c.withColumn("reason", F.coalesce(refused, ST.rejection(F.col("len_med")))), F.col("tokens"), F.col("w_med"))
    return judged.withColumn("score", ST.structural_score(F.col("w_med"), F.col("diagonal")))


def _nested(paths: DataFrame, segments: DataFrame | None) -> DataFrame:
    """A row for each path with its segments in order, and whether ``paths`` knows it; it is dealt to its segments once, here."""
    if segments is None:
        return paths.withColumn("known", F.lit(True))
    each = segments.groupBy(*DRAWING, "path_id").agg(F.array_sort(F.collect_list(F.struct("seg_no", *_ENDS))).alias("segments"))
    return cut(paths.withColumn("known", F.lit(True)).join(each, [*DRAWING, "path_id"], "full"))


def measure(paths: DataFrame, segments: DataFrame | None = None, pages: DataFrame | None = None, words: DataFrame | None = None, rules: DataFrame | None = None, references: DataFrame | None = None) -> Measurement:
    """Measure the pipes of all drawings.

    ``paths(drawing_id, path_id, layer, kind, stroke, fill, width, dash_signature, closed)``; ``segments(drawing_id, path_id, seg_no, ax,
    ay, bx, by_)``, or None where ``paths`` has them in an array ``segments`` as the record table does (then ``paths`` is read many times and should be a written table); ``pages(drawing_id, width, height)``; ``words(drawing_id, text, x0, y0, x1, y1)``; ``rules(project_key, tokens, valid)``
    and ``references(project_key, known_pitch, known_divisions, known_span_mm)`` of calibrated projects.

    Steps: style clusters; frame, panels and plan; scale sources (grid words, scale bar, the project's bar), walls and vote; negative
    filters, layer rule or gates; straight runs, bridges up to the plateau of the sweep, polylines; strands split at junctions;
    hatch mask; vertical symbols; metres. A drawing whose scale isn't verified is refused: its paths are
    blocked with reason ``no_scale`` and no length is given.
    """
    spark = paths.sparkSession
    whole = Z.measured_paths(_nested(paths, segments))
    paths = whole.filter("known")
    words = words if words is not None else spark.createDataFrame([], "drawing_id long, text string, x0 double, y0 double, x1 double, y1 double")
    rules = rules if rules is not None else spark.createDataFrame([], "project_key string, tokens array<string>, valid boolean")
    references = references if references is not None else spark.createDataFrame([], "project_key string, known_pitch double, known_divisions int, known_span_mm double")
    pages = cut(pages.select(*DRAWING, F.col("width").alias("page_width"), F.col("height").alias("page_height"), F.hypot("width", "height").alias("diagonal")))
    per_page = F.broadcast(pages)  # a row a drawing
    sheet = pages.select(*DRAWING, F.col("page_width").alias("width"), F.col("page_height").alias("height"))

    by_path, clusters = ST.style_index(paths, None, DRAWING, carry=("kind", "width", "segments"))
    by_path, clusters = cut(by_path.sortWithinPartitions(*CLUSTER, "path_id")), clusters.withColumnRenamed("width", "cluster_width")  # in order, rows that are dealt pack better
    shape = by_path.select(*CLUSTER, "path_id", F.explode("segments").alias("s")).select(*CLUSTER, "path_id", "s.*")
    drawn = Z.measured_paths(by_path).filter("len IS NOT NULL").select(*CLUSTER, "path_id", "kind", "len", "x0", "y0", "x1", "y1")
    boxes = drawn.join(F.broadcast(clusters.select(*CLUSTER, "layer")), CLUSTER)

    _, zones = Z.detect(None, sheet, DRAWING, whole.filter("len IS NOT NULL").select(*DRAWING, "path_id", "x0", "y0", "x1", "y1", "rectangular"))
    zones = cut(zones)
    plans = zones.filter("ordinal = 0").select(*DRAWING, *[F.col(f"z{c}").alias(f"p{c}") for c in ("x0", "y0", "x1", "y1")])
    projects = cut(L.project_keys(paths, DRAWING).select(*DRAWING, "project_key"))

    # the scale: sources that don't depend on each other
    prefix, value = T.grid_label(F.col("text"))
    middle = G.box_middle("x0", "y0", "x1", "y1")
    labels = words.select(*DRAWING, prefix.alias("prefix"), value.alias("value"), middle[0].alias("x"), middle[1].alias("y"), (F.col("y1") - F.col("y0")).alias("height")).filter("value IS NOT NULL")
    bars = cut(SC.scalebars(boxes.join(per_page, DRAWING), plans, DRAWING, F.col("diagonal")))
    known = projects.join(references, "project_key").select(*DRAWING, "known_pitch", "known_divisions", "known_span_mm")
    rated = cut(SC.candidates(SC.sources_of(O.grid_pitch(labels, DRAWING), bars, known, DRAWING), DRAWING))
    stats, angles = cut(ST.cluster_stats(shape, CLUSTER, 1.0, drawn.withColumn("width", F.lit(None).cast("double")))), cut(ST.orthogonal_share(shape, CLUSTER))
    sized = angles.join(stats.select(*CLUSTER, "n_paths", "total", "box"), CLUSTER).join(pages, DRAWING)
    ranked = sized.withColumn("spread", F.col("box") / (F.col("page_width") * F.col("page_height")))
    walls = cut(SC.wall_modes(shape.join(per_page, DRAWING), ranked, DRAWING, "cluster_id", F.col("diagonal")).select(*DRAWING, "mode"))
    named = rated.groupBy(*DRAWING).agg(F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"))
    voted = SC.vote(rated, walls, DRAWING).join(named, DRAWING, "left")
    scales = cut(pages.select(*DRAWING).join(voted, DRAWING, "left").fillna({"verified": False, "flags": "no_source", "sources": ""}))

    tokens = projects.join(rules.withColumnRenamed("project_key", "of"), T.rule_applies(F.col("valid"), F.col("tokens"), F.col("of"), F.col("project_key"))).select(*DRAWING, "tokens")
    judged = cut(_selected(shape, stats, angles, boxes, clusters.withColumn("width", F.col("cluster_width")), paths, zones, scales, pages, tokens))
    pipes = cut(judged.filter("verdict = 'pipe'").select(*CLUSTER, "layer", "width"))
    placed = by_path.select(*CLUSTER, "path_id", "width").join(F.broadcast(judged.select(*CLUSTER, "layer", "verdict", "step")), CLUSTER)
    accepted = placed.filter("verdict = 'pipe'").select(*DRAWING, "path_id", "cluster_id", "layer")
    blocked = placed.filter("verdict <> 'pipe'").select(*DRAWING, "path_id", "cluster_id", "layer", F.col("verdict").alias("reason"), "step")

    # runs, bridges up to the plateau, polylines, strands
    inked = shape.join(F.broadcast(pipes.select(*CLUSTER)), CLUSTER, "left_semi")
    run_id = F.shiftleft("path_id", 20) + F.col("chain_no")
    points = cut(N.run_points(O.corner_split(inked, CLUSTER).withColumn("run_id", run_id), CLUSTER))
    widths = placed.filter("verdict = 'pipe'").groupBy(*CLUSTER).agg(F.percentile(F.when(F.col("width") > 0, F.col("width")), 0.5).alias("unit"))
    units = cut(widths.join(pages, DRAWING).select(*CLUSTER, F.coalesce("unit", F.col("diagonal") * 1e-4).alias("unit")))
    runs = cut(N.straight_runs(points, CLUSTER).join(F.broadcast(units), CLUSTER))
    bridges = cut(N.bridge_runs(runs, CLUSTER, F.col("unit") * 12, offset=F.col("unit") * 0.5))
    base = runs.groupBy(*CLUSTER).agg(F.sum("len").alias("total"), F.first("unit").alias("unit"))
    flat = cut(O.plateau(O.sweep(base, bridges, CLUSTER), CLUSTER).select(*CLUSTER, "threshold", F.col("width").alias("plateau_width")))
    kept = bridges.join(flat, CLUSTER).join(units, CLUSTER).filter(F.col("gap") <= F.col("threshold") * F.col("unit")).drop("threshold", "plateau_width", "unit")
    kept = cut(N.rechained(kept, CLUSTER))
    nets = cut(pipes.groupBy(*DRAWING).agg(F.percentile("width", 0.5).alias("unit")).select(*DRAWING, F.greatest("unit", F.lit(1e-6)).alias("unit")))
    lines = N.polylines(runs, points, kept, CLUSTER).join(F.broadcast(nets.withColumnRenamed("unit", "eps")), DRAWING)
    strand_points, strands = N.strands(lines, CLUSTER, DRAWING, F.col("eps"), written=True)
    strands = cut(strands)
    strand = [*CLUSTER, "chain_id", "strand_no"]
    along = W.partitionBy(*strand).orderBy("ordinal")
    walked = strand_points.select(*strand, "ordinal", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(along).alias("bx"), F.lead("y").over(along).alias("by_")).filter("bx IS NOT NULL").withColumn("len", G.distance(*_ENDS))
    walked = cut(walked)

    # what the drawing's own hatching takes out
    held = G.overlap_fraction(("x0", "y0", "x1", "y1"), ("px0", "py0", "px1", "py1")) >= 0.6
    fillers = judged.filter("verdict NOT IN ('pipe', 'text_or_glyph', 'frame', 'degenerate', 'no_scale') AND total > 0").join(plans, DRAWING).filter(held).select(*CLUSTER, F.greatest(G.box_area("px0", "py0", "px1", "py1"), F.lit(1e-9)).alias("plan_area"), (F.col("diagonal") * 0.01).alias("most_pitch"))
    pool = shape.join(F.broadcast(fillers), CLUSTER)
    hatching = cut(H.hatch_clusters(pool, CLUSTER, F.col("plan_area"), F.col("most_pitch"), counted=stats.select(*CLUSTER, F.col("n_paths").alias("n"))))
    cells = paths.groupBy(*DRAWING).agg((F.percentile(F.when(F.col("width") > 0, F.col("width")), 0.5) * 6).alias("cell")).select(*DRAWING, F.greatest(F.coalesce("cell", F.lit(0.0)), F.lit(1e-6)).alias("cell"))
    cells = F.broadcast(cut(cells))
    mask = cut(H.hatch_mask(pool.join(cells, DRAWING), hatching, CLUSTER, "cell"))
    split = S.masked(walked.join(cells, DRAWING), mask, DRAWING, F.col("cell"))

    # vertical pipes: symbols on the pipes' layers that are no pipes
    layers = pipes.select(*DRAWING, "layer").distinct()
    loose = boxes.join(F.broadcast(pipes.select(*CLUSTER)), CLUSTER, "left_anti").filter("len > 0").join(F.broadcast(layers), [*DRAWING, "layer"], "left_semi").join(F.broadcast(nets), DRAWING)
    candidates = cut(loose.select(*DRAWING, F.col("path_id").alias("box_id"), "layer", "x0", "y0", "x1", "y1", "unit"))
    links = N.box_components(candidates, DRAWING, F.col("unit") * 0.7, F.col("unit") * 0.7)
    symbols = S.symbol_instances(candidates, links, DRAWING, ("layer",))
    drawn = walked.withColumns({"path_id": F.col("chain_id"), "seg_no": F.col("strand_no") * 1_000_000 + F.col("ordinal")})
    found = N.verticals(symbols, drawn, nets, DRAWING, ("cluster_id",))
    spots = found.join(cells, DRAWING).withColumns({"ax": F.col("x"), "bx": F.col("x"), "ay": F.col("y"), "by_": F.col("y")})
    verticals = cut(S.masked(spots, mask, DRAWING, F.col("cell")).drop(*_ENDS, "cell"))

    # metres
    metres = lambda c: F.col(c) * (G.MM_PER_PT / 1000) * F.col("scale")
    share = split.groupBy(*CLUSTER).agg(F.sum(F.when(F.col("masked"), 0.0).otherwise(F.col("len"))).alias("out_pt"), F.sum(F.when(F.col("masked"), F.col("len")).otherwise(0.0)).alias("in_pt"))
    counts = strands.groupBy(*CLUSTER).agg(F.count("*").alias("n_strands"), F.sum("bends").alias("bends"))
    upright = verticals.groupBy(*CLUSTER).agg(F.count_if(~F.col("masked")).alias("verticals"), F.count_if("masked").alias("masked_verticals"))
    bridged = kept.groupBy(*CLUSTER).agg(F.sum("gap").alias("bridged_pt"))
    q = judged.filter("verdict = 'pipe'").select(*CLUSTER, "layer", "total", "step", "scale")
    for more in (share, counts, upright, bridged, flat.select(*CLUSTER, "plateau_width")):
        q = q.join(more, CLUSTER, "left")
    q = q.fillna(0, ["out_pt", "in_pt", "n_strands", "bends", "verticals", "masked_verticals", "bridged_pt", "plateau_width"])
    flags = F.array_compact(F.array(F.when(F.col("plateau_width") <= 0, "no_plateau"), F.when(F.col("step") != "layer_rule", "style_by_structure"), F.when(F.col("in_pt") > 0, "masked_length")))
    quantities = cut(
        q.select(
            *CLUSTER, "layer", T.system_from_layer(F.col("layer")).alias("system"), metres("out_pt").alias("length_m"), metres("in_pt").alias("masked_m"), metres("total").alias("raw_m"), metres("bridged_pt").alias("bridged_m"),
            "n_strands", "verticals", "masked_verticals", "bends", F.greatest(F.lit(0), F.col("n_strands") - 1).alias("joints"), "plateau_width", F.concat_ws(",", flags).alias("flags"),
        )
    )
    triage = cut(D.triage(pages, paths, DRAWING, words))
    facts = _facts(triage, scales, judged, by_path, boxes, zones, quantities, strands, walked)
    delivery = D.delivery_rows(quantities, ["layer", "cluster_id"]).join(triage.select(*DRAWING, "delivers"), DRAWING)
    return Measurement(triage, zones, bars, scales, judged, accepted, blocked, strands, verticals, quantities, delivery, facts, ST.width_percentiles(paths, DRAWING))


def _facts(triage: DataFrame, scales: DataFrame, judged: DataFrame, by_path: DataFrame, boxes: DataFrame, zones: DataFrame, quantities: DataFrame, strands: DataFrame, walked: DataFrame) -> DataFrame:
    """One row for each drawing with what is reported of it."""
    top = D.top_share(judged.select(*DRAWING, F.col("cluster_id").alias("cluster"), "total"), DRAWING).select(*DRAWING, "n_clusters", F.col("share").alias("share_top3"))
    excluded = Z.classify_boxes(boxes, zones, DRAWING).groupBy(*DRAWING).agg((F.sum(F.when(F.col("zone") == "plan", 0.0).otherwise(F.col("len"))) / F.nullif(F.sum("len"), F.lit(0.0))).alias("share_in_excluded"))
    sums = quantities.groupBy(*DRAWING).agg(
        F.count("*").alias("n_pipe_clusters"), F.sum("length_m").alias("length_m"), F.sum("masked_m").alias("masked_m"), F.sum("raw_m").alias("raw_m"), F.sum("verticals").alias("verticals"), F.sum("masked_verticals").alias("masked_verticals"),
        F.sum("bends").alias("bends"), F.min("plateau_width").alias("plateau_width"), F.sum("n_strands").alias("n_strands"), (F.sum("bridged_m") / F.nullif(F.sum(F.col("length_m") + F.col("masked_m")), F.lit(0.0))).alias("bridged_share"),
    )
    nodes = N.nodes(strands, DRAWING).groupBy(*DRAWING).agg(F.count("*").alias("n_nodes"))
    verdicts = judged.select(*CLUSTER, "verdict")
    paths = by_path.join(F.broadcast(verdicts), CLUSTER).groupBy(*DRAWING).agg(((F.count_if(F.col("verdict") == "pipe") + F.count_if(F.col("verdict") != "pipe")) / F.count("*")).alias("coverage"))
    method = judged.groupBy(*DRAWING).agg(F.when(F.max((F.col("step") == "layer_rule").cast("int")) == 1, "layer_rule").otherwise("structural").alias("method"))
    mx, my = G.box_middle("ax", "ay", "bx", "by_")
    wall_boxes = boxes.join(F.broadcast(verdicts.filter("verdict = 'wall'").select(*CLUSTER)), CLUSTER, "left_semi").select(*DRAWING, "x0", "y0", "x1", "y1")
    middles = walked.select(*DRAWING, "len", mx.alias("x"), my.alias("y"))
    inside = S.points_in_boxes(middles, wall_boxes, DRAWING, 50.0).groupBy(*DRAWING).agg(F.sum("len").alias("in_walls"))
    walls = middles.groupBy(*DRAWING).agg(F.sum("len").alias("all")).join(inside, DRAWING, "left").select(*DRAWING, (F.coalesce("in_walls", F.lit(0.0)) / F.nullif("all", F.lit(0.0))).alias("wall_zone_share"))
    facts = triage.select(*DRAWING, "track", "n_paths", "n_layers", "n_words", "vectorised", "delivers").join(scales.select(*DRAWING, "scale", "verified", "error_pct", "sources", F.col("flags").alias("scale_flags")), DRAWING, "left")
    for more in (top, excluded, sums, nodes, paths, method, walls):
        facts = facts.join(more, DRAWING, "left")
    return facts.fillna(0, ["n_clusters", "n_pipe_clusters", "length_m", "masked_m", "raw_m", "verticals", "masked_verticals", "bends", "n_strands", "n_nodes", "bridged_share", "wall_zone_share", "plateau_width", "share_in_excluded"])


def sheets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Inputs of ``measure`` from the test tables: every line item is a path; each drawing has a scale bar, and grid words, which are null in one of seven.

    At 1 : 50 a grid step of ten units (a metre) is 56.69 points and fifty metres of bar are 2834.6, with a tick every five metres.
    """
    drawn = A.drawn_segments(spark, sf_dir).withColumn("path_id", F.col("path_id") * 1000 + F.col("seg_no"))
    drawn = cut(drawn.select("drawing_id", "path_id", "layer", "width", "dash_signature", *_ENDS))
    metre = 1000 / G.MM_PER_PT / 50
    ids = cut(drawn.select("drawing_id").distinct())
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    box = [("x", "y", "u", "y"), ("u", "y", "u", "v"), ("u", "v", "x", "v"), ("x", "v", "x", "y")]
    frames = ids.select("drawing_id", F.lit(-1).alias("path_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(24900.0).alias("u"), F.lit(1790.0).alias("v"), F.lit("s").alias("kind"))
    bar = ids.select("drawing_id", F.lit(-2).alias("path_id"), F.lit(100.0).alias("x"), F.lit(1760.0).alias("y"), F.lit(100 + 50 * metre).alias("u"), F.lit(1770.0).alias("v"), F.lit("f").alias("kind"))
    ticks = ids.withColumn("k", number(10)).select("drawing_id", (-10 - F.col("k")).alias("path_id"), (F.lit(100.0) + F.col("k") * metre * 5).alias("x"), F.lit(1755.0).alias("y"), (F.lit(100.0) + F.col("k") * metre * 5).alias("u"), F.lit(1758.0).alias("v"), F.lit("s").alias("kind"))
    marks = frames.unionByName(bar).unionByName(ticks).withColumn("path_id", F.col("path_id").cast("bigint"))
    edges = F.array(*(F.struct(F.lit(i + 1).alias("seg_no"), F.col(a).alias("ax"), F.col(b).alias("ay"), F.col(c).alias("bx"), F.col(d).alias("by_")) for i, (a, b, c, d) in enumerate(box)))
    line = F.array(F.struct(F.lit(1).alias("seg_no"), *_ENDS))
    colour = lambda v: F.struct(v.alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"))
    paths = drawn.select("drawing_id", "path_id", "layer", F.lit("s").alias("kind"), colour(F.col("width")).alias("stroke"), F.lit(None).cast("struct<r:double,g:double,b:double>").alias("fill"), "width", "dash_signature", F.lit(False).alias("closed"), line.alias("segments"))
    outline = marks.select("drawing_id", "path_id", F.lit("268-O|FRAME-").alias("layer"), "kind", colour(F.lit(0.0)).alias("stroke"), colour(F.lit(0.0)).alias("fill"), F.lit(0.25).alias("width"), F.lit("solid").alias("dash_signature"), F.lit(True).alias("closed"), edges.alias("segments"))
    words = ids.withColumn("k", number(6)).select("drawing_id", F.when(F.col("drawing_id") % 7 != 0, F.concat(F.lit("A"), (F.col("k") * 10).cast("string"))).alias("text"), (F.lit(50.0) + F.col("k") * metre).alias("x0"), F.lit(20.0).alias("y0"), (F.lit(70.0) + F.col("k") * metre).alias("x1"), F.lit(30.0).alias("y1"))
    return {
        "paths": paths.unionByName(outline),
        "pages": ids.select("drawing_id", F.lit(25000.0).alias("width"), F.lit(1800.0).alias("height")),
        "words": words,
        "rules": spark.createDataFrame([("268", ["-FE-"], True)], "project_key string, tokens array<string>, valid boolean"),
    }


@query()
def measured_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres of pipe by drawing and cluster, from paths to delivered rows; one drawing in seven has a single scale source and is refused."""
    m = measure(**sheets(spark, sf_dir))
    return m.delivery.withColumn("length_m", F.round("length_m", 3))
