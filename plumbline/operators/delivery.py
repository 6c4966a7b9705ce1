"""Quantities, ground truth, evaluation and the rows that are delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import spatial as S


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label, length_a, length_b, diff) of two runs (row_no, label, length_m); the last row of a label counts, a missing one is 0. Sort by diff where it is shown."""

    def last(run: DataFrame, name: str) -> DataFrame:
        return run.groupBy("label").agg(F.max_by("length_m", "row_no").alias(name))

    both = last(a, "length_a").join(last(b, "length_b"), "label", "full")
    return both.withColumn("diff", F.coalesce("length_b", F.lit(0.0)) - F.coalesce("length_a", F.lit(0.0)))


def markup_votes(lines: DataFrame, segments: DataFrame, tolerance: float, least: float = 0.35, to: str = "layer", by_drawing: bool = False) -> DataFrame:
    """Marked-up lines (drawing_id, line_id, label, x0..y1; a polyline has a row for each piece) assigned to what they follow.

    Each piece is sampled once for each ``tolerance`` (twice at least); its n + 1 points vote for the ``to`` column of their
    nearest segment with weight length / (n + 1) / (1 + distance). The winner (ties by name) needs ``least`` of the whole line's
    length. Returns (to, n_lines, n_labels, length), for each drawing if ``by_drawing``.
    """
    whole = ["drawing_id", "line_id", "label"]
    pieces = lines.withColumn("len", G.distance("x0", "y0", "x1", "y1")).filter("len > 0")
    n = F.greatest(F.lit(2), F.floor(F.col("len") / max(tolerance, 1e-6)).cast("int"))
    # pieces go to the cells along them, segments to those around them: all that is near a sample is in its own cell, so the samples themselves are not dealt
    reach = max(tolerance, 1e-6)
    size, ends = reach * 8, ("x0", "y0", "x1", "y1")
    part = lambda p, q, cell, more: F.when(F.col(p) == F.col(q), None).otherwise(((F.col(cell) + more) * size - F.col(p)) / (F.col(q) - F.col(p)))
    both = [(part("x0", "x1", "cx", 0), part("x0", "x1", "cx", 1)), (part("y0", "y1", "cy", 0), part("y0", "y1", "cy", 1))]
    # the samples in a cell, one more at each end for rounding (least and greatest pass over nulls)
    first, last = F.floor(F.greatest(F.lit(0.0), *(F.least(*b) for b in both)) * F.col("n") - 1e-3), F.ceil(F.least(F.lit(1.0), *(F.greatest(*b) for b in both)) * F.col("n") + 1e-3)
    own = S.in_cells(pieces.select(*whole, *ends, "len", n.alias("n")), ends, size).withColumns({"first": F.greatest(F.lit(0), first).cast("int"), "last": F.least(F.col("n"), last).cast("int")}).filter("first <= last")
    close = S.around(segments.select("drawing_id", "path_id", "seg_no", "ax", "ay", "bx", "by_", to), pieces, ["drawing_id"], reach, ("x0", "x1"), ("y0", "y1"))
    met = own.join(S.in_cells(close, ("ax", "ay", "bx", "by_"), size, reach * 1.001), ["drawing_id", "cx", "cy"])
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("n")
    beside = met.withColumn("k", F.explode(F.sequence("first", "last"))).withColumns({"x": at("x0", "x1"), "y": at("y0", "y1")})
    own_cell = (F.floor(F.col("x") / size) == F.col("cx")) & (F.floor(F.col("y") / size) == F.col("cy"))
    near = beside.filter(own_cell).withColumn("d", G.point_segment_distance("x", "y", "ax", "ay", "bx", "by_")).filter(F.col("d") <= float(tolerance))
    # grouped with the cell, the samples stay where they met
    nearest = near.groupBy("drawing_id", "cx", "cy", "line_id", "label", *ends, "k").agg(F.min(F.struct("d", "path_id", "seg_no", to)).alias("m"), F.first("len").alias("len"), F.first("n").alias("n"))
    weight = F.col("len") / (F.col("n") + 1) / (F.col("m.d") + 1)
    votes = nearest.groupBy("drawing_id", "line_id", "label", F.col(f"m.{to}").alias(to)).agg(F.sum(weight).alias("votes"))
    lengths = pieces.groupBy(*whole).agg(F.sum("len").alias("length"))
    rank = F.row_number().over(W.partitionBy(*whole).orderBy(F.round("votes", 9).desc(), to))
    won = votes.withColumn("rank", rank).filter("rank = 1").join(lengths, whole).filter(F.col("votes") >= F.col("length") * least)
    return won.groupBy(*(["drawing_id"] if by_drawing else []), to).agg(F.count("*").alias("n_lines"), F.count_distinct("label").alias("n_labels"), F.sum("length").alias("length"))


def quantities(strands: DataFrame, keys: list[str]) -> DataFrame:
    """Length counted and masked, strands and bends of every group of strands (length_m, masked, bends).

    Strands that are cut by a mask come with both lengths instead (length_m outside, masked_m inside, bends). ``joints`` is strands - 1, at least 0; ``bends`` the measured number.
    """
    if "masked_m" not in strands.columns:
        masked = F.coalesce("masked", F.lit(False))
        strands = strands.withColumn("masked_m", F.when(masked, F.col("length_m")).otherwise(0.0)).withColumn("length_m", F.when(masked, 0.0).otherwise(F.col("length_m")))
    g = strands.groupBy(*keys).agg(
        F.sum("length_m").alias("length_m"),
        F.sum("masked_m").alias("masked_m"),
        F.count("*").alias("n_strands"),
        F.sum("bends").alias("bends"),
    )
    flags = F.array_compact(F.array(F.when(F.col("masked_m") > 0, "masked_length"), F.when(F.col("length_m") == 0, "nothing_counted")))
    return g.withColumns({"joints": F.greatest(F.lit(0), F.col("n_strands") - 1), "flags": F.concat_ws(",", flags)})


def delivery_rows(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group (sort by length where it is shown), and one for the masked length of every drawing that has any: excluded length is reported, never dropped."""
    rows = found.select("drawing_id", F.concat_ws(" ", *keys).alias("item"), F.lit("pipe").alias("kind"), F.round("length_m", 4).alias("length_m"), "flags")
    masked = found.groupBy("drawing_id").agg(F.sum("masked_m").alias("m")).filter("m > 0")
    rest = masked.select("drawing_id", F.lit("masked zone").alias("item"), F.lit("excluded").alias("kind"), F.round("m", 4).alias("length_m"), F.lit("masked_length").alias("flags"))
    return rows.unionByName(rest)


def ground_truth_totals(rows: DataFrame) -> DataFrame:
    """Length and number of vertical pipes by drawing and label; nulls and zeros add nothing."""
    return rows.groupBy("drawing", "label").agg(F.sum(F.coalesce("length_m", F.lit(0.0))).alias("length_m"), F.sum(F.coalesce("vertical_count", F.lit(0.0))).alias("verticals"))


def system_errors(found: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """(key, length_m, truth_m, error_pct): error against the truth; null where the truth is missing or 0."""
    joined = found.join(truth, key, "left")
    return joined.withColumn("error_pct", F.when(F.col("truth_m") != 0, (F.col("length_m") - F.col("truth_m")) / F.col("truth_m") * 100))


def gates(metrics: DataFrame) -> DataFrame:
    """Pass or fail of (length_error_pct, vertical_error, n_nodes, n_labels, mape): 10 %, 10 pieces, 3 nodes a label, 10 %."""
    ok = {"length_ok": F.abs("length_error_pct") <= 10, "verticals_ok": F.abs("vertical_error") <= 10, "nodes_ok": F.col("n_nodes") < F.col("n_labels") * 3, "mape_ok": F.col("mape") <= 10}
    return metrics.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in ok.items()})


def coverage(total: DataFrame, accepted: DataFrame, blocked: DataFrame, keys: list[str]) -> DataFrame:
    """Accepted and blocked paths over all paths of every group; 1 unless rows were lost or counted twice."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    joined = count(total, "total").join(count(accepted, "accepted"), keys, "left").join(count(blocked, "blocked"), keys, "left").fillna(0, ["accepted", "blocked"])
    return joined.withColumn("coverage", (F.col("accepted") + F.col("blocked")) / F.col("total"))


def status_split(lengths: DataFrame, fields: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """Length by each of several alternative splits: (keys, field, value, length)."""
    expanded = lengths.select(*keys, "len", F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in fields.items()))).alias("s"))
    return expanded.groupBy(*keys, "s.field", "s.value").agg(F.sum("len").alias("length"))


def status_fields(stroke: str = "stroke") -> dict[str, Column]:
    """The four splits that a drawing's pipes are tried by: layer, colour (to 0.01), line type, lightness (to 0.1)."""
    part = lambda c: F.format_string("%.2f", F.round(F.col(f"{stroke}.{c}"), 2))
    colour = F.when(F.col(stroke).isNotNull(), F.concat_ws("/", part("r"), part("g"), part("b")))
    light = F.format_string("%.1f", F.round(G.lightness(F.col(f"{stroke}.r"), F.col(f"{stroke}.g"), F.col(f"{stroke}.b")), 1))
    return {"layer": F.col("layer"), "colour": colour, "linetype": F.col("dash_signature"), "lightness": light}


def status_rule(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict on pipe clusters (keys, cluster, layer): (keys, field, n_hinted, n_clusters, mapping).

    Layers split a drawing by status where the names of some, but not of all clusters suggest one; else ``field`` is null:
    all length is one category, and none is taken for new. ``mapping`` lists layer=status in order.
    """
    hinted = clusters.withColumn("status", status_hint(F.col("layer")))
    layers = hinted.filter("status IS NOT NULL").select(*keys, F.coalesce("layer", F.lit("")).alias("layer"), "status").distinct()
    mapping = layers.groupBy(*keys).agg(F.count("*").alias("n_hinted"), F.concat_ws(";", F.array_sort(F.collect_set(F.concat_ws("=", "layer", "status")))).alias("mapping"))
    g = clusters.groupBy(*keys).agg(F.count("*").alias("n_clusters")).join(mapping, keys, "left").fillna(0, ["n_hinted"])
    split = (F.col("n_hinted") > 0) & (F.col("n_hinted") < F.col("n_clusters"))
    return g.select(*keys, F.when(split, "layer").alias("field"), "n_hinted", "n_clusters", F.when(split, F.col("mapping")).otherwise("").alias("mapping"))


#: Parts of a layer's name that suggest a status (fixed values).
STATUS_HINTS = {"existing": ("bef", "exist", "befint", "e-", "_e"), "demolition": ("riv", "demol", "demo", "rivs"), "new": ("ny", "new", "n-")}


def status_hint(layer: Column) -> Column:
    """The status that a layer's name suggests, null without a hint; to be confirmed, never to exclude by."""
    low = F.lower(F.coalesce(layer, F.lit("")))
    out = F.lit(None).cast("string")
    for status, parts in reversed(STATUS_HINTS.items()):
        hit = F.lit(False)
        for p in parts:
            hit = hit | low.contains(p)
        out = F.when(hit, status).otherwise(out)
    return out


def top_share(clusters: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """Share of the ``k`` longest clusters (cluster, total) in a drawing's length: (keys, n_clusters, share)."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("total"), "cluster"))
    ranked = clusters.withColumn("place", place)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n_clusters"), (F.sum(F.when(F.col("place") <= k, F.col("total"))) / F.sum("total")).alias("share"))


def triage(drawings: DataFrame, paths: DataFrame, keys: list[str], words: DataFrame | None = None, plans: DataFrame | None = None, least_words: int = 50) -> DataFrame:
    """Track of every drawing: A with layers, B without, C without paths: (keys, track, n_paths, n_layers, n_words, vectorised, delivers).

    ``words(keys, x0, y0, x1, y1)`` count where their middle lies in the plan (``plans(keys, px0, py0, px1, py1)``; everywhere
    without it). With fewer than ``least_words`` a drawing's text is drawn, not written. Only track A delivers measurements.
    """
    counted = paths.groupBy(*keys).agg(F.count("*").alias("n_paths"), F.count_distinct(F.nullif("layer", F.lit(""))).alias("n_layers"))
    g = drawings.select(*keys).distinct().join(counted, keys, "left")
    if words is not None:
        if plans is not None:
            words = words.join(plans, keys, "left").filter(F.coalesce(G.middle_inside(("x0", "y0", "x1", "y1"), ("px0", "py0", "px1", "py1")), F.lit(True)))
        g = g.join(words.groupBy(*keys).agg(F.count("*").alias("n_words")), keys, "left")
    else:
        g = g.withColumn("n_words", F.lit(0))
    g = g.fillna(0, ["n_paths", "n_layers", "n_words"])
    track = F.when(F.col("n_paths") == 0, "C").when(F.col("n_layers") > 0, "A").otherwise("B")
    found = F.when(F.col("n_paths") == 0, 0).otherwise(F.col("n_words"))
    return g.select(*keys, track.alias("track"), "n_paths", "n_layers", found.cast("bigint").alias("n_words"), (found < least_words).alias("vectorised"), F.when(track == "A", "measurement").otherwise("estimate").alias("delivers"))


#: The lines of a delivery's summary in order (fixed values), each with the column it shows.
SUMMARY_LINES = (
    ("drawing", "drawing_id"), ("track", "track"), ("scale", "scale"), ("scale verified", "verified"), ("scale sources", "sources"), ("selection", "method"), ("coverage", "coverage"),
    ("length m", "length_m"), ("masked length m", "masked_m"), ("masked verticals", "masked_verticals"), ("bridged share", "bridged_share"), ("share in wall zones", "wall_zone_share"), ("least plateau", "plateau_width"),
)


def summary_block(facts: DataFrame, key: str = "drawing_id") -> DataFrame:
    """The 13 lines of every drawing's summary: (key, line_no, name, value) of one row of facts for each drawing."""
    lines = F.array(*(F.struct(F.lit(i).alias("line_no"), F.lit(name).alias("name"), F.col(c).cast("string").alias("value")) for i, (name, c) in enumerate(SUMMARY_LINES)))
    return facts.select(key, F.explode(lines).alias("l")).select(key, "l.*")


def evaluate(facts: DataFrame, found: DataFrame, truth: DataFrame, scope: DataFrame, key: str = "drawing_id") -> DataFrame:
    """Every drawing's facts with its error against the ground truth and the gates.

    ``found(key, layer, length_m)``, ``truth(key, label, length_m, vertical_count)``, ``scope(key, layer, truth_m)``: the layers that the
    markup follows with its length; other layers are measured too and reported as out of scope. A drawing without
    truth keeps nulls. ``mape`` is the mean error of the layers in scope.
    """
    totals = truth.groupBy(key).agg(F.sum(F.coalesce("length_m", F.lit(0.0))).alias("truth_m"), F.sum(F.coalesce("vertical_count", F.lit(0.0))).alias("truth_verticals"), F.count_distinct("label").alias("n_labels"))
    held = found.join(scope.select(key, "layer", F.col("truth_m").alias("layer_truth_m")), [key, "layer"], "left")
    error = F.when(F.col("layer_truth_m") != 0, F.abs(F.col("length_m") - F.col("layer_truth_m")) / F.col("layer_truth_m") * 100)
    inside = F.col("layer_truth_m").isNotNull()
    layers = held.groupBy(key).agg(F.sum(F.when(inside, F.col("length_m")).otherwise(0.0)).alias("in_scope_m"), F.sum(F.when(inside, 0.0).otherwise(F.col("length_m"))).alias("out_of_scope_m"), F.concat_ws(",", F.array_sort(F.collect_set(F.when(~inside, F.col("layer"))))).alias("out_of_scope"), F.avg(error).alias("mape"))
    base = F.when(F.col("truth_m").isNotNull(), F.when(F.col("truth_m") == 0, 1.0).otherwise(F.col("truth_m")))
    off = lambda c: (F.col(c) - base) / base * 100
    m = facts.join(totals, key, "left").join(layers, key, "left")
    m = m.withColumns({"length_error_pct": off("length_m"), "in_scope_error_pct": off("in_scope_m"), "vertical_error": F.col("verticals") - F.col("truth_verticals")})
    return gates(m).withColumns({"coverage_ok": F.abs(F.col("coverage") - 1) < 1e-9, "in_scope_ok": F.coalesce(F.abs("in_scope_error_pct") <= 10, F.lit(False))})


def indicators(facts: DataFrame, key: str = "drawing_id") -> DataFrame:
    """How far each drawing's result can be trusted, one row for each row of facts: least plateau, shares bridged and in wall zones, what is masked, and how scale and pipes were found."""
    to = {"plateau_width": 3, "bridged_share": 4, "wall_zone_share": 4, "masked_m": 1}
    return facts.select(key, *(F.round(c, n).alias(c) for c, n in to.items()), "masked_verticals", F.coalesce("verified", F.lit(False)).alias("scale_verified"), "track", "method")


def as_json(facts: DataFrame, key: str = "drawing_id", **lists: DataFrame) -> DataFrame:
    """(key, json): one document for each drawing with its facts and, under their names, the rows of further tables (bounded for each drawing)."""
    out = facts.select(key, F.struct(*(c for c in facts.columns if c != key)).alias("facts"))
    for name, table in lists.items():
        columns = [c for c in table.columns if c != key]
        out = out.join(table.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name)), key, "left")
    return out.select(key, F.to_json(F.struct("facts.*", *lists)).alias("json"))
