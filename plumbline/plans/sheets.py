"""Queries: sheets, styles, zones and scales of many drawings, ids repeating from drawing to drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import delivery as D
from ..operators import glyphs as GL
from ..operators import network as N
from ..operators import scale as SC
from ..operators import spatial as S
from ..operators import styles as ST
from ..operators import zones as Z
from ..sources import adapter as A
from ..sources.shared import cut
from .joins import _LINES, _PAIRS
from .oracles import LAB_SQL as _LAB
from .registry import query
from .scalars import _PAGES_SQL, BOXES, PAGES, SCALES

_LEN = "sqrt((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay))"
KEYS = ["drawing_id", "layer"]


def r4(*names: str) -> list:
    return [F.round(n, 4).alias(n) for n in names]


@query(
    f"""{_PAGES_SQL}, q AS (SELECT page_id, [a*x+c*y+e, a*(x+10)+c*y+e, a*x+c*(y+5)+e, a*(x+10)+c*(y+5)+e] AS xs, [b*x+d*y+f, b*(x+10)+d*y+f, b*x+d*(y+5)+f, b*(x+10)+d*(y+5)+f] AS ys FROM m)
SELECT page_id, round(list_min(xs), 4) AS x0, round(list_min(ys), 4) AS y0, round(list_max(xs), 4) AS x1, round(list_max(ys), 4) AS y1 FROM q"""
)
def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of every page in the upright view."""
    pages = A.rows(spark, sf_dir, "part", PAGES).withColumn("m", G.page_matrix("rotate", "w", "h", "user_unit"))
    box = G.apply_matrix_box("m", "x", "y", F.col("x") + 10, F.col("y") + 5)
    return pages.select("page_id", *(F.round(v, 4).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), box, strict=True)))


@query(
    f"""WITH b AS ({A.rows_sql("part", BOXES)})
SELECT box_id, (x0+x1)/2 AS mx, (y0+y1)/2 AS my, x0 >= 10 AND y0 >= 5 AND x1 <= 30 AND y1 <= 40 AS inside, (x0+x1)/2 BETWEEN 10 AND 30 AND (y0+y1)/2 BETWEEN 5 AND 40 AS middle_inside FROM b"""
)
def box_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether boxes, or their middles, lie in the box (10, 5)-(30, 40)."""
    box, outer = ("x0", "y0", "x1", "y1"), (10, 5, 30, 40)
    mx, my = G.box_middle(*box)
    return A.rows(spark, sf_dir, "part", BOXES).select("box_id", mx.alias("mx"), my.alias("my"), G.box_inside(box, outer).alias("inside"), G.middle_inside(box, outer).alias("middle_inside"))


@query(f"WITH s AS ({A.rows_sql('part', SCALES)})\nSELECT scale_id, round(72 * 25.4::DOUBLE/72/1000 * scale, 6) AS metres_of_inch, round(60 / (scale * 25.4::DOUBLE/72), 6) AS points_of_60mm, round(500 / (scale * 25.4::DOUBLE/72), 6) AS points_of_500mm FROM s")
def unit_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as metres and millimetres as points at every scale."""
    s = A.rows(spark, sf_dir, "part", SCALES)
    return s.select("scale_id", F.round(G.metres(72, "scale"), 6).alias("metres_of_inch"), F.round(G.points_of_mm(60, "scale"), 6).alias("points_of_60mm"), F.round(G.points_of_mm(500, "scale"), 6).alias("points_of_500mm"))


_SHEET = "sp AS (SELECT path_id % 50 AS drawing_id, CASE WHEN path_id % 50 % 5 = 0 THEN NULL ELSE layer END AS layer, CASE WHEN path_id % 50 % 7 = 0 THEN 0 ELSE width END AS width FROM paths)"


@query(
    f"""{A.WITH_SQL}, {_SHEET}
SELECT drawing_id, count(*) AS n_paths, coalesce(bool_or(layer <> ''), false) AS has_layers, coalesce(string_agg(DISTINCT layer, ';' ORDER BY layer), '') AS layers, coalesce(quantile_cont(width, 0.5) FILTER (WHERE width > 0), 0)::DOUBLE AS median_width,
  coalesce(quantile_cont(width, 0.5) FILTER (WHERE width > 0), 2000 * 1e-4::DOUBLE)::DOUBLE AS epsilon FROM sp GROUP BY drawing_id"""
)
def sheet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths, layers, median line width of every drawing, and the length that counts as nothing (diagonal 2000)."""
    d = F.col("path_id") % A.DRAWINGS
    paths = A.paths(spark, sf_dir).select(d.alias("drawing_id"), F.when(d % 5 != 0, F.col("layer")).alias("layer"), F.when(d % 7 == 0, 0.0).otherwise(F.col("width")).alias("width"))
    return ST.sheet_summary(paths, ["drawing_id"], 2000.0)


@query(
    f"""{A.DRAWN_SQL}, hb AS (SELECT drawing_id, layer, least(11, floor((CASE WHEN atan2(by_-ay, bx-ax) < 0 THEN atan2(by_-ay, bx-ax) + pi() WHEN atan2(by_-ay, bx-ax) >= pi() THEN 0 ELSE atan2(by_-ay, bx-ax) END) / (pi()/12)))::INT AS b, {_LEN} AS len FROM drawn WHERE {_LEN} > 0),
g AS (SELECT drawing_id, layer, b, sum(len) AS s FROM hb GROUP BY ALL)
SELECT drawing_id, layer, round(max(s) / sum(s), 6) AS concentration, round(coalesce(sum(s) FILTER (WHERE b IN (0, 6)), 0) / sum(s), 6)::DOUBLE AS orthogonal FROM g GROUP BY ALL"""
)
def orthogonal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a layer runs one way, and how much along the page's axes."""
    h = ST.orthogonal_share(A.drawn_segments(spark, sf_dir), KEYS)
    return h.select(*KEYS, F.round("concentration", 6).alias("concentration"), F.round("orthogonal", 6).alias("orthogonal"))


@query(
    f"""{A.WITH_SQL}, l AS (SELECT DISTINCT path_id % 50 AS drawing_id, layer FROM paths), p AS (SELECT *, CASE drawing_id % 4 WHEN 0 THEN '268' WHEN 1 THEN '269' WHEN 2 THEN '270' END AS project FROM l)
SELECT drawing_id, layer, coalesce(project, '') = '268' AS applies, coalesce(project, '') = '268' AND (contains(concat('|', layer, '|'), '-FE-') OR contains(concat('|', layer, '|'), '|V-1')) AS matches FROM p"""
)
def layer_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rule of a drawing's project applies to it, and which layers it names; one rule is invalid, one has no tokens, some drawings have no project."""
    rules = spark.createDataFrame([("268", ["-FE-", "|V-1"], True), ("269", ["-FE-"], False), ("270", [], True)], "of string, tokens array<string>, valid boolean")
    d = F.col("drawing_id") % 4
    layers = A.paths(spark, sf_dir).select((F.col("path_id") % A.DRAWINGS).alias("drawing_id"), "layer").distinct()
    named = layers.withColumn("project", F.when(d == 0, "268").when(d == 1, "269").when(d == 2, "270"))
    joined = named.join(rules, F.col("of") == F.col("project"), "left")
    applies = T.rule_applies(F.col("valid"), F.col("tokens"), F.col("of"), F.col("project"))
    return joined.select("drawing_id", "layer", applies.alias("applies"), (applies & T.layer_matches_any(F.col("layer"), F.col("tokens"))).alias("matches"))


BARS = ["s_suppkey AS drawing_id", "CAST(283.5 AS double) + CAST(s_suppkey % 9 AS double) / CAST(2 AS double) AS pitch", "CAST(9 + s_suppkey % 3 AS int) AS divisions", "CASE WHEN s_suppkey % 5 = 0 THEN CAST(0 AS double) ELSE CAST(284 AS double) END AS known_pitch", "s_suppkey % 4 <> 0 AS verified", "CAST(50 * (1 + s_suppkey % 2) AS double) AS scale"]


@query(f"WITH b AS ({A.rows_sql('supplier', BARS)})\nSELECT b.drawing_id, coalesce(known_pitch > 0 AND abs(pitch - known_pitch) / nullif(known_pitch, 0) <= 0.005::DOUBLE AND divisions = 10, false) AS matches, CASE WHEN verified THEN round(pitch * (25.4::DOUBLE/72) * scale, 1) END AS span_mm FROM b")
def scale_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a drawing's bar is its project's, and the span that a verified drawing teaches."""
    bars = A.rows(spark, sf_dir, "supplier", BARS)
    learnt = SC.reference_from(bars.select("drawing_id", "verified", "scale"), bars.select("drawing_id", "pitch", "divisions"), ["drawing_id"])
    matches = SC.reference_matches(F.col("pitch"), F.col("divisions"), F.col("known_pitch"), F.lit(10))
    return bars.select("drawing_id", matches.alias("matches")).join(learnt.select("drawing_id", "span_mm"), "drawing_id", "left")


@query(
    """WITH w AS (SELECT p_partkey AS id, CAST(p_partkey * 31 % 400 AS double) / CAST(100 AS double) AS width FROM part), d AS (SELECT id, unnest([0, 1, 2, 3]) AS bucket, abs(width - unnest([0.25, 0.5, 1.0, 2.5]::DOUBLE[])) / unnest([0.25, 0.5, 1.0, 2.5]::DOUBLE[]) AS d FROM w)
SELECT id, bucket FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, bucket) = 1"""
)
def width_bucket_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The representative (0.25, 0.5, 1, 2.5) that every width is nearest to."""
    w = A.rows(spark, sf_dir, "part", ["p_partkey AS id", "CAST(p_partkey * 31 % 400 AS double) / CAST(100 AS double) AS width"])
    return w.select("id", ST.nearest_bucket(F.col("width"), F.array(*(F.lit(v) for v in (0.25, 0.5, 1.0, 2.5)))).alias("bucket"))


PANELS = ["s_suppkey % 50 AS drawing_id", "s_suppkey AS box_id", "CAST(s_suppkey * 19 % 1800 AS double) AS x0", "CAST(s_suppkey * 37 % 1500 AS double) AS y0", "CAST(s_suppkey * 19 % 1800 + 150 + s_suppkey % 70 AS double) AS x1", "CAST(s_suppkey * 37 % 1500 + s_suppkey % 4 * 60 AS double) AS y1"]


@query(
    f"""{A.DRAWN_SQL}, b AS ({A.rows_sql("supplier", PANELS)}), pb AS (SELECT drawing_id, path_id, min(least(ax,bx)) AS px0, min(least(ay,by_)) AS py0, max(greatest(ax,bx)) AS px1, max(greatest(ay,by_)) AS py1 FROM drawn GROUP BY ALL),
o AS (SELECT b.*, CASE WHEN (px1-px0)*(py1-py0) > 0 THEN greatest(0, least(px1,x1)-greatest(px0,x0)) * greatest(0, least(py1,y1)-greatest(py0,y0)) / ((px1-px0)*(py1-py0)) WHEN (px0+px1)/2 BETWEEN x0 AND x1 AND (py0+py1)/2 BETWEEN y0 AND y1 THEN 1 ELSE 0 END AS share FROM b LEFT JOIN pb USING (drawing_id))
SELECT drawing_id, box_id, count(*) FILTER (WHERE share > 0.9) AS n_inside, round(CASE WHEN any_value((x1-x0)*(y1-y0)) > 0 THEN count(*) FILTER (WHERE share > 0.9) / (any_value((x1-x0)*(y1-y0)) / 10000) ELSE 0 END, 6)::DOUBLE AS density FROM o GROUP BY ALL"""
)
def path_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths per 10,000 square points inside every panel."""
    paths = Z.path_boxes(A.drawn_segments(spark, sf_dir), ["drawing_id"])
    return Z.densities(A.rows(spark, sf_dir, "supplier", PANELS), paths, ["drawing_id"]).withColumn("density", F.round("density", 6))


@query(
    f"""WITH b AS ({A.rows_sql("supplier", PANELS)})
SELECT box_id, CASE WHEN x0 / 2000.0::DOUBLE > 0.66::DOUBLE AND y0 / 1700.0::DOUBLE > 0.66::DOUBLE THEN 'titleblock' WHEN x0 / 2000.0::DOUBLE > 0.66::DOUBLE AND ((y1-y0) / greatest(x1-x0, 1e-9) > 1.2::DOUBLE OR box_id % 3 / 4.0::DOUBLE > 0.4) THEN 'legend' ELSE 'detail' END AS kind FROM b"""
)
def panel_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every panel is by its place, shape and density."""
    b = A.rows(spark, sf_dir, "supplier", PANELS)
    return b.select("box_id", Z.panel_kind(("x0", "y0", "x1", "y1"), (0, 0, 2000, 1700), (F.col("box_id") % 3) / 4 + 0.1).alias("kind"))


FRAMES = ["s_suppkey % 8 AS drawing_id", "s_suppkey AS path_id", "CAST(s_suppkey % 3 * 10 AS double) AS x0", "CAST(s_suppkey % 2 * 10 AS double) AS y0", "CAST(s_suppkey % 3 * 10 + 1000 + s_suppkey % 5 * 240 AS double) AS x1", "CAST(s_suppkey % 2 * 10 + 1000 + s_suppkey % 4 * 160 AS double) AS y1"]


@query(
    f"""WITH r AS ({A.rows_sql("supplier", FRAMES)}), p AS (SELECT DISTINCT drawing_id FROM r UNION SELECT 99), f AS (SELECT * FROM r WHERE (x1-x0)*(y1-y0) / (2000*1500) BETWEEN 0.30::DOUBLE AND 0.995::DOUBLE QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY (x1-x0)*(y1-y0) DESC, path_id) = 1)
SELECT drawing_id, coalesce(x0, 0) AS x0, coalesce(y0, 0) AS y0, coalesce(x1, 2000) AS x1, coalesce(y1, 1500) AS y1 FROM p LEFT JOIN f USING (drawing_id)"""
)
def page_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame of every page; the page itself where no rectangle fits."""
    r = A.rows(spark, sf_dir, "supplier", FRAMES)
    pages = r.select("drawing_id").distinct().union(spark.sql("SELECT 99L")).select("drawing_id", F.lit(2000.0).alias("width"), F.lit(1500.0).alias("height"))
    return Z.frames(r, pages, ["drawing_id"])


SYMBOLS = ["p_partkey % 20 AS drawing_id", "CAST(floor(p_partkey / 20) AS bigint) AS box_id", "CAST(p_partkey * 13 % 1900 AS double) AS x0", "CAST(p_partkey * 29 % 1684 AS double) AS y0", "CAST(p_partkey * 13 % 1900 + 3 + p_size % 4 AS double) AS x1", "CAST(p_partkey * 29 % 1684 + 4 AS double) AS y1", "concat('L', CAST(p_size % 5 AS string)) AS layer"]
_JOINED = f"""b AS ({A.rows_sql("part", SYMBOLS)}), e AS (SELECT p.drawing_id, p.box_id AS a, q.box_id AS b FROM b p JOIN b q ON p.drawing_id = q.drawing_id AND p.box_id < q.box_id AND p.x1 >= q.x0 - {{g}} AND q.x1 >= p.x0 - {{g}} AND p.y1 >= q.y0 - {{g}} AND q.y1 >= p.y0 - {{g}}),
u AS (SELECT drawing_id, a AS n, b AS o FROM e UNION SELECT drawing_id, b, a FROM e), cc AS (SELECT drawing_id, n AS node, n AS seen FROM u UNION SELECT cc.drawing_id, cc.node, u.o FROM cc JOIN u ON u.n = cc.seen AND u.drawing_id = cc.drawing_id), k AS (SELECT drawing_id, node, min(seen) AS component FROM cc GROUP BY ALL),
sy AS (SELECT b.drawing_id, coalesce(component, box_id) AS symbol_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_boxes, arg_min(layer, box_id) AS layer FROM b LEFT JOIN k ON k.node = b.box_id AND k.drawing_id = b.drawing_id GROUP BY ALL)"""


def _symbols(spark: SparkSession, sf_dir: str, gap: float) -> DataFrame:
    boxes = A.rows(spark, sf_dir, "part", SYMBOLS)
    links = N.box_components(boxes, ["drawing_id"], gap, gap)
    return S.symbol_instances(boxes, links, ["drawing_id"], ("layer",))


@query(f"WITH RECURSIVE {_JOINED.format(g=0)}\nSELECT drawing_id, symbol_id, (x0+x1)/2 AS x, (y0+y1)/2 AS y, x1-x0 AS w, y1-y0 AS h, n_boxes, layer FROM sy")
def symbols_by_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of touching boxes (gap 0), numbered from 0 in every drawing, with the layer of the first box."""
    return _symbols(spark, sf_dir, 0.0)


@query(
    f"""WITH RECURSIVE {_JOINED.format(g=20)}
SELECT drawing_id, symbol_id AS box_id, x0, y0, x1, y1, n_boxes AS n_parts FROM sy"""
)
def boxes_by_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes joined over gaps of 20 points, numbered from 0 in every drawing."""
    return GL.grouped(A.rows(spark, sf_dir, "part", SYMBOLS), ["drawing_id"], 20.0, 20.0)


@query(
    f"""{A.DRAWN_SQL.replace("WITH segments", "WITH RECURSIVE segments", 1)}, {_JOINED.format(g=1)}, sq AS (SELECT *, (x0+x1)/2 AS x, (y0+y1)/2 AS y, 6.0::DOUBLE + drawing_id % 3 AS unit FROM sy WHERE greatest(x1-x0, y1-y0) > 0 AND abs((x1-x0) - (y1-y0)) <= 0.25::DOUBLE * greatest(x1-x0, y1-y0)),
d AS (SELECT p.drawing_id, p.symbol_id, s.layer, s.path_id, s.seg_no, unit, CASE WHEN {_LEN} = 0 THEN sqrt(pow(p.x-ax,2)+pow(p.y-ay,2)) ELSE sqrt(pow(p.x - ax - greatest(0, least(1, ((p.x-ax)*(bx-ax)+(p.y-ay)*(by_-ay)) / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) * (bx-ax), 2) + pow(p.y - ay - greatest(0, least(1, ((p.x-ax)*(bx-ax)+(p.y-ay)*(by_-ay)) / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) * (by_-ay), 2)) END AS d
  FROM sq p JOIN drawn s ON p.drawing_id = s.drawing_id)
SELECT drawing_id, symbol_id, path_id, seg_no, layer, round(d, 4) AS distance FROM d WHERE d <= 2 * unit QUALIFY row_number() OVER (PARTITION BY drawing_id, symbol_id ORDER BY round(d / unit, 9), path_id, seg_no) = 1"""
)
def verticals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square symbols at most two units (6 to 8 points) from a pipe, each with its nearest segment."""
    units = spark.range(A.DRAWINGS).select(F.col("id").alias("drawing_id"), (F.col("id") % 3 + 6).cast("double").alias("unit"))
    found = N.verticals(_symbols(spark, sf_dir, 1.0), A.drawn_segments(spark, sf_dir), units, ["drawing_id"], ("layer",))
    return found.select("drawing_id", "symbol_id", "path_id", "seg_no", "layer", F.round("distance", 4).alias("distance"))


@query(
    f"""{A.DRAWN_SQL}, dd AS (SELECT * REPLACE (path_id // 50 AS path_id) FROM drawn), mk AS (SELECT o_orderkey % 50 AS drawing_id, o_orderkey // 50 AS line_id, concat('S', o_custkey % 9) AS label, (o_custkey * 7 % 2000)::DOUBLE AS x0, (o_orderkey * 29 % 1684)::DOUBLE AS y0, 24.0::DOUBLE AS len FROM orders),
smp AS (SELECT drawing_id, line_id, label, k, x0 + len * k / 6.0::DOUBLE AS x, y0 AS y FROM mk, unnest(range(0, 7)) AS u(k)),
d AS (SELECT m.drawing_id, m.line_id, m.label, m.k, s.layer, s.path_id, s.seg_no, CASE WHEN {_LEN} = 0 THEN sqrt(pow(m.x-ax,2)+pow(m.y-ay,2)) ELSE sqrt(pow(m.x - ax - greatest(0, least(1, ((m.x-ax)*(bx-ax)+(m.y-ay)*(by_-ay)) / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) * (bx-ax), 2) + pow(m.y - ay - greatest(0, least(1, ((m.x-ax)*(bx-ax)+(m.y-ay)*(by_-ay)) / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) * (by_-ay), 2)) END AS d
  FROM smp m JOIN dd s ON m.drawing_id = s.drawing_id AND m.x BETWEEN least(ax,bx) - 4 AND greatest(ax,bx) + 4 AND m.y BETWEEN least(ay,by_) - 4 AND greatest(ay,by_) + 4),
n AS (SELECT * FROM d WHERE d <= 4 QUALIFY row_number() OVER (PARTITION BY drawing_id, line_id, k ORDER BY d, path_id, seg_no, layer) = 1),
v AS (SELECT drawing_id, line_id, label, layer, sum(24.0::DOUBLE / 7 / (1 + d)) AS votes FROM n GROUP BY ALL),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY drawing_id, line_id ORDER BY round(votes, 9) DESC, layer) = 1)
SELECT drawing_id, layer, count(*) AS n_lines, count(DISTINCT label) AS n_labels, sum(24.0::DOUBLE) AS length FROM w WHERE votes >= 0.35::DOUBLE * 24 GROUP BY ALL"""
)
def markup_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the markup that each layer of a drawing carries; paths and lines are numbered from 0 in every drawing."""
    drawn = A.drawn_segments(spark, sf_dir).withColumn("path_id", F.floor(F.col("path_id") / A.DRAWINGS))
    o = A.read(spark, sf_dir, "orders")
    lines = o.select((F.col("o_orderkey") % 50).alias("drawing_id"), F.floor(F.col("o_orderkey") / 50).alias("line_id"), F.concat(F.lit("S"), (F.col("o_custkey") % 9).cast("string")).alias("label"), (F.col("o_custkey") * 7 % 2000).cast("double").alias("x0"), (F.col("o_orderkey") * 29 % 1684).cast("double").alias("y0"))
    lines = lines.withColumns({"x1": F.col("x0") + 24, "y1": F.col("y0")})
    return D.markup_votes(lines, drawn, 4.0, by_drawing=True)


#: Walls as pairs of lines at 40 heights, four to six points apart by drawing, on three layers.
WALLS = [
    "o_orderkey % 10 AS drawing_id", "concat('W', CAST(CAST(floor(o_orderkey / 7) % 3 AS bigint) AS string)) AS layer", "o_orderkey AS path_id", "1 AS seg_no", "CAST(1 AS double) AS width", "CAST(o_custkey % 50 AS double) AS ax",
    "CAST(floor(o_orderkey / 10) % 40 * 30 + o_custkey % 2 * (4 + o_orderkey % 10 % 3) AS double) AS ay", "CAST(o_custkey % 50 + 200 AS double) AS bx", "CAST(floor(o_orderkey / 10) % 40 * 30 + o_custkey % 2 * (4 + o_orderkey % 10 % 3) AS double) AS by_",
]
_MODES = f"""WITH drawn AS ({A.rows_sql("orders", WALLS)}), {_LINES.replace("FROM drawn WHERE", f"FROM drawn WHERE {_LEN} > 2.0::DOUBLE AND")}, {_PAIRS.format(reach="24.0::DOUBLE", overlap=0.5)}"""


@query(
    f"""{_MODES.replace("SELECT a.drawing_id, a.layer, a.axis,", "SELECT a.drawing_id, a.layer, a.axis, a.at,")}, hb AS (SELECT drawing_id, layer, sum(CASE WHEN bx = ax OR by_ = ay THEN {_LEN} ELSE 0 END) / sum({_LEN}) AS orthogonal, sum({_LEN}) AS total, count(DISTINCT path_id) AS n FROM drawn WHERE {_LEN} > 0 GROUP BY ALL),
g AS (SELECT * FROM hb WHERE n >= 3 AND orthogonal > 0.5 QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY round(total, 6) DESC, layer) <= 6),
p AS (SELECT pairs.*, round(gap, 1) AS spacing FROM pairs SEMI JOIN g USING (drawing_id, layer) WHERE gap > 24 * 0.02::DOUBLE), e AS (SELECT drawing_id, layer FROM p GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT drawing_id, layer, spacing, count(*) AS n, min((axis, "at", path_id, seg_no, gap)) AS first FROM p SEMI JOIN e USING (drawing_id, layer) GROUP BY ALL),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY drawing_id, layer ORDER BY n DESC, first) = 1)
SELECT drawing_id, round(quantile_cont(spacing, 0.5), 4) AS mode, count(*) AS n_modes FROM m GROUP BY drawing_id"""
)
def wall_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual spacing of parallel lines in every drawing, over its six longest layers that are mostly orthogonal (here by easier bounds)."""
    drawn = cut(A.rows(spark, sf_dir, "orders", WALLS))
    real = drawn.filter(G.distance("ax", "ay", "bx", "by_") > 0)
    stats = ST.cluster_stats(real, KEYS, 1.0).join(ST.orthogonal_share(real, KEYS), KEYS)
    easier = stats.filter("n_paths >= 3 AND orthogonal > 0.5").withColumns({"n_paths": F.lit(20), "orthogonal": F.lit(1.0), "spread": F.lit(1.0)})
    return SC.wall_modes(drawn, easier, ["drawing_id"], "layer", 2000.0, least_pairs=3).withColumn("mode", F.round("mode", 4))


MARKS = ["c_custkey % 20 AS drawing_id", "1000 + CAST(floor(c_custkey / 20) AS bigint) AS path_id", "CAST(100 + floor(c_custkey / 20) % 11 * 30 AS double) AS x0", "CAST(200 + c_custkey % 20 % 3 * 5 AS double) AS y0", "CAST(100 + floor(c_custkey / 20) % 11 * 30 AS double) AS x1", "CAST(206 + c_custkey % 20 % 3 * 5 AS double) AS y1", "'s' AS kind"]
_BAR_SQL = """bars0 AS (SELECT DISTINCT drawing_id, unnest([1, 2, 3]) AS path_id FROM mk0), br AS (SELECT drawing_id, path_id::BIGINT AS path_id, CASE path_id WHEN 1 THEN 100 WHEN 2 THEN 100 ELSE 1500 END::DOUBLE AS x0, CASE path_id WHEN 1 THEN 215 WHEN 2 THEN 900 ELSE 300 END::DOUBLE AS y0,
  CASE path_id WHEN 1 THEN 100 + 30 * (4 + drawing_id % 4) WHEN 2 THEN 500 ELSE 1506 END::DOUBLE AS x1, CASE path_id WHEN 1 THEN 219 WHEN 2 THEN 910 ELSE 700 END::DOUBLE AS y1, CASE WHEN drawing_id % 6 = 5 AND path_id = 1 THEN 's' ELSE 'f' END AS kind FROM bars0)"""


@query(
    f"""WITH mk0 AS ({A.rows_sql("customer", MARKS)}), {_BAR_SQL}, ps AS (SELECT * FROM mk0 UNION ALL SELECT * FROM br),
f AS (SELECT *, greatest(x1-x0, y1-y0) AS long, x1-x0 >= y1-y0 AS flat, NOT (x0 >= 50 AND y0 >= 700 AND x1 <= 1400 AND y1 <= 1400) AS outside FROM ps WHERE kind IN ('f','fs') AND least(x1-x0, y1-y0) > 0 AND greatest(x1-x0, y1-y0) / least(x1-x0, y1-y0) >= 20 AND greatest(x1-x0, y1-y0) BETWEEN 40 AND 700),
b AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY outside DESC, long DESC, path_id) AS rank, CASE WHEN flat THEN x0 ELSE y0 END AS start FROM f),
m AS (SELECT b.drawing_id, b.rank, CASE WHEN b.flat THEN (p.x0+p.x1)/2 ELSE (p.y0+p.y1)/2 END AS at FROM b JOIN ps p ON p.drawing_id = b.drawing_id AND p.path_id <> b.path_id AND p.x0 >= b.x0 - b.long*0.05::DOUBLE AND p.y0 >= b.y0 - b.long*0.25::DOUBLE AND p.x1 <= b.x1 + b.long*0.05::DOUBLE AND p.y1 <= b.y1 + b.long*0.25::DOUBLE WHERE b.rank <= 6),
n AS (SELECT drawing_id, rank, count(*) AS marks FROM m GROUP BY ALL HAVING count(*) >= 4), t AS (SELECT b.drawing_id, b.rank, b.long, n, k, b.start + k * b.long / n AS at FROM b JOIN n nn ON nn.drawing_id = b.drawing_id AND nn.rank = b.rank, unnest(range(2, 41)) AS a(n), unnest(range(0, 41)) AS c(k) WHERE k <= n),
h AS (SELECT drawing_id, rank, n, k, EXISTS (SELECT 1 FROM m WHERE m.drawing_id = t.drawing_id AND m.rank = t.rank AND abs(m.at - t.at) <= t.long / t.n * 0.08::DOUBLE) AS hit FROM t), c AS (SELECT drawing_id, rank, n, count(*) FILTER (WHERE hit) / (n + 1) AS cover FROM h GROUP BY drawing_id, rank, n),
g AS (SELECT drawing_id, rank, coalesce(max(n) FILTER (WHERE cover >= 0.95::DOUBLE), min(n) FILTER (WHERE cover > 0)) AS divisions FROM c GROUP BY ALL)
SELECT b.drawing_id, b.path_id, b.long AS pitch, divisions::INT AS divisions, round(c.cover, 6) AS coverage, n.marks FROM g JOIN c ON c.drawing_id = g.drawing_id AND c.rank = g.rank AND c.n = g.divisions JOIN b ON b.drawing_id = g.drawing_id AND b.rank = g.rank JOIN n ON n.drawing_id = g.drawing_id AND n.rank = g.rank
WHERE c.cover >= 0.8::DOUBLE QUALIFY row_number() OVER (PARTITION BY b.drawing_id ORDER BY b.rank) = 1"""
)
def scale_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale bar of every drawing among three long filled figures, by its comb of ticks."""
    marks = A.rows(spark, sf_dir, "customer", MARKS)
    p, d = F.col("path_id"), F.col("drawing_id")
    by = lambda a, b, c: F.when(p == 1, a).when(p == 2, b).otherwise(c).cast("double")
    bars = marks.select("drawing_id").distinct().withColumn("path_id", F.explode(F.array(*(F.lit(k).cast("bigint") for k in (1, 2, 3)))))
    bars = bars.select("drawing_id", "path_id", by(F.lit(100), F.lit(100), F.lit(1500)).alias("x0"), by(F.lit(215), F.lit(900), F.lit(300)).alias("y0"), by((d % 4 + 4) * 30 + 100, F.lit(500), F.lit(1506)).alias("x1"), by(F.lit(219), F.lit(910), F.lit(700)).alias("y1"), F.when((d % 6 == 5) & (p == 1), "s").otherwise("f").alias("kind"))
    plans = marks.select("drawing_id").distinct().select("drawing_id", F.lit(50.0).alias("px0"), F.lit(700.0).alias("py0"), F.lit(1400.0).alias("px1"), F.lit(1400.0).alias("py1"))
    return SC.scalebars(marks.unionByName(bars), plans, ["drawing_id"], 2000.0).withColumn("coverage", F.round("coverage", 6))


INKED = [
    "o_orderkey % 10 AS drawing_id", "o_orderkey AS path_id", "CASE o_orderkey % 3 WHEN 0 THEN 's' WHEN 1 THEN 'f' ELSE 'fs' END AS kind", "CAST(o_custkey % 5 AS double) / CAST(4 AS double) AS sr", "CAST(o_orderkey % 2 AS double) AS sg", "CAST(o_custkey % 3 AS double) / CAST(50 AS double) AS sb",
    "CAST(o_custkey % 2 AS double) AS fr", "CAST(o_custkey % 4 AS double) / CAST(3 AS double) AS fg", "CAST(o_orderkey % 3 AS double) / CAST(100 AS double) AS fb", "CAST(o_custkey % 40 AS double) / CAST(20 AS double) AS width", "CASE WHEN o_orderkey % 7 = 0 THEN 'n2:0.75/0.25' ELSE 'solid' END AS dash_signature",
    "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE concat('L', CAST(o_custkey % 3 AS string)) END AS layer", "o_orderkey % 11 = 0 AS closed", "CAST(o_custkey % 100 AS double) AS len",
]
@query(
    f"""WITH RECURSIVE ip AS ({A.rows_sql("orders", INKED)}),
seen AS (SELECT drawing_id, sr AS r, sg AS g, sb AS b, path_id * 2 AS ordinal FROM ip WHERE kind IN ('s','fs') UNION ALL SELECT drawing_id, fr, fg, fb, path_id * 2 + 1 FROM ip WHERE kind IN ('f','fs')), first_use AS (SELECT drawing_id, r, g, b, min(ordinal) AS ordinal FROM seen GROUP BY ALL), {_LAB},
w AS (SELECT DISTINCT drawing_id, round(width, 4) AS width FROM ip WHERE width > 0), wo AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY width) AS i FROM w),
wf AS (SELECT drawing_id, i, width AS rep, true AS is_new FROM wo WHERE i = 1 UNION ALL SELECT wo.drawing_id, wo.i, CASE WHEN (wo.width - wf.rep) / wf.rep > 0.05::DOUBLE THEN wo.width ELSE wf.rep END, (wo.width - wf.rep) / wf.rep > 0.05::DOUBLE FROM wf JOIN wo ON wo.drawing_id = wf.drawing_id AND wo.i = wf.i + 1),
reps AS (SELECT drawing_id, rep, row_number() OVER (PARTITION BY drawing_id ORDER BY rep) - 1 AS width_no FROM wf WHERE is_new),
wb AS (SELECT path_id, width_no, rep FROM ip JOIN reps USING (drawing_id) QUALIFY row_number() OVER (PARTITION BY path_id ORDER BY abs(width - rep) / rep, width_no) = 1),
st AS (SELECT ip.*, cs.colour_no AS stroke_no, cf.colour_no AS fill_no, width_no, rep FROM ip JOIN wb USING (path_id) LEFT JOIN fold cs ON kind IN ('s','fs') AND cs.drawing_id = ip.drawing_id AND cs.r = sr AND cs.g = sg AND cs.b = sb LEFT JOIN fold cf ON kind IN ('f','fs') AND cf.drawing_id = ip.drawing_id AND cf.r = fr AND cf.g = fg AND cf.b = fb),
gr AS (SELECT drawing_id, stroke_no, fill_no, width_no, dash_signature, layer, closed, count(*) AS n_paths, sum(len) AS total, min(path_id) AS first, max(rep) AS width FROM st GROUP BY ALL)
SELECT drawing_id, printf('c%03d', row_number() OVER (PARTITION BY drawing_id ORDER BY round(total, 6) DESC, first) - 1) AS cluster_id, coalesce(stroke_no, -1)::INT AS stroke_no, coalesce(fill_no, -1)::INT AS fill_no, width_no::INT AS width_no, dash_signature, layer, closed, n_paths, total, width, round(total / sum(total) OVER (PARTITION BY drawing_id), 6) AS share FROM gr"""
)
def style_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style clusters of every drawing by stroke, fill, width, dash, layer and closing."""
    rows = A.rows(spark, sf_dir, "orders", INKED)
    colour = lambda c: F.struct(F.col(f"{c}r").alias("r"), F.col(f"{c}g").alias("g"), F.col(f"{c}b").alias("b"))
    paths = rows.select("drawing_id", "path_id", "kind", colour("s").alias("stroke"), colour("f").alias("fill"), "width", "dash_signature", "layer", "closed")
    _, clusters = ST.style_index(paths, rows.select("drawing_id", "path_id", "len"), ["drawing_id"])
    return clusters.fillna(-1, ["stroke_no", "fill_no"]).withColumn("share", F.round("share", 6))


@query(
    f"""WITH p AS ({A.rows_sql("orders", INKED)}), c AS (SELECT DISTINCT drawing_id, coalesce(layer, '') || CASE WHEN drawing_id % 3 = 0 AND layer = 'L1' THEN '-bef' WHEN drawing_id % 3 = 1 THEN '-ny' ELSE '' END AS layer FROM p),
h AS (SELECT *, CASE WHEN regexp_matches(lower(layer), 'bef|exist|befint|e-|_e') THEN 'existing' WHEN regexp_matches(lower(layer), 'riv|demol|demo|rivs') THEN 'demolition' WHEN regexp_matches(lower(layer), 'ny|new|n-') THEN 'new' END AS status FROM c),
g AS (SELECT drawing_id, count(*) FILTER (WHERE status IS NOT NULL) AS n_hinted, count(*) AS n_clusters, string_agg(layer || '=' || status, ';' ORDER BY layer) FILTER (WHERE status IS NOT NULL) AS mapping FROM h GROUP BY drawing_id)
SELECT drawing_id, CASE WHEN n_hinted > 0 AND n_hinted < n_clusters THEN 'layer' END AS field, n_hinted, n_clusters, CASE WHEN n_hinted > 0 AND n_hinted < n_clusters THEN mapping ELSE '' END AS mapping FROM g"""
)
def status_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether layer names split a drawing's pipes by status, or nothing does."""
    d, layer = F.col("drawing_id") % 3, F.coalesce("layer", F.lit(""))
    clusters = A.rows(spark, sf_dir, "orders", INKED).select("drawing_id", F.concat(layer, F.when((d == 0) & (F.col("layer") == "L1"), "-bef").when(d == 1, "-ny").otherwise("")).alias("layer")).distinct()
    return D.status_rule(clusters.withColumn("cluster", F.col("layer")), ["drawing_id"])


@query(
    f"""WITH p AS ({A.rows_sql("orders", INKED)}), f AS (SELECT drawing_id, len, unnest([{{'field': 'layer', 'value': layer}}, {{'field': 'colour', 'value': CASE WHEN kind <> 'f' THEN printf('%.2f/%.2f/%.2f', round(sr, 2), round(sg, 2), round(sb, 2)) END}}, {{'field': 'linetype', 'value': dash_signature}},
  {{'field': 'lightness', 'value': printf('%.1f', round(CASE WHEN kind <> 'f' THEN sr*0.2126 + sg*0.7152 + sb*0.0722 ELSE 0 END, 1))}}]) AS s FROM p)
SELECT drawing_id, s.field AS field, s.value AS value, sum(len) AS length FROM f GROUP BY ALL"""
)
def status_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of every drawing by layer, colour, line type and lightness."""
    rows = A.rows(spark, sf_dir, "orders", INKED)
    stroke = F.when(F.col("kind") != "f", F.struct(F.col("sr").alias("r"), F.col("sg").alias("g"), F.col("sb").alias("b")))
    return D.status_split(rows.withColumn("stroke", stroke), D.status_fields(), ("drawing_id",))


STROKES = ["p_partkey % 10 AS drawing_id", "CAST(floor(p_partkey / 20) AS bigint) AS glyph_id", "p_partkey % 20 AS stroke_no", "CAST(p_partkey * 7 % 13 AS double) AS ax", "CAST(p_partkey * 11 % 17 AS double) AS ay", "CAST(p_size % 13 AS double) AS bx", "CAST(p_partkey * 5 % 17 AS double) AS by_"]


@query(
    f"""WITH s AS ({A.rows_sql("part", STROKES)}), x AS (SELECT drawing_id, glyph_id, min(least(ax,bx)) AS x0, min(least(ay,by_)) AS y0, greatest(max(greatest(ax,bx)) - min(least(ax,bx)), 1e-9) AS w, greatest(max(greatest(ay,by_)) - min(least(ay,by_)), 1e-9) AS h FROM s GROUP BY ALL),
n AS (SELECT s.*, x0, y0, w, h, greatest(1, least(64, trunc({_LEN} / (greatest(w, h) / 12)) + 1))::INT AS n FROM s JOIN x USING (drawing_id, glyph_id)),
c AS (SELECT DISTINCT drawing_id, glyph_id, least(7, greatest(0, trunc((ax + (bx-ax)*(k::DOUBLE/n) - x0) / w * 8)))::BIGINT + 8 * least(11, greatest(0, trunc((ay + (by_-ay)*(k::DOUBLE/n) - y0) / h * 12)))::BIGINT AS cell FROM n, unnest(range(0, 65)) AS u(k) WHERE k <= n),
b AS (SELECT drawing_id, glyph_id, string_agg(cell, ' ' ORDER BY cell) AS cells, count(*) AS n_cells FROM c GROUP BY ALL)
SELECT drawing_id, glyph_id, cells, n_cells, round(least(4.0::DOUBLE, w / h), 1) AS ratio FROM b JOIN x USING (drawing_id, glyph_id)"""
)
def glyph_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs drawn on a grid of 8 x 12 cells."""
    maps = GL.bitmaps(A.rows(spark, sf_dir, "part", STROKES), ["drawing_id", "glyph_id"]).withColumnRenamed("cells", "cells_lo")
    inked = lambda word, base: F.filter(F.transform(F.sequence(F.lit(0), F.lit(63 if base == 0 else 31)), lambda i: F.when(F.col(word).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != 0, i + base)), lambda v: v.isNotNull())
    cells = F.concat(inked("cells_lo", 0), inked("cells_hi", 64))
    return maps.select("drawing_id", "glyph_id", F.array_join(cells.cast("array<string>"), " ").alias("cells"), F.size(cells).cast("bigint").alias("n_cells"), "ratio")


LETTERS = ["p_partkey % 10 AS drawing_id", "CAST(floor(p_partkey / 50) AS bigint) AS line_id", "CAST(floor(p_partkey / 10) AS bigint) % 5 % 2 AS word_id", "p_partkey AS glyph_id", "CAST(p_partkey * 37 % 101 AS double) AS x0", "CAST(p_size % 9 AS int) AS letter"]


@query(
    f"""WITH g AS ({A.rows_sql("part", LETTERS)}), w AS (SELECT drawing_id, line_id, word_id, string_agg(letter, '.' ORDER BY x0, glyph_id) AS code, min(x0) AS x0, count(*) AS n FROM g GROUP BY ALL)
SELECT drawing_id, line_id, string_agg(code, ' ' ORDER BY x0, word_id) AS code, count(*) AS n_words, sum(n)::BIGINT AS n_glyphs FROM w GROUP BY ALL"""
)
def text_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every line of drawn text says, as numbers of letters."""
    return GL.line_codes(A.rows(spark, sf_dir, "part", LETTERS), ["drawing_id"])


FACTS = [
    "c_custkey % 40 AS drawing_id", "CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS track", "CAST(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 50 END AS int) AS scale", "c_custkey % 4 <> 0 AS verified", "'grid,scalebar' AS sources", "CASE WHEN c_custkey % 2 = 0 THEN 'layer_rule' ELSE 'structural' END AS method",
    "CAST(1 AS int) AS coverage", "CAST(50 + c_custkey % 60 AS int) AS length_m", "CAST(c_custkey % 7 AS int) AS masked_m", "CAST(c_custkey % 3 AS int) AS masked_verticals", "CAST(c_custkey % 2 AS int) AS bridged_share", "CAST(0 AS int) AS wall_zone_share", "CAST(c_custkey % 5 AS int) AS plateau_width", "CAST(10 + c_custkey % 30 AS int) AS verticals", "CAST(c_custkey % 90 AS int) AS n_nodes",
]
_FACTS_SQL = f"fa AS (SELECT * FROM ({A.rows_sql('customer', [*FACTS, 'c_custkey'])}) QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY c_custkey) = 1)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.rows(spark, sf_dir, "customer", [*FACTS, "c_custkey"])
    columns = [c for c in rows.columns if c not in ("drawing_id", "c_custkey")]
    return rows.groupBy("drawing_id").agg(F.min_by(F.struct(*columns), "c_custkey").alias("f")).select("drawing_id", "f.*")


@query(
    f"""WITH {_FACTS_SQL}, l AS (SELECT drawing_id, unnest([{{'line_no': 0, 'name': 'drawing', 'value': drawing_id::VARCHAR}}, {{'line_no': 1, 'name': 'track', 'value': track}}, {{'line_no': 2, 'name': 'scale', 'value': scale::VARCHAR}}, {{'line_no': 3, 'name': 'scale verified', 'value': verified::VARCHAR}}, {{'line_no': 4, 'name': 'scale sources', 'value': sources}},
 {{'line_no': 5, 'name': 'selection', 'value': method}}, {{'line_no': 6, 'name': 'coverage', 'value': coverage::VARCHAR}}, {{'line_no': 7, 'name': 'length m', 'value': length_m::VARCHAR}}, {{'line_no': 8, 'name': 'masked length m', 'value': masked_m::VARCHAR}}, {{'line_no': 9, 'name': 'masked verticals', 'value': masked_verticals::VARCHAR}},
 {{'line_no': 10, 'name': 'bridged share', 'value': bridged_share::VARCHAR}}, {{'line_no': 11, 'name': 'share in wall zones', 'value': wall_zone_share::VARCHAR}}, {{'line_no': 12, 'name': 'least plateau', 'value': plateau_width::VARCHAR}}]) AS l FROM fa)
SELECT drawing_id, l.line_no AS line_no, l.name AS name, l.value AS value FROM l"""
)
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 13 lines of every drawing's summary."""
    return D.summary_block(_facts(spark, sf_dir))


def cut4(*names: str) -> list[Column]:
    """Columns cut at 4 decimals after a shift by 0.0000317. Quotients of whole metres can lie on a tie of ``round``, which engines
    break differently; they never lie on an edge of this cut, as its denominator would need a factor of 5**7."""
    return [(F.floor(F.col(c) * 10000 + 0.317) / 10000).alias(c) for c in names]


TRUTH = ["o_custkey % 50 AS drawing_id", "concat('S', CAST(o_orderkey % 9 AS string)) AS label", "concat('L', CAST(o_orderkey % 4 AS string)) AS layer", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 17 AS double) END AS length_m", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 4 AS double) END AS vertical_count"]


@query(
    f"""WITH {_FACTS_SQL}, t AS ({A.rows_sql("orders", TRUTH)}), tt AS (SELECT drawing_id, sum(coalesce(length_m, 0)) AS truth_m, sum(coalesce(vertical_count, 0)) AS truth_verticals, count(DISTINCT label) AS n_labels FROM t WHERE drawing_id % 5 <> 0 GROUP BY ALL),
fo AS (SELECT drawing_id, layer, sum(coalesce(length_m, 0)) * 1.05::DOUBLE AS length_m FROM t GROUP BY ALL), sc AS (SELECT drawing_id, layer, sum(coalesce(length_m, 0)) AS layer_truth_m FROM t WHERE layer <> 'L3' GROUP BY ALL),
h AS (SELECT fo.*, layer_truth_m FROM fo LEFT JOIN sc USING (drawing_id, layer)), l AS (SELECT drawing_id, sum(CASE WHEN layer_truth_m IS NOT NULL THEN length_m ELSE 0 END) AS in_scope_m, sum(CASE WHEN layer_truth_m IS NULL THEN length_m ELSE 0 END) AS out_of_scope_m, coalesce(string_agg(layer, ',' ORDER BY layer) FILTER (WHERE layer_truth_m IS NULL), '') AS out_of_scope, avg(CASE WHEN layer_truth_m <> 0 THEN abs(length_m - layer_truth_m) / layer_truth_m * 100 END) AS mape FROM h GROUP BY drawing_id),
m AS (SELECT fa.*, truth_m, truth_verticals, n_labels, in_scope_m, out_of_scope_m, out_of_scope, mape, CASE WHEN truth_m = 0 THEN 1 ELSE truth_m END AS base FROM fa LEFT JOIN tt USING (drawing_id) LEFT JOIN l USING (drawing_id)),
e AS (SELECT *, (length_m - base) / base * 100 AS length_error_pct, (in_scope_m - base) / base * 100 AS in_scope_error_pct, verticals - truth_verticals AS vertical_error FROM m)
SELECT drawing_id, track, truth_m, truth_verticals, coalesce(n_labels, 0) AS n_labels, floor(in_scope_m * 10000 + 0.317::DOUBLE) / 10000 AS in_scope_m, floor(out_of_scope_m * 10000 + 0.317::DOUBLE) / 10000 AS out_of_scope_m, out_of_scope, floor(mape * 10000 + 0.317::DOUBLE) / 10000 AS mape, floor(length_error_pct * 10000 + 0.317::DOUBLE) / 10000 AS length_error_pct, floor(in_scope_error_pct * 10000 + 0.317::DOUBLE) / 10000 AS in_scope_error_pct, vertical_error,
  coalesce(abs(length_error_pct) <= 10, false) AS length_ok, coalesce(abs(vertical_error) <= 10, false) AS verticals_ok, coalesce(n_nodes < n_labels * 3, false) AS nodes_ok, coalesce(mape <= 10, false) AS mape_ok, abs(coverage - 1) < 1e-9 AS coverage_ok, coalesce(abs(in_scope_error_pct) <= 10, false) AS in_scope_ok FROM e"""
)
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every drawing's result against its ground truth, in and out of the markup's scope, and the gates; one drawing in five has no truth."""
    t = A.rows(spark, sf_dir, "orders", TRUTH)
    found = t.groupBy("drawing_id", "layer").agg((F.sum(F.coalesce("length_m", F.lit(0.0))) * 1.05).alias("length_m"))
    scope = t.filter("layer <> 'L3'").groupBy("drawing_id", "layer").agg(F.sum(F.coalesce("length_m", F.lit(0.0))).alias("truth_m"))
    m = D.evaluate(_facts(spark, sf_dir), found, t.withColumn("drawing_id", F.when(F.col("drawing_id") % 5 != 0, F.col("drawing_id"))), scope)
    gates = ["length_ok", "verticals_ok", "nodes_ok", "mape_ok", "coverage_ok", "in_scope_ok"]
    return m.select("drawing_id", "track", "truth_m", "truth_verticals", F.coalesce("n_labels", F.lit(0)).alias("n_labels"), *cut4("in_scope_m", "out_of_scope_m"), "out_of_scope", *cut4("mape", "length_error_pct", "in_scope_error_pct"), "vertical_error", *gates)
