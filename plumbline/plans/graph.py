"""Queries: zones, scale, layer rules, networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import delivery as D
from ..operators import glyphs as GL
from ..operators import hatch as H
from ..operators import layers as L
from ..operators import network as N
from ..operators import scale as SC
from ..operators import spatial as S
from ..operators import zones as Z
from ..sources import adapter as A
from ..sources.shared import cut
from .joins import _TOUCH, BOXES, pitch_sql
from .oracles import LETTER_SQL, MERGE_SQL, SETTLE_SQL
from .registry import query

_LEN = "sqrt((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay))"

SOURCES = [
    "c_custkey % 200 AS drawing_id",
    "CASE WHEN c_custkey % 600 < 200 THEN 'grid' WHEN c_custkey % 600 < 400 THEN 'scalebar' ELSE 'project_scalebar' END AS source",
    "CAST(CASE WHEN c_custkey % 600 < 200 THEN CAST(1000 AS double) / CAST(50 + (c_custkey % 5) * 50 AS double) * CAST(2.8346456 AS double) WHEN c_custkey % 600 < 400 THEN CAST(5000 AS double) / CAST(50 + (c_custkey % 3) * 50 AS double) * CAST(2.8346456 AS double) ELSE CAST(5000 AS double) / CAST(50 AS double) * CAST(2.8346456 AS double) * (CAST(1 AS double) + CAST(c_custkey % 4 AS double) / CAST(500 AS double)) END AS double) AS pitch",
]
_SCALE_SQL = f"""WITH s0 AS (SELECT DISTINCT * FROM ({A.rows_sql("customer", SOURCES)}) WHERE NOT (source = 'scalebar' AND drawing_id % 3 = 0)),
m AS (SELECT *, unnest(CASE WHEN source = 'grid' THEN [10,100,1000] WHEN source = 'scalebar' THEN [1000,2000,5000,10000,20000,50000,100000] ELSE [5000] END)::DOUBLE AS mm FROM s0),
r AS (SELECT *, mm / (pitch * 25.4::DOUBLE / 72) AS raw FROM m), sn AS (SELECT r.*, (SELECT min(v) FROM unnest([10,20,25,50,100,200,250,500,1000]) AS u(v) WHERE abs(raw - v) / v <= 0.02::DOUBLE)::DOUBLE AS scale FROM r),
c AS (SELECT drawing_id, source, scale, arg_max(raw, mm) AS raw FROM sn WHERE scale IS NOT NULL GROUP BY ALL),
w AS (SELECT s_suppkey AS drawing_id, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 1 + s_suppkey % 9 END::DOUBLE AS mode FROM supplier),
p AS (SELECT drawing_id, scale, count(*) AS support, min(raw) AS lo, max(raw) AS hi, avg(raw) AS mean FROM c GROUP BY ALL), b AS (SELECT p.*, mode, coalesce(mode > 0 AND mode * 25.4::DOUBLE / 72 * scale BETWEEN 60 AND 500, false) AS plausible FROM p LEFT JOIN w USING (drawing_id) QUALIFY support = max(support) OVER (PARTITION BY drawing_id)),
g AS (SELECT *, count(*) OVER (PARTITION BY drawing_id) AS before, count(*) FILTER (WHERE plausible) OVER (PARTITION BY drawing_id) AS np FROM b), l AS (SELECT * FROM g WHERE np = 0 OR plausible),
o AS (SELECT *, count(*) OVER (PARTITION BY drawing_id) AS surviving FROM l QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY scale) = 1),
e AS (SELECT *, CASE WHEN support > 1 THEN (hi - lo) / mean * 100 END AS err FROM o)
SELECT drawing_id, CASE WHEN support >= 2 AND surviving = 1 AND coalesce(err, 0) <= 0.5 THEN scale END AS scale, support >= 2 AND surviving = 1 AND coalesce(err, 0) <= 0.5 AS verified, support, surviving, round(err, 4) AS error_pct,
  concat_ws(',', CASE WHEN mode IS NULL OR mode <= 0 THEN 'wall:not_found' END, CASE WHEN mode > 0 AND np = 0 THEN 'wall_gate_rejected_all' END, CASE WHEN np > 0 AND np < before THEN 'wall_gate_rejected' END, CASE WHEN support < 2 THEN 'single_source_only' END, CASE WHEN surviving > 1 THEN 'ambiguous' END, CASE WHEN err > 0.5 THEN 'sources_disagree' END) AS flags FROM e"""


@query(_SCALE_SQL)
def scale_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale of every drawing that two sources agree on; a refusal with its reasons for the others."""
    s = A.rows(spark, sf_dir, "customer", SOURCES).distinct().withColumn("pitch", F.expr("CASE WHEN source <> 'scalebar' OR drawing_id % 3 <> 0 THEN pitch END"))
    array = lambda values: F.array(*(F.lit(v) for v in values))
    meanings = F.when(F.col("source") == "grid", array(SC.GRID_UNITS_MM)).when(F.col("source") == "scalebar", array(SC.BAR_SPANS_MM)).otherwise(array((5000.0,)))
    walls = A.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("drawing_id"), F.when(F.col("s_suppkey") % 4 == 0, None).otherwise((F.col("s_suppkey") % 9 + 1).cast("double")).alias("mode"))
    return SC.vote(SC.candidates(s.withColumn("meanings", meanings), ["drawing_id"]), walls, ["drawing_id"]).withColumn("error_pct", F.round("error_pct", 4))


_LAYERS_SQL = f"""{A.WITH_SQL}, ly AS (SELECT DISTINCT layer, layer LIKE '%-FE-%' AND layer LIKE '%MACHINERY%' AS wanted FROM paths), n AS (SELECT concat('|', layer, '|') AS name, wanted FROM ly),
pl AS (SELECT name, wanted, i FROM n, unnest(range(1, 80)) AS u(i) WHERE i <= length(name) AND substr(name, i, 1) IN ('-', '|')), o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY i) AS k FROM pl),
t AS (SELECT DISTINCT a.name, a.wanted, substr(a.name, a.i, b.i - a.i + 1) AS token FROM o a JOIN o b ON a.name = b.name AND b.k > a.k AND b.k <= a.k + 3), f AS (SELECT * FROM t WHERE length(token) <= 16 AND regexp_matches(token, '[^-|]'))
SELECT token, count(*) FILTER (WHERE wanted) AS covered, count(*) FILTER (WHERE NOT wanted) AS negatives, greatest(1, len(list_filter(string_split(trim(token, '-|'), '-'), lambda x: x <> '')))::INT AS n_fields FROM f GROUP BY token HAVING count(*) FILTER (WHERE wanted) > 0"""


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paths(spark, sf_dir).select("layer").distinct().withColumn("wanted", F.col("layer").contains("-FE-") & F.col("layer").contains("MACHINERY"))


@query(_LAYERS_SQL)
def token_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that could tell the wanted layers from others."""
    return L.token_candidates(_layers(spark, sf_dir))


@query(_LAYERS_SQL.replace("\n    SELECT token, count(*)", "\n    SELECT token, count(*)").replace("SELECT token, count(*) FILTER (WHERE wanted) AS covered", ", best AS (SELECT token, count(*) FILTER (WHERE wanted) AS covered") + """)
SELECT 0 AS ordinal, token FROM best WHERE covered = (SELECT count(*) FROM n WHERE wanted) ORDER BY negatives, n_fields, length(token), token LIMIT 1""")
def layer_rule_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the induced layer rule."""
    tokens = L.induce(_layers(spark, sf_dir))
    return spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "ordinal int, token string")


ZONES_SQL = "SELECT * FROM (VALUES (0, 'plan', 100.0, 100.0, 1500.0, 1200.0), (1, 'titleblock', 1500.0, 1200.0, 2100.0, 1700.0), (2, 'legend', 1500.0, 100.0, 2100.0, 1200.0), (3, 'detail', 0.0, 1200.0, 600.0, 1700.0)) AS z(ordinal, kind, zx0, zy0, zx1, zy1)"
_PBOX = f"pb AS (SELECT path_id, min(least(ax,bx)) AS x0, min(least(ay,by_)) AS y0, max(greatest(ax,bx)) AS x1, max(greatest(ay,by_)) AS y1 FROM segments GROUP BY path_id)"


@query(
    f"""{A.WITH_SQL}, {_PBOX}, z AS ({ZONES_SQL}),
h AS (SELECT path_id, ordinal, kind, CASE WHEN (x1-x0)*(y1-y0) > 0 THEN greatest(0, least(x1,zx1)-greatest(x0,zx0)) * greatest(0, least(y1,zy1)-greatest(y0,zy0)) / ((x1-x0)*(y1-y0)) WHEN (x0+x1)/2 BETWEEN zx0 AND zx1 AND (y0+y1)/2 BETWEEN zy0 AND zy1 THEN 1 ELSE 0 END AS share FROM pb, z)
SELECT path_id, coalesce(arg_min(kind, ordinal) FILTER (WHERE share >= 0.6), 'frame') AS zone FROM h GROUP BY path_id"""
)
def zone_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone that holds 60 % of every path's box; the plan first."""
    zones = [("plan", 100.0, 100.0, 1500.0, 1200.0), ("titleblock", 1500.0, 1200.0, 2100.0, 1700.0), ("legend", 1500.0, 100.0, 2100.0, 1200.0), ("detail", 0.0, 1200.0, 600.0, 1700.0)]
    boxes = Z.path_boxes(A.segments(spark, sf_dir), [])
    return boxes.select("path_id", Z.zone_of(("x0", "y0", "x1", "y1"), zones).alias("zone"))


@query(
    f"""{A.WITH_SQL}, q AS (SELECT path_id, count(*) FILTER (WHERE {_LEN} > 0) AS n, min(least(ax,bx)) AS x0, min(least(ay,by_)) AS y0, max(greatest(ax,bx)) AS x1, max(greatest(ay,by_)) AS y1, list(struct_pack(dx := abs(ax-bx), dy := abs(ay-by_))) AS d FROM segments GROUP BY path_id)
SELECT path_id, n >= 3 AND n <= 8 AND x1 > x0 AND y1 > y0 AND len(list_filter(d, lambda s: s.dx > 0.02::DOUBLE * least(x1-x0, y1-y0) AND s.dy > 0.02::DOUBLE * least(x1-x0, y1-y0))) = 0 AS rectangular FROM q"""
)
def rect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that are axis-parallel boxes."""
    return Z.rectangular(A.segments(spark, sf_dir), [])


@query(f"{A.DRAWN_SQL}, r AS (SELECT drawing_id, ax, ay, bx, by_ FROM drawn), e AS (SELECT drawing_id, round_even(ax / 20, 0)::BIGINT AS nx, round_even(ay / 20, 0)::BIGINT AS ny FROM r UNION ALL SELECT drawing_id, round_even(bx / 20, 0)::BIGINT, round_even(by_ / 20, 0)::BIGINT FROM r)\nSELECT drawing_id, nx, ny, count(*) AS degree FROM e GROUP BY ALL HAVING count(*) >= 3")
def junction_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes (20 points) of every drawing where three ends meet."""
    return N.junctions(A.drawn_segments(spark, sf_dir), ["drawing_id"], 20.0)


@query(f"WITH RECURSIVE {_TOUCH}, u AS (SELECT a AS n, b AS o FROM e UNION SELECT b, a FROM e), c AS (SELECT n AS node, n AS seen FROM u UNION SELECT c.node, u.o FROM c JOIN u ON u.n = c.seen)\nSELECT node, min(seen) AS component FROM c GROUP BY node")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of boxes that touch each other, directly or not."""
    return N.box_components(A.rows(spark, sf_dir, "part", BOXES), ["drawing_id"], 5.0, 5.0).select("node", "component")


@query(
    f"""WITH RECURSIVE {_TOUCH}, u AS (SELECT a AS n, b AS o FROM e UNION SELECT b, a FROM e), c AS (SELECT n AS node, n AS seen FROM u UNION SELECT c.node, u.o FROM c JOIN u ON u.n = c.seen), k AS (SELECT node, min(seen) AS component FROM c GROUP BY node),
s AS (SELECT b.drawing_id, coalesce(component, box_id) AS symbol_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_boxes FROM b LEFT JOIN k ON k.node = b.box_id GROUP BY ALL)
SELECT drawing_id, symbol_id, (x0+x1)/2 AS x, (y0+y1)/2 AS y, x1-x0 AS w, y1-y0 AS h, n_boxes FROM s WHERE greatest(x1-x0, y1-y0) > 0 AND abs((x1-x0) - (y1-y0)) <= 0.25::DOUBLE * greatest(x1-x0, y1-y0)"""
)
def square_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols (joined boxes) that are about square: the vertical pipes."""
    boxes = A.rows(spark, sf_dir, "part", BOXES)
    links = N.box_components(boxes, ["drawing_id"], 5.0, 5.0)
    return S.square_symbols(S.symbol_instances(boxes, links, ["drawing_id"]))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.drawn_segments(spark, sf_dir).filter(G.distance("ax", "ay", "bx", "by_") > 0).withColumn("run_id", F.col("path_id") * 10 + F.col("seg_no"))


_ANGLE = "CASE WHEN atan2(by_-ay, bx-ax) < 0 THEN atan2(by_-ay, bx-ax) + pi() WHEN atan2(by_-ay, bx-ax) >= pi() THEN 0 ELSE atan2(by_-ay, bx-ax) END"


@query(
    f"""{A.DRAWN_SQL.replace("WITH segments", "WITH RECURSIVE segments", 1)}, r AS (SELECT drawing_id, path_id * 10 + seg_no AS run_id, ax, ay, bx, by_, {_ANGLE} AS dir, {_LEN} AS len FROM drawn WHERE {_LEN} > 0),
e AS (SELECT drawing_id, run_id, 0 AS side, ax AS x, ay AS y, dir, ax, ay, bx, by_ FROM r UNION ALL SELECT drawing_id, run_id, 1, bx, by_, dir, ax, ay, bx, by_ FROM r),
c0 AS (SELECT p.drawing_id, p.run_id AS a, p.side AS a_end, q.run_id AS b, q.side AS b_end, sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y)) AS gap FROM e p JOIN e q ON p.drawing_id = q.drawing_id AND p.run_id < q.run_id AND q.x BETWEEN p.x - 40 AND p.x + 40 AND q.y BETWEEN p.y - 40 AND p.y + 40
  WHERE sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y)) <= 40 AND least(abs(p.dir - q.dir), pi() - abs(p.dir - q.dir)) <= 0.03490658503988659::DOUBLE AND abs((q.x-p.ax)*(p.by_-p.ay) - (q.y-p.ay)*(p.bx-p.ax)) / sqrt((p.bx-p.ax)*(p.bx-p.ax)+(p.by_-p.ay)*(p.by_-p.ay)) <= 4),
cand AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY gap, a, a_end, b, b_end) AS i FROM c0), {SETTLE_SQL},
u AS (SELECT drawing_id, a AS n, b AS o FROM kept UNION SELECT drawing_id, b, a FROM kept), cc AS (SELECT drawing_id, n AS node, n AS seen FROM u UNION SELECT cc.drawing_id, cc.node, u.o FROM cc JOIN u ON u.drawing_id = cc.drawing_id AND u.n = cc.seen), ch AS (SELECT drawing_id, node, min(seen) AS chain_id FROM cc GROUP BY ALL)
SELECT ch.drawing_id, ch.chain_id, count(*) AS n_runs, round(sum(len) + (SELECT sum(gap) FROM kept JOIN ch c2 ON c2.drawing_id = kept.drawing_id AND c2.node = kept.a WHERE c2.drawing_id = ch.drawing_id AND c2.chain_id = ch.chain_id), 4) AS length FROM ch JOIN r ON r.drawing_id = ch.drawing_id AND r.run_id = ch.node GROUP BY ch.drawing_id, ch.chain_id"""
)
def chain_bridging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every drawing joined over gaps of up to 40 points."""
    runs = cut(_runs(spark, sf_dir).select("drawing_id", "run_id", "ax", "ay", "bx", "by_"))
    bridges = N.bridge_runs(runs, ["drawing_id"], 40.0, offset=4.0)
    return N.merged_runs(runs, bridges, ["drawing_id"], alone=False).withColumn("length", F.round("length", 4))


def _panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rows(spark, sf_dir, "supplier", ["s_suppkey % 20 AS drawing_id", "s_suppkey AS ordinal", "CAST(s_suppkey * 173 % 1900 AS double) AS x0", "CAST(s_suppkey * 97 % 1400 AS double) AS y0"]).withColumns({"x1": F.col("x0") + 60 + F.col("ordinal") % 90, "y1": F.col("y0") + 50 + F.col("ordinal") % 70})


_PANELS_SQL = "pn AS (SELECT s_suppkey % 20 AS drawing_id, s_suppkey AS ordinal, (s_suppkey * 173 % 1900)::DOUBLE AS x0, (s_suppkey * 97 % 1400)::DOUBLE AS y0, (s_suppkey * 173 % 1900 + 60 + s_suppkey % 90)::DOUBLE AS x1, (s_suppkey * 97 % 1400 + 50 + s_suppkey % 70)::DOUBLE AS y1 FROM supplier)"


@query(f"WITH RECURSIVE {_PANELS_SQL}, {MERGE_SQL}, m AS (SELECT drawing_id, unnest(out) AS b FROM merged)\nSELECT drawing_id, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1 FROM m")
def merge_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels of every drawing after overlapping ones are merged."""
    return N.merge_boxes(_panels(spark, sf_dir), ["drawing_id"])


@query(
    f"""WITH {_PANELS_SQL}, c AS (SELECT DISTINCT drawing_id, greatest(0, trunc(x0 / (2000.0::DOUBLE/240)))::INT AS i0, least(240, trunc(x1 / (2000.0::DOUBLE/240)) + 1)::INT AS i1, greatest(0, trunc(y0 / (1500.0::DOUBLE/170)))::INT AS j0, least(170, trunc(y1 / (1500.0::DOUBLE/170)) + 1)::INT AS j1 FROM pn),
t AS (SELECT drawing_id, j1 AS top FROM c UNION SELECT DISTINCT drawing_id, 0 FROM c), b AS (SELECT drawing_id, j0 AS low FROM c UNION SELECT DISTINCT drawing_id, 170 FROM c), band AS (SELECT drawing_id, top, low FROM t JOIN b USING (drawing_id) WHERE low > top),
free AS (SELECT drawing_id, top, low, col FROM band, unnest(range(0, 240)) AS u(col) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.drawing_id = band.drawing_id AND c.j0 < low AND c.j1 > top AND col >= c.i0 AND col < c.i1)),
isl AS (SELECT *, col - row_number() OVER (PARTITION BY drawing_id, top, low ORDER BY col) AS island FROM free), r AS (SELECT drawing_id, top, low, min(col) AS lft, max(col) + 1 AS rgt FROM isl GROUP BY drawing_id, top, low, island),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY (rgt - lft) * (low - top) DESC, low, rgt, top) = 1)
SELECT drawing_id, lft * (2000.0::DOUBLE/240) AS x0, top * (1500.0::DOUBLE/170) AS y0, rgt * (2000.0::DOUBLE/240) AS x1, low * (1500.0::DOUBLE/170) AS y1 FROM best"""
)
def largest_free_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan area of every drawing: the largest rectangle without a panel."""
    panels = _panels(spark, sf_dir)
    frames = panels.select("drawing_id").distinct().select("drawing_id", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(2000.0).alias("x1"), F.lit(1500.0).alias("y1"))
    return N.largest_free_rectangle(frames, panels, ["drawing_id"])


@query(
    f"""WITH RECURSIVE g AS (SELECT p_size % 3 AS drawing_id, (p_partkey % 61)::BIGINT AS lo, (p_size % 7)::BIGINT AS hi, (p_partkey % 4)::DOUBLE / 2 AS ratio, p_partkey AS ordinal FROM part), d AS (SELECT drawing_id, lo, hi, ratio, count(*) AS n, min(ordinal) AS first FROM g GROUP BY ALL),
shapes AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY n DESC, first) AS i FROM d), {LETTER_SQL}
SELECT drawing_id, lo AS cells, hi AS cells_hi, ratio, letter::INT AS letter, n FROM lf"""
)
def glyph_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters from glyph bitmaps."""
    glyphs = A.rows(spark, sf_dir, "part", ["p_size % 3 AS drawing_id", "CAST(p_partkey % 61 AS bigint) AS cells", "CAST(p_size % 7 AS bigint) AS cells_hi", "CAST(p_partkey % 4 AS double) / CAST(2 AS double) AS ratio", "p_partkey AS ordinal"])
    return N.glyph_alphabet(glyphs, ["drawing_id"])


STROKES = ["p_partkey AS box_id", "p_partkey % 10 AS drawing_id", "CAST(p_partkey * 7 % 600 AS double) AS x0", "CAST(p_partkey * 11 % 40 * 12 AS double) AS y0", "CAST(p_partkey * 7 % 600 + 2 AS double) AS x1", "CAST(p_partkey * 11 % 40 * 12 + 6 + p_size % 2 AS double) AS y1"]


@query(
    f"""WITH b AS ({A.rows_sql("part", STROKES)}), h AS (SELECT drawing_id, round(y1 - y0, 1) AS height, count(*) AS n, min(box_id) AS first FROM b GROUP BY ALL)
SELECT drawing_id, height FROM h QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY n DESC, first) = 1"""
)
def cap_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual height of the letters of every drawing."""
    return GL.cap_height(A.rows(spark, sf_dir, "part", STROKES), ["drawing_id"])


@query(
    f"""WITH RECURSIVE b AS ({A.rows_sql("part", STROKES)}),
e AS (SELECT p.box_id AS a, q.box_id AS b FROM b p JOIN b q ON p.drawing_id = q.drawing_id AND p.box_id < q.box_id AND p.x1 + 2.4 >= q.x0 AND q.x1 + 2.4 >= p.x0 AND p.y1 + 0.9 >= q.y0 AND q.y1 + 0.9 >= p.y0),
u AS (SELECT a AS n, b AS o FROM e UNION SELECT b, a FROM e), c AS (SELECT n AS node, n AS seen FROM u UNION SELECT c.node, u.o FROM c JOIN u ON u.n = c.seen), k AS (SELECT node, min(seen) AS component FROM c GROUP BY node)
SELECT drawing_id, coalesce(component, box_id) AS box_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_parts FROM b LEFT JOIN k ON k.node = b.box_id GROUP BY ALL"""
)
def stroke_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes joined to words (letter height 6)."""
    return GL.grouped(A.rows(spark, sf_dir, "part", STROKES), ["drawing_id"], 2.4, 0.9)


@query(f"{A.WITH_SQL}\nSELECT DISTINCT layer, CASE WHEN regexp_matches(lower(layer), 'bef|exist|befint|e-|_e') THEN 'existing' WHEN regexp_matches(lower(layer), 'riv|demol|demo|rivs') THEN 'demolition' WHEN regexp_matches(lower(layer), 'ny|new|n-') THEN 'new' END AS status FROM paths")
def status_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status each layer's name suggests."""
    return A.paths(spark, sf_dir).select("layer").distinct().withColumn("status", D.status_hint(F.col("layer")))


@query(f"{A.DRAWN_SQL}, c AS (SELECT drawing_id, layer, sum({_LEN}) AS total FROM drawn GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY total DESC, layer) AS place FROM c)\nSELECT drawing_id, count(*) AS n_clusters, round(sum(total) FILTER (WHERE place <= 3) / sum(total), 6) AS share FROM r GROUP BY drawing_id")
def top_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the three longest layers in every drawing."""
    c = A.drawn_segments(spark, sf_dir).groupBy("drawing_id", F.col("layer").alias("cluster")).agg(F.sum(G.distance("ax", "ay", "bx", "by_")).alias("total"))
    return D.top_share(c, ["drawing_id"]).withColumn("share", F.round("share", 6))


HATCHING = ["o_orderkey % 10 AS drawing_id", "concat('H', CAST(o_orderkey % 10 % 3 AS string)) AS layer", "o_orderkey AS path_id", "1 AS seg_no", "CAST(100 + o_orderkey % 3 AS double) AS ax", "CAST(CASE WHEN o_orderkey % 10 % 2 = 0 THEN floor(o_orderkey / 10) * (2 + o_orderkey % 10 % 3) ELSE floor(o_orderkey / 10) * floor(o_orderkey / 10) % 997 END AS double) AS ay"]
_CELL = "round_even(({v} - fmod({v}, {s})) / {s}, 0)::BIGINT"


@query(
    f"""WITH h0 AS ({A.rows_sql("orders", HATCHING)}), h AS (SELECT *, ax + 300 AS bx, ay AS by_ FROM h0), {pitch_sql("h", "drawing_id, layer")}, big AS (SELECT drawing_id, layer FROM h GROUP BY ALL HAVING count(DISTINCT path_id) >= 60),
rated AS (SELECT pp.* FROM pp SEMI JOIN big USING (drawing_id, layer) WHERE pitch > 0 AND pitch <= 10 AND regularity >= 0.8::DOUBLE), k AS (SELECT h.drawing_id, h.layer, ax, ay, bx, by_, pitch, greatest(1, trunc({_LEN} / pitch))::INT AS n FROM h JOIN rated USING (drawing_id, layer)),
x AS (SELECT drawing_id, layer, pitch, ax + (bx-ax) * (j::DOUBLE/n) AS px, ay + (by_-ay) * (j::DOUBLE/n) AS py FROM k, unnest(range(0, 400)) AS u(j) WHERE j <= n),
cells AS (SELECT DISTINCT drawing_id, layer, pitch, {_CELL.format(v="px", s="pitch")} AS cx, {_CELL.format(v="py", s="pitch")} AS cy FROM x), cov AS (SELECT drawing_id, layer, pitch, count(*) * pitch * pitch / 1000000 AS coverage FROM cells GROUP BY drawing_id, layer, pitch),
chosen AS (SELECT drawing_id, layer, pitch FROM cov QUALIFY coverage >= max(coverage) OVER (PARTITION BY drawing_id) * 0.5::DOUBLE), m AS (SELECT h.drawing_id, ax, ay, bx, by_, pitch, greatest(1, trunc({_LEN} / 50))::INT AS n FROM h JOIN chosen USING (drawing_id, layer)),
seed AS (SELECT DISTINCT drawing_id, pitch, floor((ax + (bx-ax) * (j::DOUBLE/n)) / 50)::BIGINT AS cx, floor((ay + (by_-ay) * (j::DOUBLE/n)) / 50)::BIGINT AS cy FROM m, unnest(range(0, 400)) AS u(j) WHERE j <= n)
SELECT DISTINCT drawing_id, cx + dx AS cx, cy + dy AS cy FROM seed, unnest([-1,0,1]) AS a(dx), unnest([-1,0,1]) AS b(dy) WHERE abs(dx) <= greatest(1, ceil(pitch / 50 / 2)) AND abs(dy) <= greatest(1, ceil(pitch / 50 / 2))"""
)
def hatch_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that the regular hatching of drawings covers; five of ten drawings have irregular lines instead."""
    lines = A.rows(spark, sf_dir, "orders", HATCHING).withColumns({"bx": F.col("ax") + 300, "by_": F.col("ay")})
    found = H.hatch_clusters(lines, ["drawing_id", "layer"], 1e6, 10.0)
    return H.hatch_mask(lines, found, ["drawing_id", "layer"], 50.0)
