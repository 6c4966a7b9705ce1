"""Queries: spatial and relational joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import spatial as S
from ..sources import adapter as A
from .registry import query

KEYS = ["drawing_id", "layer"]
_LEN = "sqrt((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay))"
_LINES = f"""l AS (SELECT drawing_id, layer, path_id, seg_no, {_LEN} AS len, CASE WHEN by_ = ay THEN 'h' WHEN bx = ax THEN 'v' END AS axis,
  CASE WHEN by_ = ay THEN ay ELSE ax END AS at, CASE WHEN by_ = ay THEN least(ax,bx) ELSE least(ay,by_) END AS lo, CASE WHEN by_ = ay THEN greatest(ax,bx) ELSE greatest(ay,by_) END AS hi FROM drawn WHERE (by_ = ay OR bx = ax) AND {_LEN} > 0)"""
_PAIRS = """pairs AS (SELECT a.drawing_id, a.layer, a.axis, a.path_id, a.seg_no, a.len, b.len AS other_len, b.at - a.at AS gap FROM l a JOIN l b ON a.drawing_id = b.drawing_id AND a.layer = b.layer AND a.axis = b.axis AND b.at - a.at BETWEEN 0 AND {reach}
  WHERE (b.at > a.at OR (b.path_id, b.seg_no) > (a.path_id, a.seg_no)) AND least(a.hi,b.hi) - greatest(a.lo,b.lo) > least(a.len,b.len) * {overlap})"""


#: CTEs ``conn(drawing_id, layer, n_paths, n_touching, connectivity)`` at 6 points, and ``wall(drawing_id, layer, n_long, share)`` at 2 to 15 points.
CONNECTIVITY_SQL = """pts AS (SELECT drawing_id, layer, path_id, ax AS x, ay AS y FROM drawn UNION SELECT drawing_id, layer, path_id, bx, by_ FROM drawn),
tc AS (SELECT DISTINCT p.drawing_id, p.layer, p.path_id FROM pts p JOIN pts q ON p.drawing_id = q.drawing_id AND p.layer = q.layer AND p.path_id <> q.path_id AND abs(p.x - q.x) <= 6 AND abs(p.y - q.y) <= 6 AND sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y)) <= 6),
cn AS (SELECT drawing_id, layer, count(DISTINCT path_id) AS n_paths FROM drawn GROUP BY ALL), ct AS (SELECT drawing_id, layer, count(*) AS n_touching FROM tc GROUP BY ALL), conn AS (SELECT drawing_id, layer, cn.n_paths, coalesce(n_touching, 0) AS n_touching, coalesce(n_touching, 0) / cn.n_paths AS connectivity FROM cn LEFT JOIN ct USING (drawing_id, layer))"""
WALL_SQL = f"""{_LINES.replace("FROM drawn WHERE", f"FROM drawn WHERE {_LEN} > 15 AND")}, {_PAIRS.format(reach=15, overlap=0.7)},
wp AS (SELECT drawing_id, layer, sum(len) AS paired FROM (SELECT DISTINCT drawing_id, layer, path_id, seg_no, len FROM pairs WHERE gap >= 2) GROUP BY ALL), wt AS (SELECT drawing_id, layer, count(*) AS n_long, sum({_LEN}) AS total FROM drawn WHERE {_LEN} > 15 GROUP BY ALL),
wall AS (SELECT drawing_id, layer, n_long, CASE WHEN n_long >= 8 AND total > 0 THEN coalesce(paired, 0) / total ELSE 0 END AS share FROM wt LEFT JOIN wp USING (drawing_id, layer))"""


@query(
    f"""{A.DRAWN_SQL}, pts AS (SELECT drawing_id, layer, path_id, ax AS x, ay AS y FROM drawn UNION SELECT drawing_id, layer, path_id, bx, by_ FROM drawn),
t AS (SELECT DISTINCT p.drawing_id, p.layer, p.path_id FROM pts p JOIN pts q ON p.drawing_id = q.drawing_id AND p.layer = q.layer AND p.path_id <> q.path_id AND abs(p.x - q.x) <= 6 AND abs(p.y - q.y) <= 6 AND sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y)) <= 6),
n AS (SELECT drawing_id, layer, count(DISTINCT path_id) AS n_paths FROM drawn GROUP BY ALL), c AS (SELECT drawing_id, layer, count(*) AS n_touching FROM t GROUP BY ALL)
SELECT drawing_id, layer, n_paths, coalesce(n_touching, 0) AS n_touching, round(coalesce(n_touching, 0) / n_paths, 6) AS connectivity FROM n LEFT JOIN c USING (drawing_id, layer)"""
)
def endpoint_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the paths of a layer that touch another one (6 points)."""
    return S.connectivity(A.drawn_segments(spark, sf_dir), KEYS, 6.0).withColumn("connectivity", F.round("connectivity", 6))


@query(f"{A.DRAWN_SQL}, {_LINES}, {_PAIRS.format(reach=12, overlap=0.5)}\nSELECT drawing_id, round(gap, 1) AS spacing, count(*) AS n FROM pairs WHERE gap > 12 * 0.02::DOUBLE GROUP BY ALL")
def wall_pair_spacings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacings of parallel pairs in every drawing, up to 12 points."""
    return S.pair_spacings(A.drawn_segments(spark, sf_dir), KEYS, 12.0).groupBy("drawing_id", "spacing").agg(F.sum("n").alias("n"))


@query(
    f"""{A.DRAWN_SQL}, {_LINES.replace("FROM drawn WHERE", f"FROM drawn WHERE {_LEN} > 15 AND")}, {_PAIRS.format(reach=15, overlap=0.7)},
p AS (SELECT drawing_id, layer, sum(len) AS paired FROM (SELECT DISTINCT drawing_id, layer, path_id, seg_no, len FROM pairs WHERE gap >= 2) GROUP BY ALL),
t AS (SELECT drawing_id, layer, count(*) AS n_long, sum({_LEN}) AS total FROM drawn WHERE {_LEN} > 15 GROUP BY ALL)
SELECT drawing_id, layer, n_long, round(CASE WHEN n_long >= 8 AND total > 0 THEN coalesce(paired, 0) / total ELSE 0 END, 6)::DOUBLE AS share FROM t LEFT JOIN p USING (drawing_id, layer)"""
)
def wall_pair_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a layer's length in wall-like pairs at 2 to 15 points."""
    return S.paired_share(A.drawn_segments(spark, sf_dir), KEYS, 2.0, 15.0).withColumn("share", F.round("share", 6))


@query(
    f"""{A.DRAWN_SQL}, {_LINES.replace("FROM drawn WHERE", f"FROM drawn WHERE {_LEN} > 16 AND")}, {_PAIRS.format(reach=16, overlap=0.5)},
p AS (SELECT drawing_id, layer, sum(len) AS paired FROM (SELECT DISTINCT drawing_id, layer, path_id, seg_no, len FROM pairs WHERE gap >= 3.2) GROUP BY ALL),
t AS (SELECT drawing_id, layer, sum({_LEN}) AS total FROM drawn WHERE {_LEN} > 16 GROUP BY ALL)
SELECT drawing_id, layer, CASE WHEN coalesce(paired, 0) / total > 0.5 THEN 'double_line' ELSE 'single_line' END AS representation FROM t LEFT JOIN p USING (drawing_id, layer)"""
)
def pipe_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a layer's pipes are drawn as double lines (width 8)."""
    return S.representation(A.drawn_segments(spark, sf_dir), KEYS, 8.0)


POINTS = ["s_suppkey AS point_id", "s_suppkey % 50 AS drawing_id", "CAST(s_suppkey * 19 % 2000 AS double) AS x", "CAST(s_suppkey * 37 % 1684 AS double) AS y"]


@query(
    f"""{A.DRAWN_SQL}, pts AS ({A.rows_sql("supplier", POINTS)}),
d AS (SELECT p.drawing_id, p.point_id, s.path_id, s.seg_no, CASE WHEN {_LEN} = 0 THEN sqrt(pow(p.x-ax,2)+pow(p.y-ay,2)) ELSE sqrt(pow(p.x - ax - greatest(0, least(1, ((p.x-ax)*(bx-ax)+(p.y-ay)*(by_-ay)) / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) * (bx-ax), 2) + pow(p.y - ay - greatest(0, least(1, ((p.x-ax)*(bx-ax)+(p.y-ay)*(by_-ay)) / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) * (by_-ay), 2)) END AS d
  FROM pts p JOIN drawn s ON p.drawing_id = s.drawing_id AND p.x BETWEEN least(ax,bx) - 40 AND greatest(ax,bx) + 40 AND p.y BETWEEN least(ay,by_) - 40 AND greatest(ay,by_) + 40)
SELECT drawing_id, point_id, path_id, seg_no, round(d, 4) AS distance FROM d WHERE d <= 40 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, path_id, seg_no) = 1"""
)
def nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment nearest to every symbol, at most 40 points away."""
    points = A.rows(spark, sf_dir, "supplier", POINTS)
    segments = S.around(A.drawn_segments(spark, sf_dir).drop("layer"), points, ["drawing_id"], 40.0)
    return S.nearest_segment(points, segments, ["drawing_id"], 40.0).withColumn("distance", F.round("distance", 4))


@query(
    f"""{A.DRAWN_SQL}, h AS (SELECT * FROM drawn WHERE layer LIKE '%BUILDING%'),
k AS (SELECT drawing_id, ax, ay, bx, by_, n, k FROM (SELECT *, greatest(1, trunc({_LEN} / 25))::INT AS n FROM h), unnest(range(0, 400)) AS u(k) WHERE k <= n),
cells AS (SELECT DISTINCT drawing_id, floor((ax + (bx-ax)*(k::DOUBLE/n)) / 25)::BIGINT AS cx, floor((ay + (by_-ay)*(k::DOUBLE/n)) / 25)::BIGINT AS cy FROM k),
mask AS (SELECT DISTINCT drawing_id, cx + dx AS cx, cy + dy AS cy FROM cells, unnest([-1,0,1]) AS a(dx), unnest([-1,0,1]) AS b(dy)),
s AS (SELECT d.drawing_id, d.layer, {_LEN} AS len, m.cx IS NOT NULL AS hit FROM drawn d LEFT JOIN mask m ON d.drawing_id = m.drawing_id AND m.cx = floor((ax+bx)/2/25)::BIGINT AND m.cy = floor((ay+by_)/2/25)::BIGINT)
SELECT drawing_id, layer, round(sum(CASE WHEN hit THEN len ELSE 0 END), 4)::DOUBLE AS masked_len, round(sum(CASE WHEN hit THEN 0 ELSE len END), 4)::DOUBLE AS counted_len, count(*) AS n FROM s GROUP BY ALL"""
)
def mask_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length inside and outside of the hatched area (cells of 25 points around one layer, widened by a cell)."""
    drawn = A.drawn_segments(spark, sf_dir)
    mask = S.dilate(S.covered_cells(drawn.filter("layer LIKE '%BUILDING%'"), ["drawing_id"], 25.0), ["drawing_id"], 1)
    length = G.distance("ax", "ay", "bx", "by_")
    split = S.masked(drawn, mask, ["drawing_id"], 25.0)
    return split.groupBy("drawing_id", "layer").agg(F.round(F.sum(F.when(F.col("masked"), length).otherwise(0.0)), 4).alias("masked_len"), F.round(F.sum(F.when(F.col("masked"), 0.0).otherwise(length)), 4).alias("counted_len"), F.count("*").alias("n"))


BOXES = ["p_partkey AS box_id", "p_partkey % 20 AS drawing_id", "CAST(p_partkey * 13 % 300 AS double) AS x0", "CAST(p_partkey * 29 % 170 AS double) AS y0", "CAST(p_partkey * 13 % 300 + p_size % 9 AS double) AS x1", "CAST(p_partkey * 29 % 170 + p_size % 11 AS double) AS y1"]
_TOUCH = f"""b AS ({A.rows_sql("part", BOXES)}),
e AS (SELECT p.drawing_id, p.box_id AS a, q.box_id AS b FROM b p JOIN b q ON p.drawing_id = q.drawing_id AND p.box_id < q.box_id AND p.x1 + 5 >= q.x0 AND q.x1 + 5 >= p.x0 AND p.y1 + 5 >= q.y0 AND q.y1 + 5 >= p.y0)"""


@query(f"WITH {_TOUCH}\nSELECT drawing_id, a, b FROM e")
def box_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes at most 5 points apart."""
    return S.touching_boxes(A.rows(spark, sf_dir, "part", BOXES), ["drawing_id"], 5.0, 5.0)


@query(
    f"""{A.DRAWN_SQL}, w AS (SELECT s_suppkey % 50 AS drawing_id, CAST(s_suppkey * 19 % 1800 AS double) AS x0, CAST(s_suppkey * 37 % 1500 AS double) AS y0 FROM supplier),
s AS (SELECT d.drawing_id, {_LEN} AS len, EXISTS (SELECT 1 FROM w WHERE w.drawing_id = d.drawing_id AND (ax+bx)/2 BETWEEN w.x0 AND w.x0 + 150 AND (ay+by_)/2 BETWEEN w.y0 AND w.y0 + 120) AS hit FROM drawn d)
SELECT drawing_id, round(sum(CASE WHEN hit THEN len ELSE 0 END) / sum(len), 6) AS share FROM s GROUP BY drawing_id"""
)
def wall_zone_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a drawing's length whose segments have their middle in a wall box."""
    boxes = A.rows(spark, sf_dir, "supplier", ["s_suppkey % 50 AS drawing_id", "CAST(s_suppkey * 19 % 1800 AS double) AS x0", "CAST(s_suppkey * 37 % 1500 AS double) AS y0"]).withColumns({"x1": F.col("x0") + 150, "y1": F.col("y0") + 120})
    drawn = A.drawn_segments(spark, sf_dir)
    lengths = drawn.select("drawing_id", G.distance("ax", "ay", "bx", "by_").alias("len"), ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by_")) / 2).alias("y"))
    inside = S.points_in_boxes(lengths, boxes, ["drawing_id"], 100.0).groupBy("drawing_id").agg(F.sum("len").alias("inside"))
    total = lengths.groupBy("drawing_id").agg(F.sum("len").alias("total"))
    return total.join(inside, "drawing_id", "left").select("drawing_id", F.round(F.coalesce("inside", F.lit(0.0)) / F.col("total"), 6).alias("share"))


def pitch_sql(source: str, keys: str) -> str:
    """CTEs up to ``pp(keys, pitch, regularity)`` over a relation (keys, path_id, seg_no, ax, ay, bx, by_), by comparing all lines of a group."""
    first = keys.split(", ")
    same, mine = " AND ".join(f"a.{k} = b.{k}" for k in first), ", ".join(f"a.{k}" for k in first)
    return f"""pa AS (SELECT *, CASE WHEN atan2(by_-ay, bx-ax) < 0 THEN atan2(by_-ay, bx-ax) + pi() WHEN atan2(by_-ay, bx-ax) >= pi() THEN 0 ELSE atan2(by_-ay, bx-ax) END AS angle FROM {source} WHERE ax <> bx OR ay <> by_),
pd AS (SELECT {keys}, round_even(angle, 2) AS main, count(*) AS n, min((path_id, seg_no)) AS first FROM pa GROUP BY ALL), pt AS (SELECT {keys} FROM pa GROUP BY ALL HAVING count(*) >= 20),
pm AS (SELECT {keys}, main FROM pd SEMI JOIN pt USING ({keys}) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, first) = 1),
pl AS (SELECT {keys}, ax * -sin(main) + ay * cos(main) AS across, least(ax*cos(main) + ay*sin(main), bx*cos(main) + by_*sin(main)) AS lo, greatest(ax*cos(main) + ay*sin(main), bx*cos(main) + by_*sin(main)) AS hi FROM pa JOIN pm USING ({keys}) WHERE least(abs(angle - main), pi() - abs(angle - main)) < 0.05::DOUBLE),
pq AS (SELECT *, row_number() OVER () AS line FROM pl QUALIFY count(*) OVER (PARTITION BY {keys}) >= 20),
pg AS (SELECT {mine}, a.line, any_value(a.across) AS across, any_value(a.lo) AS lo, any_value(a.hi) AS hi, min(b.across - a.across) AS gap FROM pq a JOIN pq b ON {same} AND b.across - a.across > 0.05::DOUBLE AND least(a.hi, b.hi) - greatest(a.lo, b.lo) > least(a.hi - a.lo, b.hi - b.lo) * 0.3::DOUBLE GROUP BY {mine}, a.line),
pr AS (SELECT {keys}, round(gap, 1) AS pitch, count(*) AS n, min((across, lo, hi)) AS first FROM pg GROUP BY ALL), pb AS (SELECT {keys}, pitch FROM pr QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, first) = 1),
pf AS (SELECT {keys}, pitch, avg(CASE WHEN abs(gap - pitch) <= pitch * 0.15::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS regularity FROM pg JOIN pb USING ({keys}) GROUP BY ALL HAVING count(*) >= 10),
pp AS (SELECT {keys}, coalesce(pitch, 0)::DOUBLE AS pitch, coalesce(regularity, 0)::DOUBLE AS regularity FROM (SELECT DISTINCT {keys} FROM {source}) LEFT JOIN pf USING ({keys}))"""


@query(f"{A.DRAWN_SQL}, {pitch_sql('drawn', 'drawing_id')}\nSELECT drawing_id, round(pitch, 4) AS pitch, round(regularity, 4) AS regularity FROM pp")
def parallel_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch and regularity of the lines of every drawing."""
    return S.parallel_pitch(A.drawn_segments(spark, sf_dir), ["drawing_id"]).withColumns({"pitch": F.round("pitch", 4), "regularity": F.round("regularity", 4)})


RUNS = ["o_custkey % 400 AS label_no", "concat('L', CAST(o_custkey % 400 AS string)) AS label", "CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS run", "o_orderkey AS row_no", "round(o_totalprice / 1000, 3) AS length_m"]


@query(
    f"""WITH r AS ({A.rows_sql("orders", RUNS)}), last AS (SELECT run, label, length_m FROM r QUALIFY row_number() OVER (PARTITION BY run, label ORDER BY row_no DESC) = 1)
SELECT label, a.length_m AS length_a, b.length_m AS length_b, round(coalesce(b.length_m, 0) - coalesce(a.length_m, 0), 4) AS diff FROM (SELECT * FROM last WHERE run = 'a') a FULL JOIN (SELECT * FROM last WHERE run = 'b') b USING (label)"""
)
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs side by side by label (the last row of a label counts), smallest difference first."""
    from ..operators.delivery import compare_runs

    runs = A.rows(spark, sf_dir, "orders", RUNS)
    return compare_runs(runs.filter("run = 'a'"), runs.filter("run = 'b'")).withColumn("diff", F.round("diff", 4))


MARKUP = ["o_orderkey AS line_id", "concat('S', CAST(o_custkey % 9 AS string)) AS label", "o_orderkey % 50 AS drawing_id", "CAST(o_custkey * 7 % 2000 AS double) AS x0", "CAST(o_orderkey * 29 % 1684 AS double) AS y0", "CAST(o_custkey * 7 % 2000 + 40 AS double) AS x1", "CAST(o_orderkey * 29 % 1684 AS double) AS y1"]


@query(
    f"""{A.DRAWN_SQL}, g AS ({A.rows_sql("orders", MARKUP)}),
smp AS (SELECT line_id, label, drawing_id, k, x0 + (x1-x0)*k/10.0::DOUBLE AS x, y0 + (y1-y0)*k/10.0::DOUBLE AS y FROM g, unnest(range(0, 11)) AS u(k)),
d AS (SELECT m.line_id, m.label, m.k, s.layer, s.path_id, s.seg_no, CASE WHEN {_LEN} = 0 THEN sqrt(pow(m.x-ax,2)+pow(m.y-ay,2)) ELSE sqrt(pow(m.x - ax - greatest(0, least(1, ((m.x-ax)*(bx-ax)+(m.y-ay)*(by_-ay)) / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) * (bx-ax), 2) + pow(m.y - ay - greatest(0, least(1, ((m.x-ax)*(bx-ax)+(m.y-ay)*(by_-ay)) / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) * (by_-ay), 2)) END AS d
  FROM smp m JOIN drawn s ON m.drawing_id = s.drawing_id AND m.x BETWEEN least(ax,bx) - 4 AND greatest(ax,bx) + 4 AND m.y BETWEEN least(ay,by_) - 4 AND greatest(ay,by_) + 4),
n AS (SELECT * FROM d WHERE d <= 4 QUALIFY row_number() OVER (PARTITION BY line_id, k ORDER BY d, path_id, seg_no) = 1),
v AS (SELECT line_id, label, layer, sum(40.0::DOUBLE / 11 / (1 + d)) AS votes FROM n GROUP BY ALL),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY round(votes, 9) DESC, layer) = 1)
SELECT layer, count(*) AS n_lines, count(DISTINCT label) AS n_labels, sum(40.0::DOUBLE) AS length FROM w WHERE votes >= 0.35 * 40 GROUP BY layer"""
)
def facit_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked-up lines vote for the layer that they follow (within 4 points); length per layer."""
    from ..operators.delivery import markup_votes

    return markup_votes(A.rows(spark, sf_dir, "orders", MARKUP), A.drawn_segments(spark, sf_dir), 4.0)
