"""Queries: from segments to straight runs, polylines, strands and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import network as N
from ..operators import ordered as O
from ..sources import adapter as A
from ..sources.shared import cut
from .registry import query

KEYS = ["drawing_id", "layer"]
#: Size of the cells in which ends meet, in points.
EPS = 20.0

_LEN = "sqrt((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay))"
_STEP = "sqrt((x-px)*(x-px) + (y-py)*(y-py))"
_RUNS_SQL = f"""{A.DRAWN_SQL.replace("WITH segments", "WITH RECURSIVE segments", 1)},
h AS (SELECT *, atan2(by_-ay, bx-ax) AS heading FROM drawn WHERE {_LEN} > 0), t0 AS (SELECT *, abs(heading - lag(heading) OVER (PARTITION BY path_id ORDER BY seg_no)) AS d FROM h), t AS (SELECT *, least(d, 2*pi() - d) AS turn FROM t0), md AS (SELECT path_id, quantile_cont(turn, 0.5) AS med FROM t GROUP BY path_id),
ch AS (SELECT t.*, path_id * 100 + coalesce(sum(CASE WHEN turn > greatest(med * 3, 1e-9) THEN 1 ELSE 0 END) OVER (PARTITION BY path_id ORDER BY seg_no), 0)::BIGINT AS run_id FROM t JOIN md USING (path_id)),
p0 AS (SELECT drawing_id, layer, path_id, run_id, seg_no * 2 AS pos, ax AS x, ay AS y FROM ch UNION ALL SELECT drawing_id, layer, path_id, run_id, seg_no * 2 + 1, bx, by_ FROM ch),
p1 AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p0 WINDOW w AS (PARTITION BY run_id ORDER BY pos)), pts AS (SELECT drawing_id, layer, path_id, run_id, pos, x, y FROM p1 WHERE pos % 2 = 1 OR px IS NULL OR {_STEP} > 1e-9),
p2 AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM pts WINDOW w AS (PARTITION BY run_id ORDER BY pos)),
runs AS (SELECT drawing_id, layer, path_id, run_id, arg_min(x, pos) AS ax, arg_min(y, pos) AS ay, arg_max(x, pos) AS bx, arg_max(y, pos) AS by_, sum({_STEP}) AS len FROM p2 GROUP BY ALL HAVING sum({_STEP}) > 0)"""

#: The runs of a path are joined in their order; ends alternate, so that a walk passes some of them backwards.
_LINES_SQL = f"""{_RUNS_SQL}, nr AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY run_id) AS k, ((run_id + row_number() OVER (PARTITION BY path_id ORDER BY run_id)) % 2)::INT AS entry FROM runs),
br AS (SELECT p.drawing_id, p.run_id AS a, 1 - p.entry AS a_end, q.run_id AS b, q.entry AS b_end FROM nr p JOIN nr q ON p.path_id = q.path_id AND q.k = p.k + 1),
lk AS (SELECT a AS run, a_end AS leave, b AS nrun, b_end AS nentry FROM br UNION ALL SELECT b, b_end, a, a_end FROM br), fe AS (SELECT run_id AS run, e AS entry FROM runs, unnest([0, 1]) AS u(e) ANTI JOIN lk ON lk.run = run_id AND lk.leave = e),
wk AS (SELECT run AS r0, entry AS e0, 0 AS place, run, entry FROM fe UNION ALL SELECT r0, e0, place + 1, nrun, nentry FROM wk JOIN lk ON lk.run = wk.run AND lk.leave = 1 - wk.entry),
cw AS (SELECT *, min(run) OVER (PARTITION BY r0, e0) AS chain_id FROM wk), walk AS (SELECT * FROM cw QUALIFY rank() OVER (PARTITION BY chain_id ORDER BY r0, e0) = 1),
lines AS (SELECT drawing_id, layer, chain_id, place, CASE WHEN entry = 0 THEN pos ELSE -pos END AS pos, run_id, x, y FROM walk JOIN pts ON run_id = run),
nb AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY place, pos) AS ordinal, count(*) OVER (PARTITION BY chain_id) AS n FROM lines)"""

_STRANDS_SQL = f"""{_LINES_SQL}, nn AS (SELECT *, round_even(x / {EPS}, 0)::BIGINT AS nx, round_even(y / {EPS}, 0)::BIGINT AS ny FROM nb), meet AS (SELECT drawing_id, nx, ny FROM nn WHERE ordinal = 1 OR ordinal = n GROUP BY ALL HAVING count(*) >= 3),
mk AS (SELECT nn.*, meet.nx IS NOT NULL AND ordinal > 1 AND ordinal < n AS cut_ FROM nn LEFT JOIN meet ON meet.drawing_id = nn.drawing_id AND meet.nx = nn.nx AND meet.ny = nn.ny),
st AS (SELECT *, coalesce(sum(cut_::INT) OVER (PARTITION BY chain_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS s0 FROM mk), sp AS (SELECT *, unnest(CASE WHEN cut_ THEN [s0, s0 + 1] ELSE [s0] END) AS strand_no FROM st),
s1 AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM sp WINDOW w AS (PARTITION BY chain_id, strand_no ORDER BY ordinal)), s2 AS (SELECT *, {_STEP} AS slen, atan2(y - py, x - px) AS heading FROM s1),
s3 AS (SELECT *, abs(heading - lag(heading) OVER (PARTITION BY chain_id, strand_no ORDER BY ordinal)) AS d FROM s2),
strands AS (SELECT drawing_id, layer, chain_id, strand_no, sum(slen) AS length, count(*) AS n_points, count(*) FILTER (WHERE least(d, 2*pi() - d) > 15 * pi() / 180) AS bends, arg_min(x, ordinal) AS ax, arg_min(y, ordinal) AS ay, arg_max(x, ordinal) AS bx, arg_max(y, ordinal) AS by_,
  concat(arg_min(nx, ordinal), ':', arg_min(ny, ordinal)) AS node_a, concat(arg_max(nx, ordinal), ':', arg_max(ny, ordinal)) AS node_b FROM s3 GROUP BY ALL HAVING sum(slen) > 0)"""


#: A run lies on one path, so its rows stay where the path's segments were dealt to.
PATH = [*KEYS, "path_id"]


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the straight runs of every path, with their steps."""
    chained = O.corner_split(A.drawn_segments(spark, sf_dir), KEYS)
    return N.run_steps(N.run_points(chained.withColumn("run_id", F.col("path_id") * 100 + F.col("chain_no")), PATH), PATH)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines: the runs of a path joined in their order, one end of a run to one of the next."""
    points = cut(_points(spark, sf_dir))
    runs = cut(N.straight_runs(points, PATH))
    order = W.partitionBy(*PATH).orderBy("run_id")
    entered = runs.withColumn("k", F.row_number().over(order)).withColumn("entry", ((F.col("run_id") + F.col("k")) % 2).cast("int"))
    pair = entered.withColumns({"b": F.lead("run_id").over(order), "b_end": F.lead("entry").over(order), "bx2": F.lead("ax").over(order), "by2": F.lead("ay").over(order)}).filter("b IS NOT NULL")
    bridges = pair.select(*KEYS, F.col("run_id").alias("a"), (1 - F.col("entry")).alias("a_end"), "b", "b_end", G.distance("bx", "by_", "bx2", "by2").alias("gap"))
    return N.polylines(runs, points, cut(N.rechained(bridges, KEYS)), KEYS)


@query(f"{_RUNS_SQL}\nSELECT drawing_id, layer, run_id, ax, ay, bx, by_, round(len, 4) AS len FROM runs")
def straight_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight runs of every drawing's paths, from the first point to the last."""
    return N.straight_runs(_points(spark, sf_dir), PATH).drop("path_id").withColumn("len", F.round("len", 4))


@query(f"{_LINES_SQL}\nSELECT drawing_id, layer, chain_id, ordinal, run_id, x, y FROM nb")
def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of every chain of runs in walking order, from its smaller free end."""
    order = W.partitionBy(*KEYS, "chain_id").orderBy("place", "pos")
    return _lines(spark, sf_dir).select(*KEYS, "chain_id", F.row_number().over(order).alias("ordinal"), "run_id", "x", "y")


@query(f"{_STRANDS_SQL}\nSELECT drawing_id, layer, chain_id, strand_no, round(length, 4) AS length, n_points, bends, ax, ay, bx, by_, node_a, node_b FROM strands")
def network_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines split where three ends of a drawing's polylines meet, with length, bends and end nodes."""
    return N.strands(_lines(spark, sf_dir), KEYS, ["drawing_id"], EPS)[1].withColumn("length", F.round("length", 4))


@query(f"{_STRANDS_SQL}, both_ AS (SELECT drawing_id, node_a AS node FROM strands UNION ALL SELECT drawing_id, node_b FROM strands), g AS (SELECT drawing_id, node, count(*) AS degree FROM both_ GROUP BY ALL)\nSELECT drawing_id, node, degree, row_number() OVER (PARTITION BY drawing_id ORDER BY node) - 1 AS node_no FROM g")
def network_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of every drawing's network, with the number of strands that end there."""
    return N.nodes(N.strands(_lines(spark, sf_dir), KEYS, ["drawing_id"], EPS)[1], ["drawing_id"])


@query(f"{_STRANDS_SQL}\nSELECT drawing_id, count(*) AS n_strands, round(sum(length), 2) AS total_length, sum(bends)::BIGINT AS bends, count(DISTINCT chain_id) AS n_chains FROM strands GROUP BY drawing_id")
def network_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strands, chains, bends and total length of every drawing's network."""
    strands = N.strands(_lines(spark, sf_dir), KEYS, ["drawing_id"], EPS)[1]
    return strands.groupBy("drawing_id").agg(F.count("*").alias("n_strands"), F.round(F.sum("length"), 2).alias("total_length"), F.sum("bends").alias("bends"), F.count_distinct("chain_id").alias("n_chains"))
