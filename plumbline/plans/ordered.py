"""Queries: ordered analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered as O
from ..sources import adapter as A
from .registry import query

_LEN = "sqrt((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay))"
_TURNS = f"""h AS (SELECT path_id, seg_no, {_LEN} AS len, atan2(by_-ay, bx-ax) AS heading FROM segments WHERE {_LEN} > 0),
p AS (SELECT *, abs(heading - lag(heading) OVER (PARTITION BY path_id ORDER BY seg_no)) AS d FROM h), t AS (SELECT *, least(d, 2*pi() - d) AS turn FROM p)"""


@query(f"{A.WITH_SQL}, {_TURNS}, m AS (SELECT path_id, quantile_cont(turn, 0.5) AS med FROM t GROUP BY path_id),\nc AS (SELECT t.path_id, seg_no, len, sum(CASE WHEN turn > greatest(med * 3, 1e-9) THEN 1 ELSE 0 END) OVER (PARTITION BY t.path_id ORDER BY seg_no) AS chain_no FROM t JOIN m USING (path_id))\nSELECT path_id, chain_no::BIGINT AS chain_no, count(*) AS n_segments, round(sum(len), 4) AS length FROM c GROUP BY ALL")
def corner_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths split at corners: number and length of the segments of every chain."""
    chains = O.corner_split(A.segments(spark, sf_dir), [])
    return chains.groupBy("path_id", "chain_no").agg(F.count("*").alias("n_segments"), F.round(F.sum("len"), 4).alias("length"))


@query(f"{A.WITH_SQL}, {_TURNS}\nSELECT path_id, count(*) FILTER (WHERE turn > 15 * pi() / 180) AS bends FROM t GROUP BY path_id")
def bend_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bends over 15 degrees of every path."""
    return O.bend_counts(A.segments(spark, sf_dir), [])


CURVES = ["s_suppkey AS curve_id", "CAST(k AS double) * 0.3 AS x", "CAST(100 + floor(k / (1 + s_suppkey % 9)) * (1 + s_suppkey % 4) AS double) AS y"]
_CURVES_SQL = "c AS (SELECT s_suppkey AS curve_id, k * 0.3::DOUBLE AS x, (100 + floor(k::DOUBLE / (1 + s_suppkey % 9)) * (1 + s_suppkey % 4))::DOUBLE AS y FROM supplier, unnest(range(0, 41)) AS u(k) WHERE k <= 2 + s_suppkey % 41)"


@query(
    f"""WITH {_CURVES_SQL},
s AS (SELECT curve_id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, row_number() OVER w - 1 AS step, count(*) OVER (PARTITION BY curve_id) AS points FROM c WINDOW w AS (PARTITION BY curve_id ORDER BY x)),
d AS (SELECT *, abs(y - CASE WHEN py = 0 THEN 1 ELSE py END) / CASE WHEN py = 0 THEN 1 ELSE py END AS change FROM s WHERE step > 0 AND points >= 4),
m AS (SELECT curve_id, CASE WHEN quantile_cont(change, 0.5) = 0 THEN 1e-9 ELSE quantile_cont(change, 0.5) END AS med FROM d GROUP BY curve_id),
f AS (SELECT d.*, med, step - row_number() OVER (PARTITION BY d.curve_id ORDER BY x) AS island FROM d JOIN m USING (curve_id) WHERE change <= med),
r AS (SELECT curve_id, med, island, count(*) AS n, min(step) AS first, min(px) AS lo, max(x) AS hi FROM f GROUP BY ALL),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY curve_id ORDER BY n DESC, first) = 1)
SELECT curve_id, round((lo + hi) / 2, 4) AS threshold, round(hi - lo, 4) AS width FROM b UNION ALL SELECT curve_id, 0, 0 FROM s GROUP BY curve_id HAVING count(*) < 4"""
)
def plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat part of step curves."""
    curves = A.read(spark, sf_dir, "supplier").withColumn("k", F.explode(F.sequence(F.lit(0), (2 + F.col("s_suppkey") % 41).cast("int")))).filter("k <= 40")
    found = O.plateau(curves.selectExpr(*CURVES), ["curve_id"])
    return found.select("curve_id", F.round("threshold", 4).alias("threshold"), F.round("width", 4).alias("width"))


BRIDGES = ["o_custkey % 200 AS cluster_id", "CAST(o_orderkey * 37 % 1200 AS double) / CAST(100 AS double) AS gap"]


@query(
    f"""WITH b AS ({A.rows_sql("orders", BRIDGES)}), base AS (SELECT DISTINCT cluster_id, (1000 + cluster_id)::DOUBLE AS total, 1::DOUBLE AS unit FROM b),
g AS (SELECT cluster_id, total, k, k * 0.3::DOUBLE AS x FROM base, unnest(range(0, 41)) AS u(k))
SELECT cluster_id, round(x, 4) AS x, round(total + coalesce((SELECT sum(gap) FROM b WHERE b.cluster_id = g.cluster_id AND b.gap <= g.x + 1e-9), 0), 4) AS y FROM g"""
)
def sweep_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length against joining threshold, from the bridges of the greatest one."""
    bridges = A.rows(spark, sf_dir, "orders", BRIDGES)
    base = bridges.select("cluster_id").distinct().select("cluster_id", (F.col("cluster_id") + 1000).cast("double").alias("total"), F.lit(1.0).alias("unit"))
    return O.sweep(base, bridges, ["cluster_id"]).select("cluster_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


WORDS = [
    "c_custkey % 25 AS drawing_id",
    "CASE WHEN c_custkey % 25 < 12 THEN 'A' ELSE '' END AS prefix",
    "CAST(floor(c_custkey / 25) AS double) * CAST(10 AS double) AS value",
    "CAST(floor(c_custkey / 25) AS double) * CAST(40 AS double) + CASE WHEN c_custkey % 4 = 1 THEN CAST(c_custkey % 7 AS double) / CAST(100 AS double) WHEN c_custkey % 25 % 4 = 2 THEN CAST(c_custkey % 7 AS double) ELSE CAST(0 AS double) END AS x",
    "CAST(c_custkey % 5 AS double) * CAST(100 AS double) AS y",
    "CAST(8 AS double) AS height",
]


@query(
    f"""WITH w0 AS ({A.rows_sql("customer", WORDS)}), m AS (SELECT drawing_id, quantile_cont(height, 0.5) AS h FROM w0 GROUP BY drawing_id HAVING count(*) >= 3), w AS (SELECT * FROM w0 JOIN m USING (drawing_id)),
b AS (SELECT drawing_id, prefix, value, 'row' AS axis, x AS along, floor(y / h)::BIGINT AS bucket FROM w UNION ALL SELECT drawing_id, prefix, value, 'column', y, floor(x / h)::BIGINT FROM w),
g AS (SELECT *, lead(value) OVER o - value AS dv, lead(along) OVER o - along AS dp FROM b WINDOW o AS (PARTITION BY drawing_id, axis, prefix, bucket ORDER BY along, value)),
r AS (SELECT drawing_id, axis, prefix, bucket, count(*) AS n, min(CASE WHEN dv = 0 OR dp <= 0 THEN 0 ELSE 1 END) AS sound, min(sign(dv)) AS lo, max(sign(dv)) AS hi, avg(abs(dp / nullif(dv, 0))) AS pitch, (max(abs(dp / nullif(dv, 0))) - min(abs(dp / nullif(dv, 0)))) / avg(abs(dp / nullif(dv, 0))) AS spread FROM g WHERE dv IS NOT NULL GROUP BY ALL)
SELECT drawing_id, round(pitch, 6) AS pitch, round(spread, 6) AS spread, n + 1 AS n FROM (SELECT * FROM r WHERE n >= 2 AND sound = 1 AND lo = hi QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY spread, axis, prefix, bucket) = 1) WHERE spread <= 0.02"""
)
def grid_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch of the module grid of every drawing."""
    found = O.grid_pitch(A.rows(spark, sf_dir, "customer", WORDS), ["drawing_id"])
    return found.select("drawing_id", F.round("pitch", 6).alias("pitch"), F.round("spread", 6).alias("spread"), "n")


MARKS = ["c_custkey % 60 AS bar_id", "CAST(c_custkey * 11 % (4 + c_custkey % 60) AS double) * CAST(100 AS double) / CAST(4 + c_custkey % 60 AS double) AS at"]


@query(
    f"""WITH m AS ({A.rows_sql("customer", MARKS)}), bars AS (SELECT DISTINCT bar_id, 0::DOUBLE AS start, 100::DOUBLE AS span FROM m),
t AS (SELECT bar_id, span, n, k, start + k * span / n AS at FROM bars, unnest(range(2, 41)) AS a(n), unnest(range(0, 41)) AS b(k) WHERE k <= n),
h AS (SELECT bar_id, n, k, EXISTS (SELECT 1 FROM m WHERE m.bar_id = t.bar_id AND abs(m.at - t.at) <= t.span / t.n * 0.08::DOUBLE) AS hit FROM t),
c AS (SELECT bar_id, n, count(*) FILTER (WHERE hit) / (n + 1) AS cover FROM h GROUP BY bar_id, n),
f AS (SELECT bar_id, max(n) FILTER (WHERE cover >= 0.95::DOUBLE) AS fine, min(n) FILTER (WHERE cover > 0) AS coarse FROM c GROUP BY bar_id)
SELECT f.bar_id, coalesce(fine, coarse, 0)::INT AS divisions, round(coalesce(c.cover, 0), 6) AS coverage FROM f LEFT JOIN c ON c.bar_id = f.bar_id AND c.n = coalesce(fine, coarse)"""
)
def comb_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divisions of scale bars by their tick marks."""
    marks = A.rows(spark, sf_dir, "customer", MARKS)
    bars = marks.select("bar_id").distinct().select("bar_id", F.lit(0.0).alias("start"), F.lit(100.0).alias("span"))
    return O.comb_fit(marks, bars, ["bar_id"]).withColumn("coverage", F.round("coverage", 6))


_VOTES = "SELECT path_id % 50 AS drawing_id, layer AS cluster, count(*) AS votes FROM paths GROUP BY ALL"


@query(f"{A.WITH_SQL}, v AS ({_VOTES}), s AS (SELECT *, sum(votes) OVER (PARTITION BY drawing_id ORDER BY votes DESC, cluster ROWS UNBOUNDED PRECEDING) AS upto, sum(votes) OVER (PARTITION BY drawing_id) AS total FROM v)\nSELECT drawing_id, cluster, votes, round(upto / total, 6) AS cumulative, (upto - votes) / total <= 0.70::DOUBLE AS chosen FROM s")
def anchor_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers chosen by label votes until 70 % are reached."""
    votes = A.paths(spark, sf_dir).groupBy((F.col("path_id") % A.DRAWINGS).alias("drawing_id"), F.col("layer").alias("cluster")).agg(F.count("*").alias("votes"))
    return O.anchor_vote(votes, ["drawing_id"]).withColumn("cumulative", F.round("cumulative", 6))
