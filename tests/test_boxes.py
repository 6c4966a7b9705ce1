"""Many equal boxes, many panels, boxes merged in order, symbols exactly at the reach, and layers of many paths."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from plumbline.operators import layers as L
from plumbline.operators import network as N
from plumbline.operators import spatial as S
from plumbline.operators import zones as Z

BOX = "g int, box_id long, x0 double, y0 double, x1 double, y1 double"


def test_symbol_exactly_at_the_reach(spark):
    symbol = spark.createDataFrame([(1, 5, 10.0, 29.0, 4.0, 4.0)], "g int, symbol_id long, x double, y double, w double, h double")
    ends = "g int, path_id long, seg_no int, ax double, ay double, bx double, by_ double"
    pipe = spark.createDataFrame([(1, 3, 1, 0.0, 15.0, 20.0, 15.0)], ends)  # 14 points off; 29/7 - 15/7 is over 2
    units = spark.createDataFrame([(1, 7.0)], "g int, unit double")
    assert [(r.path_id, r.distance) for r in N.verticals(symbol, pipe, units, ["g"]).collect()] == [(3, 14.0)]


def test_layers_of_many_paths(spark):
    rows = spark.range(400_000).select(F.concat(F.lit("268-F|V-1-FE--A"), (F.col("id") % 20).cast("string"), F.lit("-")).alias("layer"), (F.col("id") % 2 == 0).alias("wanted"))
    start = time.perf_counter()
    tokens = L.token_candidates(rows.distinct()).filter("token = '-FE-'").collect()
    assert [(r.covered, r.negatives) for r in tokens] == [(10, 10)]
    assert time.perf_counter() - start < 60


def test_densities_of_many_panels(spark):
    rng = random.Random(3)
    panels = [(1, i, x := rng.uniform(-50, 900), y := rng.uniform(-50, 900), x + rng.choice([0, 3, 40, 500]), y + rng.choice([0, 2, 60, 300])) for i in range(60)]
    paths = [(1, i, x := rng.uniform(-50, 900), y := rng.uniform(-50, 900), x + rng.choice([0, 5]), y + rng.choice([0, 9])) for i in range(300)]

    def inside(p, b):
        area = (p[4] - p[2]) * (p[5] - p[3])
        if area > 0:
            return max(0, min(p[4], b[4]) - max(p[2], b[2])) * max(0, min(p[5], b[5]) - max(p[3], b[3])) / area > 0.9
        return b[2] <= (p[2] + p[4]) / 2 <= b[4] and b[3] <= (p[3] + p[5]) / 2 <= b[5]

    got = Z.densities(spark.createDataFrame(panels, BOX), spark.createDataFrame(paths, BOX.replace("box_id", "path_id")), ["g"])
    assert {r.box_id: r.n_inside for r in got.collect()} == {b[1]: sum(inside(p, b) for p in paths) for b in panels}
    many = spark.range(100_000).select(F.lit(1).alias("g"), F.col("id").alias("box_id"), (F.col("id") % 997 * 200.0).alias("x0"), (F.col("id") % 991 * 200.0).alias("y0")).withColumns({"x1": F.col("x0") + 150, "y1": F.col("y0") + 150})
    few = spark.createDataFrame(paths, BOX.replace("box_id", "path_id"))
    start = time.perf_counter()
    assert Z.densities(many, few, ["g"]).count() == 100_000
    assert time.perf_counter() - start < 40


def test_many_copies_of_boxes(spark):
    n = 60_000
    copies = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("box_id"), (F.col("id") % 2 * 6.0).alias("x0"), F.lit(0.0).alias("y0")).withColumns({"x1": F.col("x0") + 4, "y1": F.lit(3.0)})
    alone = spark.createDataFrame([(1, n, 90.0, 90.0, 91.0, 91.0), (2, 7, 0.0, 0.0, 4.0, 3.0), (2, 8, 0.0, 0.0, 4.0, 3.0)], BOX)
    start = time.perf_counter()
    got = N.box_components(copies.unionByName(alone), ["g"], 2.0, 2.0)
    assert sorted(map(tuple, got.groupBy("g", "component").agg(F.count("*"), F.min("node"), F.max("node")).collect())) == [(1, 0, n, 0, n - 1), (2, 7, 2, 7, 8)]
    assert time.perf_counter() - start < 60


def test_components_equal_those_of_all_pairs(spark):
    rng = random.Random(8)
    boxes = spark.createDataFrame([(k % 2, k, x := float(rng.randrange(60)), y := float(rng.randrange(60)), x + rng.choice([0, 3, 20]), y + rng.choice([0, 2, 9])) for k in range(250)], BOX)
    for gap in (0.0, 2.0):
        pairs = S.touching_boxes(boxes, ["g"], gap, gap)
        assert pairs.count() == pairs.distinct().count()
        want = {tuple(r) for r in N.connected_components(pairs, ["g"]).collect()}
        assert {tuple(r) for r in N.box_components(boxes, ["g"], gap, gap).collect()} == want


def test_a_grown_box_takes_in_a_copy(spark):
    panels = [(1, 0, 9.0, 2.0, 18.0, 9.0), (1, 1, 3.0, 6.0, 12.0, 10.0), (1, 2, 5.0, 3.0, 16.0, 6.0), (1, 3, 2.0, 5.0, 11.0, 13.0), (1, 4, 3.0, 6.0, 12.0, 10.0)]
    got = N.merge_boxes(spark.createDataFrame(panels, BOX.replace("box_id", "ordinal")), ["g"])
    assert [tuple(r)[1:] for r in got.collect()] == [(2.0, 2.0, 18.0, 13.0)]
