"""Operators on small literal tables."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import text as T
from plumbline.operators import delivery as D
from plumbline.operators import glyphs as GL
from plumbline.operators import hatch as H
from plumbline.operators import layers as L
from plumbline.operators import network as N
from plumbline.operators import ordered as O
from plumbline.operators import scale as SC
from plumbline.operators import spatial as S
from plumbline.operators import styles as ST
from plumbline.operators import zones as Z

RUN = "g int, run_id long, ax double, ay double, bx double, by_ double"


def runs(spark, *segments):
    return spark.createDataFrame([(1, i, *map(float, s)) for i, s in enumerate(segments)], RUN)


@pytest.mark.parametrize(
    ("segments", "gap", "offset", "bridges", "chains"),
    [
        ([(0, 0, 10, 0), (12, 0, 20, 0)], 3.0, 1.0, 1, [20.0]),
        ([(0, 0, 10, 0), (30, 0, 40, 0)], 3.0, 1.0, 0, [10.0, 10.0]),
        ([(0, 0, 10, 0), (11, 0, 11, 10)], 3.0, 1.0, 0, [10.0, 10.0]),
        ([(0, 0, 10, 0), (12, 5, 20, 5)], 6.0, 1.0, 0, [8.0, 10.0]),
    ],
)
def test_bridging(spark, segments, gap, offset, bridges, chains):
    r = runs(spark, *segments)
    b = N.bridge_runs(r, ["g"], gap, offset=offset)
    assert b.count() == bridges
    assert sorted(x.length for x in N.merged_runs(r, b, ["g"]).collect()) == chains


def test_sweep_is_a_prefix_of_the_widest_join(spark):
    rng = random.Random(1)
    segments, x = [], 0.0
    for _ in range(30):
        segments.append((x, 0, x + 5, 0))
        x += 5 + rng.choice([0.4, 1.0, 2.2, 5.0, 9.0])
    r = runs(spark, *segments)
    base = spark.createDataFrame([(1, 150.0, 1.0)], "g int, total double, unit double")
    curve = {round(p.x, 6): p.y for p in O.sweep(base, N.bridge_runs(r, ["g"], 12.0, offset=0.5), ["g"]).collect()}
    for k in (0, 4, 8, 20, 40):
        t = k * 0.3
        direct = sum(p.gap for p in N.bridge_runs(r, ["g"], t, offset=0.5).collect()) if t else 0.0
        assert abs(curve[round(t, 6)] - 150 - direct) < 1e-9


def test_plateau(spark):
    y = [10, 10, 10, 20, 20, 20, 20, 20, 20, 30]
    curve = spark.createDataFrame([(1, 0.5 * i, float(v)) for i, v in enumerate(y)], "g int, x double, y double")
    got = O.plateau(curve, ["g"]).first()
    assert got.width > 0 and 1.0 < got.threshold < 4.5
    short = O.plateau(curve.limit(3), ["g"]).first()
    assert (short.threshold, short.width) == (0.0, 0.0)


@pytest.mark.parametrize("rotate", [0, 90, 180, 270])
def test_page_matrix(spark, rotate):
    df = spark.createDataFrame([(x, y) for x in (0.0, 400.0) for y in (0.0, 200.0)], "x double, y double").withColumn("m", G.page_matrix(F.lit(rotate), 400, 200, F.lit(None).cast("double")))
    tx, ty = G.apply_matrix("m", "x", "y")
    got = df.select(tx.alias("tx"), ty.alias("ty"), "m", "x", "y")
    w, h = (200, 400) if rotate in (90, 270) else (400, 200)
    assert sorted((r.tx, r.ty) for r in got.collect()) == [(0, 0), (0, h), (w, 0), (w, h)]
    bx, by = G.invert_matrix("m", "tx", "ty")
    assert all(abs(r.x - r.ix) < 1e-9 and abs(r.y - r.iy) < 1e-9 for r in got.select("x", "y", bx.alias("ix"), by.alias("iy")).collect())


def test_page_matrix_refuses_other_rotations(spark):
    with pytest.raises(Exception, match="no such page rotation"):
        spark.range(1).select(G.page_matrix(F.lit(45), 1, 1, 1)).collect()


def test_scale_functions(spark):
    row = spark.range(1).select(G.snap_scale(F.lit(50.02)).alias("a"), G.snap_scale(F.lit(37.0)).alias("b"), G.metres(72, 50).alias("m")).first()
    assert row.a == 50.0 and row.b is None and abs(row.m - 1.27) < 1e-12
    with pytest.raises(Exception, match="scale is not known"):
        spark.range(1).select(G.metres(1, F.lit(None).cast("double"))).collect()
    source = spark.createDataFrame([(1, "grid", 5.6695, [10.0, 100.0, 1000.0])], "g int, source string, pitch double, meanings array<double>")
    assert sorted(r.scale for r in SC.candidates(source, ["g"]).collect()) == [50.0, 500.0]


def test_scale_vote_refuses(spark):
    rated = spark.createDataFrame([(1, "a", 50.0, 50.0), (1, "b", 50.0, 50.1), (2, "a", 50.0, 50.0), (3, "a", 50.0, 50.0), (3, "b", 50.0, 50.9)], "g int, source string, scale double, raw double")
    walls = spark.createDataFrame([], "g int, mode double")
    got = {r.g: r for r in SC.vote(rated, walls, ["g"]).collect()}
    assert got[1].scale == 50.0 and got[2].scale is None and got[3].scale is None
    assert "single_source_only" in got[2].flags and "sources_disagree" in got[3].flags


def test_labels(spark):
    df = spark.createDataFrame([("S3-R8-110",), ("KV2-X31-16",), ("KV2-X31",), ("Markera",), (None,)], "s string")
    got = [tuple(r) for r in df.select(*T.parse_label(F.col("s"))).collect()]
    assert got == [("S3", "R8", "110"), ("KV2", "X31", "16"), ("KV2", "X31", None), (None, None, None), (None, None, None)]


def test_grid_label_numbers_and_names(spark):
    df = spark.createDataFrame([("A200",), ("70",), ("b-1,5",), ("2024-04-19",), ("Ä 7",), ("",)], "s string")
    prefix, value = T.grid_label(F.col("s"))
    assert [tuple(r) for r in df.select(prefix, value).collect()] == [("A", 200.0), ("", 70.0), ("B", 1.5), (None, None), ("Ä", 7.0), (None, None)]
    one = spark.range(1).select(T.locale_number(F.lit("1 234,5 m")).alias("n"), T.locale_number(F.lit("-")).alias("x"), T.dash_signature(F.lit("[3 1] 0")).alias("d"), T.dash_signature(F.lit(None).cast("string")).alias("e"), T.system_from_layer(F.lit("W|V-52-FE--KV-")).alias("s"), T.layer_matches(F.lit(""), ["-"]).alias("m")).first()
    assert (one.n, one.x, one.d, one.e, one.s, one.m) == (1234.5, None, "n2:0.75/0.25", "solid", "KV", False)


def test_grid_cell_and_node_key(spark):
    row = spark.range(1).select(G.grid_cell(F.lit(1.0), 0.1).alias("a"), G.node_key(F.lit(2.5), 1.0).alias("b"), G.node_key(F.lit(3.5), 1.0).alias("c")).first()
    assert (row.a, row.b, row.c) == (9, 2, 4)


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(1, i, i + 1) for i in range(100, 160)] + [(1, rng.randrange(90), rng.randrange(90)) for _ in range(50)]
    parent = {n: n for e in edges for n in e[1:]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in N.connected_components(spark.createDataFrame(edges, "g int, a long, b long"), ["g"]).collect()}
    assert got == {n: root(n) for n in parent}


def test_joins_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(1, p, 1, x := float(rng.randrange(60)), y := float(rng.randrange(60)), x + rng.choice([0, 7.0]), y + rng.choice([0, 5.0])) for p in range(60)]
    seg = spark.createDataFrame(rows, "g int, path_id int, seg_no int, ax double, ay double, bx double, by_ double")
    ends = {r[1]: {(r[3], r[4]), (r[5], r[6])} for r in rows}
    near = {p for p in ends for q in ends if p != q and any(math.dist(a, b) <= 3 for a in ends[p] for b in ends[q])}
    got = S.connectivity(seg, ["g"], 3.0).first()
    assert (got.n_paths, got.n_touching) == (60, len(near))
    points = spark.createDataFrame([(1, i, float(rng.randrange(60)), float(rng.randrange(60))) for i in range(30)], "g int, point_id int, x double, y double")

    def gap(p, r):
        dx, dy = r[5] - r[3], r[6] - r[4]
        t = 0 if dx == dy == 0 else max(0, min(1, ((p[2] - r[3]) * dx + (p[3] - r[4]) * dy) / (dx * dx + dy * dy)))
        return math.dist((p[2], p[3]), (r[3] + t * dx, r[4] + t * dy))

    want = {}
    for p in points.collect():
        d, best = min((gap(p, r), r[1]) for r in rows)
        if d <= 4:
            want[p.point_id] = round(d, 9)
    assert {r.point_id: round(r.distance, 9) for r in S.nearest_segment(points, seg, ["g"], 4.0).collect()} == want


def test_touching_boxes_find_large_ones(spark):
    rng = random.Random(4)
    boxes = [(1, i, x := rng.uniform(0, 300), y := rng.uniform(0, 300), x + rng.choice([2, 200]), y + rng.choice([2, 150])) for i in range(40)]
    want = {(a[1], b[1]) for a, b in itertools.combinations(boxes, 2) if a[4] + 1 >= b[2] and b[4] + 1 >= a[2] and a[5] + 1 >= b[3] and b[5] + 1 >= a[3]}
    got = S.touching_boxes(spark.createDataFrame(boxes, "g int, box_id int, x0 double, y0 double, x1 double, y1 double"), ["g"], 1.0, 1.0)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_parallel_pitch_of_a_hatch(spark):
    hatch = [(1, i, 1, 0.0, 2.0 * i, 50.0, 2.0 * i) for i in range(40)]
    got = S.parallel_pitch(spark.createDataFrame(hatch, "g int, path_id int, seg_no int, ax double, ay double, bx double, by_ double"), ["g"]).first()
    assert (got.pitch, got.regularity) == (2.0, 1.0)


def test_free_rectangle_and_merge(spark):
    frame = spark.createDataFrame([(1, 0.0, 0.0, 240.0, 170.0)], "g int, x0 double, y0 double, x1 double, y1 double")
    panel = spark.createDataFrame([(1, 200.0, 0.0, 239.0, 169.0, 0), (1, 201.0, 1.0, 238.0, 168.0, 1)], "g int, x0 double, y0 double, x1 double, y1 double, ordinal int")
    assert tuple(N.largest_free_rectangle(frame, panel, ["g"]).first())[1:] == (0.0, 0.0, 200.0, 170.0)
    assert [tuple(r)[1:] for r in N.merge_boxes(panel, ["g"]).collect()] == [(200.0, 0.0, 239.0, 169.0)]


def test_widths_colours_and_modes(spark):
    w = spark.createDataFrame([(1, x) for x in (1.0, 1.04, 1.06, 2.0, 0.0)], "g int, width double")
    assert ST.width_buckets(w, ["g"]).first().representatives == [1.0, 1.06, 2.0]
    c = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1), (1, 1.0, 0.0, 0.0, 2), (1, 0.01, 0.0, 0.0, 3)], "g int, r double, g2 double, b double, ordinal int").withColumnRenamed("g", "k").withColumnRenamed("g2", "g")
    assert {(r.r, r.colour_no) for r in ST.colour_representatives(c, ["k"]).collect()} == {(0.0, 0), (1.0, 1), (0.01, 0)}
    m = spark.createDataFrame([(1, v, i) for i, v in enumerate([3, 3, 1, 1, 2])], "g int, v int, i int")
    assert S.first_mode(m, ["g"], "v", "i").first().v == 3


def test_layer_rule(spark):
    df = spark.createDataFrame([("W|V-52-FE--KV-", True), ("W|V-53-FE--S-", True), ("W|A-40-T--", False), ("W|V-1-T--", False)], "layer string, wanted boolean")
    assert L.induce(df) == ["-FE-"]
    assert L.induce(df.limit(0)) == []


def test_zones_and_gates(spark):
    box = spark.createDataFrame([(1.0, 1.0, 5.0, 5.0), (90.0, 90.0, 99.0, 99.0), (50.0, 50.0, 50.0, 50.0)], "x0 double, y0 double, x1 double, y1 double")
    zones = [("plan", 0, 0, 60, 60), ("legend", 80, 80, 100, 100)]
    assert [r[0] for r in box.select(Z.zone_of(("x0", "y0", "x1", "y1"), zones)).collect()] == ["plan", "legend", "plan"]
    metrics = spark.createDataFrame([(-9.9, 3, 10, 4, None)], "length_error_pct double, vertical_error int, n_nodes int, n_labels int, mape double")
    g = D.gates(metrics).first()
    assert (g.length_ok, g.verticals_ok, g.nodes_ok, g.mape_ok) == (True, True, True, False)


def test_masked_length_is_reported(spark):
    strands = spark.createDataFrame([(1, "a", 2.0, False, 1), (1, "a", 3.0, True, 0), (1, "b", 4.0, None, 2)], "drawing_id int, layer string, length_m double, masked boolean, bends int")
    q = D.quantities(strands, ["drawing_id", "layer"])
    rows = D.delivery_rows(q, ["layer"]).collect()
    assert sum(r.length_m for r in rows) == 9.0 and [r.length_m for r in rows if r.kind == "excluded"] == [3.0]


def test_input_order_does_not_matter(spark):
    segments = [(0, 0, 10, 0), (12, 0, 20, 0), (21, 0, 30, 0), (31, 0, 40, 0)]
    a = runs(spark, *segments)
    results = [sorted(tuple(r) for r in N.bridge_runs(df, ["g"], 3.0).collect()) for df in (a, a.orderBy(F.desc("run_id")), a.repartition(4))]
    assert results[0] == results[1] == results[2]


def test_hatch_mask_closes_gaps(spark):
    rows = [(1, "hatch", i, 1, 0.0, 2.0 * i, 100.0, 2.0 * i) for i in range(60)] + [(1, "pipe", 100 + i, 1, 0.0, 300.0 + 7 * i * i, 50.0, 300.0 + 7 * i * i) for i in range(60)]
    seg = spark.createDataFrame(rows, "drawing_id int, layer string, path_id int, seg_no int, ax double, ay double, bx double, by_ double")
    found = H.hatch_clusters(seg, ["drawing_id", "layer"], 1e6, 10.0)
    assert [(r.layer, r.pitch) for r in found.collect()] == [("hatch", 2.0)]
    mask = H.hatch_mask(seg, found, ["drawing_id", "layer"], 1.0)
    inside = spark.createDataFrame([(1, 10.0, 31.0, 20.0, 31.0), (1, 10.0, 290.0, 20.0, 290.0)], "drawing_id int, ax double, ay double, bx double, by_ double")
    assert sorted((r.ay, r.masked) for r in S.masked(inside, mask, ["drawing_id"], 1.0).collect()) == [(31.0, True), (290.0, False)]


def test_text_lines_and_calibration(spark):
    boxes = [(1, i, 3.0 * i + 6 * (i // 4), 0.0, 3.0 * i + 6 * (i // 4) + 2, 7.0) for i in range(8)]
    out = GL.text_lines(spark.createDataFrame(boxes, "g int, box_id int, x0 double, y0 double, x1 double, y1 double"), ["g"], 7.0)
    assert (out["glyphs"].count(), out["words"].count(), out["lines"].count()) == (8, 2, 1)
    layers = spark.createDataFrame([("W|V-52-FE--KV-", True), ("W|V-1-T--", False)], "layer string, wanted boolean")
    assert L.calibrate(layers, layers.filter("NOT wanted"))["valid"]
    assert not L.calibrate(layers, layers)["valid"]


def test_triage_reports_every_drawing(spark):
    from plumbline.operators import delivery

    drawings = spark.createDataFrame([(7,), (8,), (9,)], "drawing_id long")
    paths = spark.createDataFrame([(7, "a"), (7, "b"), (8, None)], "drawing_id long, layer string")
    got = sorted(map(tuple, delivery.triage(drawings, paths, ["drawing_id"]).select("drawing_id", "track", "n_paths", "n_layers", "vectorised").collect()))
    assert got == [(7, "A", 2, 2, True), (8, "B", 1, 0, True), (9, "C", 0, 0, True)]
