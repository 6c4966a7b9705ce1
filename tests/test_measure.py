"""The whole measurement on drawings whose lengths are known, and its parts against plain computations."""

from __future__ import annotations

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import delivery as D
from plumbline.operators import glyphs as GL
from plumbline.operators import network as N
from plumbline.operators import ordered as O
from plumbline.operators import scale as SC
from plumbline.operators import spatial as S
from plumbline.operators import styles as ST
from plumbline.operators import zones as Z
from plumbline.plans.measure import measure, profile, sheets

SEG = "drawing_id long, path_id long, seg_no int, ax double, ay double, bx double, by_ double"
RUN = "g int, run_id long, ax double, ay double, bx double, by_ double"
METRE = 1000 / (25.4 / 72) / 50  # points at 1 : 50


def box(x0, y0, x1, y1):
    return [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)]


def drawing(d, with_scale=True):
    """(paths, segments, words) of one sheet of 2000 x 1500: two pipes in dashes, a bend, a hatch with a pipe inside, symbols, walls, text."""
    paths, segments, words = [], [], []

    def add(layer, width, segs, kind="s", dash="solid", closed=False):
        i = len(paths)
        paths.append((d, i, layer, kind, (0.0, 0.0, width), (0.5, 0.5, 0.5), width, dash, closed))
        segments.extend((d, i, k + 1, *map(float, s)) for k, s in enumerate(segs))
        return i

    pipe = "268-W|V-52-FE--KV-"
    for k in range(20):  # ten metres in dashes of 25 with gaps of 3.3465 points
        add(pipe, 2.0, [(100 + k * METRE / 2, 300, 100 + k * METRE / 2 + 25, 300)])
    add(pipe, 2.0, [(300, 500, 300 + 2 * METRE, 500)])
    add(pipe, 2.0, [(900, 700, 900 + 4 * METRE, 700)])  # in the hatch
    for x in (150.0, 400.0, 1500.0):  # two on a pipe, one far away
        add(pipe, 0.5, [(x - 3, 297, x + 3, 297), (x + 3, 297, x + 3, 303), (x + 3, 303, x - 3, 303), (x - 3, 303, x - 3, 297)], closed=True)
    add(pipe, 0.5, [(1000, 698, 1004, 698), (1004, 698, 1004, 702), (1004, 702, 1000, 702), (1000, 702, 1000, 698)], closed=True)  # in the hatch
    for k in range(100):
        add("268-W|A-HATCH", 0.5, [(880, 600 + 3 * k, 1180, 600 + 3 * k)])
    for k in range(40):
        add("268-W|A-40-T-", 0.5, [(200 + 30 * k, 1000 + 7 * k * k % 300, 215 + 30 * k, 1009 + 7 * k * k % 300)])
    add("268-W|A-40-T-", 0.5, [(100, 1200, 900, 1200)])
    add("268-W|FRAME", 0.5, box(10, 10, 1990, 1490), closed=True)
    add("268-W|FRAME", 0.5, box(1600, 1250, 1990, 1490), closed=True)
    if with_scale:
        add("268-W|BAR", 0.5, box(1650, 100, 1650 + 5 * METRE, 104), kind="f", closed=True)
    for k in range(11):
        add("268-W|BAR", 0.5, [(1650 + k * METRE / 2, 96, 1650 + k * METRE / 2, 99)])
    if with_scale:
        words = [(d, f"A{10 * k}", 50 + k * METRE, 40.0, 60 + k * METRE, 50.0) for k in range(8)]
    return paths, segments, words


@pytest.fixture(scope="module")
def measured(spark):
    parts = [drawing(1), drawing(2, with_scale=False), drawing(3)]
    paths, segments, words = ([x for p in parts for x in p[k]] for k in range(3))
    colour = "struct<r:double,g:double,b:double>"
    return measure(
        spark.createDataFrame(paths, f"drawing_id long, path_id long, layer string, kind string, stroke {colour}, fill {colour}, width double, dash_signature string, closed boolean"),
        spark.createDataFrame(segments, SEG),
        spark.createDataFrame([(d, 2000.0, 1500.0) for d in (1, 2, 3, 4)], "drawing_id long, width double, height double"),
        spark.createDataFrame(words, "drawing_id long, text string, x0 double, y0 double, x1 double, y1 double"),
        spark.createDataFrame([("268", ["-FE-"], True)], "project_key string, tokens array<string>, valid boolean"),
        spark.createDataFrame([("268", 283.5, 10, 5000.0)], "project_key string, known_pitch double, known_divisions int, known_span_mm double"),
    ), paths


def test_known_lengths(measured):
    m, paths = measured
    rows = {(r.drawing_id, r.layer): r for r in m.quantities.collect()}
    assert set(rows) == {(1, "268-W|V-52-FE--KV-"), (3, "268-W|V-52-FE--KV-")}
    for r in rows.values():
        dashes = 19 * 0.5 + 25 / METRE
        assert abs(r.length_m + r.masked_m - (dashes + 6)) < 1e-6 and 3.9 < r.masked_m <= 4.0 + 1e-9
        assert (r.verticals, r.masked_verticals, r.system, r.n_strands) == (2, 1, "KV", 3)
        assert "no_plateau" not in r.flags and "masked_length" in r.flags
    scales = {r.drawing_id: r for r in m.scales.collect()}
    assert scales[1].scale == 50.0 and scales[1].sources == "grid,project_scalebar,scalebar" and scales[2].scale is None and scales[2].flags == scales[4].flags == "no_source"
    assert m.accepted.count() + m.blocked.count() == len(paths)
    assert {r.reason for r in m.blocked.filter("drawing_id = 2").collect()} == {"no_scale"}
    facts = {r.drawing_id: r for r in m.facts.collect()}
    assert facts[1].coverage == 1.0 and facts[1].method == "layer_rule" and facts[1].n_pipe_clusters == 1 and (facts[4].track, facts[2].length_m) == ("C", 0)
    assert facts[1].length_m == facts[3].length_m and facts[1].verticals == 2
    zones = {(r.drawing_id, r.ordinal): r for r in m.zones.collect()}
    assert zones[1, 1].kind == "titleblock" and zones[1, 0].kind == "plan"
    delivered = m.delivery.filter("drawing_id = 1").collect()
    assert sorted(r.kind for r in delivered) == ["excluded", "pipe"]
    truth = m.facts.sparkSession.createDataFrame([(1, "KV-A-1", 12.0, 2.0)], "drawing_id long, label string, length_m double, vertical_count double")
    scope = m.facts.sparkSession.createDataFrame([(1, "268-W|V-52-FE--KV-", 12.0)], "drawing_id long, layer string, truth_m double")
    e = {r.drawing_id: r for r in D.evaluate(m.facts, m.quantities, truth, scope).collect()}
    assert e[1].vertical_error == 0 and e[1].verticals_ok and abs(e[1].mape - abs(facts[1].length_m - 12) / 12 * 100) < 1e-9 and e[3].truth_m is None and not e[3].length_ok
    report = json.loads(D.as_json(m.facts, systems=m.quantities.select("drawing_id", "cluster_id", "length_m")).filter("drawing_id = 1").first().json)
    assert report["track"] == "A" and len(report["systems"]) == 1
    assert D.summary_block(m.facts).filter("drawing_id = 1").count() == 13


def test_measured_sheets_of_the_test_tables(spark):
    inputs = sheets(spark, "/root/testdata/sf0.001")
    inputs = {k: (v if k == "rules" else v.filter("drawing_id < 8")) for k, v in inputs.items()}
    m = measure(**inputs)
    assert m.accepted.count() + m.blocked.count() == inputs["paths"].count() and m.accepted.count() > 0
    assert {r.drawing_id for r in m.scales.filter("scale = 50").collect()} == {1, 2, 3, 4, 5, 6}
    assert {r.reason for r in m.blocked.filter("drawing_id IN (0, 7)").collect()} == {"no_scale"}


def test_boxes_numbered_in_every_drawing(spark):
    rows = [(1, 1, 0.0, 0.0, 5.0, 5.0), (1, 2, 5.0, 5.0, 9.0, 9.0), (2, 1, 0.0, 0.0, 5.0, 5.0), (2, 2, 50.0, 50.0, 55.0, 55.0), (2, 3, 0.0, 0.0, 300.0, 300.0)]
    boxes = spark.createDataFrame(rows, "drawing_id int, box_id int, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.drawing_id, r.box_id, r.n_parts) for r in GL.grouped(boxes.filter("box_id < 3"), ["drawing_id"], 0.0, 0.0).collect())
    assert got == [(1, 1, 2), (2, 1, 1), (2, 2, 1)]
    assert sorted(map(tuple, S.touching_boxes(boxes, ["drawing_id"], 0.0, 0.0).collect())) == [(1, 1, 2), (2, 1, 3), (2, 2, 3)]
    lines = spark.createDataFrame([(2, 7, "a", 0.0, 0.0, 24.0, 0.0)], "drawing_id int, line_id int, label string, x0 double, y0 double, x1 double, y1 double")
    seg = spark.createDataFrame([(1, 1, 1, "B", 0.0, 90.0, 24.0, 90.0), (2, 1, 1, "Z", 0.0, 1.0, 24.0, 1.0)], "drawing_id int, path_id int, seg_no int, layer string, ax double, ay double, bx double, by_ double")
    assert [r.layer for r in D.markup_votes(lines, seg, 4.0).collect()] == ["Z"]


def test_bridges_against_one_greedy_pass(spark):
    rng = random.Random(5)
    rows = []
    for g in (1, 2):
        for i in range(150):
            x, y, a = rng.uniform(0, 200), rng.uniform(0, 60), rng.choice([0.0, 0.0, math.pi / 2, 0.01, 3.1315])
            n = rng.uniform(3, 20)
            rows.append((g, i, x, y, x + n * math.cos(a), y + n * math.sin(a)))
    got = sorted((r.g, r.a, r.a_end, r.b, r.b_end) for r in N.bridge_runs(spark.createDataFrame(rows, RUN), ["g"], 15.0, offset=3.0).collect())

    def turn(r):
        a = math.atan2(r[5] - r[3], r[4] - r[2])
        return a + math.pi if a < 0 else a

    want = []
    for g in (1, 2):
        own = [r for r in rows if r[0] == g]
        cand = []
        for r, q in itertools.combinations(own, 2):
            d = abs(turn(r) - turn(q))
            if min(d, math.pi - d) > math.radians(2):
                continue
            for s, t in itertools.product((0, 1), (0, 1)):
                p, e = r[2 + 2 * s : 4 + 2 * s], q[2 + 2 * t : 4 + 2 * t]
                n = math.dist(r[2:4], r[4:6])
                off = abs((e[0] - r[2]) * (r[5] - r[3]) - (e[1] - r[3]) * (r[4] - r[2])) / n
                if math.dist(p, e) <= 15 and off <= 3:
                    cand.append((math.dist(p, e), r[1], s, q[1], t))
        parent, used = {}, set()

        def root(x, parent=parent):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for _, a, s, b, t in sorted(cand):
            if (a, s) not in used and (b, t) not in used and root(a) != root(b):
                used |= {(a, s), (b, t)}
                parent[root(a)] = root(b)
                want.append((g, a, s, b, t))
    assert got == sorted(want) and len(got) > 40


def test_polylines_walk_chains_and_split_at_junctions(spark):
    runs = [(1, 1, 0, 0, 10, 0), (1, 2, 20, 0, 12, 0), (1, 3, 22, 0, 30, 0), (1, 9, 100, 0, 110, 0)]
    df = spark.createDataFrame([(g, i, *map(float, p)) for g, i, *p in runs], RUN)
    points = df.select("g", "run_id", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.lit(1).alias("pos"), F.col("bx").alias("x"), F.col("by_").alias("y")))).alias("p")).select("g", "run_id", "p.*")
    bridges = N.bridge_runs(df, ["g"], 3.0)
    lines = N.polylines(df, points, bridges, ["g"])
    walked = {c: [(r.x, r.y) for r in sorted((r for r in lines.collect() if r.chain_id == c), key=lambda r: (r.place, r.pos))] for c in (1, 9)}
    assert walked == {1: [(0, 0), (10, 0), (12, 0), (20, 0), (22, 0), (30, 0)], 9: [(100, 0), (110, 0)]}
    cross = [(0, 0, 10, 0), (10, 0, 20, 5), (10, 0, 10, 9), (10, 0, 13, -9)]
    more = spark.createDataFrame([(1, "a", 1, 0, k, *map(float, p)) for k, p in enumerate([(0, 0), (10, 0), (20, 5)])] + [(1, "b", c, 0, k, *map(float, p)) for c, (x0, y0, x1, y1) in enumerate(cross[1:], 5) for k, p in enumerate([(x0, y0), (x1, y1)])], "d int, cluster string, chain_id long, place int, pos int, x double, y double")
    _, strands = N.strands(more, ["d", "cluster"], ["d"], 1.0)
    got = sorted((r.cluster, r.chain_id, r.strand_no, round(r.length, 4), r.node_a, r.node_b) for r in strands.collect())
    assert got[:2] == [("a", 1, 0, 10.0, "0:0", "10:0"), ("a", 1, 1, 11.1803, "10:0", "20:5")] and len(got) == 5
    degrees = {r.node: r.degree for r in N.nodes(strands, ["d"]).collect()}
    assert degrees["10:0"] == 5


def test_long_chain_is_walked_in_few_rounds(spark):
    n = 200
    rows = [(1, (i * 37) % n + 1, 10.0 * i, 0.0, 10.0 * i + 8, 0.0) for i in range(n)]
    df = spark.createDataFrame(rows, RUN)
    points = df.select("g", "run_id", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.lit(1).alias("pos"), F.col("bx").alias("x"), F.col("by_").alias("y")))).alias("p")).select("g", "run_id", "p.*")
    lines = N.polylines(df, points, N.bridge_runs(df, ["g"], 3.0), ["g"]).collect()
    x = [r.x for r in sorted(lines, key=lambda r: (r.place, r.pos))]
    assert x in (sorted(x), sorted(x, reverse=True)) and len(x) == 2 * n and {r.chain_id for r in lines} == {1}


def test_zones_of_a_page(spark):
    rects = [(1, 0, b) for b in box(10, 10, 990, 690)] + [(1, 1, b) for b in box(800, 500, 990, 690)] + [(1, 2, b) for b in box(300, 300, 420, 400)]
    small = [(1, 10 + k, (310 + k, 310.0, 311 + k, 312.0)) for k in range(80)] + [(1, 100 + k, (20 + 9.0 * k, 20.0, 25 + 9.0 * k, 21.0)) for k in range(80)]
    seg = spark.createDataFrame([(d, p, k, *map(float, s)) for k, (d, p, s) in enumerate(rects + small)], SEG)
    frame, zones = Z.detect(seg, spark.createDataFrame([(1, 1000.0, 700.0), (5, 100.0, 100.0)], "drawing_id long, width double, height double"), ["drawing_id"])
    assert sorted(map(tuple, frame.collect())) == [(1, 10.0, 10.0, 990.0, 690.0), (5, 0.0, 0.0, 100.0, 100.0)]
    got = [(r.ordinal, r.kind, r.zx0, r.zy0) for r in zones.orderBy("ordinal").filter("drawing_id = 1").collect()]
    assert [g[1] for g in got] == ["plan", "titleblock", "detail"] and got[1][2:] == (800.0, 500.0) and got[2][2:] == (300.0, 300.0)
    assert [(r.kind, r.zx1) for r in zones.filter("drawing_id = 5").collect()] == [("plan", 100.0)]


def test_free_rectangle_against_all_rectangles(spark):
    rng = random.Random(9)
    frames, panels, want = [], [], {}
    for d in range(12):
        own = [(x := rng.randrange(0, 11), y := rng.randrange(0, 8), x + rng.randrange(0, 5), y + rng.randrange(0, 4)) for _ in range(rng.randrange(0, 6))]
        frames.append((d, 0.0, 0.0, 12.0, 9.0))
        panels += [(d, x0 + 0.5, y0 + 0.5, x1 + 0.5, y1 + 0.5) for x0, y0, x1, y1 in own]
        taken = {(i, j) for x0, y0, x1, y1 in own for i in range(x0, min(11, x1) + 1) for j in range(y0, min(8, y1) + 1)}
        best = None
        for l, r in itertools.combinations(range(13), 2):
            for t, b in itertools.combinations(range(10), 2):
                if not any(l <= i < r and t <= j < b for i, j in taken):
                    key = (-(r - l) * (b - t), b, r, t)
                    best = min(best, (key, (l, t, r, b))) if best else (key, (l, t, r, b))
        want[d] = tuple(map(float, best[1])) if best else (0.0, 0.0, 12.0, 9.0)
    schema = "d int, x0 double, y0 double, x1 double, y1 double"
    got = N.largest_free_rectangle(spark.createDataFrame(frames, schema), spark.createDataFrame(panels, schema), ["d"], 12, 9)
    assert {r.d: (r.x0, r.y0, r.x1, r.y1) for r in got.collect()} == want


def test_sweep_and_scale_reference(spark):
    bars = spark.createDataFrame([(1, 283.46, 10), (2, 290.0, 10)], "drawing_id int, pitch double, divisions int")
    scales = spark.createDataFrame([(1, 50.0, True), (2, 50.0, False)], "drawing_id int, scale double, verified boolean")
    assert [tuple(r) for r in SC.reference_from(scales, bars, ["drawing_id"]).collect()] == [(1, 283.46, 10, 4999.9)]
    known = spark.createDataFrame([(1, 283.5, 10, 5001.7), (2, 283.5, 10, 5001.7)], "drawing_id int, known_pitch double, known_divisions int, known_span_mm double")
    grids = spark.createDataFrame([], "drawing_id int, pitch double")
    sources = SC.sources_of(grids, bars, known, ["drawing_id"])
    assert sorted((r.drawing_id, r.source) for r in sources.collect()) == [(1, "project_scalebar"), (1, "scalebar"), (2, "scalebar")]


def test_positional_values_and_quantiser(spark):
    rng = random.Random(2)
    data = [(g, float(rng.randrange(20))) for g in range(5) for _ in range(rng.randrange(1, 40))]
    got = {r.g: (r.a, r.b) for r in ST.positional_values(spark.createDataFrame(data, "g int, v double"), ["g"], "v", {"a": 0.5, "b": 0.9}).collect()}
    for g in range(5):
        v = sorted(x for k, x in data if k == g)
        assert got[g] == tuple(v[min(len(v) - 1, int(len(v) * p))] for p in (0.5, 0.9))
    paths = spark.createDataFrame([(1, 1, "fs", (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)), (1, 2, "f", (0.0, 1.0, 0.0), (1.0, 0.01, 0.0)), (1, 3, "s", None, None)], "d int, path_id int, kind string, stroke struct<r:double,g:double,b:double>, fill struct<r:double,g:double,b:double>")
    assert sorted(map(tuple, ST.quantised(paths, ["d"]).collect()))[0] == (1, 1, 0, 1)
    assert {(r.path_id, r.stroke_no, r.fill_no) for r in ST.quantised(paths, ["d"]).collect()} == {(1, 0, 1), (2, None, 0), (3, None, None)}


def test_letter_height_and_plateau_of_known_curve(spark):
    strokes = [(1, 3 * k + j, 10.0 * k + 2 * j, 0.0, 10.0 * k + 2 * j + 1, 3.0 if j else 7.0) for k in range(6) for j in range(3)]
    df = spark.createDataFrame(strokes, "g int, box_id int, x0 double, y0 double, x1 double, y1 double")
    assert GL.letter_height(df, ["g"]).first().height == 7.0
    curve = spark.createDataFrame([(1, float(i), float(v)) for i, v in enumerate([10, 12, 14, 14, 14, 14, 16, 19, 23])], "g int, x double, y double")
    got = O.plateau(curve, ["g"]).first()
    assert (got.threshold, got.width) == (4.0, 4.0)  # three steps of 0 and the one of 1/7 are at most the median


def test_profile_and_indicators(measured):
    measured = measured[0]
    rated = {r["drawing_id"]: r for r in D.indicators(measured.facts).collect()}
    assert sorted(rated) == [1, 2, 3, 4]
    assert rated[1]["scale_verified"] and rated[1]["masked_m"] == 4.0 and rated[1]["masked_verticals"] == 1
    assert not rated[2]["scale_verified"] and rated[2]["masked_m"] == 0.0 and not rated[4]["scale_verified"]
    kept = {r["drawing_id"]: json.loads(r["json"]) for r in profile(measured).collect()}
    assert sorted(kept) == [1, 2, 3, 4]
    assert kept[1]["p90"] == 2.0 and kept[1]["p10"] == 0.5 and kept[1]["zones"][0]["kind"] == "plan"
    pipes = [c for c in kept[1]["clusters"] if c["class"] == "pipe"]
    assert [c["layer"] for c in pipes] == ["268-W|V-52-FE--KV-"] and 0 <= pipes[0]["confidence"] <= 1
    assert len(kept[1]["clusters"]) == kept[1]["n_clusters"] and not any(c["class"] == "pipe" for c in kept[2]["clusters"])
    assert "clusters" not in kept[4]
