"""Work that must not grow faster than its input: rows shuffled and how often a row is computed."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import delivery as D
from plumbline.operators import network as N
from plumbline.operators import spatial as S
from plumbline.operators import styles as ST
from plumbline.operators import zones as Z
from plumbline.plans import catalog


@pytest.fixture
def shuffled(spark):
    """Rows that the stages of a call wrote to shuffles, with joins by shuffle."""

    def stages():
        jvm, sc = spark._jvm, spark.sparkContext
        listed = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(listed.apply, range(listed.size()))}

    def measure(call):
        before = stages()
        got = call()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return got, sum(n for k, n in stages().items() if k not in before)

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield measure
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_an_end_is_written_to_few_cells(spark, shuffled):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        x, y, (dx, dy) = rng.uniform(0, 2000), rng.uniform(0, 2000), rng.choice([(30, 0), (0, 30), (20, 20), (20, 1), (-20, 0.5)])
        rows.append((i % 3, i, x, y, x + dx, y + dy))
    frame = spark.createDataFrame(rows, "d int, run_id long, ax double, ay double, bx double, by_ double")
    got, n = shuffled(lambda: N.bridge_candidates(frame, ["d"], 40.0, 0.035, 4.0).collect())
    con = frame.toPandas().merge(frame.toPandas(), on="d", suffixes=("", "2")).query("run_id < run_id2")
    want = 0
    for i, j in itertools.product((("ax", "ay"), ("bx", "by_")), repeat=2):
        px, py, qx, qy = con[i[0]], con[i[1]], con[f"{j[0]}2"], con[f"{j[1]}2"]
        dx, dy, ex, ey = con.bx - con.ax, con.by_ - con.ay, con.bx2 - con.ax2, con.by_2 - con.ay2
        length, other = (dx**2 + dy**2) ** 0.5, (ex**2 + ey**2) ** 0.5
        aligned = ((dx * ey - dy * ex) / length / other).abs() <= 0.03499285
        want += int(((((px - qx) ** 2 + (py - qy) ** 2) ** 0.5 <= 40) & aligned & (((qx - con.ax) * dy - (qy - con.ay) * dx).abs() / length <= 4)).sum())
    assert len(got) == len({tuple(r)[:5] for r in got}) == want > 20
    assert n < 8 * len(rows)  # it was over 36 times


def test_free_rectangle_of_many_panels(spark):
    rng = random.Random(5)
    panels = [(1, x := rng.uniform(0, 235), y := rng.uniform(0, 165), x + rng.uniform(0, 4), y + rng.uniform(0, 4)) for _ in range(1500)]
    taken = {(i, j) for _, x0, y0, x1, y1 in panels for i in range(int(x0), min(239, int(x1)) + 1) for j in range(int(y0), min(169, int(y1)) + 1)}
    best = None
    up = [0] * 240
    for j in range(170):
        up = [0 if (i, j) in taken else up[i] + 1 for i in range(240)]
        for l in range(240):
            high = 170
            for r in range(l, 240):
                high = min(high, up[r])
                if not high:
                    break
                key = (-(r + 1 - l) * high, j + 1, r + 1, j + 1 - high)
                best = min(best, (key, l)) if best else (key, l)
    (_, low, right, top), left = best
    schema = "d int, x0 double, y0 double, x1 double, y1 double"
    got = N.largest_free_rectangle(spark.createDataFrame([(1, 0.0, 0.0, 240.0, 170.0)], schema), spark.createDataFrame(panels, schema), ["d"]).collect()
    assert [tuple(r)[1:] for r in got] == [tuple(map(float, (left, top, right, low)))]


def test_curves_of_a_small_file_are_spread_over_the_tasks(spark):
    frame = catalog.QUERIES["bezier_flatten"](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning(p_partkey" in plan and "lambdafunction" not in plan


def test_operations_are_flattened_in_compiled_methods(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = catalog.QUERIES["flattened_ops"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        assert "lambdafunction" not in run.toString()
        code = run.debug().codegenToSeq()
        sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert max(sizes) < 8000, sizes  # the JVM leaves longer ones to its interpreter


def test_plain_rounding_is_round(spark):
    rng = random.Random(6)
    values = [0.0, -0.0, 0.5, 2.5, -2.5, 0.000005, -0.000005, 1.000015, 123.123455, 123.1234549999, 9999.999995, 1e4, -1e4, 12345.678905, 1e12 + 0.3, -1e300, float("inf"), float("nan"), None]
    values += [rng.uniform(-2000, 2000) for _ in range(3000)] + [rng.randrange(-(10**8), 10**8) / 1e5 + rng.choice([5e-6, 5e-6 - 1e-12, 0.0]) for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for row in frame.select(G.rounded("v", 5).alias("got"), F.round("v", 5).alias("want")).collect():
        assert repr(row.got) == repr(row.want)


def test_runs_without_a_bridge_take_no_part_in_the_rounds(spark, shuffled):
    n = 1500
    runs = [(1, i) for i in range(n)]
    points = [(1, i, pos, float(i), float(pos)) for i in range(n) for pos in (0, 1)]
    frames = spark.createDataFrame(runs, "d int, run_id long"), spark.createDataFrame(points, "d int, run_id long, pos long, x double, y double"), spark.createDataFrame([(1, 5, 0, 9, 0, 1.0, 5)], "d int, a long, a_end int, b long, b_end int, gap double, chain long")
    got, rows = shuffled(lambda: N.polylines(*frames, ["d"]).collect())
    assert len(got) == 2 * n and sorted(tuple(r)[1:5] for r in got if r.chain_id == 5) == [(5, 0, -1, 5), (5, 0, 0, 5), (5, 1, 0, 9), (5, 1, 1, 9)]
    assert rows < 4.5 * n


def test_samples_of_marked_lines_are_not_dealt(spark, shuffled):
    lines = [(1, i, "a", 0.0, 40.0 * i, 400.0, 40.0 * i) for i in range(200)]
    segments = [(1, i, 1, 0.0, 40.0 * i + 1, 400.0, 40.0 * i + 1, "Z" if i % 2 else "Y") for i in range(200)]
    ends = "double, ay double, bx double, by_ double"
    frames = spark.createDataFrame(lines, "drawing_id long, line_id long, label string, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(segments, f"drawing_id long, path_id long, seg_no int, ax {ends}, layer string")
    got, rows = shuffled(lambda: D.markup_votes(*frames, 4.0).orderBy("layer").collect())
    assert [tuple(r) for r in got] == [("Y", 100, 1, 40000.0), ("Z", 100, 1, 40000.0)]
    assert rows < 50 * len(lines)  # a line has 101 samples


def test_marked_lines_against_all_samples(spark):
    rng = random.Random(7)
    turn = lambda: rng.choice([(0, 0), (9, 0), (0, 9), (30, 17), (-25, 40), (3, -70)])
    lines = [(i % 2, i, "ab"[i % 2], x := rng.randrange(-60, 60), y := rng.randrange(-60, 60), x + (t := turn())[0], y + t[1]) for i in range(80)]
    segments = [(i % 2, i, 1, x := rng.randrange(-60, 60), y := rng.randrange(-60, 60), x + (t := turn())[0], y + t[1], "XYZ"[i % 3]) for i in range(90)]
    want = {}
    for d, line, _, x0, y0, x1, y1 in lines:
        length = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
        n, votes = max(2, int(length // 4.0)), {}
        for k in range(n + 1) if length else ():
            x, y, near = x0 + (x1 - x0) * k / n, y0 + (y1 - y0) * k / n, []
            for g, path, no, ax, ay, bx, by, layer in segments:
                dx, dy = bx - ax, by - ay
                t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
                gap = ((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2) ** 0.5
                if g == d and gap <= 4.0:
                    near.append((gap, path, no, layer))
            if near:
                votes[min(near)[3]] = votes.get(min(near)[3], 0.0) + length / (n + 1) / (1 + min(near)[0])
        if votes:
            layer = min(votes, key=lambda v: (-round(votes[v], 9), v))
            if votes[layer] >= length * 0.05:
                want.setdefault((d, layer), []).append(length)
    whole = lambda rows: [tuple(float(v) if isinstance(v, int) and i > 2 else v for i, v in enumerate(r)) for r in rows]
    frames = spark.createDataFrame(whole(lines), "drawing_id long, line_id long, label string, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(whole(segments), "drawing_id long, path_id long, seg_no int, ax double, ay double, bx double, by_ double, layer string")
    got = {(r.drawing_id, r.layer): (r.n_lines, round(r.length, 6)) for r in D.markup_votes(*frames, 4.0, 0.05, by_drawing=True).collect()}
    assert got == {k: (len(v), round(sum(v), 6)) for k, v in want.items()} and len(got) == 6


def test_cells_of_long_segments_take_no_lambda_and_far_ones_none(spark, shuffled):
    n = 1500
    rows = [(1, i, 1, 500.0 * i, 0.0, 500.0 * i + 30, 20.0) for i in range(n)] + [(1, n, 1, -900.0, -300.0, 3000.0, 1000.0)]
    segments = spark.createDataFrame(rows, "g int, path_id int, seg_no int, ax double, ay double, bx double, by_ double")
    points = spark.createDataFrame([(1, i, 40.0 * i, 8.0 + 40.0 * i / 3) for i in range(20)], "g int, point_id int, x double, y double")
    assert "lambdafunction" not in S.nearest_segment(points, segments, ["g"], 40.0)._jdf.queryExecution().toString()
    got, dealt = shuffled(lambda: S.nearest_segment(points, S.around(segments, points, ["g"], 40.0), ["g"], 40.0).collect())
    assert len(got) == 20 and {r.path_id for r in got} == {0, n} and dealt < 200


def test_boxes_stay_where_they_are_when_zones_name_them(spark, shuffled):
    boxes = spark.createDataFrame([(i % 3, i, float(i), 0.0, i + 2.0, 1.0) for i in range(900)], "d int, path_id int, x0 double, y0 double, x1 double, y1 double")
    zones = spark.createDataFrame([(0, 1, "legend", 0.0, 0.0, 300.0, 9.0), (0, 0, "plan", 0.0, 0.0, 100.0, 9.0), (1, 0, "plan", 500.0, 0.0, 900.0, 9.0)], "d int, ordinal int, kind string, zx0 double, zy0 double, zx1 double, zy1 double")
    got, rows = shuffled(lambda: Z.classify_boxes(boxes, zones, ["d"]).collect())
    inside = lambda i, lo, hi: min(i + 2, hi) - max(i, lo) >= 1.2
    want = lambda i: "plan" if (i % 3 == 0 and inside(i, 0, 100)) or (i % 3 == 1 and inside(i, 500, 900)) else "legend" if i % 3 == 0 and inside(i, 0, 300) else "frame"
    assert {r.path_id: r.zone for r in got} == {i: want(i) for i in range(900)} and rows < 50


def test_points_of_connectivity_are_dealt_once(spark, shuffled):
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        x, y = rng.choice([(rng.uniform(0, 900), rng.uniform(0, 900)), (float(rng.randrange(90)), float(rng.randrange(90)))])
        rows.append((i % 3, i // 2, x, y, x + rng.choice([0.0, 3.0, 40.0]), y + rng.choice([0.0, 2.0])))
    frame = spark.createDataFrame(rows, "d int, path_id long, ax double, ay double, bx double, by_ double")
    got, n = shuffled(lambda: S.connectivity(frame, ["d"], 1.5).collect())
    ends = [(d, p, x, y) for d, p, ax, ay, bx, by in rows for x, y in ((ax, ay), (bx, by))]
    touching = {(d, p) for d, p, x, y in ends if any(d == e and p != q and ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= 1.5 for e, q, u, v in ends)}
    assert {r.d: r.n_touching for r in got} == {d: sum(t[0] == d for t in touching) for d in (0, 1, 2)}
    assert n < 6 * len(rows)  # two ends a segment, in about 1.4 cells each; it was over 10


def test_paths_with_their_segments_are_not_dealt(spark, shuffled):
    rng = random.Random(7)
    rows, flat = [], []
    for i in range(2000):
        x, y, s = float(rng.randrange(900)), float(rng.randrange(900)), float(rng.randrange(4))
        lines = [(1, x, y, x + s, y), (2, x + s, y, x + s, y + 5), (3, x + s, y + 5, x, y + 5), (4, x, y + 5, x, y)][: 4 if i % 2 else 1 + i % 3]
        rows.append((i % 2, i, "L" + str(i % 3), "s", (0.0, 0.0, 0.25 * (i % 4)), (0.5, 0.5, 0.5), 0.25 * (1 + i % 4), "solid", False, lines))
        flat.extend((i % 2, i, *line) for line in lines)
    colour, seg = "struct<r:double,g:double,b:double>", "seg_no int, ax double, ay double, bx double, by_ double"
    nested = f"array<struct<{', '.join(c.replace(' ', ':') for c in seg.split(', '))}>>"
    paths = Z.measured_paths(spark.createDataFrame(rows, f"drawing_id int, path_id long, layer string, kind string, stroke {colour}, fill {colour}, width double, dash_signature string, closed boolean, segments {nested}"))
    segments = spark.createDataFrame(flat, f"drawing_id int, path_id long, {seg}")
    keys, sides = ["drawing_id"], ("x0", "y0", "x1", "y1")
    assert sorted(map(tuple, paths.select(*keys, "path_id", *sides).collect())) == sorted(map(tuple, Z.path_boxes(segments, keys).select(*keys, "path_id", *sides).collect()))
    assert sorted(map(tuple, paths.select(*keys, "path_id", "rectangular").collect())) == sorted(map(tuple, Z.rectangular(segments, keys).collect()))
    lengths = segments.groupBy(*keys, "path_id").agg(F.sum(G.distance("ax", "ay", "bx", "by_")).alias("len"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    got, n = shuffled(lambda: ST.style_index(paths, None, keys)[0].collect())
    assert sorted(map(tuple, got)) == sorted(map(tuple, ST.style_index(paths.drop("len"), lengths, keys)[0].collect()))
    assert n < len(rows) / 2  # only styles, colours and widths are dealt; every path was, several times
