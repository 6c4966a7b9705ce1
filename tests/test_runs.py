"""Runs shown once or not at all, incremental measurement, drawings that arrive in parts; leaders and drawing operations."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators.flatten import flatten_ops
from plumbline.operators.leaders import leaders, numbered
from plumbline.plans import incremental as I
from plumbline.sources import commits as C
from plumbline.sources import tables as S
from plumbline.streaming.drawings import measure_stream
from plumbline.streaming.gathering import gathered


def test_a_run_shows_once_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    q = spark.createDataFrame([(1, 2.0), (2, 3.0)], "drawing_id long, length_m double")
    broken = q.withColumn("length_m", F.when(F.col("drawing_id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("length_m")).cast("double"))
    assert C.read_runs(spark, root, "quantities", "drawing_id long, length_m double").count() == 0
    with pytest.raises(Exception, match="lost"):  # fails between two tables
        C.commit_run(spark, root, "r1", {"quantities": q, "strands": broken})
    read = lambda: sorted((r.run_id, r.drawing_id) for r in C.read_runs(spark, root, "quantities", "drawing_id long, length_m double").collect())
    assert read() == [] and not C.committed(spark, root, "r1")
    assert C.commit_run(spark, root, "r1", {"quantities": q, "strands": q})
    assert not C.commit_run(spark, root, "r1", {"quantities": q, "strands": q})
    assert C.commit_run(spark, root, "r2", {"quantities": q.limit(1)})
    assert read() == [("r1", 1), ("r1", 2), ("r2", 1)]
    assert C.read_runs(spark, root, "strands", "drawing_id long, length_m double").count() == 2
    with pytest.raises(ValueError, match="file name"):
        C.commit_run(spark, root, "a/b", {"quantities": q})


def test_only_changed_drawings_are_measured(spark, tmp_path):
    root, seen = f"file://{tmp_path}/db", []

    def run(inputs):
        seen.append(sorted(r[0] for r in inputs["segments"].select("drawing_id").distinct().collect()))
        return {"quantities": inputs["segments"].groupBy("drawing_id").agg(F.sum("len").alias("length"))}

    def inputs(lengths, rules=("a",)):
        rows = [(d, k, float(n)) for d, some in lengths.items() for k, n in enumerate(some)]
        random.shuffle(rows)
        return {"segments": spark.createDataFrame(rows, "drawing_id long, seg_no int, len double").repartition(3), "pages": spark.createDataFrame([(d, 10.0) for d in lengths], "drawing_id long, width double"), "rules": spark.createDataFrame([(r,) for r in rules], "tokens string")}

    now = lambda: sorted((r.drawing_id, r.length) for r in I.current(spark, root, "quantities", "drawing_id long, length double").collect())
    assert I.measure_changed(spark, root, "r1", inputs({1: [1, 2], 2: [3, 3], 3: [4]}), run)
    assert not I.measure_changed(spark, root, "r1", inputs({1: [9]}), run)
    assert I.measure_changed(spark, root, "r2", inputs({1: [1, 2], 2: [3, 5], 3: [4], 4: [7]}), run)
    assert seen == [[1, 2, 3], [2, 4]]
    assert now() == [(1, 3.0), (2, 8.0), (3, 4.0), (4, 7.0)]
    assert I.measure_changed(spark, root, "r3", inputs({1: [1, 2], 2: [3, 5], 3: [4], 4: [7]}), run) and seen[-1] == []
    assert I.measure_changed(spark, root, "r4", inputs({1: [1, 2], 2: [3, 5, 5], 3: [4], 4: [7]}, ("b",)), run) and seen[-1] == [1, 2, 3, 4]
    assert now() == [(1, 3.0), (2, 13.0), (3, 4.0), (4, 7.0)]


def test_a_drawing_in_three_batches(spark, tmp_path):
    root = f"file://{tmp_path}"
    schema = S.SCHEMAS["paths"] + ", n_paths INT"

    def send(number, rows):
        made = [f"SELECT '{d}' AS drawing_id, {p}L AS path_id, {n} AS n_paths, 0.5D AS width, array(named_struct('ax', 0D, 'ay', 0D, 'bx', {x}D, 'by_', 0D)) AS segments" for d, p, n, x in rows]
        df = spark.sql(" UNION ALL ".join(made))
        whole = df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema).schema))
        whole.coalesce(1).write.mode("append").parquet(f"{root}/paths")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/paths")
        measured = measure_stream(gathered(stream), lambda s: s.groupBy("drawing_id").agg(F.sum(F.col("bx") - F.col("ax")).alias("length"), F.count("*").alias("n")), f"{root}/out", f"{root}/state")
        measured.awaitTermination(120)
        assert measured.exception() is None
        return sorted((r.drawing_id, r.length, r.n) for r in spark.read.schema("drawing_id string, length double, n long").parquet(f"{root}/out").collect())

    assert send(1, [("A", 1, 4, 1), ("B", 1, 1, 9)]) == [("B", 9.0, 1)]
    assert send(2, [("A", 2, "NULL", 2), ("A", 1, 4, 5)]) == [("B", 9.0, 1)]
    assert send(3, [("A", 3, 4, 3), ("A", 4, 4, 4), ("B", 1, 1, 9)]) == [("A", 14.0, 4), ("B", 9.0, 1)]


def one_by_one(points, reach):
    out, lead = {}, []
    for k, x in enumerate(points):
        first = next((j for j in lead if abs(points[j] - x) < reach), None)
        if first is None:
            lead.append(k)
        out[k] = k if first is None else first
    return out


@pytest.mark.parametrize("shape", ["random", "rising", "equal", "none"])
def test_leaders_equal_the_fold(spark, shape):
    rng = random.Random(3)
    points = {"random": [rng.uniform(0, 60) for _ in range(300)], "rising": [k * 0.6 for k in range(40)], "equal": [1.0] * 50, "none": []}[shape]
    items = spark.createDataFrame([(d, k) for d in (1, 2) for k in range(len(points))], "d int, item long")
    near = spark.createDataFrame([(d, k, j) for d in (1, 2) for k, x in enumerate(points) for j in range(k) if abs(points[j] - x) < 1.0], "d int, item long, earlier long")
    led = leaders(items, near, ["d"])
    want = one_by_one(points, 1.0)
    assert {(r.d, r.item): r.leader for r in led.collect()} == {(d, k): v for d in (1, 2) for k, v in want.items()}
    order = {k: i for i, k in enumerate(sorted(set(want.values())))}
    assert {(r.d, r.item): r.number for r in numbered(led, ["d"]).collect()} == {(d, k): order[v] for d in (1, 2) for k, v in want.items()}


def test_drawing_operations(spark):
    rows = [
        (1, 1, "l", [(0.0, 0.0), (3.0, 4.0)], None), (1, 2, "c", [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)], False), (2, 1, "re", [(5.0, 7.0), (1.0, 2.0)], None),
        (3, 1, "qu", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], None), (4, 1, "l", [(0.0, 0.0)], True), (4, 2, "l", [(0.0, 0.0), (1.0, 0.0)], True), (5, 1, "zz", [(0.0, 0.0)], None), (6, 1, None, None, None),
    ]
    ops = spark.createDataFrame(rows, "path_id int, op_no int, kind string, points array<struct<x:double,y:double>>, closes boolean").withColumn("m", G.page_matrix(F.lit(0), F.lit(3000.0), F.lit(4000.0), F.lit(None).cast("double")))
    got = flatten_ops(ops, []).orderBy("path_id", "seg_no").collect()
    by = {p: [r for r in got if r.path_id == p] for p in range(1, 7)}
    assert [tuple(r)[2:6] for r in by[1]][0] == (0.0, 0.0, 3.0, 4.0)
    # the control polygon is 30 long and 5000 * 5e-4 is 2.5: twelve chords
    assert len(by[1]) == 13 and [r.seg_no for r in by[1]] == list(range(1, 14)) and not any(r.closed for r in by[1])
    assert by[1][7].ax == pytest.approx(5.0) and by[1][7].ay == pytest.approx(7.5)
    assert [tuple(r)[2:6] for r in by[2]] == [(1.0, 2.0, 5.0, 2.0), (5.0, 2.0, 5.0, 7.0), (5.0, 7.0, 1.0, 7.0), (1.0, 7.0, 1.0, 2.0)] and all(r.closed for r in by[2])
    assert len(by[3]) == 4 and all(r.closed for r in by[3]) and [(r.seg_no, r.closed) for r in by[4]] == [(1, True)] and not by[5] and not by[6]
