"""Record tables: written, replaced, read again; the whole measurement and the stream."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.sources import tables as S
from plumbline.streaming.drawings import measure_stream, stream_paths


def test_ground_truth_import_is_idempotent(spark, tmp_path):
    sheet = tmp_path / "truth.csv"
    sheet.write_text("Subject,Längd,Antal_VS,Lager\nS1-R8-110,\"1 234,5\",,x\nS1-R8-110 Vertikal,,3,x\n,9,9,y\n", encoding="utf-8")
    root = f"file://{tmp_path}/db"
    rows = S.read_ground_truth_sheet(spark, f"file://{sheet}", "D1")
    other = S.read_ground_truth_sheet(spark, f"file://{sheet}", "D2")
    S.replace_ground_truth(other, root)
    for _ in range(2):
        S.replace_ground_truth(rows, root)
    got = spark.read.parquet(f"{root}/ground_truth")
    assert got.groupBy("drawing").count().orderBy("drawing").collect() == [("D1", 2), ("D2", 2)]
    first = got.filter("drawing = 'D1' AND NOT is_vertical").first()
    assert (first.label, first.system, first.dimension, first.length_m, first.vertical_count) == ("S1-R8-110", "S1", "110", 1234.5, None)
    sheet.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no label column"):
        S.read_ground_truth_sheet(spark, f"file://{sheet}", "D1")


def test_runs_profiles_and_exports(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    q = spark.createDataFrame([("a", 2.0, "masked_length"), ("b", 5.0, "")], "label string, length_m double, flags string")
    for _ in range(2):
        S.append(q.withColumn("run_id", F.lit("r1")), root, "quantities")
    assert S.read(spark, root, "quantities").count() == 4
    S.save_evaluation(spark.createDataFrame([(1.5,)], "mape double"), root, None, "D1")
    assert S.read(spark, root, "eval_results").first().metrics_json == '{"mape":1.5}'
    profiles = spark.sql("SELECT 'p/1' AS project_key, named_struct('tokens', array('-FE-'), 'valid', true, 'reason', '', 'calibrated_on', 'D1') AS layer_rule UNION ALL SELECT 'p2', named_struct('tokens', array('x'), 'valid', false, 'reason', 'leak', 'calibrated_on', 'D1')")
    S.save_profiles(profiles, root)
    assert S.load_profile(spark, root, "p/1").first().layer_rule.tokens == ["-FE-"]
    assert S.load_profile(spark, root, "p2").count() == 0 and S.load_profile(spark, root, None).count() == 0
    blocked = spark.createDataFrame([("frame",), ("frame",), ("hatch",)], "reason string")
    out = S.export_tables(q, q, blocked)
    assert [r.label for r in out["summary"].collect()] == ["b", "a"]
    assert [tuple(r) for r in out["deviations"].collect()] == [("blocked", "frame", 2), ("blocked", "hatch", 1), ("flag", "masked_length", 1)]


def test_stream_of_drawings(spark, tmp_path):
    root = f"file://{tmp_path}"
    one = spark.sql("SELECT 'D1' AS drawing_id, 1L AS path_id, 'x' AS layer, 0.5D AS width, '[3 1] 0' AS dashes, array(named_struct('ax', 0D, 'ay', 0D, 'bx', 3D, 'by_', 4D)) AS segments")
    S.append(one, root, "paths")
    query = measure_stream(stream_paths(spark, root), lambda s: s.groupBy("drawing_id").agg(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"))).alias("length")), f"{root}/out", f"{root}/state")
    query.awaitTermination(60)
    assert [tuple(r)[:2] for r in spark.read.parquet(f"{root}/out").select("drawing_id", "length").collect()] == [("D1", 5.0)]


def test_overlay_colours(spark):
    seg = spark.createDataFrame([(1, f"l{i}", 0.0, 0.0, float(i), 0.0) for i in range(1, 11)], "drawing_id int, layer string, ax double, ay double, bx double, by_ double")
    got = {r.layer: r.colour for r in S.overlay_geometry(seg, ["layer"]).collect()}
    assert got["l10"] == S.PALETTE[0] and got["l2"] == S.PALETTE[0] and got["l3"] == S.PALETTE[7]
