"""Record tables in and out: runs, quantities, ground truth, evaluations, profiles, delivered tables.

Every table is Parquet (profiles are JSON) below one root that all executors reach.
"""

from __future__ import annotations

import subprocess
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

_BOX = "STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"
_POINTS = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"

#: Schemas of the record tables.
SCHEMAS = {
    "sheets": f"drawing_id STRING, source STRING, page_number INT, width DOUBLE, height DOUBLE, rotate INT, user_unit DOUBLE, cropbox {_BOX}, mediabox {_BOX}",
    "paths": f"drawing_id STRING, path_id BIGINT, seqno INT, layer STRING, kind STRING, width DOUBLE, dashes STRING, closed BOOLEAN, bbox {_BOX}, segments ARRAY<STRUCT<ax: DOUBLE, ay: DOUBLE, bx: DOUBLE, by_: DOUBLE>>",
    "texts": f"drawing_id STRING, text_id BIGINT, text STRING, bbox {_BOX}, block INT, line INT, word INT",
    "markup": f"drawing_id STRING, kind STRING, label STRING, vertices {_POINTS}",
    "ground_truth": "drawing STRING, label STRING, system STRING, material STRING, dimension STRING, length_m DOUBLE, vertical_count DOUBLE, layer STRING, is_vertical BOOLEAN",
    "runs": "run_id STRING, drawing STRING, source STRING, started_at STRING, git_sha STRING, track STRING, scale_value DOUBLE, scale_verified BOOLEAN",
    "quantities": "run_id STRING, label STRING, system STRING, dimension STRING, length_m DOUBLE, verticals BIGINT, bends BIGINT, tees BIGINT, status STRING, flags STRING",
    "blocked_paths": "run_id STRING, path_id BIGINT, cluster_id STRING, reason STRING, step STRING",
    "strands": f"run_id STRING, strand_id BIGINT, cluster_id STRING, length_pt DOUBLE, length_m DOUBLE, label STRING, label_source STRING, points {_POINTS}",
    "eval_results": "run_id STRING, drawing STRING, created_at STRING, git_sha STRING, metrics_json STRING",
}
#: A profile: what a project's calibrated drawing taught.
PROFILE = "project_key STRING, layer_rule STRUCT<tokens: ARRAY<STRING>, valid: BOOLEAN, reason: STRING, calibrated_on: STRING>, scale_reference STRUCT<pitch_pt: DOUBLE, divisions: INT, span_mm: DOUBLE, calibrated_on: STRING>"
#: Colours of an overlay, in turn (fixed values).
PALETTE = ("#e6194b", "#3cb44b", "#4363d8", "#f58231", "#911eb4", "#008080", "#9a6324", "#808000")


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def git_sha() -> str:
    """The short commit of the working folder, or ``unknown``."""
    try:
        return subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=True, timeout=5).stdout.strip() or "unknown"
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def fitted(df: DataFrame, name: str) -> DataFrame:
    """The columns of a record table, in order; those that are missing are null, others go."""
    schema = T.StructType.fromDDL(SCHEMAS[name])
    have = set(df.columns)
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def segments_of(paths: DataFrame) -> DataFrame:
    """One row for each segment of ``paths``: (drawing_id, path_id, seg_no, layer, width, dash_signature, ax, ay, bx, by_)."""
    signature = X.dash_signature(F.col("dashes")).alias("dash_signature")
    return paths.select("drawing_id", "path_id", "layer", "width", signature, F.posexplode("segments").alias("seg_no", "s")).select("drawing_id", "path_id", (F.col("seg_no") + 1).alias("seg_no"), "layer", "width", "dash_signature", "s.*")


def append(df: DataFrame, root: str, name: str) -> None:
    """Add rows to a record table."""
    fitted(df, name).write.mode("append").parquet(f"{root}/{name}")


def replace_ground_truth(df: DataFrame, root: str) -> None:
    """Write ground truth so that a drawing's earlier rows go: importing twice changes nothing."""
    fitted(df, "ground_truth").repartition("drawing").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("drawing").parquet(f"{root}/ground_truth")


def read_ground_truth_sheet(spark: SparkSession, path: str, drawing: str) -> DataFrame:
    """Ground truth from a CSV sheet; columns are found by their headings (see functions.text.HEADINGS).

    Rows without a label go. A label that ends in ``Vertikal`` counts vertical pipes. An error without a label column.
    """
    raw = spark.read.option("header", True).csv(path)
    headings = spark.createDataFrame([(i, c) for i, c in enumerate(raw.columns)], "i int, heading string")
    field = {r["field"]: raw.columns[r["i"]] for r in sorted(headings.select("i", X.heading_field(F.col("heading")).alias("field")).collect(), key=lambda r: -r["i"]) if r["field"]}
    if "label" not in field:
        raise ValueError(f"no label column among {raw.columns}")
    get = lambda name: F.col(f"`{field[name]}`") if name in field else F.lit(None).cast("string")
    label = F.trim(get("label"))
    bare = F.trim(F.regexp_replace(label, r"(?i)[\s_-]*vertikal$", ""))
    system, material, dimension = X.parse_label(bare)
    rows = raw.select(F.lit(drawing).alias("drawing"), bare.alias("label"), system.alias("system"), material.alias("material"), dimension.alias("dimension"), X.locale_number(get("length")).alias("length_m"), X.locale_number(get("count")).alias("vertical_count"), get("layer").alias("layer"), label.rlike(r"(?i)vertikal$").alias("is_vertical"), label.alias("__raw"))
    return rows.filter(F.coalesce(F.col("__raw"), F.lit("")) != "").drop("__raw")


def markup_lengths(markup: DataFrame) -> DataFrame:
    """Lines of marked-up drawings with their length and whether they mark a vertical pipe."""
    from ..functions.geometry import polyline_length

    vertical = (F.col("kind") == "Polygon") | F.coalesce(F.col("label").rlike(r"(?i)vertikal$"), F.lit(False))
    return markup.filter(F.col("kind").isin("PolyLine", "Polygon")).withColumns({"is_vertical": vertical, "length_pt": polyline_length(F.col("vertices"))})


def save_evaluation(metrics: DataFrame, root: str, run_id: str | None, drawing: str) -> None:
    """Append a row of metrics (one row) as JSON, with time and commit."""
    row = metrics.select(F.lit(run_id).alias("run_id"), F.lit(drawing).alias("drawing"), F.lit(now()).alias("created_at"), F.lit(git_sha()).alias("git_sha"), F.to_json(F.struct("*")).alias("metrics_json"))
    append(row, root, "eval_results")


def save_profiles(profiles: DataFrame, root: str) -> None:
    """Write the profiles that have a key and a valid layer rule, one folder for each key."""
    good = profiles.filter(F.col("project_key").isNotNull() & F.col("layer_rule.valid"))
    good.withColumn("slug", X.slug(F.col("project_key"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").json(f"{root}/profiles")


def load_profile(spark: SparkSession, root: str, project_key: str | None) -> DataFrame:
    """The profile of a project, no row where there is none."""
    found = spark.read.schema(PROFILE + ", slug STRING").json(f"{root}/profiles")
    return found.filter(F.col("slug") == X.slug(F.lit(project_key))).drop("slug")


def export_tables(quantities: DataFrame, strands: DataFrame, blocked: DataFrame) -> dict[str, DataFrame]:
    """The three delivered tables: summary (longest first), one row for each pipe, and deviations (blocked paths by reason, then flags)."""
    flags = quantities.select(F.explode(F.split("flags", ",")).alias("what")).filter("what <> ''").groupBy("what").count().withColumn("kind", F.lit("flag"))
    reasons = blocked.groupBy(F.col("reason").alias("what")).count().withColumn("kind", F.lit("blocked"))
    return {
        "summary": quantities.orderBy(F.desc("length_m")),
        "per_pipe": strands.orderBy(F.desc("length_m")),
        "deviations": reasons.unionByName(flags).select("kind", "what", "count").orderBy("kind", F.desc("count"), "what"),
    }


def overlay_geometry(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with the colour of their cluster: eight colours in turn, by the clusters' length."""
    from ..functions.geometry import distance

    length = segments.groupBy("drawing_id", *keys).agg(F.sum(distance("ax", "ay", "bx", "by_")).alias("len"))
    turn = F.row_number().over(W.partitionBy("drawing_id").orderBy(F.desc("len"), *keys))
    colours = F.array(*(F.lit(c) for c in PALETTE))
    named = length.select("drawing_id", *keys, F.get(colours, (turn - 1) % len(PALETTE)).alias("colour"))
    return segments.join(named, ["drawing_id", *keys])
