"""Drawing tables derived from the order tables: paths, segments and labels.

The scan contract of the engine is a set of Parquet tables (``paths``,
``segments``, ``texts`` ...). Where no drawings are at hand, this adapter derives
them: an order is a path, a line item is a segment of it. Coordinates are whole
numbers, so lengths of axis-parallel segments are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_id, seg_no, ax, ay, bx, by_): horizontal, vertical or diagonal by return flag, as long as the quantity.

    The rows are dealt by the name ``path_id``: under another name, every later join or window on it would deal them again.
    """
    li = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "path_id")
    order = W.partitionBy("path_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    ax = F.col("l_partkey").cast("double")
    ay = ((F.col("l_suppkey") * 17 + F.col("path_id") * 29) % 1684).cast("double")
    step = lambda flags: F.when(F.col("l_returnflag").isin(*flags), F.col("l_quantity")).otherwise(F.lit(0.0))
    return li.select(
        "path_id",
        F.row_number().over(order).alias("seg_no"),
        ax.alias("ax"),
        ay.alias("ay"),
        (ax + step("AR")).alias("bx"),
        (ay + step("NR")).alias("by_"),
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_id, layer, width, dash_signature): layers spell project, discipline, system and status."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    level = F.substring("o_orderpriority", 1, 1)
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("path_id"),
        F.concat(F.lit("268-"), "o_orderstatus", F.lit("|V-"), level, F.when(F.col("o_custkey") % 3 == 0, "-FE--").otherwise("--T--"), "c_mktsegment", F.lit("-")).alias("layer"),
        (level.cast("double") * 0.25).alias("width"),
        F.when(F.col("o_orderkey") % 7 == 0, "n2:0.75/0.25").otherwise("solid").alias("dash_signature"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label): SYSTEM-TYPE[-DIMENSION]; every third size has no dimension."""
    size = F.col("p_size")
    return (
        read(spark, sf_dir, "part")
        .select(F.concat(F.lit("S"), (size % 5).cast("string"), F.lit("-R"), (size % 9).cast("string"), F.when(size % 3 == 0, "").otherwise(F.concat(F.lit("-"), size.cast("string")))).alias("label"))
        .distinct()
    )


#: The same tables as SQL that Spark and DuckDB both run.
SEGMENTS_SQL = """SELECT l_orderkey AS path_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS seg_no,
       CAST(l_partkey AS double) AS ax,
       CAST((l_suppkey*17 + l_orderkey*29) % 1684 AS double) AS ay,
       CAST(l_partkey AS double) + CASE WHEN l_returnflag IN ('A','R') THEN l_quantity ELSE CAST(0 AS double) END AS bx,
       CAST((l_suppkey*17 + l_orderkey*29) % 1684 AS double) + CASE WHEN l_returnflag IN ('N','R') THEN l_quantity ELSE CAST(0 AS double) END AS by_
FROM lineitem"""
PATHS_SQL = """SELECT o_orderkey AS path_id,
       concat('268-', o_orderstatus, '|V-', substr(o_orderpriority,1,1), CASE WHEN o_custkey % 3 = 0 THEN '-FE--' ELSE '--T--' END, c_mktsegment, '-') AS layer,
       CAST(substr(o_orderpriority,1,1) AS double) * CAST(0.25 AS double) AS width,
       CASE WHEN o_orderkey % 7 = 0 THEN 'n2:0.75/0.25' ELSE 'solid' END AS dash_signature
FROM orders JOIN customer ON o_custkey = c_custkey"""
LABELS_SQL = """SELECT DISTINCT concat('S', CAST(p_size % 5 AS string), '-R', CAST(p_size % 9 AS string),
       CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('-', CAST(p_size AS string)) END) AS label
FROM part"""
#: Sheets that the queries spread the paths over.
DRAWINGS = 50


def rows(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """A table seen through column expressions that Spark and DuckDB both read."""
    return read(spark, sf_dir, name).selectExpr(*columns)


def rows_sql(name: str, columns: list[str]) -> str:
    return f"SELECT {', '.join(columns)} FROM {name}"


def drawn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with the drawing and the layer of their path; a drawing is a path's number modulo DRAWINGS."""
    return segments(spark, sf_dir).join(paths(spark, sf_dir), "path_id").withColumn("drawing_id", F.col("path_id") % DRAWINGS)


WITH_SQL = f"WITH segments AS ({SEGMENTS_SQL}),\npaths AS ({PATHS_SQL})"
DRAWN_SQL = f"{WITH_SQL},\ndrawn AS (SELECT s.*, p.layer, p.width, p.dash_signature, s.path_id % {DRAWINGS} AS drawing_id FROM segments s JOIN paths p USING (path_id))"
