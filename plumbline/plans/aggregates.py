"""Queries: aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import delivery as D
from ..operators import layers as L
from ..operators import ordered as O
from ..operators import spatial
from ..operators import styles as S
from ..sources import adapter as A
from ..sources.shared import cut
from .oracles import COLOUR_SQL
from .joins import CONNECTIVITY_SQL, WALL_SQL
from .ordered import _TURNS as TURNS_SQL
from .registry import query


@query(
    f"""{A.WITH_SQL},
lens AS (SELECT path_id, sum(sqrt((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay))) AS len FROM segments GROUP BY path_id),
g AS (SELECT path_id % 50 AS drawing_id, layer, width, dash_signature, count(*) AS n_paths, sum(len) AS s, max(len) AS m, min(path_id) AS first_path
      FROM paths JOIN lens USING (path_id) GROUP BY ALL)
SELECT drawing_id, layer, width, dash_signature, n_paths, round(s, 4) AS total_len, round(m, 4) AS max_len, round(s / sum(s) OVER (PARTITION BY drawing_id), 6) AS share,
       row_number() OVER (PARTITION BY drawing_id ORDER BY round(s, 4) DESC, first_path) - 1 AS cluster_no FROM g"""
)
def style_cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group every drawing's paths by style; number its clusters by total length."""
    lens = A.segments(spark, sf_dir).groupBy("path_id").agg(F.sum(G.distance("ax", "ay", "bx", "by_")).alias("len"))
    paths = A.paths(spark, sf_dir).withColumn("drawing_id", F.col("path_id") % A.DRAWINGS)
    g = paths.join(lens, "path_id").groupBy("drawing_id", "layer", "width", "dash_signature").agg(F.count("*").alias("n_paths"), F.sum("len").alias("s"), F.max("len").alias("m"), F.min("path_id").alias("first_path"))
    sheet = W.partitionBy("drawing_id")
    return g.select(
        "drawing_id",
        "layer",
        "width",
        "dash_signature",
        "n_paths",
        F.round("s", 4).alias("total_len"),
        F.round("m", 4).alias("max_len"),
        F.round(F.col("s") / F.sum("s").over(sheet), 6).alias("share"),
        (F.row_number().over(sheet.orderBy(F.round("s", 4).desc(), "first_path")) - 1).alias("cluster_no"),
    )


KEYS = ["drawing_id", "layer"]
_LEN = "sqrt((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay))"
_PATHS = f"""pl AS (SELECT drawing_id, layer, path_id, sum({_LEN}) AS len, min(least(ax,bx)) AS x0, min(least(ay,by_)) AS y0, max(greatest(ax,bx)) AS x1, max(greatest(ay,by_)) AS y1, any_value(width) AS width FROM drawn GROUP BY ALL)"""
_STATS = f"""{_PATHS}, r AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, layer ORDER BY len) - 1 AS i, count(*) OVER (PARTITION BY drawing_id, layer) AS n FROM pl),
st AS (SELECT drawing_id, layer, count(*) AS n_paths, sum(len) AS total, max(len) FILTER (WHERE i = least(n-1, floor(n*0.5::DOUBLE))) AS p50, max(len) FILTER (WHERE i = least(n-1, floor(n*0.9::DOUBLE))) AS p90, (max(x1)-min(x0))*(max(y1)-min(y0)) / 4000000.0::DOUBLE AS spread, max(width) AS width FROM r GROUP BY ALL)"""
_HIST = f"""hb AS (SELECT layer, drawing_id, least(11, floor((CASE WHEN atan2(by_-ay, bx-ax) < 0 THEN atan2(by_-ay, bx-ax) + pi() WHEN atan2(by_-ay, bx-ax) >= pi() THEN 0 ELSE atan2(by_-ay, bx-ax) END) / (pi()/12)))::INT AS b, {_LEN} AS len FROM drawn WHERE {_LEN} > 0)"""


@query(f"{A.DRAWN_SQL}, {_HIST}, g AS (SELECT layer, b, sum(len) AS s FROM hb GROUP BY ALL)\nSELECT layer, printf('%03d', b * 15) AS bin, round(s / sum(s) OVER (PARTITION BY layer), 6) AS share FROM g")
def angle_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of every layer's segments."""
    return S.angle_histogram(A.drawn_segments(spark, sf_dir), ["layer"]).withColumn("share", F.round("share", 6))


@query(f"{A.DRAWN_SQL}, {_STATS}\nSELECT drawing_id, layer, n_paths, round(total, 4) AS total, round(p50, 4) AS p50, round(p90, 4) AS p90, round(spread * 4000000, 1) AS box FROM st")
def pos_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, lengths (positional p50, p90) and spread of every drawing's layers."""
    stats = S.cluster_stats(A.drawn_segments(spark, sf_dir), KEYS, 4_000_000.0)
    return stats.select(*KEYS, "n_paths", F.round("total", 4).alias("total"), F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"), F.round("box", 1).alias("box"))


@query(f"{A.WITH_SQL}\nSELECT path_id % 50 AS drawing_id, coalesce(quantile_cont(width, 0.5) FILTER (WHERE width > 0), 0) AS median_width, CASE WHEN coalesce(quantile_cont(width, 0.5) FILTER (WHERE width > 0), 0) > 0 THEN quantile_cont(width, 0.5) FILTER (WHERE width > 0) ELSE 2616 * 1e-4::DOUBLE END AS epsilon FROM paths GROUP BY 1")
def median_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median line width of every drawing, and the length that counts as nothing."""
    median = F.coalesce(F.percentile(F.when(F.col("width") > 0, F.col("width")), 0.5), F.lit(0.0))
    g = A.paths(spark, sf_dir).groupBy((F.col("path_id") % A.DRAWINGS).alias("drawing_id")).agg(median.alias("median_width"))
    return g.withColumn("epsilon", F.when(F.col("median_width") > 0, F.col("median_width")).otherwise(2616 * 1e-4))


_AT = "round(max(width) FILTER (WHERE i = least(n - 1, floor(n * {p}::DOUBLE))), 3) AS {name}"


@query(f"{A.WITH_SQL}, w AS (SELECT path_id % 50 AS drawing_id, width, row_number() OVER (PARTITION BY path_id % 50 ORDER BY width) - 1 AS i, count(*) OVER (PARTITION BY path_id % 50) AS n FROM paths WHERE width > 0)\nSELECT drawing_id, {', '.join(_AT.format(p=p, name=name) for name, p in S.WIDTH_SHARES.items())} FROM w GROUP BY drawing_id")
def width_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line widths of every drawing by percentile."""
    return S.width_percentiles(A.paths(spark, sf_dir).withColumn("drawing_id", F.col("path_id") % A.DRAWINGS), ["drawing_id"])


WIDTHS = ["p_size % 20 AS group_id", "CAST(p_partkey * 31 % 400 AS double) / CAST(100 AS double) AS width"]


@query(
    f"""WITH RECURSIVE w AS (SELECT DISTINCT group_id, round(width, 4) AS width FROM ({A.rows_sql("part", WIDTHS)}) WHERE width > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY width) AS i FROM w),
f AS (SELECT group_id, i, width AS rep, true AS is_new FROM o WHERE i = 1 UNION ALL
  SELECT o.group_id, o.i, CASE WHEN (o.width - f.rep) / f.rep > 0.05::DOUBLE THEN o.width ELSE f.rep END, (o.width - f.rep) / f.rep > 0.05::DOUBLE FROM f JOIN o ON o.group_id = f.group_id AND o.i = f.i + 1)
SELECT group_id, rep FROM f WHERE is_new"""
)
def width_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representative line widths of every group."""
    return S.width_buckets(A.rows(spark, sf_dir, "part", WIDTHS), ["group_id"]).select("group_id", F.explode("representatives").alias("rep"))


@query(COLOUR_SQL)
def colour_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy colour clusters of every group of parts."""
    from .scalars import COLOURS

    colours = A.rows(spark, sf_dir, "part", [*COLOURS, "p_partkey % 16 AS drawing_id"]).withColumn("ordinal", F.col("colour_id"))
    return S.colour_representatives(colours, ["drawing_id"])


_PREFIX = "x AS (SELECT path_id % 50 AS drawing_id, layer, string_split(layer, '|')[1] AS prefix FROM paths WHERE layer LIKE '%|%')"


@query(f"{A.WITH_SQL}, {_PREFIX}, d AS (SELECT DISTINCT drawing_id, layer, prefix FROM x),\ng AS (SELECT drawing_id, prefix, count(*) AS n, min(layer) AS first FROM d GROUP BY ALL),\nb AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY n DESC, first) = 1)\nSELECT drawing_id, CASE WHEN n >= 2 THEN coalesce(nullif(trim(string_split(prefix, '-')[1]), ''), prefix) END AS project_key, n FROM b")
def project_key_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project every drawing belongs to: the leading field of its layers' most frequent prefix (two layers at least)."""
    return L.project_keys(A.paths(spark, sf_dir).withColumn("drawing_id", F.col("path_id") % A.DRAWINGS), ["drawing_id"])


@query(
    f"""{A.DRAWN_SQL}, {CONNECTIVITY_SQL}, {WALL_SQL}, {_STATS}, {_HIST}, hs AS (SELECT drawing_id, layer, b, sum(len) AS s FROM hb GROUP BY ALL), hc AS (SELECT drawing_id, layer, max(s) / sum(s) AS conc FROM hs GROUP BY ALL),
ou AS (SELECT drawing_id, layer, sum(CASE WHEN NOT (x0 >= 200 AND x1 <= 1800) THEN greatest(len, 1e-9) ELSE 0 END) / sum(greatest(len, 1e-9)) AS outside FROM pl GROUP BY ALL),
lm AS (SELECT drawing_id, list_sort(list(p50))[least(count(*), floor(count(*) * 0.5::DOUBLE)::BIGINT + 1)] AS len_med, list_sort(list(width))[least(count(*), floor(count(*) * 0.5::DOUBLE)::BIGINT + 1)] AS w_med FROM st WHERE p50 > 0 GROUP BY drawing_id),
j AS (SELECT st.*, connectivity, conc, outside, len_med, w_med, CASE WHEN total <= 0 THEN 'degenerate' WHEN outside > 0.5 THEN 'frame' WHEN st.n_paths >= 30 AND p90 < len_med AND connectivity < 0.25::DOUBLE THEN 'text_or_glyph' WHEN conc > 0.8 AND st.n_paths >= 30 AND p50 < len_med THEN 'hatch' WHEN coalesce(wall.share, 0) > 0.5 THEN 'wall' END AS reason FROM st JOIN conn USING (drawing_id, layer) LEFT JOIN wall USING (drawing_id, layer) JOIN hc USING (drawing_id, layer) JOIN ou USING (drawing_id, layer) JOIN lm USING (drawing_id))
SELECT drawing_id, layer, coalesce(reason, CASE WHEN contains(concat('|', layer, '|'), '-FE-') AND width > w_med * 1.02::DOUBLE THEN 'pipe' WHEN NOT contains(concat('|', layer, '|'), '-FE-') THEN 'not_in_layer_rule' ELSE 'thin_for_service_layer' END) AS verdict, CASE WHEN reason IS NOT NULL THEN 'negative_filter' ELSE 'layer_rule' END AS step,
  round(CASE WHEN width > w_med THEN 0.40::DOUBLE ELSE 0 END + least(1, connectivity)::DOUBLE * 0.25 + least(1, p90 / 26.16) * 0.20 + least(1, spread / 0.2) * 0.15, 4) AS score FROM j"""
)
def negative_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every drawing's layers: the negative filters, the layer rule, and the structural score."""
    drawn = cut(A.drawn_segments(spark, sf_dir).drop("dash_signature"))  # four branches read it
    per_path = cut(S.path_lengths(drawn, KEYS))
    stats = cut(S.cluster_stats(drawn, KEYS, 4_000_000.0, per_path))
    top = S.angle_histogram(drawn, KEYS).groupBy(*KEYS).agg(F.max("share").alias("concentration"))
    weight = F.greatest("len", F.lit(1e-9))
    outside = per_path.groupBy(*KEYS).agg((F.sum(F.when((F.col("x0") >= 200) & (F.col("x1") <= 1800), 0.0).otherwise(weight)) / F.sum(weight)).alias("outside"))
    known = stats.filter("p50 > 0")
    medians = S.positional_values(known, ["drawing_id"], "p50", {"len_med": 0.5}).join(S.positional_values(known, ["drawing_id"], "width", {"w_med": 0.5}), "drawing_id")
    touching = spatial.connectivity(drawn, KEYS, 6.0).select(*KEYS, "connectivity")
    walls = spatial.paired_share(drawn, KEYS, 2.0, 15.0).select(*KEYS, F.col("share").alias("wall_share"))
    c = stats.join(top, KEYS).join(outside, KEYS).join(touching, KEYS).join(walls, KEYS, "left").fillna(0.0, ["wall_share"]).join(medians, "drawing_id")
    verdicts = S.classify(c.withColumn("reason", S.rejection(F.col("len_med"))), ["-FE-"], F.col("w_med"))
    return verdicts.select(*KEYS, "verdict", "step", F.round(S.structural_score(F.col("w_med"), 2616.0), 4).alias("score"))


@query(f"{A.WITH_SQL}, v AS (SELECT path_id, path_id % 50 AS drawing_id, CASE WHEN layer LIKE '%-FE-%' THEN 'pipe' ELSE 'not_in_layer_rule' END AS verdict FROM paths)\nSELECT drawing_id, count(*) AS total, count(*) FILTER (WHERE verdict = 'pipe') AS accepted, count(*) FILTER (WHERE verdict <> 'pipe') AS blocked, 1.0::DOUBLE AS coverage FROM v GROUP BY drawing_id")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and blocked paths make up all paths."""
    paths = A.paths(spark, sf_dir).withColumn("drawing_id", F.col("path_id") % A.DRAWINGS)
    pipe = T.layer_matches(F.col("layer"), ["-FE-"])
    return D.coverage(paths, paths.filter(pipe), paths.filter(~pipe), ["drawing_id"])


_STRANDS = f"""mh AS (SELECT * FROM drawn WHERE layer LIKE '%BUILDING%'), mk AS (SELECT drawing_id, ax, ay, bx, by_, n, k FROM (SELECT *, greatest(1, trunc({_LEN} / 25))::INT AS n FROM mh), unnest(range(0, 400)) AS u(k) WHERE k <= n),
mc AS (SELECT DISTINCT drawing_id, floor((ax + (bx-ax)*(k::DOUBLE/n)) / 25)::BIGINT AS cx, floor((ay + (by_-ay)*(k::DOUBLE/n)) / 25)::BIGINT AS cy FROM mk), {TURNS_SQL}, bc AS (SELECT path_id, count(*) FILTER (WHERE turn > 15 * pi() / 180) AS bends FROM t GROUP BY path_id),
ms AS (SELECT d.drawing_id, d.layer, d.path_id, {_LEN} AS len, mc.cx IS NOT NULL AS hit FROM drawn d LEFT JOIN mc ON d.drawing_id = mc.drawing_id AND mc.cx = floor((ax+bx)/2/25)::BIGINT AND mc.cy = floor((ay+by_)/2/25)::BIGINT),
sl AS (SELECT drawing_id, layer, path_id, sum(CASE WHEN hit THEN 0 ELSE len END) * 0.0176::DOUBLE AS length_m, sum(CASE WHEN hit THEN len ELSE 0 END) * 0.0176::DOUBLE AS masked_m, coalesce(any_value(bends), 0) AS bends FROM ms LEFT JOIN bc USING (path_id) GROUP BY drawing_id, layer, path_id)"""
_QUANT = f"{_STRANDS}, q AS (SELECT drawing_id, layer, sum(length_m) AS length_m, sum(masked_m) AS masked_m, count(*) AS n_strands, sum(bends)::BIGINT AS bends FROM sl GROUP BY ALL)"


def _strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as strands: metres outside and inside of the mask that one layer's lines make, and measured bends."""
    drawn = A.drawn_segments(spark, sf_dir)
    mask = spatial.covered_cells(drawn.filter("layer LIKE '%BUILDING%'"), ["drawing_id"], 25.0)
    split, length = spatial.masked(drawn, mask, ["drawing_id"], 25.0), G.distance("ax", "ay", "bx", "by_")
    metres = lambda kept: (F.sum(F.when(F.col("masked") == kept, 0.0).otherwise(length)) * 0.0176)
    bends = O.bend_counts(A.segments(spark, sf_dir), [])
    return split.groupBy(*KEYS, "path_id").agg(metres(True).alias("length_m"), metres(False).alias("masked_m")).join(bends, "path_id", "left").fillna(0, ["bends"])


@query(f"{A.DRAWN_SQL}, {_QUANT}\nSELECT drawing_id, layer, round(length_m, 4) AS length_m, round(masked_m, 4) AS masked_m, n_strands, bends, greatest(0, n_strands - 1) AS joints, concat_ws(',', CASE WHEN masked_m > 0 THEN 'masked_length' END, CASE WHEN length_m = 0 THEN 'nothing_counted' END) AS flags FROM q")
def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths, strands and bends of every drawing's layers."""
    return D.quantities(_strands(spark, sf_dir), KEYS).withColumns({"length_m": F.round("length_m", 4), "masked_m": F.round("masked_m", 4)})


@query(
    f"""{A.DRAWN_SQL}, {_QUANT}
SELECT drawing_id, layer AS item, 'pipe' AS kind, round(length_m, 4) AS length_m, concat_ws(',', CASE WHEN masked_m > 0 THEN 'masked_length' END, CASE WHEN length_m = 0 THEN 'nothing_counted' END) AS flags FROM q
UNION ALL SELECT drawing_id, 'masked zone', 'excluded', round(sum(masked_m), 4), 'masked_length' FROM q GROUP BY drawing_id HAVING sum(masked_m) > 0"""
)
def delivery_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is delivered: a row for each layer, and one for what was left out."""
    return D.delivery_rows(D.quantities(_strands(spark, sf_dir), KEYS), ["layer"])


@query(f"{A.DRAWN_SQL}, {_QUANT}\nSELECT drawing_id, count(*) AS n_items, round(sum(length_m), 4) AS length_m, round(sum(masked_m), 4) AS masked_m, round(sum(masked_m) / (sum(length_m) + sum(masked_m)), 6) AS masked_share, sum(n_strands)::BIGINT AS n_strands FROM q GROUP BY drawing_id")
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of how far the result of a drawing can be trusted."""
    q = D.quantities(_strands(spark, sf_dir), KEYS)
    return q.groupBy("drawing_id").agg(F.count("*").alias("n_items"), F.round(F.sum("length_m"), 4).alias("length_m"), F.round(F.sum("masked_m"), 4).alias("masked_m"), F.round(F.sum("masked_m") / (F.sum("length_m") + F.sum("masked_m")), 6).alias("masked_share"), F.sum("n_strands").alias("n_strands"))


@query(f"{A.DRAWN_SQL}\nSELECT 'layer' AS field, layer AS value, round(sum({_LEN}), 4) AS length FROM drawn GROUP BY layer UNION ALL SELECT 'linetype', dash_signature, round(sum({_LEN}), 4) FROM drawn GROUP BY dash_signature UNION ALL SELECT 'width', CAST(width * 100 AS BIGINT)::VARCHAR, round(sum({_LEN}), 4) FROM drawn GROUP BY width")
def status_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length by layer, by line type and by width, as candidates for a status split."""
    lengths = A.drawn_segments(spark, sf_dir).withColumn("len", G.distance("ax", "ay", "bx", "by_"))
    fields = {"layer": F.col("layer"), "linetype": F.col("dash_signature"), "width": (F.col("width") * 100).cast("bigint")}
    return D.status_split(lengths, fields).withColumn("length", F.round("length", 4))


TRUTH = ["concat('D', CAST(o_custkey % 12 AS string)) AS drawing", "concat('S', CAST(o_orderkey % 9 AS string), '-R', CAST(o_orderkey % 7 AS string)) AS label", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 1000 END AS length_m", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 4 AS double) END AS vertical_count"]


@query(f"WITH t AS ({A.rows_sql('orders', TRUTH)})\nSELECT drawing, label, round(sum(coalesce(length_m, 0)), 6) AS length_m, sum(coalesce(vertical_count, 0)) AS verticals FROM t GROUP BY ALL")
def gt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth by drawing and label."""
    return D.ground_truth_totals(A.rows(spark, sf_dir, "orders", TRUTH)).withColumn("length_m", F.round("length_m", 6))


@query(
    f"""{A.DRAWN_SQL}, {_QUANT}, tru AS (SELECT layer, sum(length_m) * CASE WHEN hash_no % 2 = 0 THEN 1.05::DOUBLE ELSE 0.97::DOUBLE END AS truth_m FROM (SELECT *, length(layer) AS hash_no FROM q) WHERE layer LIKE '%-FE-%' GROUP BY layer, hash_no),
s AS (SELECT layer, sum(length_m) AS length_m FROM q GROUP BY layer), e AS (SELECT s.*, (length_m - truth_m) / nullif(truth_m, 0) * 100 AS error_pct, truth_m FROM s LEFT JOIN tru USING (layer))
SELECT count(*) AS n_layers, count(truth_m) AS n_truth, round(avg(abs(error_pct)), 4) AS mape, round(sum(length_m), 2) AS length_m, round((sum(CASE WHEN truth_m IS NOT NULL THEN length_m END) - sum(truth_m)) / sum(truth_m) * 100, 4) AS length_error_pct, avg(abs(error_pct)) <= 10 AS mape_ok, abs((sum(CASE WHEN truth_m IS NOT NULL THEN length_m END) - sum(truth_m)) / sum(truth_m) * 100) <= 10 AS length_ok FROM e"""
)
def eval_mape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error against the ground truth by layer, its mean, and the gates."""
    found = D.quantities(_strands(spark, sf_dir), KEYS).groupBy("layer").agg(F.sum("length_m").alias("length_m"))
    factor = F.when(F.length("layer") % 2 == 0, 1.05).otherwise(0.97)
    truth = found.filter(F.col("layer").contains("-FE-")).select("layer", (F.col("length_m") * factor).alias("truth_m"))
    errors = D.system_errors(found, truth, "layer")
    known = F.when(F.col("truth_m").isNotNull(), F.col("length_m"))
    m = errors.agg(F.count("*").alias("n_layers"), F.count("truth_m").alias("n_truth"), F.avg(F.abs("error_pct")).alias("mape"), F.sum("length_m").alias("length_m"), ((F.sum(known) - F.sum("truth_m")) / F.sum("truth_m") * 100).alias("length_error_pct"))
    gated = D.gates(m.withColumns({"vertical_error": F.lit(0), "n_nodes": F.lit(0), "n_labels": F.lit(1)}))
    return gated.select("n_layers", "n_truth", F.round("mape", 4).alias("mape"), F.round("length_m", 2).alias("length_m"), F.round("length_error_pct", 4).alias("length_error_pct"), "mape_ok", "length_ok")


WORDS = ["p_partkey % 7 AS drawing_id", "CAST(p_partkey * 19 % 1900 AS double) AS x0", "CAST(p_partkey * 37 % 1600 AS double) AS y0", "CAST(p_partkey * 19 % 1900 + 40 AS double) AS x1", "CAST(p_partkey * 37 % 1600 + 8 AS double) AS y1"]


@query(
    f"""{A.WITH_SQL}, d AS (SELECT unnest(range(0, 60)) AS drawing_id), w AS (SELECT path_id % 50 AS drawing_id, count(*) AS n_paths, count(DISTINCT CASE WHEN path_id % 50 % 3 > 0 THEN layer END) AS n_layers FROM paths GROUP BY 1),
tx AS (SELECT drawing_id, count(*) AS n_words FROM ({A.rows_sql("part", WORDS)}) WHERE (x0+x1)/2 BETWEEN 100 AND 1500 AND (y0+y1)/2 BETWEEN 100 AND 1200 GROUP BY drawing_id),
g AS (SELECT d.drawing_id, coalesce(n_paths, 0) AS n_paths, coalesce(n_layers, 0) AS n_layers, CASE WHEN coalesce(n_paths, 0) = 0 THEN 0 ELSE coalesce(n_words, 0) END AS n_words FROM d LEFT JOIN w USING (drawing_id) LEFT JOIN tx USING (drawing_id))
SELECT drawing_id, CASE WHEN n_paths = 0 THEN 'C' WHEN n_layers > 0 THEN 'A' ELSE 'B' END AS track, n_paths, n_layers, n_words, n_words < 50 AS vectorised, CASE WHEN n_paths > 0 AND n_layers > 0 THEN 'measurement' ELSE 'estimate' END AS delivers FROM g"""
)
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be measured on every drawing: A with layers, B without, C without paths; and how much of its text is written."""
    d = F.col("path_id") % A.DRAWINGS
    paths = A.paths(spark, sf_dir).select(d.alias("drawing_id"), "path_id", F.when(d % 3 > 0, F.col("layer")).alias("layer"))
    words = A.rows(spark, sf_dir, "part", WORDS)
    drawings = spark.range(60).select(F.col("id").alias("drawing_id"))
    plans = drawings.select("drawing_id", F.lit(100.0).alias("px0"), F.lit(100.0).alias("py0"), F.lit(1500.0).alias("px1"), F.lit(1200.0).alias("py1"))
    return D.triage(drawings, paths, ["drawing_id"], words, plans)
