"""Drawing operations to line segments: one row for each line, chord or edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G


def flatten_ops(ops: DataFrame, keys: list[str], matrix: str = "m") -> DataFrame:
    """Segments (keys, path_id, seg_no, ax, ay, bx, by_, closed) of ``ops(keys, path_id, op_no, kind, points, closes)``.

    ``points`` is an array of (x, y) in page space: two of a line ``l``, four of a curve ``c``, two opposite corners of a rectangle
    ``re``, the corners of a quad ``qu`` in turn. A curve becomes as many chords as its control polygon holds two-thousandths of the
    page's diagonal, from 2 to 24. Another kind, or one with too few points, has none. ``matrix`` names a page's struct of
    ``geometry.page_matrix``. ``closes`` says that the path was closed when it was drawn (null: not); a path with a rectangle or a
    quad is closed too. Segments are numbered along the path from 1. An operation
    is dealt to its path with its points and matrix; there it is turned, numbered, and its segments become rows.
    """
    # the steps before and after the shuffle, and the ends' weights apart: a generated method over 8000 bytes isn't compiled by the JVM
    m, spots = [f"_{c}" for c in ("a", "b", "c", "d", "e", "f", "width", "height")], [(f"x{i}", f"y{i}") for i in range(4)]
    page = ops.select(*keys, "path_id", "op_no", "kind", "closes", F.coalesce(F.size("points"), F.lit(0)).alias("given"), *(F.col(f"{matrix}.{c[1:]}").alias(c) for c in m), *(F.get("points", F.lit(i))[v[0]].alias(f"_{v}") for i, spot in enumerate(spots) for v in spot))
    page = page.repartition(*keys, "path_id")  # the windows' own shuffle, here: it parts what would be one method
    turned = lambda x, y, a, b, e: (F.col(a) * F.col(f"_{x}") + F.col(b) * F.col(f"_{y}") + F.col(e))
    own = page.select(*keys, "path_id", "op_no", "kind", "closes", "given", F.sqrt(F.col("_width") * F.col("_width") + F.col("_height") * F.col("_height")).alias("diagonal"), *(turned(x, y, *of).alias(v) for x, y in spots for v, of in ((x, ("_a", "_c", "_e")), (y, ("_b", "_d", "_f")))))
    is_, most = (lambda kind: F.coalesce(F.col("kind") == kind, F.lit(False))), F.greatest(F.col("diagonal") * 5e-4, F.lit(1e-6))
    control = sum((G.distance(f"x{i}", f"y{i}", f"x{i + 1}", f"y{i + 1}") for i in range(1, 3)), G.distance("x0", "y0", "x1", "y1"))
    parts = F.greatest(F.lit(2), F.least(F.lit(24), (control / most).cast("int")))
    n = F.when(is_("l") & (F.col("given") >= 2), 1).when(is_("c") & (F.col("given") >= 4), parts).when((is_("re") & (F.col("given") >= 2)) | (is_("qu") & (F.col("given") >= 4)), 4).otherwise(0)
    # a rectangle is given by two corners: its four, from the least one
    sides = {"x": (F.least("x0", "x1"), F.greatest("x0", "x1")), "y": (F.least("y0", "y1"), F.greatest("y0", "y1"))}
    corners = [F.when(is_("re"), sides[c][j]).otherwise(F.col(f"{c}{i}")).alias(f"{c}{i}") for i, turn in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))) for c, j in zip("xy", turn, strict=True)]
    closing = F.coalesce(F.col("closes"), F.lit(False)) | F.coalesce(F.col("kind").isin(*G.CLOSING), F.lit(False))
    sized = own.select(*keys, "path_id", "op_no", n.alias("n"), is_("c").alias("curve"), closing.alias("closing"), *corners)
    path = W.partitionBy(*keys, "path_id")
    before = F.coalesce(F.sum("n").over(path.orderBy("op_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumns({"before": before, "closed": F.bool_or("closing").over(path)}).filter("n > 0")
    # a segment is a row where its operation stands, so its ends are computed in generated code
    each = placed.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    place = {"t0": (F.col("k") - 1) / F.col("n"), "t1": F.col("k") / F.col("n"), "j0": F.col("k") - 1, "j1": F.col("k") % 4}

    def weights(t: Column) -> tuple[Column, ...]:
        s = F.lit(1.0) - t
        return s * s * s, s * s * t * 3.0, s * t * t * 3.0, t * t * t

    weighed = each.withColumns(place).withColumns({f"w{e}{i}": w for e in (0, 1) for i, w in enumerate(weights(F.col(f"t{e}")))})

    def end(e: int, c: str) -> Column:
        p, w, j = [F.col(f"{c}{i}") for i in range(4)], [F.col(f"w{e}{i}") for i in range(4)], F.col(f"j{e}")
        return F.when(F.col("curve"), w[0] * p[0] + w[1] * p[1] + w[2] * p[2] + w[3] * p[3]).when(j == 0, p[0]).when(j == 1, p[1]).when(j == 2, p[2]).otherwise(p[3])

    return weighed.select(*keys, "path_id", (F.col("before") + F.col("k")).cast("int").alias("seg_no"), end(0, "x").alias("ax"), end(0, "y").alias("ay"), end(1, "x").alias("bx"), end(1, "y").alias("by_"), "closed")
