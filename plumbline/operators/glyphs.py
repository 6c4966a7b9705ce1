"""Text drawn as strokes: glyphs, words and lines by proximity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import network as N
from . import spatial as S
from . import styles as ST


def grouped(boxes: DataFrame, keys: list[str], gap_x: float | Column, gap_y: float | Column) -> DataFrame:
    """Boxes joined where they are at most the gaps apart: (keys, box_id, x0, y0, x1, y1, n_parts); box_id is the smallest of the parts."""
    links = N.box_components(boxes, keys, gap_x, gap_y)
    named = boxes.join(links.withColumnRenamed("node", "box_id"), [*keys, "box_id"], "left").withColumn("box_id", F.coalesce("component", "box_id"))
    return named.groupBy(*keys, "box_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_parts"))


def cap_height(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent height (to 0.1) of the boxes, ties to the box seen first: (keys, height)."""
    heights = boxes.withColumn("height", F.round(F.col("y1") - F.col("y0"), 1)).filter("height > 0")
    return S.first_mode(heights, keys, "height", "box_id").select(*keys, "height")


def letter_height(strokes: DataFrame, keys: list[str]) -> DataFrame:
    """The height of the letters that strokes make up: (keys, height).

    Strokes (box_id, x0, y0, x1, y1) are joined where they are at most the group's median stroke height apart (by position; the
    mean of the positive heights where that is 0); the most frequent height of these groups counts.
    """
    tall = strokes.withColumn("tall", F.col("y1") - F.col("y0"))
    middle = ST.positional_values(tall, keys, "tall", {"middle": 0.5})
    mean = tall.groupBy(*keys).agg(F.avg(F.when(F.col("tall") > 0, F.col("tall"))).alias("mean"))
    seed = middle.join(mean, keys).select(*keys, F.when(F.col("middle") > 0, F.col("middle")).otherwise(F.coalesce("mean", F.lit(1.0))).alias("seed"))
    return cap_height(grouped(strokes.join(seed, keys), keys, F.col("seed"), F.col("seed")), keys)


def bitmaps(segments: DataFrame, keys: list[str], wide: int = 8, high: int = 12) -> DataFrame:
    """Glyphs drawn on a small grid: (keys, cells, cells_hi, ratio) of strokes (keys, ax, ay, bx, by_).

    A stroke is sampled once for each twelfth of the glyph's longer side (64 samples at most); cell y * 8 + x of the glyph's box
    is bit of ``cells`` (the first 64) or ``cells_hi``. ``ratio`` is width over height, 4 at most, to 0.1.
    """
    least = lambda hi, lo: F.greatest(hi - lo, F.lit(1e-9))
    box = segments.groupBy(*keys).agg(F.min(F.least("ax", "bx")).alias("x0"), F.min(F.least("ay", "by_")).alias("y0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.max(F.greatest("ay", "by_")).alias("y1"))
    box = box.select(*keys, "x0", "y0", least(F.col("x1"), F.col("x0")).alias("w"), least(F.col("y1"), F.col("y0")).alias("h"))
    n = F.greatest(F.lit(1), F.least(F.lit(64), (G.distance("ax", "ay", "bx", "by_") / (F.greatest("w", "h") / max(wide, high))).cast("int") + 1))
    sampled = segments.join(box, keys).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda a, b, lo, size, cells: F.least(F.lit(cells - 1), F.greatest(F.lit(0), ((F.col(a) + (F.col(b) - F.col(a)) * (F.col("k") / F.col("n")) - F.col(lo)) / F.col(size) * cells).cast("int")))
    cell = at("ay", "by_", "y0", "h", high) * wide + at("ax", "bx", "x0", "w", wide)
    bit = lambda low: F.bit_or(F.when((F.col("cell") >= 64) != F.lit(low), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("cell") % 64)).otherwise(F.lit(0).cast("bigint")))
    return sampled.withColumn("cell", cell).groupBy(*keys, "w", "h").agg(bit(True).alias("cells"), bit(False).alias("cells_hi")).select(*keys, "cells", "cells_hi", F.round(F.least(F.lit(4.0), F.col("w") / F.col("h")), 1).alias("ratio"))


def line_codes(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """What lines of glyphs (line_id, word_id, glyph_id, x0, letter) say: (keys, line_id, code, n_words, n_glyphs).

    A word's code is its letters' numbers from left to right; a line's code its words'. Equal codes are equal texts, though unread.
    """
    spelt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "glyph_id", "letter"))), lambda g: g["letter"].cast("string")), ".")
    words = glyphs.groupBy(*keys, "line_id", "word_id").agg(spelt.alias("code"), F.min("x0").alias("x0"), F.count("*").alias("n"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_id", "code"))), lambda w: w["code"]), " ")
    return words.groupBy(*keys, "line_id").agg(said.alias("code"), F.count("*").alias("n_words"), F.sum("n").alias("n_glyphs"))


def text_lines(strokes: DataFrame, keys: list[str], height: float) -> dict[str, DataFrame]:
    """Glyphs, words and lines from stroke boxes; glyphs over 3 heights wide or 2.5 high are no text."""
    glyphs = grouped(strokes, keys, 0.10 * height, 0.10 * height)
    glyphs = glyphs.filter(((F.col("x1") - F.col("x0")) <= 3 * height) & ((F.col("y1") - F.col("y0")) <= 2.5 * height))
    words = grouped(glyphs, keys, 0.40 * height, 0.15 * height)
    return {"glyphs": glyphs, "words": words, "lines": grouped(words, keys, 1.2 * height, 0.25 * height)}
