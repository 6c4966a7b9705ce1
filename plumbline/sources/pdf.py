"""Vector PDF pages as path records, where the optional library ``pymupdf`` is installed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SCHEMA = "drawing_id STRING, path_id BIGINT, seqno INT, layer STRING, kind STRING, width DOUBLE, dashes STRING, closed BOOLEAN, segments ARRAY<STRUCT<ax: DOUBLE, ay: DOUBLE, bx: DOUBLE, by_: DOUBLE>>"


def _edges(item: tuple) -> list[tuple[float, float, float, float]]:
    if item[0] == "l":
        return [(item[1].x, item[1].y, item[2].x, item[2].y)]
    if item[0] in ("re", "qu"):
        q = item[1].quad if item[0] == "re" else item[1]
        corners = [(p.x, p.y) for p in (q.ul, q.ur, q.lr, q.ll)]
        return [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    p = [(c.x, c.y) for c in item[1:5]]
    point = lambda t: tuple((1 - t) ** 3 * p[0][k] + 3 * (1 - t) ** 2 * t * p[1][k] + 3 * (1 - t) * t * t * p[2][k] + t**3 * p[3][k] for k in (0, 1))
    steps = [point(k / 12) for k in range(13)]
    return [(*a, *b) for a, b in zip(steps, steps[1:], strict=False)]


def read_paths(spark: SparkSession, path: str, page: int = 0) -> DataFrame:
    """Paths of one page of every PDF under ``path``, one task for each file; an ImportError where the library is missing."""
    import pandas as pd
    import pymupdf  # noqa: F401  the tasks need it too

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for frame in frames:
            for name, content in zip(frame.path, frame.content, strict=True):
                drawing = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows = []
                for i, d in enumerate(pymupdf.open(stream=content, filetype="pdf")[page].get_drawings()):
                    segments = [dict(zip(("ax", "ay", "bx", "by_"), e, strict=True)) for item in d["items"] for e in _edges(item)]
                    rows.append((drawing, i, d.get("seqno"), d.get("layer"), d.get("type"), d.get("width"), d.get("dashes"), bool(d.get("closePath")), segments))
                yield pd.DataFrame(rows, columns=["drawing_id", "path_id", "seqno", "layer", "kind", "width", "dashes", "closed", "segments"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, _SCHEMA)
