"""Drawings as they arrive: a file stream of path records, each batch measured as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import SCHEMAS, segments_of


def stream_paths(spark: SparkSession, root: str) -> DataFrame:
    """New path records under ``root``/paths as they are written."""
    return spark.readStream.schema(SCHEMAS["paths"]).parquet(f"{root}/paths")


def measure_stream(paths: DataFrame, run: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply ``run`` to the segments of every batch and append its rows to ``out``; a drawing must arrive in one batch.

    A batch that is tried again overwrites its own part, so rows appear once.
    """

    def each(batch: DataFrame, number: int) -> None:
        run(segments_of(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return paths.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
