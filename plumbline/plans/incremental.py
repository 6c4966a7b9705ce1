"""Measuring only what changed: a digest of each drawing's rows, held against those of earlier runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import commit_run, committed, manifests, read_runs
from ..sources.shared import cut

DIGESTS = "drawing_id {kind}, digest string"


def drawing_digests(inputs: Mapping[str, DataFrame], key: str = "drawing_id") -> DataFrame:
    """(key, digest) of all rows of a drawing in all tables, whatever their order; repeated rows count.

    A table's part is its number of rows and two exact sums of 64-bit hashes of its rows, added up before the shuffle.
    """
    parts = None
    for name, df in sorted(inputs.items()):
        columns = [F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}) for c in sorted(df.columns) if c != key]
        rows = df.select(key, F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)").alias("h1"), F.xxhash64(F.lit(2), *columns).cast("decimal(38,0)").alias("h2"))
        part = rows.groupBy(key).agg(F.concat_ws(":", F.lit(name), F.count("*").cast("string"), F.sum("h1").cast("string"), F.sum("h2").cast("string")).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("part")), ";"), 256).alias("digest"))  # a row a table


def last_runs(spark: SparkSession, root: str, kind: str = "bigint") -> DataFrame:
    """(drawing_id, digest, run_id) of every drawing's last visible run."""
    done = read_runs(spark, root, "digests", DIGESTS.format(kind=kind)).join(manifests(spark, root).select("run_id", "committed_at"), "run_id")
    last = done.groupBy("drawing_id").agg(F.max(F.struct("committed_at", "run_id", "digest")).alias("last"))
    return last.select("drawing_id", "last.digest", "last.run_id")


def measure_changed(spark: SparkSession, root: str, run_id: str, inputs: Mapping[str, DataFrame], run: Callable[[dict[str, DataFrame]], Mapping[str, DataFrame]], whole: tuple[str, ...] = ("rules", "references")) -> bool:
    """Measure the drawings that are new or changed since their last run, and show the results as one run; False where the run is visible already.

    ``inputs`` are the tables that ``run`` takes, keyed by drawing_id but for those named in ``whole`` (a change of these changes every
    drawing). ``run`` returns tables keyed by drawing_id. Drawings whose digest is that of their last run are not read further.
    """
    if committed(spark, root, run_id):
        return False
    own = {name: df for name, df in inputs.items() if name not in whole}
    kind = next(iter(own.values())).schema["drawing_id"].dataType.simpleString()
    digests = drawing_digests(own)
    for name in sorted(set(inputs) & set(whole)):
        of_all = drawing_digests({name: inputs[name].withColumn("__all", F.lit(1))}, "__all").first()  # one row
        digests = digests.withColumn("digest", F.sha2(F.concat_ws(";", "digest", F.lit(of_all["digest"] if of_all else "")), 256))
    digests = cut(digests)
    changed = cut(digests.join(last_runs(spark, root, kind).select("drawing_id", "digest"), ["drawing_id", "digest"], "left_anti"))
    some = {name: df.join(changed.select("drawing_id"), "drawing_id", "left_semi") if name in own else df for name, df in inputs.items()}
    return commit_run(spark, root, run_id, {**run(some), "digests": changed})


def current(spark: SparkSession, root: str, name: str, schema: str, kind: str = "bigint") -> DataFrame:
    """A table's rows as of every drawing's last run."""
    return read_runs(spark, root, name, schema).join(last_runs(spark, root, kind).select("drawing_id", "run_id"), ["drawing_id", "run_id"], "left_semi")
