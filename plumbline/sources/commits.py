"""Runs of several tables that become visible all at once: written under the run's id, shown by one manifest.

A table's rows lie below ``root/name/run_id=.../attempt=...``. Nothing reads an attempt until the run's manifest
names it, and a manifest is put in place by one rename. So a run that fails between two tables shows nothing, a run that
is tried again shows once, and a run that is there already is not written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "run_id string, attempt string, committed_at string, tables array<string>"


def _files(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, root: str, run_id: str) -> bool:
    """Whether a run is visible."""
    target, fs = _files(spark, f"{root}/_manifests/{run_id}.json")
    return fs.exists(target)


def commit_run(spark: SparkSession, root: str, run_id: str, tables: Mapping[str, DataFrame]) -> bool:
    """Write the tables of a run and show them together; False, and nothing written, where the run is visible already.

    ``run_id`` must be fit for a file name. Of two writers of one run that finish at the same time, one shows.
    """
    from .tables import now

    if not run_id or any(c in run_id for c in "/\\:*?\"<>|"):
        raise ValueError(f"not fit for a file name: {run_id!r}")
    if committed(spark, root, run_id):
        return False
    attempt = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}/run_id={run_id}/attempt={attempt}")
    draft, fs = _files(spark, f"{root}/_drafts/{attempt}.json")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"run_id": run_id, "attempt": attempt, "committed_at": now(), "tables": sorted(tables)}).encode()))
    out.close()
    target, _ = _files(spark, f"{root}/_manifests/{run_id}.json")
    fs.mkdirs(target.getParent())
    shown = not fs.exists(target) and fs.rename(draft, target)
    if not shown:
        fs.delete(draft, False)
    return shown


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, attempt, committed_at, tables) of the visible runs."""
    target, fs = _files(spark, f"{root}/_manifests")
    if not fs.exists(target):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).json(f"{root}/_manifests").filter("run_id IS NOT NULL")


def read_runs(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The rows of a table of all visible runs, with run_id. Attempts that no manifest names are pruned as partitions."""
    target, fs = _files(spark, f"{root}/{name}")
    if not fs.exists(target):
        return spark.createDataFrame([], f"{schema}, run_id string")
    rows = spark.read.schema(f"{schema}, run_id string, attempt string").option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    shown = manifests(spark, root).filter(F.array_contains("tables", name)).select("run_id", "attempt")
    return rows.join(shown, ["run_id", "attempt"], "left_semi").drop("attempt")
