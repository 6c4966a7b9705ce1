"""Session plumbing shared by the corpus operators: tables, batches, cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once. Documents reach 100 KB and more, so the
#: default of 10,000 rows would let one batch outgrow an executor.
ROWS_PER_BATCH = 256


_shipped: set[str] = set()


def ready(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Bound the rows of an Arrow batch and send this package to the executors, once per application."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="plumbline-")) / "plumbline_code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, f"{package.name}/{source.relative_to(package)}")
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, a new local one in local mode and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it again.

    A lost executor then costs the running stage only, and later readers fetch
    just the columns they use.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, by: str, cap: int, key: str = "doc_id") -> DataFrame:
    """About ``cap`` rows of each value of ``by``, the same rows on every run.

    Every row has a place in [0, 1) by the hash of its key; a value with n rows
    keeps those below cap / n. ``by`` must have few values (labels).
    """
    sizes = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for value, n in sizes.items():
        if value is not None:
            keep = keep | ((F.col(by) == F.lit(value)) & (place < F.lit(min(1.0, cap / n))))
    return df.filter(keep)
