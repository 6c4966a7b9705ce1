"""Whitening of embedding vectors: exact centring, a distributed Gramian, a local eigendecomposition, projection of all rows.

Entries become whole numbers (floor(256 * c)), so sums and centring are exact: with n
distinct vectors and sums S, a centred entry is (n * x - S) / n, rounded once. MLlib's
RowMatrix sums the outer products of these rows in a tree over the partitions; only a
matrix of dimension x dimension reaches the driver. Its eigenvectors, as a broadcast,
whiten every row in ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT  # noqa: F401  (registers the vector type)
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, ready

#: Entries are rounded down to multiples of 1 / SCALE.
SCALE = 256
#: Eigenvalues below this share of the largest count as zero (rounding of the decomposition).
_FLAT = 1e-12


@dataclass
class Whitening:
    """n fitted vectors with sums S; unit eigenvectors by column with their eigenvalues, and the trace of the covariance."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers to rows of whitened components; a component without variance is 0."""
        flat = self.values <= _FLAT * max(self.trace, 1e-300)
        scale = np.where(flat, 0.0, 1 / np.sqrt(np.where(flat, 1.0, self.values)))
        return (centred(x, self.n, self.sums) @ self.vectors) * scale

    def explained(self) -> np.ndarray:
        return np.maximum(self.values, 0) / self.trace if self.trace > 0 else np.zeros(len(self.values))


def scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: as long integers where they fit, else as Python's."""
    most = n * max(int(np.abs(x).max(initial=0)), 1) + max((abs(int(s)) for s in sums), default=0)
    if most < 1 << 62:
        return n * x - np.asarray(sums, np.int64)
    return n * x.astype(object) - np.array([int(s) for s in sums], object)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, rounded once (where n * x - S is below 2**53; by two correct roundings beyond)."""
    return scaled(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Exact sum of (n * x - S)**2 of each row."""
    z = scaled(x, n, sums)
    if z.dtype != object and x.shape[1] * float(np.abs(z).max(initial=0)) ** 2 < 2.0**62:
        return (z * z).sum(1).tolist()
    return [sum(int(v) * int(v) for v in row) for row in z]


def whole_entries(vectors: DataFrame, keep: list[str], vector: str) -> DataFrame:
    """The columns ``keep`` and x, an array of floor(SCALE * entry) as longs, of the rows whose vector is not null, not empty and wholly finite."""
    v = F.col("__v")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(*keep, F.col(vector).cast("array<double>").alias("__v")).filter(F.coalesce(sound, F.lit(False))).select(*keep, F.transform("__v", lambda c: F.floor(c * SCALE) + 0).alias("x"))


def _row_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Count and exact sums (as text) of a task's vectors, one row for each dimension."""
    held: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for size, group in batch.groupby(batch.x.map(len)):
            x = np.stack(group.x.tolist())
            small = float(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < 2.0**62
            s = (x if small else x.astype(object)).sum(0).astype(object)
            n, have = held.get(size, (0, np.zeros(size, object)))
            held[size] = (n + len(x), have + s)
    for size, (n, s) in held.items():
        yield pd.DataFrame({"size": [size], "n": [n], "sums": [[str(v) for v in s]]})


def fit_whitening(x_rows: DataFrame, components: int = 4) -> Whitening | None:
    """Fit on the distinct vectors of ``x_rows(x)``; None where there is none.

    Vectors of the commonest length (of equal ones, the longest) are fitted. The distinct vectors are
    written once and read four times: sums, Gramian, and mean and covariance of the whitened vectors.
    """
    spark = x_rows.sparkSession
    ready(spark)
    distinct = cut(x_rows.select("x").distinct())
    totals: dict[int, tuple[int, np.ndarray]] = {}
    per_dimension = distinct.mapInPandas(_row_sums, "size int, n long, sums array<string>").select("size", "n", F.posexplode("sums").alias("at", "s"))
    # one row a task and dimension; their sums as exact decimals
    summed = per_dimension.groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).groupBy("size").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "s"))).alias("sums"))
    for r in summed.orderBy(F.desc("n"), F.desc("size")).limit(1).collect():  # as many numbers as a vector has entries
        totals[r["size"]] = (int(r["n"]), np.array([int(p["s"]) for p in r["sums"]], object))
    if not totals:
        return None
    (size, (n, sums)), = totals.items()
    fitted = distinct.filter(F.size("x") == size)

    def centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"c": list(centred(np.stack(batch.x.tolist()), n, sums))})

    rows = fitted.mapInPandas(centre, "c array<double>").select(array_to_vector("c").alias("c"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "c"), n, size)._java_matrix_wrapper.call("computeGramianMatrix")
    covariance = np.array(gram.toArray(), np.float64).reshape(size, size) / n
    values, vectors = np.linalg.eigh(covariance)
    falling = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, falling]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)  # one sign for all
    fit = Whitening(n, sums, vectors, values[falling], float(np.trace(covariance)))
    fit.error = _identity_error(fitted, fit)
    return fit


def _identity_error(fitted: DataFrame, fit: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over the components with variance."""
    live = np.flatnonzero(fit.values > _FLAT * max(fit.trace, 1e-300))
    if not len(live):
        return 0.0

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(fit.whiten(np.stack(batch.x.tolist()))[:, live], columns=names)

    names = [f"w{k}" for k in range(len(live))]
    w = fitted.mapInPandas(project, ", ".join(f"{c} double" for c in names))
    mean = w.agg(*(F.avg(c).alias(c) for c in names)).first()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    covariance = w.agg(*(F.avg((F.col(a) - mean[a]) * (F.col(b) - mean[b])).alias(f"{a}_{b}") for a, b in pairs)).first()
    return max(abs(covariance[f"{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """One row for each sound vector and each of the first ``components`` components:
    (key, component, n, deviation, whitened, explained, identity_error, deviation_wide).

    A vector that is null or empty or holds a null or non-finite entry is left out, and so is one whose length is not the
    commonest. Repeated vectors count once in the fit and each give their rows; a null key is kept. Where the
    vectors have fewer dimensions than ``components``, as many components come back; one without variance (one distinct vector,
    or dependent dimensions) has whitened 0. An empty table gives an empty result. ``deviation`` is exact; should it exceed a
    long it is null, and ``deviation_wide`` has it as a decimal. Entries beyond 2**53 / SCALE in size
    are whole numbers as doubles have them; beyond a long's range they are an error. Other columns are ignored.
    """
    rows = whole_entries(vectors, [key], vector)
    fit = fit_whitening(rows, components)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` string, component int, n long, deviation_wide string, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    if fit is None:
        out = spark.createDataFrame([], schema)
    else:
        shared = spark.sparkContext.broadcast(fit)

        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            f, explained = shared.value, shared.value.explained()
            k = len(f.values)
            for batch in batches:
                if not len(batch):
                    continue
                x = np.stack(batch.x.tolist())
                yield pd.DataFrame({
                    key: batch[key].repeat(k).reset_index(drop=True), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": f.n,
                    "deviation_wide": np.repeat(np.array([str(v) for v in deviations(x, f.n, f.sums)], object), k),
                    "whitened": f.whiten(x).ravel(), "explained": np.tile(explained, len(x)), "identity_error": f.error,
                })

        keyed = rows.filter(F.size("x") == len(fit.sums)).withColumn(key, F.col(key).cast("string"))  # as text, so that pandas keeps nulls and long ids
        out = keyed.mapInPandas(project, schema)
    return out.select(F.col(key).cast(kind).alias(key), "component", "n", F.expr("try_cast(deviation_wide AS bigint)").alias("deviation"), "whitened", "explained", "identity_error", F.expr("try_cast(deviation_wide AS decimal(38,0))").alias("deviation_wide"))
