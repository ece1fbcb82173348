"""Whitening of embeddings: principal components from MLlib's singular values of the centred rows, scaled to unit variance.

Vectors are read as integers, so that sums, means and total variance are exact: the means come from integer sums, and the
total variance from exact squared deviations, apart from the decomposition. MLlib's ``computeSVD`` gives the right singular
vectors and values of the distributed centred rows; a squared singular value over n is a component's variance.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sparkio import bound_batches, saved, unused

#: whole steps a unit has, and what is added to have no negative numbers
STEPS, SHIFT = 64, 1_000_000
#: components returned
COMPONENTS = 16
#: a component with less of the first one's variance has none: it is rounding
NO_VARIANCE = 1e-12


def whole_numbers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry; null for vectors that are null or hold a null or non-finite entry."""
    v = vector.cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(sound, F.transform(v, lambda c: F.floor(c * STEPS).cast("bigint") + SHIFT))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def _summed(df: DataFrame, dims: int, make: Callable[[np.ndarray], np.ndarray], kind: str, size: int) -> list:
    """The sums over all rows of ``make``'s numbers (``size`` of them for a matrix of rows): a row a task, added by Spark."""
    values = pa.int64() if kind == "bigint" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64 if kind == "bigint" else np.float64)
        for batch in batches:
            if batch.num_rows:
                total += make(_matrix(batch.column(0), dims))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(values))], names=["s"])

    exact = F.sum(F.col("col").cast("decimal(38,0)")) if kind == "bigint" else F.sum("col")
    found = df.mapInArrow(run, f"s array<{kind}>").select(F.posexplode("s")).groupBy("pos").agg(exact.alias("s")).collect()
    out = [0] * size
    for r in found:
        out[r["pos"]] = int(r["s"]) if kind == "bigint" else float(r["s"])
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum over dimensions of (n x - S)^2 of each row."""
    if not len(x):
        return []
    s = np.array(sums, object)
    far = max(abs(n * int(x.max()) - min(sums)), abs(n * int(x.min()) - max(sums)))
    if x.shape[1] * far * far < 1 << 62 and max(map(abs, sums)) < 1 << 62:
        d = n * x - s.astype(np.int64)
        return np.einsum("ij,ij->i", d, d).tolist()
    d = n * x.astype(object) - s
    return (d * d).sum(axis=1).tolist()


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, exact up to the last division."""
    whole = [divmod(s, n) for s in sums]
    return (x - np.array([w for w, _ in whole], np.int64)).astype(np.float64) - np.array([r / n for _, r in whole])


def components_of(fit: DataFrame, n: int, sums: list[int], wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances, falling, and unit vectors as columns, of at most ``wanted`` components with any variance."""
    whole = [divmod(s, n) for s in sums]
    means = F.array(*(F.struct(F.lit(w).cast("bigint").alias("w"), F.lit(r / n).alias("r")) for w, r in whole))
    rows = fit.select(array_to_vector(F.zip_with("x", means, lambda x, m: (x - m["w"]).cast("double") - m["r"])).alias("v"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v")).computeSVD(len(sums), computeU=False)  # all of them: the full decomposition of the Gramian, not an iterative one
    s, v = found.s.toArray(), found.V.toArray()
    variance = s * s / n
    k = min(wanted, int((variance > NO_VARIANCE * variance[0]).sum())) if len(s) else 0
    return variance[:k], v[:, :k]


def whiten(vectors: DataFrame, components: int = COMPONENTS, keep: list[str] | None = None, embedding: str = "embedding") -> DataFrame:
    """A row for each sound vector and component: ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Vectors that are null or hold a null or non-finite entry are left out, whatever their id; ids may be null or repeat. Equal
    vectors count once in the fit, each has its rows. Vectors of no dimension, and of a corpus without variance, have no
    component and no row; components without variance have none either. Vectors of different lengths, and entries beyond the
    64-bit range, are errors. Of the columns to ``keep`` (all but the vector, if None) those named like a result are left out.
    ``deviation`` is decimal(38,0).
    """
    bound_batches(vectors.sparkSession)
    spark = vectors.sparkSession
    own = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.DecimalType(38, 0)), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    keep = [c for c in ([c for c in vectors.columns if c != embedding] if keep is None else keep) if c.lower() not in {n for n, _ in own}]
    x = unused(vectors, "x")
    rows = vectors.select(*(f"`{c}`" for c in keep), whole_numbers(vectors[embedding]).alias(x)).where(F.size(x) > 0)
    schema = T.StructType([*rows.drop(x).schema.fields, *(T.StructField(n, t) for n, t in own)])
    fit = saved(rows.select(F.col(x).alias("x")).distinct(), "whiten-fit")
    n, dims, most = fit.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    if dims != most:
        raise ValueError(f"vectors have from {dims} to {most} dimensions")

    sums = _summed(fit, dims, lambda x: x.sum(axis=0), "bigint", dims)
    variance, v = components_of(fit, n, sums, components)
    k = len(variance)
    if not k:
        return spark.createDataFrame([], schema)
    scaled = v / np.sqrt(variance)
    project = lambda x: centred(x, n, sums) @ scaled

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sum(sum(deviations(_matrix(b.column(0), dims), n, sums)) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([decimal.Decimal(found)], pa.decimal128(38, 0))], names=["d"])

    # deviations are n^2 times the squared distances, so that their sum is n^3 times the total variance
    deviation = int(fit.mapInArrow(total, "d decimal(38,0)").agg(F.sum("d")).first()[0])
    explained = np.array([float(e * n * n * n) for e in variance]) / float(deviation)
    mean = np.array(_summed(fit, dims, lambda x: project(x).sum(axis=0), "double", k)) / n

    def products(x: np.ndarray) -> np.ndarray:
        z = project(x) - mean
        return (z.T @ z).ravel()

    covariance = np.array(_summed(fit, dims, products, "double", k * k)).reshape(k, k) / n
    error = float(np.abs(covariance - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            found = _matrix(batch.column(len(keep)), dims)
            at = pa.array(np.repeat(np.arange(m), k))
            deviation = pa.array([decimal.Decimal(d) for d in deviations(found, n, sums)], pa.decimal128(38, 0))
            made = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation.take(at), pa.array(project(found).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[: len(keep)]), *made], names=schema.names)

    return rows.mapInArrow(run, schema)
