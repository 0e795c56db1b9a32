"""Whitening of embeddings by the singular values of their centred rows.

Entries become integers, so sums and deviations from the mean are exact. The fit is over the
distinct vectors: their centred rows are a distributed matrix, whose right singular vectors
are the components and whose singular values, squared and over n, the eigenvalues of the
covariance. Small singular values drown in the rounding of large ones; where they are wanted,
they are taken from what the rows leave over beside the large components. The total variance
comes from the exact deviations, not from the singular values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm._store import drop, materialise

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Integers are held within these bounds, so that no entry ends a job.
BOUND = 1 << 52
_LONG = (1 << 63) - 1
#: Share of the largest singular value of a matrix down to which the others are taken from
#: it; share of the largest of all below which there is only rounding.
SURE, NOTHING = 1e-4, 1e-12


@dataclass
class Whitening:
    """n distinct vectors with their sums; ``components`` has unit rows by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    variance: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: the whole part taken off as an integer, then the rest."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole).astype(float) - np.array([s % self.n / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of (n x - sums)^2 over the dimensions, exact."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if most * most * max(1, len(self.sums)) <= _LONG:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        near = x - whole  # n x - sums = n (x - whole) - rest
        most = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if most * most * max(1, len(self.sums)) <= _LONG:
            d = self.n * near - np.array(rest, np.int64)
            return (d * d).sum(1).tolist()
        d = self.n * near.astype(object) - np.array(rest, object)
        return (d * d).sum(1).tolist()

    def left_over(self, x: np.ndarray) -> np.ndarray:
        """What the centred rows are beside the components."""
        c = self.centred(x)
        for _ in range(2):  # once more for what rounding has left
            c = c - c @ self.components.T @ self.components
        return c

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)


def integers(vector: Column) -> Column:
    """array<long> of floor(64 c) + 1,000,000; null for a null vector or one with a null or
    non-finite entry."""
    v = vector.cast("array<double>")
    whole = F.transform(v, lambda c: F.greatest(F.least(F.floor(c * float(SCALE)), F.lit(BOUND).cast("long")), F.lit(-BOUND).cast("long")) + F.lit(SHIFT).cast("long"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(v.isNotNull() & ~F.coalesce(bad, F.lit(False)), whole)


def _matrix(b: pa.RecordBatch, dims: int) -> np.ndarray:
    x = b.column("x")
    return x.flatten().to_numpy().reshape(len(x), dims)


def _vectors(df: DataFrame, array: Column) -> DataFrame:
    return MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(array).alias("v")), "v")


def fit_whitening(vectors: DataFrame, x_col: str = "x", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``vectors`` (array<long>, of one length), with
    ``components`` components or more; None without any vector. Components without variance,
    up to :data:`NOTHING`, are left out."""
    fit = materialise(vectors.select(F.col(x_col).alias("x")).distinct(), "whiten-fit")
    first = fit.first()
    if first is None:
        return None
    dims = len(first.x)

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, own = 0, np.zeros(dims, object)
        for b in it:
            x = _matrix(b, dims)
            n += len(x)
            # 2^10 entries of 2^53 fit in a long
            for at in range(0, len(x), 1024):
                own = own + x[at : at + 1024].sum(0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[Decimal(int(s)) for s in own]], pa.list_(pa.decimal128(38, 0)))], names=["n", "s"])

    # one row from each task, summed by dimension
    parts = fit.mapInArrow(sums, "n long, s array<decimal(38,0)>")
    told = parts.select("n", F.posexplode("s").alias("d", "s")).groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("d").collect()
    w = Whitening(told[0].n, [int(r.s) for r in told], np.empty((0, dims)), np.empty(0), 0.0)

    def deviations(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(w.deviations(_matrix(b, dims))) for b in it)
        yield pa.RecordBatch.from_arrays([pa.array([str(total)])], names=["total"])

    # one number from each task
    total = sum(int(r.total) for r in fit.mapInArrow(deviations, "total string").collect())
    w.variance = total / w.n**3
    if total:
        whole = F.array(*(F.lit(s // w.n).cast("long") for s in w.sums))
        rest = F.array(*(F.lit(s % w.n / w.n) for s in w.sums))
        centred = F.zip_with(F.zip_with("x", whole, lambda a, b: a - b), rest, lambda a, b: a.cast("double") - b)
        rows, largest = _vectors(fit, centred), None
        while len(w.eigenvalues) < min(components, dims):
            svd = RowMatrix(rows, w.n, dims).computeSVD(dims)
            s = svd.s.toArray()
            largest = s[0] if largest is None else largest
            sure = s >= max(s[0] * SURE, largest * NOTHING)
            if not sure.any():
                break
            w.components = np.concatenate((w.components, svd.V.toArray().T[sure]))
            w.eigenvalues = np.concatenate((w.eigenvalues, s[sure] ** 2 / w.n))
            rows = _vectors(_rows(fit, w.left_over, dims), F.col("w"))
        w.identity_error = _identity_error(fit, w)
    drop(fit)
    return w


def _rows(df: DataFrame, of: Callable[[np.ndarray], np.ndarray], dims: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array(list(of(_matrix(b, dims))), pa.list_(pa.float64()))], names=["w"])

    return df.select("x").mapInArrow(run, "w array<double>")


def _identity_error(fit: DataFrame, w: Whitening, components: int = COMPONENTS) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the
    identity, over the components that are told."""
    k = min(components, len(w.eigenvalues))
    own = Whitening(w.n, w.sums, w.components[:k], w.eigenvalues[:k], w.variance)
    c = RowMatrix(_vectors(_rows(fit, own.whitened, len(w.sums)), F.col("w")), w.n, k).computeCovariance().toArray()
    return float(np.abs(c * ((w.n - 1) / w.n) - np.eye(k)).max())


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each row of ``embeddings`` and component: id, component, n, deviation,
    whitened, explained, identity_error.

    Null vectors and those with null or non-finite entries are left out, as are those of
    another length than the longest: they have no place among the others. Entries are held
    within 2^52 after scaling. Repeated vectors count once in the fit and stay rows of their
    own, null ids too. Where the vectors vary in fewer than ``components`` directions, there
    are only so many components; one distinct vector, or an empty table, gives no rows. A
    deviation that no long holds is null. Other columns are not looked at.
    """
    kind = embeddings.schema[id_col].dataType.simpleString()
    rows = embeddings.select(F.col(f"`{id_col}`").alias("_id"), integers(F.col(f"`{vector_col}`")).alias("x")).where("x is not null")
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.where(F.size("x") == dims)
    w = fit_whitening(rows, components=components) if dims else None
    told = ["component int", "n long", "deviation long", "whitened double", "explained double", "identity_error double"]
    schema = f"`{id_col}` {kind}, " + ", ".join(told)
    if w is None or not len(w.eigenvalues):
        return embeddings.sparkSession.createDataFrame([], schema)
    k = min(components, len(w.eigenvalues))
    own = Whitening(w.n, w.sums, w.components[:k], w.eigenvalues[:k], w.variance, w.identity_error)
    explained = own.eigenvalues / own.variance

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x, m = _matrix(part, dims), part.num_rows
                deviation = pa.array([d if d <= _LONG else None for d in own.deviations(x)], pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [part.column("_id").take(each), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, own.n), deviation.take(each)]
                columns += [own.whitened(x).ravel(), np.tile(explained, m), np.full(m * k, own.identity_error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[id_col, *(t.split()[0] for t in told)])

    return rows.mapInArrow(run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first 16 components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
