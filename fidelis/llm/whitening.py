"""Whitening of embeddings by a distributed singular value decomposition.

Entries become whole numbers first, x = floor(scale * entry) + offset, so that counts, sums and deviations are exact. The
fit list is every distinct x once: n vectors with sums S. Its rows less S / n are a RowMatrix, whose singular values s
give the variances s * s / n of its components; the divisor is n, not n - 1. Their share is of the total variance,
which comes not from the singular values but from the exact deviations sum((n * x - S)^2) = n * n * |x - S / n|^2.

Held by the driver: S and at most `most` components, numbers of columns times `most`. Never more of the table.

Defined results: rows without a vector, with a null or non-finite entry, with one that times `scale` reaches 2^53 (its
floor is no longer told from its neighbours), or of another length than most rows have (the shorter on ties) are dropped;
an empty vector has no components. Repeated rows and rows without a key have rows of their own; other columns are not
looked at. Components whose variance is nearly none (singular value below 1e-5 of the largest) are left out, so equal vectors
have none at all; fewer columns than `most` give fewer. A deviation beyond a long is null. Signs: a component's entry of
largest size is positive, the first of these on ties. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import Scratch, slices

SCALE, OFFSET, MOST, LEAST = 64, 1_000_000, 16, 1e-5
_LONG = 1 << 63
SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(df: DataFrame, vector: str, *keep: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """The rows that take part, with the columns to keep and their vector as whole numbers, x."""
    c = F.col(vector)
    sound = F.forall(c, lambda v: F.coalesce(F.abs(v.cast("double")) * scale < float(1 << 53), F.lit(False)) & ~F.isnan(v.cast("double")))
    rows = df.where(c.isNotNull() & (F.size(c) > 0)).where(sound)
    sizes = rows.groupBy(F.size(c).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d = sizes[0].d if sizes else 0
    return rows.where(F.size(c) == d).select(*keep, F.transform(c, lambda v: F.floor(v.cast("double") * scale) + F.lit(offset).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """sum((n * x - sums)^2) of each row, exactly: by 64-bit numbers where none can overflow, else by Python's."""
    far = max(abs(n * int(x.max()) - int(sums.min())), abs(n * int(x.min()) - int(sums.max())), n * int(np.abs(x).max()), int(np.abs(sums).max()))
    if x.shape[1] * far * far < _LONG:
        d = n * x - sums
        return (d * d).sum(axis=1).tolist()
    # What no single bound excludes may still fit: differences from the mean are small beside n times the offset.
    if far < _LONG:
        d = n * x - sums
        most = int(np.abs(d).max())
        if x.shape[1] * most * most < _LONG:
            return (d * d).sum(axis=1).tolist()
    s = sums.tolist()
    return [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x.tolist()]


class Whitening:
    """n, sums, components (columns x components, already divided by the root of their variance), explained, identity_error."""

    def __init__(self, n: int, sums: np.ndarray, components: np.ndarray, explained: np.ndarray, identity_error: float):
        self.n, self.sums, self.components, self.explained, self.identity_error = n, sums, components, explained, identity_error

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ self.components


def _moments(fit: DataFrame, n: int, sums: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over the fit list: of deviations / n^2, of projections, and of their products; added up in Spark, task by task."""
    k = w.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 + k + k * k)
        for batch in slices(batches, 4096):
            x = _matrix(batch.column(0))
            y = (x - sums / n) @ w
            held += np.concatenate(([sum(d / n / n for d in _deviations(x, n, sums))], y.sum(axis=0), (y.T @ y).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held)), pa.int32()), pa.array(held)], ["i", "v"])

    rows = fit.select("x").mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(1 + k + k * k)
    for r in rows:
        out[r.i] = r.v
    return out


def learn(rows: DataFrame, scratch: Scratch, most: int = MOST) -> Whitening | None:
    """What whitens the rows of whole_vectors; None if there are none."""
    first = rows.select(F.size("x").alias("d")).limit(1).collect()
    if not first:
        return None
    d = first[0].d
    fit = scratch.write(rows.select("x").distinct(), "fit", **{f"s{i}": F.sum(F.col("x")[i]) for i in range(d)})
    n, sums = fit.said["n"], np.array([fit.said[f"s{i}"] for i in range(d)], np.int64)
    mean = F.array(*(F.lit(s / n) for s in sums.tolist()))
    centred = fit.select(array_to_vector(F.zip_with("x", mean, lambda a, m: a - m)).alias("v"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, d).computeSVD(min(most, d), computeU=False, rCond=LEAST) if n > 1 else None
    s = np.array(found.s.toArray()) if found else np.empty(0)
    v = np.array(found.V.toArray()).reshape(d, -1) if len(s) else np.zeros((d, 0))
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    variances = s * s / n
    w = v / np.sqrt(variances)
    sums_of = _moments(fit, n, sums, w)
    k = w.shape[1]
    middle = sums_of[1 : 1 + k] / n
    # Means of centred projections are nearly none, so that their product takes nothing from the digits of the rest.
    covariance = sums_of[1 + k :].reshape(k, k) / n - np.outer(middle, middle)
    error = float(np.abs(covariance - np.eye(k)).max()) if k else 0.0
    scratch.drop(fit)
    return Whitening(n, sums, w, variances / (sums_of[0] / n) if k else np.empty(0), error)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """A row for each row that takes part and each component: key and the columns of SCHEMA."""
    rows = whole_vectors(df, vector, key, scale=scale, offset=offset)
    model = learn(rows, Scratch(df.sparkSession, "whitening"), most)
    kind = dict(df.dtypes)[key]
    if model is None or not len(model.explained):
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, {SCHEMA}")
    k = len(model.explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            m = batch.num_rows
            x = _matrix(batch.column(1))
            deviations = [v if v < _LONG else None for v in _deviations(x, model.n, model.sums)]
            rep = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rep), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()), pa.array(deviations, pa.int64()).take(rep),
                    pa.array(model.project(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error)),
                ],
                [key, *(c.split()[0] for c in SCHEMA.split(", "))],
            )

    return rows.mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")
