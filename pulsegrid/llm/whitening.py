"""Whitening of embeddings by exact integer statistics.

Entries become integers, so counts, sums and products are exact whatever the order of the
tasks.  The fit list (each distinct vector once) is written once; every task sums it into one
``d x d`` table whose entries, cut into limbs of 40 bits, are added by Spark.  One task per
vector length then holds the scatter matrix, ``n * sum(x x') - S S'``, as Python integers and
takes its components from the exact characteristic polynomial (``exact_spectrum``).

What reaches the driver is one model per vector length: 16 vectors of that length.  Lengths are
at most the longest vector, so it is bounded by that length and not by rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.exact_spectrum import leading_components
from pulsegrid.llm.phases import phase

COMPONENTS = 16
# x = floor(SCALE * c) + OFFSET; entries that leave 62 bits are held at the end.
SCALE, OFFSET, LARGEST = 64, 1_000_000, 1 << 62

LIMB, LIMBS = 40, 5
_LIMB_COLUMNS = [f"l{k}" for k in range(LIMBS)]
_SUMS = "dim int, i int, j int, " + ", ".join(f"{c} long" for c in _LIMB_COLUMNS)
_MODEL = "dim int, n string, sums array<string>, trace string, shares array<double>, vectors array<double>"
_MOMENTS = "dim int, i int, j int, value double"
_OUT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def integer_vectors(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, ``x - OFFSET`` as longs) of the usable vectors of each length from 1."""
    vectors = batch.column(column).cast(pa.large_list(pa.float64()))
    lengths = np.diff(vectors.offsets.to_numpy())
    starts = vectors.offsets.to_numpy()[:-1]
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    entries = vectors.values.to_numpy(zero_copy_only=False)  # null entries become nan
    for dim in np.unique(lengths[valid & (lengths > 0)]).tolist():
        rows = np.flatnonzero(valid & (lengths == dim))
        found = entries[starts[rows][:, None] + np.arange(dim)]
        whole = np.isfinite(found).all(axis=1)
        with np.errstate(over="ignore"):
            scaled = np.clip(np.floor(found[whole] * SCALE), -float(LARGEST), float(LARGEST))
        yield rows[whole], scaled.astype(np.int64)


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, y in integer_vectors(batch, "embedding"):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([lists], names=["y"])


def products(y: np.ndarray) -> np.ndarray:
    """``y' y`` as Python integers, exact."""
    if not len(y):
        return np.zeros((y.shape[1],) * 2, dtype=object)
    largest = max(int(y.max()), -int(y.min()), 1)
    rows = (1 << 53) // largest**2  # so many products add up exactly in doubles
    if not rows:
        wide = y.astype(object)
        return wide.T.dot(wide)
    total = np.zeros((y.shape[1],) * 2, dtype=object)
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    held: dict[int, list] = {}
    for batch in batches:
        lists = batch.column("y")
        lengths, starts, entries = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()[:-1], lists.values.to_numpy()
        for dim in np.unique(lengths).tolist():
            y = entries[starts[lengths == dim][:, None] + np.arange(dim)]
            part = [len(y), y.astype(object).sum(axis=0) if np.abs(y).max() > 1 << 40 else y.sum(axis=0).astype(object), products(y)]
            held[dim] = [a + b for a, b in zip(held[dim], part)] if dim in held else part
    for dim, (n, sums, square) in held.items():
        i, j = np.triu_indices(dim)
        values = [int(n), *map(int, sums), *(int(square[a, b]) for a, b in zip(i, j))]
        limbs = {c: [v >> LIMB * k if k == LIMBS - 1 else v >> LIMB * k & (1 << LIMB) - 1 for v in values] for k, c in enumerate(_LIMB_COLUMNS)}
        place = {"dim": dim, "i": [-1, *range(dim), *i.tolist()], "j": [-1, *[-1] * dim, *j.tolist()]}
        yield pa.RecordBatch.from_pandas(pd.DataFrame({**place, **limbs}), schema=_schema(), preserve_index=False)


def _schema() -> pa.Schema:
    return pa.schema([(c, pa.int32()) for c in ("dim", "i", "j")] + [(c, pa.int64()) for c in _LIMB_COLUMNS])


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    """The components of one vector length, from its count, sums and products."""
    dim = int(group["dim"].iloc[0])
    values = sum((group[c].astype(object) * (1 << LIMB * k) for k, c in enumerate(_LIMB_COLUMNS)), 0)
    held = dict(zip(zip(group["i"], group["j"]), values))
    n, sums = int(held[-1, -1]), [int(held[i, -1]) for i in range(dim)]
    matrix = [[n * int(held[min(i, j), max(i, j)]) - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    shares, vectors, _ = leading_components(matrix, COMPONENTS)
    return pd.DataFrame({
        "dim": [dim], "n": [str(n)], "sums": [[str(s) for s in sums]], "trace": [str(sum(matrix[i][i] for i in range(dim)))],
        "shares": [shares], "vectors": [vectors.ravel().tolist()],
    })


class Model:
    """Count, sums and components of the vectors of one length."""

    def __init__(self, dim: int, n: str, sums: list[str], trace: str, shares: list[float], vectors: list[float]):
        self.dim, self.n, self.sums, self.trace = dim, int(n), [int(s) for s in sums], int(trace)
        self.shares = np.array(shares, dtype=np.float64)
        self.vectors = np.array(vectors, dtype=np.float64).reshape(len(shares), dim)
        self.identity_error: float | None = None

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """``n * x - S`` of each entry, exact: longs where they all fit, else Python integers."""
        largest = max([int(np.abs(y).max()) * self.n if len(y) else 0, *map(abs, self.sums)])
        if largest < 1 << 61:
            return y * self.n - np.array(self.sums, dtype=np.int64)
        return y.astype(object) * self.n - np.array(self.sums, dtype=object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        """One column per component with variance."""
        root = np.array([math.sqrt(s) for s in self.shares]) * math.sqrt(self.trace) if len(self.shares) else self.shares
        return deviations.astype(np.float64) @ self.vectors.T / root


def squared_lengths(deviations: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; null where a long cannot hold them."""
    if deviations.dtype != object and (deviations.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < 2.0**61:
        return (deviations**2).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in deviations]
    return [v if v < 1 << 63 else None for v in exact]


def fit_list(embeddings: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Each distinct vector of integers (less the offset) once, as ``y``; rows with null or non-finite entries are left out."""
    return embeddings.select(F.col(vector_col).alias("embedding")).mapInArrow(_convert, "y array<long>").distinct()


def fit(distinct: DataFrame) -> list[Model]:
    """A model for each vector length of a fit list, with the error of its whitened covariance."""
    sums = distinct.mapInArrow(_sum, _SUMS).groupBy("dim", "i", "j").agg(*[F.sum(c).alias(c) for c in _LIMB_COLUMNS])
    models = {r["dim"]: Model(**r.asDict()) for r in sums.groupBy("dim").applyInPandas(_fit, _MODEL).collect()}
    if not models:
        return []

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column("y")
            lengths, starts, entries = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()[:-1], lists.values.to_numpy()
            for dim in np.unique(lengths).tolist():
                model = models[dim]
                w = model.whitened(model.deviations(entries[starts[lengths == dim][:, None] + np.arange(dim)]))
                w = np.concatenate((w, np.ones((len(w), 1))), axis=1)  # the last row of the products has the sums
                held[dim] = held.get(dim, 0) + w.T @ w
        for dim, total in held.items():
            i, j = np.indices(total.shape)
            columns = [pa.array(np.full(total.size, dim, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total.ravel())], names=["dim", "i", "j", "value"])

    # at most 17 x 17 numbers for each vector length
    added = distinct.mapInArrow(moments, _MOMENTS).groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).collect()
    totals = {dim: np.zeros((len(m.shares) + 1,) * 2) for dim, m in models.items()}
    for r in added:
        totals[r["dim"]][r["i"], r["j"]] = r["value"]
    for dim, m in models.items():
        k, total = len(m.shares), totals[dim]
        if k:
            mean = total[:k, k] / m.n
            m.identity_error = float(np.abs(total[:k, :k] / m.n - np.outer(mean, mean) - np.eye(k)).max())
    return list(models.values())


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row with a usable vector and leading component (up to 16, from 1): the whitened value and figures of the fit.

    Each entry c becomes x = floor(64 c) + 1000000.  The fit list has each distinct x vector once, n of
    them with sums S.  ``deviation``: sum of (n x - S)**2, exact (null where a long cannot hold it);
    ``whitened``: x - S / n on the unit eigenvector, over the square root of its eigenvalue;
    ``explained``: eigenvalue over the trace; ``identity_error``: largest absolute entry of the whitened
    fit list's covariance less the identity.

    Rows whose vector is null, empty or holds a null or non-finite entry are left out.  Vectors of
    another length have a fit of their own.  A component without variance has a null ``whitened``, and a
    null ``explained`` if nothing varies.  Equal eigenvalues share a space; their vectors are one basis of
    it.  Repeated rows and ids give rows each; a null id stays null; other columns are ignored; an empty
    table gives no rows.  Entries whose x leaves 62 bits are held there.
    """
    models = {m.dim: m for m in fit(phase(fit_list(embeddings, vector_col), "fit-list"))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, y in integer_vectors(batch, "embedding"):
                if not len(rows):
                    continue
                m = models[y.shape[1]]
                deviations, k, all_k = m.deviations(y), len(m.shares), min(COMPONENTS, m.dim)
                values = np.full((len(rows), all_k), np.nan)
                values[:, :k] = m.whitened(deviations)
                explained = [*m.shares.tolist(), *[0.0 if m.trace else None] * (all_k - k)]
                each, total = np.repeat(np.arange(len(rows)), all_k), len(rows) * all_k
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, all_k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(total, m.n)), pa.array(squared_lengths(deviations), pa.int64()).take(pa.array(each)),
                        pa.array(values.ravel(), from_pandas=True), pa.array(explained * len(rows), pa.float64()),
                        pa.array([m.identity_error] * total, pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    given = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    return given.mapInArrow(run, _OUT).withColumnRenamed("vec_id", id_col)
