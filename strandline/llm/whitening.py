"""Whitening of embeddings by principal components, refined from single to higher precision.

Vectors are put on a lattice of integers, so sums, deviations and, up to 2^53, products
are exact and no result depends on how rows are dealt to tasks. Tasks send sums and a
dimensions-by-dimensions matrix each; only their totals reach the driver, which finds the
eigenvectors there: in float32 first, then corrected by Ogita and Aishima's iteration,
whose work is matrix products in extended precision. Eigenvalues too close for it to tell
apart are a cluster, whose vectors are turned by an eigensolution of the cluster's own
shifted block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialise

#: Products of entries and pieces of sums stay within a long up to here.
SMALL, PIECE, PIECES = 1 << 20, 24, 4


def lattice(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale c) of each entry, as longs; null for a vector that is null or holds a null or non-finite entry."""
    as_double = lambda c: c.cast("double")
    bad = lambda c: c.isNull() | F.isnan(as_double(c)) | (F.abs(as_double(c)) == float("inf"))
    return F.when(~F.exists(vector, bad), F.transform(vector, lambda c: F.floor(F.lit(scale) * as_double(c))))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _sum_arrays(parts: DataFrame, column: str, kind: str, keys: tuple[str, ...] = ()) -> dict[tuple, float | int]:
    """Totals of arrays by position; as many as the arrays are long."""
    flat = parts.select(*keys, F.posexplode(column).alias("_at", "_v"))
    rows = flat.groupBy(*keys, "_at").agg(F.sum("_v").cast(kind).alias("_v")).collect()
    return {(*(r[k] for k in keys), r["_at"]): r["_v"] for r in rows}


def _integer_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    high = low = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"))
            high = (x >> 32).sum(axis=0) + (0 if high is None else high)
            low = (x & 0xFFFFFFFF).sum(axis=0) + (0 if low is None else low)
    if high is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v.tolist()], pa.list_(pa.int64())) for v in (high, low)], ["high", "low"])


def products(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of v v' over ``rows`` (x), where v is ``of`` x and has ``size`` entries: each task adds up its own, and Spark their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                v = of(_matrix(batch.column("x")))
                total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "v"])

    out = np.zeros((size, size))
    for (i, j), v in _sum_arrays(rows.mapInArrow(run, "i int, v array<double>"), "v", "double", ("i",)).items():
        out[i, j] = v
    return out


def refined_eigenvectors(matrix: np.ndarray, rounds: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of a symmetric matrix, from float32 vectors refined in extended precision.

    With R = I - X'X and S = X'AX, a round adds X E to X, where E_ij is (S_ij + l_j R_ij) /
    (l_j - l_i), or R_ij / 2 where the two eigenvalues are within the error bound of each
    other. Runs of such eigenvalues form clusters: the block X_J'(A - m I)X_J, with m their
    mean taken off in extended precision, is solved by itself and turns X_J. Errors square
    in each round. Equal eigenvalues get some orthonormal basis of their space. The largest
    entry of each vector is positive.
    """
    wide = np.longdouble
    size = float(np.abs(matrix).max()) if matrix.size else 0.0
    if not size:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    a = matrix.astype(wide) / wide(size)
    identity, tiny = np.eye(len(a), dtype=wide), 64 * len(a) * float(np.finfo(wide).eps)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(wide)
    norm = lambda m: float(np.linalg.norm(m.astype(float), 2))
    top = norm(a)
    for _ in range(rounds):
        r, s = identity - x.T @ x, x.T @ a @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        bound = 2 * (norm(s - np.diag(values)) + top * norm(r))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > bound
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        if float(np.abs(e).max()) <= tiny and float(np.abs(off).max()) <= tiny:
            break
        x = x + x @ e
        order = np.argsort(values)
        cuts = np.flatnonzero(np.diff(values[order]) > bound) + 1
        for cluster in np.split(order, cuts):
            if len(cluster) > 1:
                own = x[:, cluster]
                block = own.T @ (a @ own) - values[cluster].mean() * (own.T @ own)
                block = (block + block.T) / 2
                if largest := float(np.abs(block).max()):
                    x[:, cluster] = own @ np.linalg.eigh((block / wide(largest)).astype(float))[1].astype(wide)
    x = x + x @ (identity - x.T @ x) / 2
    values = np.diag(x.T @ a @ x) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    x = x * np.where(x[np.abs(x).argmax(axis=0), range(len(a))] < 0, -1, 1)
    return values[order] * wide(size), x


@dataclass
class Whitening:
    """What is fitted: rows of the fit list, sums by dimension, centre (whole numbers) and what is left of the mean, eigenvalues and vectors, trace."""

    n: int
    sums: list[int]
    centre: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened entries of lattice vectors."""
        return ((x - self.centre) - self.rest) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n x - S)^2 of each row."""
        squares = sum(s * s for s in self.sums)
        if len(self.sums) <= 1 << 13 and max(int(x.max()), -int(x.min())) <= SMALL and max(map(abs, self.sums)) < 1 << (PIECE * PIECES):
            mask = (1 << PIECE) - 1
            pieces = [np.array([s >> PIECE * p if p == PIECES - 1 else s >> PIECE * p & mask for s in self.sums], dtype=np.int64) for p in range(PIECES)]
            crossed = [(x @ p).tolist() for p in pieces]
            own = (x * x).sum(axis=1).tolist()
            return [self.n * self.n * q - 2 * self.n * sum(d << PIECE * p for p, d in enumerate(dots)) + squares for q, *dots in zip(own, *crossed, strict=True)]
        whole = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return (whole * whole).sum(axis=1).tolist()


def fit(vectors: DataFrame, components: int) -> Whitening | None:
    """Fit to the distinct lattice vectors ``vectors`` (x, all of one length); None without any.

    Components whose eigenvalue is zero to rounding can't be whitened and are left out.
    """
    n = vectors.count()
    if not n:
        return None
    parts = vectors.mapInArrow(_integer_sums, "high array<long>, low array<long>")
    high, low = (_sum_arrays(parts, c, "decimal(38,0)") for c in ("high", "low"))
    sums = [(int(high[(i,)]) << 32) + int(low[(i,)]) for i in range(len(high))]
    d = len(sums)
    whole = [(2 * s + n) // (2 * n) for s in sums]  # the whole number next to the mean
    centre = np.array(whole, dtype=np.int64)
    rest = np.array([(s - n * c) / n for s, c in zip(sums, whole, strict=True)])
    wide = np.longdouble
    exact = products(vectors, lambda x: (x - centre).astype(float), d).astype(wide) / n
    covariance = exact - np.outer(rest.astype(wide), rest.astype(wide))
    values, x = refined_eigenvectors(covariance)
    kept = [i for i in range(min(components, d)) if values[i] > 0 and values[i] > values[0] * d * np.finfo(float).eps]
    return Whitening(n, sums, centre, rest, values[kept].astype(float), x[:, kept].astype(float), float(np.trace(covariance)))


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 4, scale: float = 256.0) -> DataFrame:
    """id, n, deviation (decimal, null beyond 38 digits), whitened, explained (arrays by component), identity_error for each usable row.

    Vectors that are null, empty or hold null or non-finite entries are dropped, as are those
    of another length than the commonest among distinct vectors (of equally common ones the
    largest). Entries become floor(scale c), kept within longs. Every distinct vector counts
    once in the fit; rows that repeat one, or an id, all get results, and so do rows without
    an id. Where all vectors are equal there is no component and the arrays are empty. An
    empty table gives no rows. More columns are not read.
    """
    usable = rows.select(F.col(f"`{id_column}`").alias("id"), lattice(F.col(f"`{vector_column}`"), scale).alias("x")).where("size(x) > 0")
    distinct = materialise(usable.select("x").distinct(), "whitening-fit")
    length = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", "d"))).first()[0] or 0
    fitted = fit(distinct.where(F.size("x") == length), components)
    schema = f"id {rows.schema[id_column].dataType.simpleString()}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema)
    k = len(fitted.values)
    spread = products(distinct.where(F.size("x") == length), fitted.project, k) / fitted.n if k else np.zeros((0, 0))
    error = float(np.abs(spread - np.eye(k)).max()) if k else 0.0
    explained = (fitted.values / fitted.trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(np.ascontiguousarray(fitted.project(x)).reshape(-1), pa.float64()))
            deviation = pa.array([Decimal(v) if v < 10**38 else None for v in fitted.deviations(x)], pa.decimal128(38, 0))
            shared = lambda v, kind: pa.array([v] * len(x), kind)
            yield pa.RecordBatch.from_arrays([batch.column("id"), shared(fitted.n, pa.int64()), deviation, whitened, shared(explained, pa.list_(pa.float64())), shared(error, pa.float64())], ["id", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.where(F.size("x") == length).mapInArrow(run, schema)
