"""Embedding whitening: eigenvectors of a distributed covariance, found in float32 and refined to double precision.

Vectors become whole numbers, so their sums and deviations are exact.  Each task adds up the centred products of
its part of the fit list; the sums of all parts are d x d numbers, which the driver turns into components.  A
float32 eigensolver gives the first vectors.  Iterations made of matrix products in higher precision (Ogita and
Aishima) correct them; eigenvalues too close to be told apart in an iteration are a cluster, whose small
eigenproblem is solved on its own, shifted by its mean, before the next iteration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioseek.session import staged

SCALE, SHIFT = 64, 1_000_000
#: Entries from here on do not fit a long with room to add.
_TOO_LARGE = float(1 << 61)


def whole_entries(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of every entry; null if the vector or an entry is null, not finite or beyond a long."""
    scaled = F.transform(vector, lambda c: c.cast("double") * SCALE)
    usable = F.forall(scaled, lambda c: F.coalesce(F.abs(c) < _TOO_LARGE, F.lit(False)))
    return F.when(usable, F.transform(scaled, lambda c: F.floor(c) + F.lit(SHIFT).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S as exact integers: 64 bits where all of them fit, else Python's own."""
    top = max(int(x.max()), -int(x.min())) if x.size else 0
    if 2 * n * max(top, 1) < 1 << 62 and max(map(abs, sums), default=0) < 1 << 61:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def deviations(num: np.ndarray) -> list[int | None]:
    """Exact sums of squares; null where a long cannot hold one."""
    d = num.shape[1]
    if num.dtype != object and (not num.size or int(np.abs(num).max()) ** 2 * d < 1 << 63):
        return (num * num).sum(axis=1).tolist()
    exact = (sum(int(v) ** 2 for v in row) for row in num)
    return [v if v < 1 << 63 else None for v in exact]


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows of the fit list and their exact sums by dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"), d)
                n += len(x)
                wide = len(x) * max(int(x.max()), -int(x.min())) >= 1 << 62
                total = [t + int(s) for t, s in zip(total, (x.astype(object) if wide else x).sum(axis=0))]
        if n:
            yield pa.record_batch({"dim": list(range(d)), "n": [n] * d, "s": [str(t) for t in total]}, pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("s", pa.string())]))

    found = fit.mapInArrow(part, "dim int, n long, s string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rows = sorted(found.collect())
    return (rows[0].n, [int(r.s) for r in rows]) if rows else (0, [0] * d)


def _second_moments(fit: DataFrame, d: int, n: int, sums: list[int], projection: np.ndarray | None = None) -> np.ndarray:
    """Means of products of the centred vectors, or of their projections less the projections' mean."""
    k = d if projection is None else projection.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((k + 1, k)), 0
        for b in batches:
            if b.num_rows:
                y = numerators(_matrix(b.column("x"), d), n, sums).astype(np.float64) / n
                y = y if projection is None else y @ projection
                total[:k] += y.T @ y
                total[k] += y.sum(axis=0)
                rows += len(y)
        if rows:
            i, j = np.triu_indices(k)
            i, j = np.concatenate([i, np.full(k, k)]), np.concatenate([j, np.arange(k)])
            yield pa.record_batch({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})

    cells = fit.mapInArrow(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((k + 1, k))
    for c in cells:
        out[c.i, c.j] = c.v
    full, mean = out[:k] / n, out[k] / n
    full = np.triu(full) + np.triu(full, 1).T
    return full - np.outer(mean, mean)


def _clusters(values: np.ndarray, close: float) -> list[np.ndarray]:
    """Groups of two or more places whose sorted values lie no further than ``close`` from the next one."""
    order = np.argsort(values)
    cuts = np.nonzero(np.diff(values[order]) > close)[0] + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def _orthonormal(q: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns, one step closer (quadratically)."""
    return q + q @ (np.eye(q.shape[1], dtype=q.dtype) - q.T @ q) / 2


def refine_eigenvectors(a: np.ndarray, x: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a symmetric matrix from approximate vectors, in extended precision.

    Each round corrects X by X E, E found from I - X'X and X'AX alone.  Where two eigenvalues are closer than the
    bound of what this round can tell apart, E only restores orthogonality, and the cluster's own matrix, shifted
    by its mean so that small gaps keep their digits, is solved and rotates its vectors.
    """
    wide = np.longdouble
    a, x = a.astype(wide), x.astype(wide)
    eye, tiny = np.eye(len(a), dtype=wide), np.finfo(wide).eps
    norm = np.abs(a).sum(axis=1).max()
    for _ in range(rounds):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        value = np.diag(s) / (1 - np.diag(r))
        close = 2 * (np.sqrt(((s - np.diag(value)) ** 2).sum()) + norm * np.sqrt((r**2).sum()))
        close = max(close, 4 * norm * np.sqrt(tiny))  # below this rounding alone would turn vectors
        gap = value[None, :] - value[:, None]
        near = np.abs(gap) <= close
        e = np.where(near, r / 2, (s + value[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ e
        turned = wide(0)
        for group in _clusters(value, close):
            q = _orthonormal(x[:, group])
            b = q.T @ (a @ q) - value[group].mean() * (q.T @ q)
            off = np.abs(b - np.diag(np.diag(b))).max()
            if off > tiny * norm:
                _, w = np.linalg.eigh((b / np.abs(b).max()).astype(np.float64))
                q = _orthonormal(q @ w.astype(wide))
                turned = max(turned, off / norm)
            x[:, group] = q
        if max(np.abs(e).max(), turned) < 16 * len(a) * tiny:
            break
    value = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    x = x / np.sqrt((x**2).sum(axis=0))
    order = np.argsort(-value, kind="stable")
    return value[order], x[:, order]


def principal_components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The up to ``k`` largest eigenvalues, falling, with unit vectors; only those that rounding cannot explain."""
    size = np.abs(cov).max() if cov.size else 0.0
    if not size > 0:
        return np.zeros(0), np.zeros((len(cov), 0))
    _, first = np.linalg.eigh((cov / size).astype(np.float32))
    value, vector = refine_eigenvectors(cov / size, first)
    keep = int((value[:k] > len(cov) * 2.0**-50 * value[0]).sum())
    return (value[:keep] * size).astype(np.float64), vector[:, :keep].astype(np.float64)


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """One row per usable row of ``vectors`` and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty, or holds null, non-finite or beyond-long entries, take no part.  Vectors
    must share one length: the most frequent one counts (the longer of two as frequent), others take no part.
    Repeated rows and null ids are whitened like any other, but weigh once in the fit.  Directions without variance
    have no component, so one distinct vector, like an empty table, gives no rows.  ``deviation`` is null where its
    exact value is beyond a long.  ``identity_error`` is measured over the fit list after projection.

    The driver holds d x d sums (d: the vectors' length), never vectors.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), whole_entries(F.col(vector_col)).alias("x")).filter("size(x) > 0")
    rows = staged(rows, "whole-vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths.d
    rows = rows.filter(F.size("x") == d)
    fit = staged(rows.select("x").distinct(), "fit-list")
    n, sums = _sums(fit, d)
    cov = _second_moments(fit, d, n, sums)
    value, vector = principal_components(cov, components)
    k = len(value)
    if not k:
        return spark.createDataFrame([], schema)
    projection = vector / np.sqrt(value)
    error = float(np.abs(_second_moments(fit, d, n, sums, projection) - np.eye(k)).max())
    explained = (value / np.trace(cov)).tolist()
    kind = rows.schema["vec_id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            num = numerators(_matrix(b.column("x"), d), n, sums)
            z = (num.astype(np.float64) / n) @ projection
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, dtype=np.int64)),
                    pa.array(deviations(num), pa.int64()).take(pa.array(each)),
                    pa.array(z.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema.replace("vec_id long", f"vec_id {kind}"))
