"""Embedding whitening by TSQR: right singular vectors of the centred rows, no covariance formed.

An entry c counts as the whole number floor(256 * c).  The fit list holds each distinct row
once.  Its size n and its sums per dimension S are exact, so (n * x - S) / n centres a row with
one rounding.  Each partition folds its centred rows into one triangle, a block of rows at a
time; triangles are merged FAN at a time, level by level, each level a table of its own.  The
last triangle's singular values and right vectors are those of all rows.  The whitened
covariance is then measured over the fit list, not taken for granted.  The driver sees n, S and
the components asked for: what grows with the dimensions, not with the rows.

Left out are rows whose vector is null or empty, holds null, NaN or infinite entries, or entries
from 2^54 on (no long holds 256 of them), and vectors of another length than most distinct ones
(of two lengths as frequent, the longer stays).  A null vec_id and rows that repeat stay, one
result each.  A component without variance has null coordinates and no part in identity_error;
a deviation beyond a long is null.  An empty table gives an empty one.  Only `vec_id` and
`embedding` are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmark.llm.common import dropped, stored, table

SCALE, FAN, COMPONENTS = 256, 8, 4
#: Rows that enter a triangle at once.
AT_ONCE = 512
#: Sums of squares up to here are exact in 64 bits; up to the second they are summed as Python integers.
SURE, LARGEST = 9.2e18, 9.3e18
TRIANGLE = "part long, triangle binary"


@dataclass(frozen=True)
class Whitening:
    """n rows with sums per dimension, unit vectors as columns, their eigenvalues, the trace, the measured error."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def explained(self) -> list[float | None]:
        return [float(v / self.trace) if self.trace > 0 else None for v in self.values]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of whole rows; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, centred(x, self.n, self.sums) @ self.vectors / np.sqrt(self.values), np.nan)


def whole_rows(vectors: DataFrame) -> DataFrame:
    """vec_id and x of the rows that have whole entries."""
    sound = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, c -> c IS NOT NULL AND abs(CAST(c AS DOUBLE)) < 18014398509481984D)"
    return vectors.where(sound).select("vec_id", F.expr(f"transform(embedding, c -> floor({SCALE} * CAST(c AS DOUBLE)) + 0L)").alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    if max(int(np.abs(x).max(initial=0)), 1) * n + max(map(abs, sums)) < 2**62:
        return (n * x - np.array(sums, np.int64)) / n
    return x - np.array([s / n for s in sums])


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sums of (n * x - S)^2, exact; None beyond a long."""
    near = ((n * x.astype(np.float64) - np.array(sums, np.float64)) ** 2).sum(axis=1)
    sure = near < SURE
    out: list[int | None] = [None] * len(x)
    exact = ((n * x[sure] - np.array(sums, np.int64)) ** 2).sum(axis=1) if sure.any() else []
    for k, v in zip(np.flatnonzero(sure), exact, strict=True):
        out[k] = int(v)
    for k in np.flatnonzero(~sure & (near < LARGEST)):
        v = sum((n * int(c) - s) ** 2 for c, s in zip(x[k], sums, strict=True))
        out[k] = v if v < 2**63 else None
    return out


def _sums(size: int):
    """High and low halves apart: no sum of a task overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), size)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array([n] * size), pa.array(high), pa.array(low)], names=["at", "n", "high", "low"])

    return run


def _packed(r: np.ndarray, part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["part", "triangle"])


def _unpacked(column: pa.Array | pa.ChunkedArray, size: int) -> list[np.ndarray]:
    return [np.frombuffer(b, np.float64).reshape(-1, size) for b in column.to_pylist()]


def _triangle(n: int, sums: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            x = centred(_matrix(batch.column("x"), len(sums)), n, sums)
            for lo in range(0, len(x), AT_ONCE):
                rows = x[lo : lo + AT_ONCE]
                r = np.linalg.qr(rows if r is None else np.concatenate([r, rows]), mode="r")
        if r is not None:
            yield _packed(r, TaskContext.get().partitionId())

    return run


def _merge(size: int):
    def run(group: pa.Table) -> pa.Table:
        r = None
        for t in _unpacked(group.sort_by("part").column("triangle"), size):
            r = t if r is None else np.linalg.qr(np.concatenate([r, t]), mode="r")
        return pa.Table.from_batches([_packed(r, min(group.column("part").to_pylist()) // FAN)])

    return run


def _decompose(size: int, n: int, k: int):
    """The last triangle's right vectors; the largest entry of each is positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _unpacked(batch.column("triangle"), size):
                _, s, rows = np.linalg.svd(r, full_matrices=len(r) < size)
                s = np.concatenate([s, np.zeros(size - len(s))])
                rows = rows * np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])[:, None]
                noise = s[0] * max(n, size) * np.finfo(np.float64).eps
                values = np.where(s > noise, s**2 / n, 0.0)
                m = min(k, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.array(values[:m]), pa.array([(s**2).sum() / n] * m), pa.array(rows[:m].tolist(), pa.list_(pa.float64()))], names=["at", "value", "trace", "vector"])

    return run


def _moments(fitted: Whitening):
    """Sums of the coordinates and of their products, one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fitted.values)
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = np.nan_to_num(fitted.project(_matrix(batch.column("x"), len(fitted.sums))))
            w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
            total += w.T @ w
        a, b = np.divmod(np.arange((k + 1) ** 2), k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total.ravel())], names=["a", "b", "s"])

    return run


def _identity_error(fit: DataFrame, fitted: Whitening) -> float | None:
    k = len(fitted.values)
    m = np.zeros((k + 1, k + 1))
    for r in fit.mapInArrow(_moments(fitted), "a long, b long, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).collect():
        m[r["a"], r["b"]] = r["s"]
    mean = m[:k, k] / fitted.n
    live = np.flatnonzero(fitted.values > 0)
    gap = np.abs(m[:k, :k] / fitted.n - np.outer(mean, mean) - np.eye(k))[np.ix_(live, live)]
    return float(gap.max()) if gap.size else None


def fit_whitening(rows: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Fits on the distinct x of rows; None if there are none."""
    listed = stored(rows.select("x").distinct(), "whitening-fit")
    common = listed.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        dropped(listed)
        return None
    size = common["size"]
    fit = listed.where(F.size("x") == size)
    sums = [0] * size
    for r in fit.mapInArrow(_sums(size), "at long, n long, high long, low long").groupBy("at").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low"))).collect():
        n, sums[r["at"]] = r["n"], (int(r["high"]) << 32) + int(r["low"])
    triangles = stored(fit.mapInArrow(_triangle(n, tuple(sums)), TRIANGLE), "whitening-triangles")
    while triangles.count() > 1:
        merged = stored(triangles.groupBy(F.expr(f"part div {FAN}")).applyInArrow(_merge(size), TRIANGLE), "whitening-triangles")
        dropped(triangles)
        triangles = merged
    parts = sorted(triangles.mapInArrow(_decompose(size, n, k), "at long, value double, trace double, vector array<double>").collect())
    fitted = Whitening(n, tuple(sums), np.array([r["vector"] for r in parts]).T, np.array([r["value"] for r in parts]), parts[0]["trace"])
    error = _identity_error(fit, fitted)
    dropped(triangles, listed)
    return Whitening(n, tuple(sums), fitted.vectors, fitted.values, fitted.trace, error)


def _coordinates(fitted: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), len(fitted.sums))
            w = fitted.project(x)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviations(x, fitted.n, fitted.sums), pa.int64()), rows], names=["vec_id", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """(vec_id, deviation, whitened array) of each row that takes part, and what was fitted."""
    rows = whole_rows(vectors)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation long, whitened array<double>"
    fitted = fit_whitening(rows, k)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    return rows.where(F.size("x") == len(fitted.sums)).mapInArrow(_coordinates(fitted), schema), fitted


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, fitted = whiten(table(spark, sf_dir, "embeddings"))
    shares = F.array(*[F.lit(v).cast("double") for v in fitted.explained]) if fitted else F.array().cast("array<double>")
    out = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    number = lambda v, kind: F.lit(v).cast(kind)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), number(fitted and fitted.n, "long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), number(fitted and fitted.identity_error, "double").alias("identity_error"))
